"""References in the older Markdown, which has no block of JSON: a table function reads a file's lines by five grammars.

* facts ``- **Name**: value`` (Patient Information, Demographics);
* entries ``- **name** | key: value | …`` (Symptoms, Diagnoses, both lists of medications);
* codes ``- **code** (seq: n): description``, and prescriptions ``- drug dose``, under their headings of Structured Clinical Data;
* treatments: a heading ``### name`` with ``**Details**``, ``**Treatment**`` and a medication a line;
* running text (Chief Complaint, Medical History) and lists between commas (Allergies).

``lines_of`` gives a row a line that says something, and a line that fits no grammar as a reject with the reason, so nothing is
lost unseen. ``references`` puts a file's rows together with grouped collections. A file that has the newer block is not
read here: see ``sinks.read_markdown``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.session import ship

# Sections, the grammar of their lines, and the fields that entries may have.
SECTIONS = {
    "Patient Information": "fact", "Demographics": "fact", "Chief Complaint": "text", "Symptoms": "entry", "Medical History": "text", "Allergies": "list",
    "Current Medications": "entry", "Discharge Medications": "entry", "Diagnoses": "entry", "Treatment Options": "treatment", "Structured Clinical Data": "coded",
}
FIELDS = {"Symptoms": ("onset", "duration", "severity"), "Diagnoses": ("notes",), "Current Medications": ("dosage", "frequency", "purpose"), "Discharge Medications": ("dosage", "frequency", "purpose")}
NUMBERS = ("Subject ID", "Admission ID", "Row ID", "Age")
CODED = {"ICD-9 Diagnoses": "code", "ICD-9 Procedures": "code", "Prescriptions": "prescription"}
NOT_PROVIDED = "not provided"

_FACT = re.compile(r"[-*]?\s*\*\*(?P<name>[^*:]+)\*\*:\s*(?P<value>.*)")
_CODE = re.compile(r"\*\*(?P<name>.+?)\*\*(?:\s*\(seq:\s*(?P<seq>\d+)\))?\s*:\s*(?P<description>.+)")
_BOLD = re.compile(r"\*\*(.+?)\*\*")

ROW = "line int, section string, part string, kind string, name string, fields map<string, string>, defect string"


class LegacyLines:
    """The table function: a text in, a row a line out."""

    def eval(self, text: str) -> Iterator[tuple]:
        section = part = None
        for number, raw in enumerate((text or "").split("\n"), 1):
            line = raw.strip()
            if line.startswith("## "):
                section, part = line[3:].strip(), None
            elif line.startswith("### "):
                part = line[4:].strip()
                if section == "Treatment Options":
                    yield number, section, part, "treatment", part, {}, None
            elif line and not line.startswith("# "):
                kind, name, fields, defect = _read(section, part, line)
                yield number, section, part, kind, name, fields, defect


def _read(section: str | None, part: str | None, line: str) -> tuple[str, str | None, dict[str, str], str | None]:
    """(kind, name, fields, defect) of a line; a reject's name is the line."""
    grammar, item = SECTIONS.get(section or ""), line[2:].strip() if line.startswith("- ") else None
    if grammar is None:
        return "reject", line, {}, "no such section" if section else "before any section"
    if grammar == "fact":
        found = _FACT.fullmatch(line)
        if not found:
            return "reject", line, {}, "not a fact"
        name, value = found["name"].strip(), found["value"].strip()
        if name in NUMBERS and not re.fullmatch(r"[+-]?\d+", value):
            return "reject", line, {}, f"{name} is not a whole number"
        return "fact", name, {"value": value}, None
    if grammar == "text":
        return ("reject", line, {}, "a list in running text") if line.startswith("-") else ("text", line, {}, None)
    if grammar == "list":
        return ("reject", line, {}, "not a list between commas") if line.startswith("-") else ("list", line, {}, None)
    if grammar == "treatment":
        found = _FACT.fullmatch(line)
        if part is None:
            return "reject", line, {}, "before any treatment"
        if found and found["name"].strip() in ("Details", "Treatment"):
            return "detail", found["name"].strip().lower(), {"value": found["value"].strip()}, None
        return ("medication", item, {}, None) if item else ("reject", line, {}, "not part of a treatment")
    if item is None:
        return "reject", line, {}, "not an item"
    if grammar == "entry":
        return _entry(section, item)
    kind = CODED.get(part or "")
    if kind == "code":
        found = _CODE.fullmatch(item)
        if not found:
            return "reject", line, {}, "not a code"
        return "code", found["name"].strip(), {"description": found["description"].strip()} | ({"seq": found["seq"]} if found["seq"] else {}), None
    if kind == "prescription":
        drug, *dose = item.split(maxsplit=1)
        return "prescription", drug, {"dose": dose[0] if dose else ""}, None
    return "reject", line, {}, "under no known heading"


def _entry(section: str, item: str) -> tuple[str, str | None, dict[str, str], str | None]:
    head, *rest = [p.strip() for p in item.split("|")]
    bold = _BOLD.match(head)
    name, fields, odd = bold[1] if bold else head.strip("*").strip(), {}, []
    for piece in rest:
        key, sep, value = piece.partition(":")
        if sep and key.strip().lower() in FIELDS[section]:
            fields[key.strip().lower()] = value.strip()
        else:
            odd.append(piece)
    if not name:
        return "reject", item, {}, "an entry without a name"
    return "entry", name, fields, f"not read: {' | '.join(odd)}" if odd else None


def lines_of(spark: SparkSession, texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line, section, part, kind, name, fields, defect) of every file's lines."""
    ship(spark)
    table = F.udtf(LegacyLines, returnType=ROW)
    return texts.select(file, text).lateralJoin(table(F.col(text).outer())).drop(text)


def _items(kind: str, section: str | None, item: Column) -> Column:
    wanted = F.col("kind") == kind
    if section:
        wanted = wanted & (F.col("section") == section)
    return F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("line", item.alias("item"))))), lambda x: x["item"])


def references(lines: DataFrame, file: str = "file") -> DataFrame:
    """A row a file: facts by name, texts, lists and entries in the order of the file, and how many lines were rejected or not wholly read."""
    rows = lines.withColumn("_held", F.when(F.col("kind") == "treatment", F.col("line"))).withColumn("_at", F.when(F.col("section") == "Treatment Options", F.col("part")))

    def entry(section: str) -> Column:
        fields = [F.coalesce(F.col("fields")[f], F.lit(NOT_PROVIDED)).alias(f) for f in FIELDS[section]]
        return _items("entry", section, F.struct(F.col("name").alias("name"), *fields))

    def words(section: str) -> Column:
        return F.array_join(_items("text", section, F.col("name")), " ")

    def coded(part: str, *fields: Column) -> Column:
        return _items(CODED[part], "Structured Clinical Data", F.when(F.col("part") == part, F.struct(*fields)))

    code = (F.col("name").alias("code"), F.col("fields")["seq"].cast("int").alias("seq"), F.col("fields")["description"].alias("description"))
    made = rows.groupBy(file).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("kind") == "fact", F.struct("name", F.col("fields")["value"].alias("value")))))).alias("facts"),
        words("Chief Complaint").alias("chief_complaint"), words("Medical History").alias("medical_history"),
        F.filter(F.transform(F.split(F.element_at(F.concat(_items("list", "Allergies", F.col("name")), F.array(F.lit(""))), 1), ","), lambda x: F.trim(x)), lambda x: x != "").alias("allergies"),
        *[entry(s).alias(s.lower().replace(" ", "_")) for s in FIELDS],
        _items("treatment", None, F.col("name")).alias("procedures"),
        _items("detail", None, F.struct(F.col("part").alias("procedure"), F.col("name").alias("what"), F.col("fields")["value"].alias("value"))).alias("details"),
        _items("medication", None, F.struct(F.col("part").alias("procedure"), F.col("name").alias("name"))).alias("given"),
        *[F.array_compact(coded(p, *code)).alias(n) for p, n in (("ICD-9 Diagnoses", "icd_diagnoses"), ("ICD-9 Procedures", "icd_procedures"))],
        _items("prescription", "Structured Clinical Data", F.struct(F.col("name").alias("drug"), F.col("fields")["dose"].alias("dose"))).alias("prescriptions"),
        F.count_if(F.col("kind") == "reject").alias("rejected"), F.count_if((F.col("kind") != "reject") & F.col("defect").isNotNull()).alias("partly"),
    )
    return made


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """The references of a folder's Markdown files, each read whole; files without a line have no row."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return references(lines_of(spark, files))
