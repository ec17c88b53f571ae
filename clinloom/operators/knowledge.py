"""Knowledge policies: schema paths, allow-list projections over nested columns, evidence audit.

A path is dotted, with ``[]`` after a list field. Paths come from the schema itself, so a
new field is invisible to every policy until it is listed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.functions import text as tx


@dataclass(frozen=True)
class Policy:
    """What each role may see, and where terms of the diagnosis are redacted."""

    policy_id: str
    version: str
    patient_visible: frozenset[str]
    doctor_visible: frozenset[str]
    redact_in: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        if loose := [p for p in self.redact_in if not permitted(p, self.patient_visible)]:
            raise ValueError(f"redacted but not visible: {sorted(loose)}")

    def visible(self, role: str) -> frozenset[str]:
        return {"Patient": self.patient_visible, "Doctor": self.doctor_visible}[role]


def paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """All addressable paths of a schema, parents before children."""
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, prefix + "[]") if isinstance(schema.elementType, T.StructType) else []
    out: list[str] = []
    if isinstance(schema, T.StructType):
        for field in schema.fields:
            own = f"{prefix}.{field.name}" if prefix else field.name
            out += [own, *paths(field.dataType, own)]
    return out


def permitted(path: str, allowed: Iterable[str]) -> bool:
    """Whether a path is allowed or lies inside what is."""
    return any(path == a or path.startswith((a + ".", a + "[")) for a in allowed)


def surface(schema: T.StructType) -> list[str]:
    """What every policy must decide about: the fields one level below the schema's sections, and fields that are no sections."""
    out: list[str] = []
    for field in schema.fields:
        inner = field.dataType
        out += [f"{field.name}.{f.name}" for f in inner.fields] if isinstance(inner, T.StructType) else [field.name]
    return out


def policy_issues(policy: Policy, masked: Iterable[str], schema: T.StructType) -> list[str]:
    """Why a policy can't be used on a schema: unknown paths, paths both visible and masked, fields that it doesn't decide about."""
    masked, known = set(masked), set(paths(schema))
    declared = policy.patient_visible | policy.doctor_visible | policy.redact_in | masked
    issues = [f"unknown path {p}" for p in sorted(declared - known)]
    issues += [f"both visible and masked: {p}" for p in sorted(policy.patient_visible & masked)]
    return issues + [f"not classified: {s}" for s in surface(schema) if not any(permitted(p, [s]) for p in policy.patient_visible | masked)]


def leakable(schema: T.DataType, allowed: Iterable[str]) -> list[str]:
    """Paths a role could leak: neither permitted nor mere containers of what is."""
    allowed = list(allowed)
    inner = lambda p: any(a.startswith((p + ".", p + "[")) for a in allowed)
    return [p for p in paths(schema) if not permitted(p, allowed) and not inner(p)]


def _project(value: Column, kind: T.DataType, path: str, allowed: frozenset[str], redact) -> Column | None:
    whole = permitted(path, allowed) if path else False
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        if not whole and not any(a.startswith(path + "[]") for a in allowed):
            return None
        return F.transform(value, lambda x: _project(x, kind.elementType, path + "[]", allowed, redact))
    if isinstance(kind, T.StructType):
        made = []
        for f in kind.fields:
            got = _project(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, allowed, redact)
            if got is not None:
                made.append(got.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*made)) if made else None
    return redact(value, kind, path) if whole else None


def mask(df: DataFrame, column: str, policy: Policy, role: str, terms: Iterable[str] = (), name: str = "view", unicode: bool = True) -> DataFrame:
    """``df`` with the role's view of a struct column: one projection, hidden fields never read."""
    pattern = tx.word_pattern(terms, unicode)

    def redact(value: Column, kind: T.DataType, path: str) -> Column:
        hit = pattern and permitted(path.replace("[]", ""), {p.replace("[]", "") for p in policy.redact_in})
        if not hit:
            return value
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: F.regexp_replace(x, pattern, "[REDACTED]"))
        return F.regexp_replace(value, pattern, "[REDACTED]") if isinstance(kind, T.StringType) else value

    kind = df.schema[column].dataType
    view = _project(F.col(column), kind, "", policy.visible(role), redact)
    return df.withColumn(name, F.struct() if view is None else view)


def without(value: Column, kind: T.DataType, name: str) -> Column:
    """A value with every field of a name removed, at any depth."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: without(x, kind.elementType, name))
    if isinstance(kind, T.StructType):
        return F.struct(*[without(value[f.name], f.dataType, name).alias(f.name) for f in kind.fields if f.name != name])
    return value


# Words that are no diagnosis term by themselves.
STOP_WORDS = ("a", "an", "and", "by", "due", "for", "in", "of", "on", "or", "secondary", "the", "to", "with", "without")


def diagnosis_terms(phrase: Column) -> Column:
    """Surface forms of a diagnosis: its phrases of four characters or more, and their acronyms."""
    parts = F.filter(F.transform(F.split(phrase, r"[,;:/()]+"), lambda p: F.regexp_replace(p, r"^[ .\t\n]+|[ .\t\n]+$", "")), lambda p: p != "")
    long = F.filter(parts, lambda p: (F.length(p) >= 4) & ~F.lower(p).isin(*STOP_WORDS))

    def acronym(p: Column) -> Column:
        words = F.filter(F.regexp_extract_all(p, F.lit(r"[A-Za-z]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*STOP_WORDS))
        return F.when(F.size(words) >= 2, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))

    return F.array_distinct(F.concat(long, F.array_compact(F.transform(parts, acronym))))


def span_error(note: Column, start: Column, end: Column, quoted: Column) -> Column:
    """Why an evidence span doesn't hold; null if the note has the quoted text there."""
    bad = (start < 0) | (end <= start) | (end > F.length(note))
    return F.when(note.isNull(), "missing note").when(bad, "offsets out of range").when(F.substr(note, start + 1, end - start) != quoted, "text differs")


def locate(note: Column, quoted: Column) -> Column:
    """The 0-based place of a quotation; white space may differ. Null if it isn't there. See ``quotes`` for many of a note."""
    exact = F.instr(note, quoted)
    plain = F.regexp_replace(quoted, r"([\\\[\](){}.*+?^$|#&~-])", r"\\$1")
    flexible = F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), r"\s+")
    found = F.regexp_instr(note, flexible)
    return F.when(exact > 0, exact - 1).when((flexible != "") & (found > 0), found - 1)


def contexts(df: DataFrame, column: str, policy: Policy, terms: Iterable[str] = (), unicode: bool = True) -> DataFrame:
    """``df`` with the three views of a reference, made together: ``patient``, ``doctor`` and ``evaluator``.

    ``redactions`` counts the terms that were replaced in the patient's view; ``policy`` names
    the policy's id and version. The evaluator sees everything.
    """
    from clinloom.operators.paths import hits

    terms = tuple(terms)
    both = mask(mask(df, column, policy, "Patient", terms, "patient", unicode), column, policy, "Doctor", (), "doctor", unicode)
    plain = mask(df, column, policy, "Patient", (), "patient", unicode).schema["patient"].dataType
    pattern, flat = tx.word_pattern(terms, unicode), {p.replace("[]", "") for p in policy.redact_in}
    # Counted where the terms are: on what the patient would see of the reference itself, not as marks in the result.
    seen = [p for p in paths(plain) if p.replace("[]", "") in flat]
    count = F.lit(0).cast("long")
    for p in seen if pattern else ():
        count = count + hits(F.col(column), df.schema[column].dataType, p, pattern)
    return both.withColumn("redactions", count).withColumn("evaluator", F.col(column)).withColumn("policy", F.lit(f"{policy.policy_id}@{policy.version}"))


# Where a reference's entities stand, and that each may have an array of evidence spans.
ENTITIES = ("core.symptoms", "core.diagnoses", "core.treatments", "context.current_medications", "context.discharge_medications")


def _item(group: str, spans):
    return lambda x, i: F.struct(F.concat(F.lit(f"{group}["), i.cast("string"), F.lit("]")).alias("path"), spans(x).alias("evidence"))


def evidenced(df: DataFrame, case: str, column: str) -> DataFrame:
    """(case, path, evidence) of every entity of the references, those of treatments' medications included.

    Groups that the schema doesn't have are passed over; an entity without evidence has an empty array.
    """
    have = set(paths(df.schema[column].dataType))
    empty = F.array().cast("array<struct<note_id: string, char_start: int, char_end: int, text: string>>")
    spans = lambda x: F.coalesce(x["evidence"].cast("array<struct<note_id: string, char_start: int, char_end: int, text: string>>"), empty)
    found = []
    for group in ENTITIES:
        if f"{group}[].evidence" in have:
            items = F.transform(F.col(f"{column}.{group}"), _item(group, spans))
            found.append(F.coalesce(items, F.array()))
    if "core.treatments[].medications[].evidence" in have:
        inner = lambda t, i: F.transform(t["medications"], lambda m, j: F.struct(F.concat(F.lit("core.treatments["), i.cast("string"), F.lit("].medications["), j.cast("string"), F.lit("]")).alias("path"), spans(m).alias("evidence")))
        found.append(F.coalesce(F.flatten(F.transform(F.col(f"{column}.core.treatments"), inner)), F.array()))
    return df.select(case, F.explode(F.concat(*found)).alias("_e")).select(case, "_e.path", "_e.evidence")


def evidence_issues(entities: DataFrame, notes: DataFrame, case: str) -> DataFrame:
    """(case, path, issue) of every span that doesn't hold; ``notes`` has (case, note_id, note)."""
    spans = entities.select(case, "path", F.posexplode("evidence").alias("_i", "_s"))
    named = spans.select(case, F.concat("path", F.lit(".evidence["), F.col("_i").cast("string"), F.lit("]")).alias("path"), F.col("_s.note_id").alias("note_id"), "_s")
    joined = named.join(notes.select(case, "note_id", "note", F.lit(True).alias("_there")), [case, "note_id"], "left")
    issue = F.when(F.col("_there").isNull(), F.concat(F.lit("unknown note "), F.coalesce("note_id", F.lit("null")))).otherwise(span_error(F.col("note"), F.col("_s.char_start"), F.col("_s.char_end"), F.col("_s.text")))
    return joined.select(case, "path", issue.alias("issue")).where("issue is not null")


def unevidenced(entities: DataFrame, notes: DataFrame, case: str) -> DataFrame:
    """(case, path) of entities without a span that holds: reported, not raised, as recall is measured."""
    bad = evidence_issues(entities, notes, case).select(case, F.regexp_replace("path", r"\.evidence\[\d+\]$", "").alias("path"))
    counts = bad.groupBy(case, "path").agg(F.count(F.lit(1)).alias("_bad"))
    joined = entities.join(counts, [case, "path"], "left")
    return joined.where(F.size("evidence") <= F.coalesce("_bad", F.lit(0))).select(case, "path")


def reference_totals(df: DataFrame, case: str, column: str, notes: DataFrame) -> DataFrame:
    """One row: references, those whose core names nothing, entities by kind, and how many no sound span of a note supports."""
    kind = df.schema[column].dataType
    core = [F.coalesce(F.size(F.col(f"{column}.core.{f.name}")), F.lit(0)) for f in kind["core"].dataType.fields if isinstance(f.dataType, T.ArrayType)]
    empty = df.agg(F.count(F.lit(1)).alias("references"), F.count_if(sum(core[1:], F.greatest(core[0], F.lit(0))) <= 0).alias("empty_cores"))
    entities = evidenced(df, case, column)
    named = entities.agg(F.count(F.lit(1)).alias("entities"), *[F.count_if(F.startswith("path", F.lit(f"{g}["))).alias(g.rsplit(".", 1)[1]) for g in ENTITIES])
    bad = unevidenced(entities, notes, case).agg(F.count(F.lit(1)).alias("unevidenced"))
    # Three rows of one line each.
    return empty.crossJoin(named).crossJoin(bad).withColumn("unevidenced_share", F.try_divide("unevidenced", "entities"))
