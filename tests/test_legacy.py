"""The older Markdown: round trips of made references, damaged lines, and files from a folder."""

import random

from clinloom.sources import legacy


def made(deal):
    """A reference, and the text that says it."""
    word = lambda: deal.choice(["ache", "mild pain", "five days", "a: b", "é日", "x*y"])
    ref = {"facts": {"Subject ID": str(deal.randint(1, 99)), "Age": str(deal.randint(1, 99)), "Sex": "F", "Insurance": word()}, "chief_complaint": " ".join(word() for _ in range(2)), "medical_history": "", "allergies": [word() for _ in range(deal.randint(0, 3))]}
    lines = ["# Title", "", "## Patient Information", "", f"- **Subject ID**: {ref['facts']['Subject ID']}", "## Demographics"] + [f"- **{k}**: {v}" for k, v in ref["facts"].items() if k != "Subject ID"]
    lines += ["## Chief Complaint", *ref["chief_complaint"].split("  "), "", "## Allergies", ", ".join(ref["allergies"]), ""]
    for section, fields in legacy.FIELDS.items():
        own = [{"name": deal.choice(["one", "two words", "tri-ple"]), **{f: word() if deal.random() < 0.6 else legacy.NOT_PROVIDED for f in fields}} for _ in range(deal.randint(0, 3))]
        ref[section.lower().replace(" ", "_")] = own
        lines += [f"## {section}"] + [" | ".join([f"- **{e['name']}**", *(f"{f.title()}: {e[f]}" for f in fields if e[f] != legacy.NOT_PROVIDED)]) for e in own]
    ref["procedures"], ref["details"], ref["given"] = ["graft", "rest"], [("graft", "details", "x: y"), ("graft", "treatment", "slow")], [("rest", "Aspirin 5 mg")]
    lines += ["## Treatment Options", "### graft", "- **Details**: x: y", "**Treatment**: slow", "### rest", "- Aspirin 5 mg"]
    ref["icd_diagnoses"], ref["icd_procedures"], ref["prescriptions"] = [("428.0", 1, "Failure: heart"), ("V12", None, "Other")], [("96.71", 2, "Vent")], [("Keflex", "500 mg"), ("Water", "")]
    lines += ["## Structured Clinical Data", "### ICD-9 Diagnoses", "- **428.0** (seq: 1): Failure: heart", "- **V12**: Other", "### ICD-9 Procedures", "- **96.71** (seq:2) : Vent", "### Prescriptions", "- Keflex 500 mg", "- Water"]
    return ref, lines


def plain(row):
    d = row.asDict(True)
    for c in ("details", "given", "icd_diagnoses", "icd_procedures", "prescriptions"):
        d[c] = [tuple(x.values()) for x in d[c]]
    return d


def test_round_trip(spark):
    deal = random.Random(5)
    refs = [made(deal) for _ in range(15)]
    df = spark.createDataFrame([(str(i), "\n".join(lines)) for i, (_, lines) in enumerate(refs)], "file string, text string").repartition(3)
    got = {int(r["file"]): plain(r) for r in legacy.references(legacy.lines_of(spark, df)).collect()}
    for i, (ref, _) in enumerate(refs):
        assert {k: got[i][k] for k in ref} == ref
        assert got[i]["rejected"] == got[i]["partly"] == 0


DAMAGED = [
    ("lost", "before any section"), ("## Patient Information", None), ("- **Subject ID**: abc", "Subject ID is not a whole number"), ("- no fact", "not a fact"), ("## Symptoms", None), ("**pain** | onset: x", "not an item"), ("- **pain** | onst: now | severity: 2", "not read: onst: now"),
    ("- | onset: x", "an entry without a name"), ("## Allergies", None), ("- nuts", "not a list between commas"), ("## Treatment Options", None), ("- early", "before any treatment"), ("### t", None), ("prose", "not part of a treatment"), ("## Structured Clinical Data", None), ("- x", "under no known heading"),
    ("### ICD-9 Diagnoses", None), ("- 428.0: none", "not a code"), ("## Unheard Of", None), ("- anything", "no such section"), ("## Chief Complaint", None), ("- dash", "a list in running text"), ("fever", None),
]


def test_damaged_lines_are_rejected_by_name(spark):
    df = spark.createDataFrame([("a", "\r\n".join(x for x, _ in DAMAGED)), ("b", ""), ("c", None), ("d", "# only a title\n\n")], "file string, text string")
    lines = legacy.lines_of(spark, df)
    found = {r["line"]: r["defect"] for r in lines.where("file = 'a' and defect is not null").collect()}
    assert found == {k + 1: d for k, (_, d) in enumerate(DAMAGED) if d}
    (ref,) = legacy.references(lines).collect()
    assert (ref["file"], ref["rejected"], ref["partly"], ref["chief_complaint"]) == ("a", len(found) - 1, 1, "fever") and ref["symptoms"][0]["severity"] == "2"


def test_folder(spark, tmp_path):
    ref, lines = made(random.Random(1))
    (tmp_path / "one.md").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "two.md").write_text("## Chief Complaint\nNone.", encoding="utf-8")
    got = {r["file"].rsplit("/", 1)[-1]: plain(r) for r in legacy.read_legacy(spark, str(tmp_path)).collect()}
    assert {k: got["one.md"][k] for k in ref} == ref and got["two.md"]["chief_complaint"] == "None."
