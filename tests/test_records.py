"""Paths into nested columns, quotations and responses, against plain versions over Python values."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from clinloom.functions import responses
from clinloom.operators import knowledge, paths, quotes

SCHEMA = "id long, r struct<core: struct<items: array<struct<name: string, tags: array<string>, more: array<struct<x: string, y: int>>>>, note: string>, solo: struct<only: string>, n: int>"


def made(seed=1, n=40):
    deal = random.Random(seed)
    word = lambda: deal.choice([None, "", "red ring", "Blue", "ring RED ring", "[REDACTED] red", "rings"])
    some = lambda f: None if deal.random() < 0.15 else [f() for _ in range(deal.randint(0, 3))]
    more = lambda: None if deal.random() < 0.1 else {"x": word(), "y": deal.choice([None, 1, 2])}
    item = lambda: None if deal.random() < 0.1 else {"name": word(), "tags": some(word), "more": some(more)}
    core = lambda: None if deal.random() < 0.1 else {"items": some(item), "note": word()}
    return [(i, None if i == 0 else {"core": core(), "solo": {"only": word()}, "n": deal.choice([None, 5])}) for i in range(n)]


def plain_found(value, path):
    now = [value]
    parts = path.split(".")
    for k, part in enumerate(parts):
        name, following = part.removesuffix("[]"), []
        for v in now:
            if v is None or v[name] is None:
                continue
            following += [x for x in v[name] if x is not None] if part.endswith("[]") and k < len(parts) - 1 else [v[name]]
        now = following
    return now


def strings(value):
    if isinstance(value, str):
        yield value
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from strings(x)


def dropped(value, parts):
    if isinstance(value, list):
        return [dropped(v, parts) for v in value]
    if value is None:
        return None
    name = parts[0].removesuffix("[]")
    if len(parts) == 1:
        return {k: v for k, v in value.items() if k != name}
    return {k: dropped(v, parts[1:]) if k == name else v for k, v in value.items()}


PATHS = ("core.items[].name", "core.items[].tags", "core.items[].more[].x", "core.items[].more", "core.note", "core.items", "core", "n", "solo.only", "core.items[].more[].y")


def test_paths_against_plain(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    kind = df.schema["r"].dataType
    assert set(PATHS) <= set(knowledge.paths(kind))
    got = {x["id"]: x.asDict(True) for x in df.select("id", *[paths.found(F.col("r"), kind, p).alias(p.replace(".", "_")) for p in PATHS], *[paths.resolve(F.col("r"), kind, p).alias("resolved_" + p.replace(".", "_")) for p in PATHS]).collect()}
    for i, value in rows:
        for p in PATHS:
            found = plain_found(value, p)
            assert got[i][p.replace(".", "_")] == found, (i, p)
            many = "[]" in p.rpartition(".")[0]
            assert got[i]["resolved_" + p.replace(".", "_")] == (None if not found else found if many else found[0])


@pytest.mark.parametrize("which", [("core.items[].name",), ("core.items[].more[].x", "core.items[].tags", "core.note"), ("core.items", "core.items[].name"), ()])
def test_drop_against_plain(spark, which):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA)
    out = paths.drop_paths(df, "r", which)
    assert not set(which) & set(knowledge.paths(out.schema["r"].dataType))
    for x in out.collect():
        value, counts = dict(rows)[x["id"]], {}
        for p in sorted(which, key=lambda p: (-p.count("."), p)):
            counts[p] = len(plain_found(value, p))
            value = dropped(value, p.split("."))
        assert x.asDict(True)["r"] == value and x["removed"] == counts


def test_redact_against_plain(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA)
    which = ("core.items[].more", "core.items[].name", "core.items[].tags", "core.note", "n", "solo")
    pattern = re.compile(r"(?i)\b(?:blue|ring|red)\b")
    for x in paths.redact_paths(df, "r", which, ("red", "ring", "blue", "")).collect():
        value = dict(rows)[x["id"]]
        assert x["redactions"] == {p: sum(len(pattern.findall(s)) for v in plain_found(value, p) for s in strings(v)) for p in which}
        text = json.dumps(value, sort_keys=True)
        assert json.dumps(x.asDict(True)["r"], sort_keys=True) == json.dumps(json.loads(pattern.sub("[REDACTED]", text)), sort_keys=True)
    none = paths.redact_paths(df, "r", which, ()).collect()
    assert all(set(x["redactions"].values()) == {0} for x in none) and [x["r"] for x in none] == [x["r"] for x in df.collect()]


def test_refused_paths(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    kind = df.schema["r"].dataType
    for p in ("core.nothing", "core.items.name", "core.note[].x", "core..note", "n.x", "core.items[].name[].z"):
        with pytest.raises(ValueError):
            paths.type_at(kind, p)
    with pytest.raises(ValueError, match="all that its container has"):
        paths.drop_paths(df, "r", ["solo.only"])
    with pytest.raises(ValueError, match="lies inside"):
        paths.redact_paths(df, "r", ["core", "core.note"], ["red"])


def test_contexts_count_terms_not_marks(spark):
    """A mark that the note itself has is no redaction."""
    df = spark.createDataFrame([(1, {"note": "[REDACTED] red [REDACTED]", "other": "red"}), (2, {"note": None, "other": None}), (3, None)], "id int, r struct<note: string, other: string>")
    policy = knowledge.Policy("p", "1", frozenset({"note", "other"}), frozenset({"other"}), frozenset({"note"}))
    got = {x["id"]: (x["redactions"], x["patient"] and x["patient"]["note"]) for x in knowledge.contexts(df, "r", policy, ("red", "redacted")).collect()}
    assert got[1] == (3, "[[REDACTED]] [REDACTED] [[REDACTED]]") and got[2][0] == got[3][0] == 0


def plain_locate(note, text):
    at = note.find(text)
    if text and at >= 0:
        return at, at + len(text)
    words = text.split()
    m = re.search(r"\s+".join(map(re.escape, words)), note) if words else None
    return (m.start(), m.end()) if m else None


def test_locate_against_search():
    deal = random.Random(6)
    parts = ["ab", "a", "b", " ", "  ", "\n", "\t \n", r"\E", "(x)", "é", " ", "日本 ", "aba"]
    for _ in range(500):
        note = "".join(deal.choices(parts, k=deal.randint(0, 25)))
        cut = [note[a : a + deal.randint(0, 9)] for a in [deal.randint(0, 20) for _ in range(5)]]
        quoted = cut + [re.sub(r"\s+", deal.choice([" ", "\n\n"]), c) for c in cut] + ["".join(deal.choices(parts, k=3)), "", " "]
        found = quotes.locate_all(note, quoted)
        assert {q: plain_locate(note, q) for q in quoted if q.strip() or q and q in note} == {q: found.get(q) for q in quoted if q.strip() or q and q in note}


def test_repair_offsets(spark):
    note = "Keflex 500 mg Capsule PO four times a\nday. Keflex again \\E end."
    spans = [("a", 0, 6, "Keflex"), ("b", 43, 49, "Keflex"), ("c", 5, 5, "four times a day."), ("d", 1, 2, "never said"), ("e", None, None, "\\E end"), ("f", 3, 9, None), ("g", 0, 6, "Keflex")]
    rows = [(1, "n", p, a, b, t) for p, a, b, t in spans] + [(2, "n", "x", 0, 1, "K"), (1, "other", "y", 0, 1, "K"), (3, "n", "z", 0, 3, "abc")]
    df = spark.createDataFrame(rows, "case long, note_id string, path string, char_start int, char_end int, text string")
    notes = spark.createDataFrame([(1, "n", note), (3, "n", "")], "case long, note_id string, note string")
    got = {(r["case"], r["note_id"], r["path"]): (r["char_start"], r["char_end"], r["status"]) for r in quotes.repair_offsets(df, notes, "case").collect()}
    at = note.index("four")
    assert got == {
        (1, "n", "a"): (0, 6, "sound"), (1, "n", "b"): (43, 49, "sound"), (1, "n", "c"): (at, at + 17, "moved"), (1, "n", "d"): (None, None, "absent"), (1, "n", "e"): (note.index("\\E"), len(note) - 1, "moved"),
        (1, "n", "f"): (None, None, "absent"), (1, "n", "g"): (0, 6, "sound"), (2, "n", "x"): (None, None, "no note"), (1, "other", "y"): (None, None, "no note"), (3, "n", "z"): (None, None, "absent"),
    }
    assert quotes.repair_offsets(df.where("false"), notes, "case").count() == 0


RESPONSES = [
    ('{"a": 1}', '{"a":1}', "as it is"), ('text {"a": {"b": "}"}} more', '{"a":{"b":"}"}}', "as it is"), ('```json\n{"a": 1}\n```', '{"a":1}', "as it is"), ('```\nnone\n``` then ```json\n{"b": 2}\n```', '{"b":2}', "as it is"),
    ('Output: {"a": [1, 2,],\n\n "é": "x",}', '{"a":[1,2],"é":"x"}', "cleaned"), ('{"a": 1} and {"b": 2}', '{"a":1}', "cleaned"), ('"a": 1}', '{"a":1}', "closed"), ('{"a": 1,', '{"a":1}', "closed"), ('{"a": 1', '{"a":1}', "closed"),
    ("{}", None, ""), ("", None, ""), (None, None, ""), ("[1, 2]", None, ""), ('{"a": "say "hi""}', None, ""), ("} {", None, ""), ('{"a": NaN}', None, ""), ("{" * 5000, None, ""),
]


def test_objects(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(RESPONSES)], "i int, r string")
    got = df.select("i", responses.object_of(spark, F.col("r")).alias("o")).select("i", "o.*").orderBy("i").collect()
    for x, (text, wanted, how) in zip(got, RESPONSES, strict=True):
        assert (x["json"], x["how"]) == (wanted, how), text
        assert (x["defect"] is None) == (wanted is not None)


def test_truncated_is_refused_on_request(spark):
    """An answer that was cut off may be read as if it had ended there; an extraction doesn't want that."""
    assert responses.read_object('{"a": 1, "b": 2', close=False) == (None, "", "no JSON object")
    assert responses.read_object('{"a": 1,}', close=False)[:2] == ('{"a":1}', "cleaned")
    (x,) = spark.createDataFrame([('{"a": 1',)], "r string").select(responses.object_of(spark, F.col("r"), close=False).alias("o")).collect()
    assert x["o"]["json"] is None


def test_first_object_against_a_loop():
    deal = random.Random(8)
    for _ in range(500):
        text = "".join(deal.choices(["{", "}", "é", '"', " "], k=deal.randint(0, 12)))
        start, depth, wanted = text.find("{"), 0, None
        for i in range(start, len(text)) if start >= 0 else ():
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                wanted = text[start : i + 1]
                break
        assert responses.first_object(text) == wanted


def test_lists(spark):
    cases = [('x ```json\n[{"k": 1}]\n``` y', '[{"k":1}]', None), ("[]", "[]", None), ("none", None, "no JSON array"), ('[{"k": 1},]', None, "not valid JSON"), ('[{"k": 1}, 2]', None, "element 1 is no object"), ('[{"j": 1}]', None, "element 0 lacks k"), (None, None, "no JSON array"), ("] [", None, "no JSON array")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r string")
    got = df.select("i", responses.list_of(spark, F.col("r"), ("k",)).alias("o")).select("i", "o.*").orderBy("i").collect()
    assert [(x["json"], x["defect"]) for x in got] == [c[1:] for c in cases]
