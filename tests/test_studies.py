"""Attempt logs, interval tables, the trend's decomposition, discrimination, retention, evidence."""

import json
import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinloom.operators import attempts as at
from clinloom.operators import decomposition, discriminate, evaluation, intervals, knowledge, logistic, retention, statistics
from clinloom.sources import attempts as log
from clinloom.sources import sinks


def record(dialogue="d1", index=1, **more):
    r = {
        "record_version": log.VERSION, "dialogue_id": dialogue, "run_id": "r", "config_hash": "c", "input_manifest_hash": "m", "prompt_set_hash": "p", "case_id": "case é", "variant": "baseline", "attempt_index": index,
        "inputs": {"policy": {"id": "FULL", "version": "1.0"}}, "dialogue": [{"index": 0, "text": "hi"}], "evaluation": {"acceptance": {"overall": "ACCEPT"}, "scores": {"naturalness": {"value": 0.5, "status": "pass"}, "knowledge_boundary": {"value": None, "status": "incomplete"}}},
        "repair": None, "model_calls": [], "cost": {"calls": 2, "prompt_tokens": 7},
    } | more
    return {**r, "record_hash": log.record_hash(r)}


def test_attempt_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(record()) + "\n\n  " + json.dumps(record(index=2)) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([record("d2"), record("d3", inputs={"variant": "other", "patient_policy_id": "P", "case_id": "c9"})], indent=2))
    (tmp_path / "c.jsonl").write_text("\n")
    got = {(r["dialogue_id"], r["attempt_index"]): r for r in log.read_attempts(spark, str(tmp_path)).collect()}
    assert set(got) == {("d1", 1), ("d1", 2), ("d2", 1), ("d3", 1)}
    assert (got["d1", 1]["policy"], got["d1", 1]["calls"], got["d1", 1]["wall_ms"], got["d1", 1]["acceptance"]) == ("FULL@1.0", 2, 0, "ACCEPT")
    assert (got["d3", 1]["variant"], got["d3", 1]["policy"], got["d3", 1]["case_id"]) == ("other", "P", "c9")
    long = log.long_scores(log.read_attempts(spark, str(tmp_path)))
    assert {(r["metric"], r["value"]) for r in long.collect()} == {("naturalness", 0.5), ("knowledge_boundary", None)}


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (json.dumps(record()) + "\n\nno json\n", "x.jsonl:3: not a JSON object"),
        (json.dumps(record() | {"case_id": "changed"}), "content hash does not match"),
        (json.dumps({k: v for k, v in record().items() if k != "cost"}), "fields are missing: cost"),
        (json.dumps(record() | {"more": 1}), "fields are unknown: more"),
        (json.dumps(record(index=0)), "at least 1"),
        (json.dumps(record()) + "\n" + json.dumps(record()), "more than once"),
        (json.dumps(record()) + "\n" + json.dumps(record("d2", run_id="other")), "several runs"),
        (json.dumps(record(inputs={})), "needs a variant, a policy"),
        ("[1, 2]", "not a JSON object"),
    ],
)
def test_bad_logs_are_refused(spark, tmp_path, text, error):
    (tmp_path / "x.jsonl").write_text(text)
    with pytest.raises(ValueError, match=error):
        log.read_attempts(spark, str(tmp_path)).count()


def times(cases, resamples, seed):
    import hashlib

    order = sorted(cases, key=lambda c: (hashlib.md5(str(c).encode()).hexdigest(), c))
    return [Counter(order[int(hashlib.sha256(f"{seed}|{b}|{s}".encode()).hexdigest()[:8], 16) % len(order)] for s in range(len(order))) for b in range(resamples)]


def test_detector_intervals_equal_python(spark):
    r = random.Random(2)
    obs = [(i % 9, r.random() < 0.5, r.random() < 0.5, round(r.random(), 1), r.randrange(4), [r.randrange(4)]) for i in range(70)]

    def metrics(sample):
        tp, fp, fn = (sum((c, p) == k for _, c, p, *_ in sample) for k in ((True, True), (False, True), (True, False)))
        pos, neg = [s for _, c, _, s, *_ in sample if c], [s for _, c, _, s, *_ in sample if not c]
        hit = [t in ts for _, c, p, _, t, ts in sample if c and p]
        return {
            "precision": tp / (tp + fp) if tp + fp else 0.0, "recall": tp / (tp + fn) if tp + fn else 0.0, "f1": 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0,
            "auc": sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg) if pos and neg else None, "localisation": sum(hit) / len(hit) if hit else 0.0,
        }

    df = spark.createDataFrame([("f", *o) for o in obs], "fault string, case_id long, is_corrupted boolean, predicted boolean, score double, truth_turn long, predicted_turns array<long>")
    got = {x["metric"]: x for x in intervals.detector_intervals(df, ["fault"], 30, "s").collect()}
    drawn = [metrics([o for o in obs for _ in range(n[o[0]])]) for n in times(range(9), 30, "s")]
    for m, v in metrics(obs).items():
        q = pd.Series([d[m] for d in drawn if d[m] is not None]).quantile([0.025, 0.975]).tolist()
        assert (got[m]["estimate"], got[m]["low"], got[m]["high"]) == (pytest.approx(v), pytest.approx(q[0]), pytest.approx(q[1])), m


def test_grounding_query_equals_python(spark, sf_dir):
    from clinloom.plans import catalogue

    counts = {r["case_id"]: (r["tp"], r["fp"], r["fn"]) for r in catalogue.QUERIES["entity_assignment"](spark, sf_dir).collect()}
    got = {r["metric"]: r for r in catalogue.QUERIES["grounding_intervals"](spark, sf_dir).collect()}
    prf = lambda t: (t[0] / (t[0] + t[1]) if t[0] + t[1] else 0.0, t[0] / (t[0] + t[2]) if t[0] + t[2] else 0.0, 2 * t[0] / (2 * t[0] + t[1] + t[2]) if sum(t) else 0.0)
    total = lambda n: tuple(sum(k * counts[c][i] for c, k in n.items()) for i in range(3))
    drawn = [prf(total(n)) for n in times(counts, 2000, "2")]
    for i, m in enumerate(("precision", "recall", "f1")):
        q = pd.Series([d[i] for d in drawn]).quantile([0.025, 0.975]).tolist()
        assert got[m]["estimate"] == pytest.approx(prf(total(dict.fromkeys(counts, 1)))[i], abs=1e-6) and (got[m]["low"], got[m]["high"]) == (pytest.approx(q[0], abs=1e-6), pytest.approx(q[1], abs=1e-6))
    assert sum(r["n"] for r in catalogue.QUERIES["granularity_counts"](spark, sf_dir).collect()) == sum(t for t, _, _ in counts.values())


def test_score_rows_say_what_was_not_measured(spark):
    df = spark.createDataFrame([("v", "p", "m", 1, 0.5), ("v", "p", "m", 1, 0.7), ("v", "p", "m", 2, None), ("v", "p", "n", 1, None)], "variant string, policy string, metric string, case_id long, value double")
    got = {r["metric"]: r for r in intervals.score_rows(df, 10, "1").collect()}
    assert (got["m"]["n_cases"], got["m"]["n_scores"], got["m"]["n_incomplete"]) == (1, 2, 1) and got["m"]["estimate"] == pytest.approx(0.6) == got["m"]["low"]
    assert got["n"]["estimate"] is None and got["n"]["method"] == "all scores INCOMPLETE" and got["n"]["n_incomplete"] == 1


def test_decomposition_report(spark):
    full, context = decomposition.MODES
    rows = [(c, f"{c}{p}{m}{d}", p, m, d, None if c == 3 and m == context else 0.9 - 0.2 * i - (0.1 if m == context else 0) + 0.01 * c) for c in range(5) for i, p in enumerate(decomposition.POLICIES) for m in (full, context) for d in (decomposition.PATIENT, decomposition.DOCTOR)]
    df = spark.createDataFrame(rows, "case_id long, dialogue_id string, policy string, mode string, dimension string, value double")
    record, text = decomposition.report(df, 20)
    assert len(record["reference_scope"]) == 6 == len(record["turn_scope"]) and len(record["gradient"]) == 4 and record["n_cases"] == 5 and record["n_dialogues"] == 60
    scope = record["reference_scope"]["patient_factuality::FULL"]
    assert scope["estimate"] == pytest.approx(-0.1) and (scope["n_cases"], scope["n_dropped"], scope["excludes_zero"]) == (4, 1, True)
    assert record["gradient"]["doctor_factuality::full_reference"]["estimate"] == pytest.approx(-0.4) and record["incomplete"]["patient_factuality::policy_context::FULL"] == 1
    assert "| patient_factuality::FULL | -0.100" in text and text.count("## ") == 4


def test_weights_equal_the_formula(spark):
    texts = ["a bb cc bb", "bb cc dd", "Ünï dd dd dd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("_terms", discriminate.terms("text"))
    words = [["bb", "cc", "bb"], ["bb", "cc", "dd"], ["ünï", "dd", "dd", "dd"]]
    docs = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]) for w in words]
    assert [Counter(r["_terms"]) for r in df.orderBy("i").collect()] == docs
    train, test, vocabulary = discriminate.weighted(df.where("i < 2"), df)
    held = {t: sum(t in d for d in docs[:2]) for d in docs[:2] for t in d}
    assert set(vocabulary) == set(held) and train.count() == 2
    for r in test.collect():
        w = {t: (1 + math.log(n)) * (math.log(3 / (1 + held[t])) + 1) for t, n in docs[r["i"]].items() if t in held}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        assert np.allclose([r["features"][vocabulary.index(t)] for t in w], [x / norm for x in w.values()])


def test_policies_are_told_apart(spark):
    r = random.Random(1)
    rows = [(c, p, " ".join([*(r.choice(["red", "blue", "green"]) for _ in range(6)), word])) for c in range(24) for p, word in (("A", "alpha"), ("B", "beta"), ("C", "gamma"))]
    d = discriminate.discriminate(spark.createDataFrame(rows, "case_id long, policy string, text string"), top=2)
    assert d.accuracy == 1.0 and d.macro_auc == 1.0 and {(x["policy"], x["feature"]) for x in d.top.where("rank = 1").collect()} == {("A", "alpha"), ("B", "beta"), ("C", "gamma")}
    assert {x["n"] for x in d.by_policy.collect()} == {6}
    two = discriminate.discriminate(spark.createDataFrame(rows[:60], "case_id long, policy string, text string").where("policy != 'C'"), top=1)
    assert two.macro_auc == 1.0 and {x["feature"] for x in two.top.collect()} == {"alpha", "beta"}
    with pytest.raises(ValueError):
        discriminate.discriminate(spark.createDataFrame(rows, "case_id long, policy string, text string").where("policy = 'A'"))


def test_discrimination_holds_no_vocabulary_and_is_the_full_fit(spark, monkeypatch):
    # A limit on the vocabulary refused this before, as terms and coefficients were on the driver.
    monkeypatch.setattr(discriminate, "MOST_TERMS", 2)
    monkeypatch.setattr(discriminate.logistic, "PART_CHARS", 200)
    monkeypatch.setattr(discriminate.logistic, "TOLERANCE", 1e-7)
    r = random.Random(5)
    rows = [(c, p, " ".join(r.choice(words.split()) for _ in range(r.randrange(9)))) for c in range(20) for p, words in (("A", "aa bb cc dd ee"), ("B", "bb cc ff gg"), ("C", "cc dd gg hh ii"))]
    df = spark.createDataFrame(rows, "case_id long, policy string, text string")
    d = discriminate.discriminate(df, top=3)
    monkeypatch.undo()
    # By the formulas, on all terms at once, by plain descent.
    parts = discriminate.case_split(df).withColumn("_terms", discriminate.terms("text"))
    train, test, vocabulary = discriminate.weighted(parts.where("not test"), parts.where("test"))
    side = lambda x: [(q["policy"], q["features"].toArray()) for q in x.collect()]
    train, test = side(train), side(test)
    x, y = np.array([v for _, v in train]), np.array([["A", "B", "C"].index(p) for p, _ in train])
    w, b = np.zeros((x.shape[1], 3)), np.zeros(3)
    for _ in range(20_000):
        e = np.exp(x @ w + b)
        e /= e.sum(1, keepdims=True)
        e[np.arange(len(y)), y] -= 1
        w, b = w - (x.T @ e + w) / len(y), b - e.sum(0) / len(y)
    right = Counter(p for p, v in test if "ABC"[int(np.argmax(v @ w + b))] == p)
    assert {q["policy"]: q["n_correct"] for q in d.by_policy.collect()} == {p: right[p] for p in "ABC"}
    top = d.top.collect()
    assert len(top) == 9 and np.allclose([q["weight"] for q in top], [w[vocabulary.index(q["feature"]), "ABC".index(q["policy"])] for q in top], atol=1e-4)
    assert all(np.isclose(q["weight"], np.sort(w[:, "ABC".index(q["policy"])])[-q["rank"]], atol=1e-4) for q in top)


def test_terms_of_equal_columns_are_multiplied_once():
    """Each iteration met every entry before, also those of the many terms that only one document has."""
    r, lengths = np.random.default_rng(3), {7: 6, 2: 5}
    x = {b: r.integers(1, 400, (n, 30)) * (r.random((n, 30)) < 0.4) for b, n in lengths.items()}
    for m in x.values():
        m[:, 10:20] = m[:, :1]
        m[:, 20:] = 0
    x[7][3, 20:25], x[2][4, 25:] = 1, 2
    entries = {b: np.nonzero(m) for b, m in x.items()}
    idf = np.log(12 / (1 + sum((m > 0).sum(0) for m in x.values()))) + 1
    row = {"part": [0], "hashes": [b""], "idf": [idf.tobytes()], "blocks": [[7, 2, 1]], "tests": [[False, False, True]], "sizes": [[*(len(i) for i, _ in entries.values()), 1]]}
    flat = {"rows": [*(i for i, _ in entries.values()), [0]], "ids": [*(j for _, j in entries.values()), [29]], "counts": [*(x[b][e] for b, e in entries.items()), [5]]}
    row |= {c: [np.concatenate(v).astype(np.uint16 if c == "rows" else np.int32).tobytes()] for c, v in flat.items()}
    made = list(logistic._trained(lengths)(iter([logistic._rows(row, logistic._PARTS)])))
    whole = sum(len(i) for i, _ in entries.values())
    assert sum(made[0].to_pylist()[0]["sizes"]) == whole - 10 * int((x[7][:, 0] > 0).sum() + (x[2][:, 0] > 0).sum()) - 8
    sent = r.normal(size=(3, 11))  # block 2 comes first
    got = {q["block"]: np.frombuffer(q["data"]).reshape(-1, 3) for b in logistic._iterated(SimpleNamespace(value=sent), lengths)(iter(made)) for q in b.to_pylist()}
    weights = np.vstack([np.where(x[b] > 0, 1 + np.log(np.maximum(x[b], 1)), 0) * idf for b in (2, 7)])
    assert np.allclose(np.vstack([got[2], got[7]]), weights @ (weights.T @ sent.T))


def test_retention_needs_an_independent_family(spark):
    cases = spark.createDataFrame([("P", 1, "b", ["a"]), ("P", 2, "b", ["a"])], "policy string, case_id long, extractor string, generators array<string>")
    e = spark.createDataFrame([("P", 1, 10), ("P", 1, 11)], "policy string, case_id long, extracted long")
    c = spark.createDataFrame([("P", 1, 20), ("P", 2, 21)], "policy string, case_id long, coded long")
    pairs = spark.createDataFrame([("P", 1, 10, 20, "exact_code", 1.0)], "policy string, case_id long, extracted long, coded long, granularity string, score double")
    got = {r["metric"]: r["estimate"] for r in retention.retention(cases, e, c, pairs, 5).collect()}
    assert got == {"precision": 0.5, "recall": 0.5, "f1": 0.5}
    with pytest.raises(ValueError, match="both generated and extracted"):
        retention.checked(cases.withColumn("generators", F.array("extractor")))
    with pytest.raises(ValueError, match="more than once"):
        retention.checked(cases.union(cases))


def test_score_rules(spark):
    df = spark.createDataFrame([(0.5, "pass", None), (None, "incomplete", "why"), (0.1, "incomplete", "why"), (None, "incomplete", ""), (None, "fail", None), (1.2, "pass", None), (float("nan"), "pass", None), (0.5, "odd", None), (0.5, None, None)], "v double, s string, r string")
    got = [x[0] for x in df.select(evaluation.score_defect(F.col("v"), F.col("s"), F.col("r"))).collect()]
    assert got[:2] == [None, None] and all(got[2:]) and got[5] == got[6] == "a value outside 0 to 1"


def test_evidence_of_nested_medications(spark):
    span = "struct<note_id: string, char_start: int, char_end: int, text: string>"
    schema = f"case_id int, r struct<core: struct<treatments: array<struct<evidence: array<{span}>, medications: array<struct<name: string, evidence: array<{span}>>>>>>>"
    good, bad = ("n", 0, 3, "abc"), ("n", 1, 3, "zz")
    df = spark.createDataFrame([(1, (([([good], [("m", [bad, good]), ("k", None)])],),)), (2, ((None,),))], schema)
    e = knowledge.evidenced(df, "case_id", "r")
    assert {r["path"] for r in e.collect()} == {"core.treatments[0]", "core.treatments[0].medications[0]", "core.treatments[0].medications[1]"}
    notes = spark.createDataFrame([(1, "n", "abcdef")], "case_id int, note_id string, note string")
    assert [(r["path"], r["issue"]) for r in knowledge.evidence_issues(e, notes, "case_id").collect()] == [("core.treatments[0].medications[0].evidence[0]", "text differs")]
    assert [r["path"] for r in knowledge.unevidenced(e, notes, "case_id").collect()] == ["core.treatments[0].medications[1]"]


def test_tables_of_a_study(spark, tmp_path):
    log_file = tmp_path / "log.jsonl"
    log_file.write_text("\n".join(json.dumps(record(f"d{i}", 1)) for i in range(4)))
    a = log.read_attempts(spark, str(log_file))
    finals = at.final_max_index(a, ["dialogue_id"])
    tables = {"scores": intervals.score_rows(log.long_scores(finals), 10), "acceptance": at.acceptance_rates(finals, ["variant", "policy"]), "cost": at.costs(a, ["variant"], 0, 0)}
    hashes = sinks.write_tables(str(tmp_path / "out"), tables, {"run_id": "r", "attempt_records": a.count()})
    assert set(hashes) == {"scores.csv", "acceptance.csv", "cost.csv", "summary.json"}
    assert (tmp_path / "out" / "scores.csv").read_text().splitlines()[0].startswith("variant,policy,metric,estimate,low,high")


def test_corpus_helpers(spark):
    from clinloom.operators import corpus

    df = spark.createDataFrame([("d", [{"role": "doctor", "content": "hi"}, {"speaker": "Patient", "utterance": "yes", "text": "no"}])], "dialogue_id string, dialogue array<map<string,string>>")
    assert [(r["index"], r["role"], r["text"]) for r in corpus.adapted_turns(df).collect()] == [(0, "Doctor", "hi"), (1, "Patient", "no")]
    for bad, error in (({"text": "x"}, "turn 0 has no role"), ({"role": "nurse", "text": "x"}, "unknown role"), ({"role": "doctor"}, "no text")):
        with pytest.raises(Exception, match=error):
            corpus.adapted_turns(spark.createDataFrame([("d", [bad])], df.schema)).collect()
    dialogues = spark.createDataFrame([(1, "a", "FULL"), (2, "b", "FULL")], "case_id int, dialogue_id string, policy string")
    refs = spark.createDataFrame([(1, "r1"), (2, "r2")], "case_id int, reference string")
    assert corpus.with_references(dialogues, refs, ("FULL",)).count() == 2
    for d, r, error in ((dialogues, refs.where("case_id = 1"), "no reference: 2"), (dialogues.union(dialogues), refs, "there twice"), (dialogues, refs.union(refs), "two references"), (dialogues.withColumn("policy", F.lit("X")), refs, "unknown: X")):
        with pytest.raises(ValueError, match=error):
            corpus.with_references(d, r, ("FULL",))
    s = spark.createDataFrame([(t,) for t in (1, 3, 9)], "t int").select(corpus.symptoms_for_turn(F.array(*map(F.lit, ("Rash", "Chest tightness", " fever ", "Back PAIN", "itch"))), F.array(F.lit("back pain")), F.col("t")).alias("s"))
    assert [r["s"] for r in s.collect()] == [["chest tightness"], ["chest tightness", "rash"], ["chest tightness", "rash", "fever"]]
    assert corpus.measured_mean(spark.createDataFrame([(1.0,), (None,)], "value double")) == 1.0
    with pytest.raises(ValueError):
        corpus.measured_mean(spark.createDataFrame([(None,)], "value double"))
    empty = spark.createDataFrame([(None,)], "d array<struct<primary: string, notes: string>>")
    assert empty.select(corpus.diagnoses_text(F.col("d"))).first()[0] == corpus.UNSPECIFIED
    assert [f[2] for f in corpus.FAMILIES] == ["holm", "holm", "holm", "bh"]


def test_slots_are_dealt_before_they_are_made(spark):
    """Every slot of every size once, with its hash, over many tasks."""
    import hashlib

    from pyspark.sql import functions as F

    from clinloom.operators import statistics

    sizes = [1, 7, statistics.SLOTS, 3 * statistics.SLOTS + 5]
    made = statistics.slots(spark.createDataFrame([(n,) for n in sizes + sizes], "cases long"), 3, "s")
    got = {(r["cases"], r["replicate"]): (r["c"], r["t"]) for r in made.groupBy("cases", "replicate").agg(F.count(F.lit(1)).alias("c"), F.sum("ordinal").alias("t")).collect()}
    number = [[int(hashlib.sha256(f"s|{b}|{x}".encode()).hexdigest()[:8], 16) for x in range(max(sizes))] for b in range(3)]
    assert got == {(n, b): (n, sum(x % n for x in number[b][:n])) for n in sizes for b in range(3)}
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    with pytest.raises(ValueError, match="positive"):
        statistics.slots(made, 0, "s")


def test_many_cases_are_joined_as_few_are(spark, monkeypatch):
    """Broadcast or joined, with null groups and groups of one case: the same draws; the slots are never broadcast."""
    from clinloom.operators import statistics

    cases = spark.createDataFrame([(g, i, float(i), 1) for g, n in (("a", 30), (None, 12), ("c", 1)) for i in range(n)], "g string, case_id long, total double, n long")
    few = statistics.resampled(cases, ["g"], 40, "s")
    want = Counter(tuple(r) for r in few.select("g", "replicate", "case_id", "total", "n", "cases").collect())
    monkeypatch.setattr(statistics, "BROADCAST_CASES", 0)
    many = statistics.resampled(cases, ["g"], 40, "s")
    assert "SortMergeJoin" in many._jdf.queryExecution().toString() and "BuildLeft" not in few._jdf.queryExecution().toString()
    assert Counter(tuple(r) for r in many.select("g", "replicate", "case_id", "total", "n", "cases").collect()) == want
    assert sum(want.values()) == 43 * 41
    for g, n in (("a", 30), (None, 12), ("c", 1)):
        drawn = times(range(n), 40, "s")
        assert {(b, c): k for (h, b, c, *_), k in want.items() if h == g and b >= 0} == {(b, c): k for b, x in enumerate(drawn) for c, k in x.items()}
    assert statistics.bootstrap(cases.where("false"), ["g"], 5, "s").count() == 0


def test_incomplete_matrices_are_refused(spark):
    from clinloom.operators import statistics

    full = [(c, r) for c in "ab" for r in ("x", "y", "z")]
    check = lambda rows: statistics.complete_matrix(spark.createDataFrame(rows, "case_id string, rater string"))
    assert check(full).count() == 6
    for rows, message in ((full[:-1], "missing b/z"), (full + full[:1], "more than one extraction of x"), ([("a", "x"), ("b", "x")], "1 raters")):
        with pytest.raises(ValueError, match=message):
            check(rows)


def test_power_is_asserted_and_recorded():
    from datetime import UTC, datetime

    from clinloom.functions import stats

    pilot = [0.1, 0.3, -0.2, 0.4, 0.0]
    plan = stats.power_plan(pilot, 0.1, incomplete=0.1)
    assert stats.assert_powered(plan["paired_sd"], 0.1, plan["total_80"], incomplete=0.1) >= 0.8
    with pytest.raises(ValueError, match="below 0.900"):
        stats.assert_powered(plan["paired_sd"], 0.1, plan["total_80"], incomplete=0.1, target=0.9)
    with pytest.raises(ValueError):
        stats.assert_powered(1.0, 0.1, 1)
    record = stats.power_record(pilot, 0.1, plan["total_80"], datetime(2024, 1, 1, tzinfo=UTC))
    assert "2024-01-01T00:00:00Z" in record and f"Planned cases: {plan['total_80']}" in record
    assert record != stats.power_record(pilot[::-1], 0.1, plan["total_80"], datetime(2024, 1, 1, tzinfo=UTC))  # the pilot is what it was
    for bad in (dict(frozen_at=datetime(2024, 1, 1)), dict(pilot=[0.1, float("nan")])):
        with pytest.raises(ValueError):
            stats.power_record(**{"pilot": pilot, "smallest": 0.1, "planned": 9, "frozen_at": datetime(2024, 1, 1, tzinfo=UTC)} | bad)


def test_condition_summary_of_nothing(spark):
    from clinloom.operators import attempts

    df = spark.createDataFrame([("v", "c", None, None, None, None, None)], "variant string, case_id string, acceptance string, calls long, prompt_tokens long, completion_tokens long, wall_ms long")
    (r,) = attempts.condition_summary(df, ["variant"]).collect()
    assert (r["attempts"], r["cases"], r["accepted_cases"], r["terminal_failures"], r["calls"], r["cost_per_case"]) == (1, 1, 0, 1, 0, 0.0)
    assert attempts.condition_summary(df.where("false"), ["variant"]).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"PACKED": 3, "TASK_SLOTS": 4, "HASHES": 8, "BROADCAST_VALUES": 0}])
def test_sums_of_draws_are_those_of_drawn_rows(spark, monkeypatch, sizes):
    """Arrays broadcast or dealt, groups in one run or several, slots in one range or several: the sums of the rows that ``resampled`` draws."""
    for name, n in sizes.items():
        monkeypatch.setattr(statistics, name, n)
    rows = [(g, h, i, float(i * i % 7), i % 3) for g, h, n in (("a", 1, 11), ("a", None, 1), (None, 2, 6), ("c", 3, 4)) for i in range(n)]
    cases = spark.createDataFrame(rows, "g string, h int, case_id long, total double, n long")
    keys = ["g", "h", "cases", "replicate"]
    want = statistics.resampled(cases, ["g", "h"], 7, "s").groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    plan = statistics.resampled_sums(cases, ["g", "h"], ["total", "n"], 7, "s")
    got = {tuple(r[k] for k in keys): (r["total"], r["n"]) for r in plan.collect()}
    assert got == {tuple(r[k] for k in keys): (r["total"], r["n"]) for r in want.collect()} and len(got) == 4 * 8
    with pytest.raises(ValueError, match="positive"):
        statistics.resampled_sums(cases, ["g", "h"], ["n"], 0, "s")


def test_bootstraps_make_no_row_a_draw(spark, monkeypatch):
    """Not even of more cases than are broadcast, whose draws were shuffled by (size, number)."""
    monkeypatch.setattr(statistics, "BROADCAST_CASES", 0)
    monkeypatch.setattr(statistics, "BROADCAST_VALUES", 0)
    cases = spark.range(500).selectExpr("id % 2 as g", "id as case_id", "cast(id as double) as total", "1L as n")
    for df in (statistics.bootstrap(cases, ["g"], 20, "s"), intervals.count_intervals(cases.selectExpr("g", "case_id", "1L as tp", "1L as fp", "0L as fn"), ["g"], 20, "s")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "explode(slice" not in plan and "ordinal" not in plan
        assert df.count()
    empty = statistics.bootstrap(cases.where("false"), ["g"], 20, "s")
    assert empty.collect() == []
