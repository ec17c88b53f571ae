"""Semantics that a user of the study's own scripts relies on, each against plain Python."""

import hashlib
import json
import random
from itertools import combinations
from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinloom.functions import lenient, stats
from clinloom.operators import cohort, matching, statistics, studies
from clinloom.session import materialize, scratch, scratch_root


def test_identifiers_are_positive_and_reasons_ordered(spark):
    rows = [(0, 1, 5, 1, 2), (1, 0, 5, 1, 2), (1, 1, 0, 1, 2), (1, 1, -1, 3, 2), (1, 1, 5, 3, 2), (None, 1, 5, 1, 2), (-1, 1, -1, 3, 2)]
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, age int, admittime int, dischtime int")
    got = [r[0] for r in df.select(cohort.malformed_reason()).collect()]
    assert got == ["identifier", "identifier", None, "negative age", "discharge before admission", "identifier", "identifier"]


def test_candidates_are_read_leniently(spark):
    good = {c: "1" for c in cohort.CANDIDATE} | {"admittime": "2020-01-01", "dischtime": "2020-01-02T10:30:00", "procedure_icd9_codes": '{96.71, "4280" ,}', "deathtime": ""}
    cases = [{}, {"has_icu_stay": "maybe"}, {"admittime": "soon"}, {"age_years": "old", "has_icu_stay": ""}, {"deathtime": "x"}, {"deathtime": "2020-01-01"}, {"hospital_expire_flag": " YES "}]
    df = spark.createDataFrame([{**good, **c} for c in cases], ", ".join(f"{c} string" for c in good))
    got = cohort.parsed_candidates(df).collect()
    assert [r["reason"] for r in got] == [None, "has_icu_stay", "admittime", "age_years", "deathtime", None, None]
    assert got[0]["procedure_icd9_codes"] == ["96.71", "4280"] and got[6]["hospital_expire_flag"] is True and got[5]["deathtime"] is not None
    with pytest.raises(ValueError, match="note_text"):
        cohort.parsed_candidates(df.drop("note_text"))
    typed = df.withColumn("procedure_icd9_codes", F.array(F.lit("a"), F.lit(None)))
    assert cohort.parsed_candidates(typed).first()["procedure_icd9_codes"] == ["a"]
    words = spark.createDataFrame([("T",), ("no",), ("2",), (None,)], "w string").select(lenient.as_bool(F.col("w"))).collect()
    assert [r[0] for r in words] == [True, False, None, None]


def test_shortage_carries_the_flow(spark):
    df = spark.createDataFrame([(1, 1, []), (2, 2, ["E2"]), (3, 3, ["E2", "E3"])], "subject_id long, hadm_id long, fired array<string>")
    with pytest.raises(cohort.Shortage) as short:
        cohort.select_cases(df, 2, "s", "1")
    assert (short.value.requested, short.value.available) == (2, 1) and {r["code"]: r["excluded"] for r in short.value.flow}["E2"] == 2
    picked = cohort.select_cases(df, 1, "s", "1")
    assert {r["hadm_id"]: r["status"] for r in cohort.audit(df, picked).collect()} == {1: "selected", 2: "excluded", 3: "excluded"}
    with pytest.raises(ValueError, match="more than once"):
        cohort.select_cases(df.union(df), 1, "s", "1")


def test_unknown_dimensions_fail_closed(spark):
    df = spark.createDataFrame([(1, 0, "naturalness"), (1, 1, "patient_factuality"), (1, 2, "naturalness")], "case_id long, position int, dimension string")
    plan = studies.repair_plan(df).first()
    assert [a["dimension"] for a in plan["actions"]] == ["naturalness", "patient_factuality"] and plan["actions"][0]["targets"] == ["patient_style", "doctor_style"]
    with pytest.raises(Exception, match="unknown failed dimension composite"):
        studies.repair_plan(spark.createDataFrame([(1, 0, "composite")], df.schema)).collect()


def test_phases_by_turn(spark):
    got = [r[0] for r in spark.range(1, 14).select(studies.phase(F.col("id"))).collect()]
    assert got == ["opening"] * 3 + ["exploration"] * 5 + ["synthesis"] * 3 + ["conclusion"] * 2


def test_moods_and_checks(spark):
    texts = ["I'm worried and it hurts", "so TIRED OF this", "awful", "I don't understand", "fine", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(studies.mood(F.col("t"))).collect()] == ["anxious", "frustrated", "in_pain", "confused", "neutral", "neutral"]
    usable = spark.createDataFrame([("  short  ",), ("long enough text",), ("[ERROR: timeout] again",), (None,)], "t string")
    assert [r[0] for r in usable.select(studies.valid_response(F.col("t"))).collect()] == [False, True, False, False]
    turns = [("a", i, "doctor" if i % 2 == 0 else "patient", "When did it happen, exactly?") for i in range(6)] + [("b", 0, "doctor", "Where?")]
    got = {r["dialogue_id"]: (r["turns"], r["invalid"], r["inquiries"], r["covered"]) for r in studies.conversation_checks(spark.createDataFrame(turns, "dialogue_id string, index int, role string, text string")).collect()}
    assert got == {"a": (6, 0, 3, True), "b": (1, 1, 1, False)}
    assert [r[0]["formality"] for r in spark.range(1).selectExpr("explode(array(29, 30, 60)) a").select(studies.style(F.col("a"))).collect()] == [0.3, 0.5, 0.7]


def test_attempt_seeds_of_canonical_json(spark):
    cases = [(1, "c1", "FULL@1.0", 1), (20260914, 'quote " back \\ slash', "é 🙂  ", 2), (0, "tab\there\nnew\x01\x7f", "", 3)]
    df = spark.createDataFrame(cases, "b long, c string, p string, a int")
    got = [r[0] for r in df.select(studies.attempt_seed(F.col("b"), F.col("c"), F.col("p"), F.col("a"))).collect()]
    for (b, c, p, a), seed in zip(cases, got, strict=True):
        text = json.dumps({"base_seed": b, "case_id": c, "patient_policy_ref": p, "attempt_index": a, "stream": "generation"}, sort_keys=True, separators=(",", ":"))
        assert seed == int(hashlib.sha256(text.encode()).hexdigest()[:16], 16) % 2**31
    for bad in [(1, "c", "p", 0), (1, None, "p", 1)]:
        with pytest.raises(Exception, match="a seed needs"):
            spark.createDataFrame([bad], df.schema).select(studies.attempt_seed(F.col("b"), F.col("c"), F.col("p"), F.col("a"))).collect()


def test_raters_without_entities_have_an_empty_set(spark):
    rows = [(1, "x", "a"), (1, "y", "a"), (2, "x", "a"), (3, "z", None), (4, "x", "b"), (4, "y", "b"), (4, "y", "c")]
    sets = {(c, r): {e for d, s, e in rows if (d, s) == (c, r) and e} for c in (1, 2, 3, 4) for r in "xyz"}
    want = [len(a & b) / len(a | b) if a | b else 1.0 for c in (1, 2, 3, 4) for a, b in combinations([sets[c, r] for r in "xyz"], 2)]
    got = statistics.pairwise_jaccard(spark.createDataFrame(rows, "case_id int, rater string, entity string")).first()
    assert got["n_pairs"] == 12 and got["mean_jaccard"] == pytest.approx(sum(want) / 12)
    assert statistics.pairwise_jaccard(spark.createDataFrame([], "case_id int, rater string, entity string")).first()["n_pairs"] == 0


def test_bootstrap_equals_python(spark):
    r = random.Random(3)
    values = {g: {c: [r.random() for _ in range(r.randint(1, 3))] for c in range(n)} for g, n in (("a", 40), ("b", 7))}
    df = spark.createDataFrame([(g, c, v) for g, cases in values.items() for c, vs in cases.items() for v in vs], "g string, case_id long, value double")
    got = {x["g"]: x for x in statistics.bootstrap(statistics.clusters(df, ["g"]), ["g"], 60, "7").collect()}
    for g, cases in values.items():
        order = sorted(cases, key=lambda c: (hashlib.md5(str(c).encode()).hexdigest(), c))
        means = []
        for b in range(60):
            drawn = [cases[order[int(hashlib.sha256(f"7|{b}|{s}".encode()).hexdigest()[:8], 16) % len(order)]] for s in range(len(order))]
            means.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
        q = pd.Series(means).quantile([0.025, 0.975]).tolist()
        assert (got[g]["low"], got[g]["high"]) == (pytest.approx(q[0]), pytest.approx(q[1])) and got[g]["cases"] == len(cases)


def test_auc_over_many_scores(spark):
    r = random.Random(5)
    rows = [("f", r.random() < 0.4, round(r.random(), r.choice([1, 3, 9]))) for _ in range(900)] + [("g", True, 1.0), ("f", True, None)]
    got = {x["fault"]: x["auc"] for x in statistics.auc(spark.createDataFrame(rows, "fault string, is_corrupted boolean, score double"), ["fault"]).collect()}
    pos = [s for f, c, s in rows if f == "f" and c and s is not None]
    neg = [s for f, c, s in rows if f == "f" and not c]
    assert got["f"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)) and got["g"] is None


def test_mersenne_bootstrap_equals_python(spark):
    rows = [("v", c, x) for c, x in [(3, 0.1), (1, 0.4), (1, 0.6), (2, None), (7, 0.9)]] + [("w", 1, None)]
    got = {r["variant"]: r for r in statistics.mersenne_bootstrap(spark.createDataFrame(rows, "variant string, case_id long, value double"), ["variant"], 50, 9).collect()}
    groups = {1: [0.4, 0.6], 3: [0.1], 7: [0.9]}
    draw, means = random.Random(9), []
    for _ in range(50):
        v = [x for _ in groups for x in groups[draw.choice(list(groups))]]
        means.append(sum(v) / len(v))
    q = pd.Series(means).quantile([0.025, 0.975]).tolist()
    assert got["v"]["cases"] == 3 and got["v"]["estimate"] == pytest.approx(0.5) and (got["v"]["low"], got["v"]["high"]) == (pytest.approx(q[0]), pytest.approx(q[1]))
    assert got["w"]["cases"] == 0 and got["w"]["estimate"] is None


def test_choices_are_those_of_python(monkeypatch):
    """In arrays, over the limits of arrays and of the generator's state, for sizes at powers of two."""
    monkeypatch.setattr(statistics, "WORDS", 100)
    for n in (1, 2, 3, 64, 65, 700, 1024):
        draw = random.Random(5)
        assert [at.tolist() for at in statistics._choices(5, n, 3)] == [[draw.choice(range(n)) for _ in range(n)] for _ in range(3)]


def test_assignment_needs_no_call_a_case(spark):
    """Cases come to Python in batches; null keys, repeated pairs and scores that aren't numbers count as before."""
    rows = [("a", 1, 10, "exact_code", 1.0), ("a", 1, 11, "description_overlap", 0.7), ("a", 2, 10, "exact_code", 1.0), ("a", 3, 12, "none", 0.9)]
    rows += [(None, 1, 10, "description_overlap", None), (None, 1, 12, "description_overlap", float("nan")), (None, 1, 11, "description_overlap", 0.6), ("b", 5, 5, "exact_code", 1.0), ("b", 5, 5, "exact_code", 1.0)]
    df = spark.createDataFrame(rows, "k string, extracted int, coded int, granularity string, score double")
    out = matching.assign(df, ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = sorted((str(r["k"]), r["extracted"], r["coded"]) for r in out.collect())
    assert got == [("None", 1, 11), ("a", 1, 11), ("a", 2, 10), ("b", 5, 5), ("b", 5, 5)]


def test_entity_assignment_query_equals_brute_force(spark, sf_dir):
    """A maximum matching's size is unique, so counts are; sizes by trying all subsets' neighbourhoods (Hall, deficiency form)."""
    from clinloom.plans import catalogue

    left, right = catalogue._entities(spark, sf_dir)
    pairs = [r for r in catalogue._pairs(spark, sf_dir).collect() if r["granularity"] != "none"]
    n_left = {r["case_id"]: r["count"] for r in left.groupBy("case_id").count().collect()}
    n_right = {r["case_id"]: r["count"] for r in right.groupBy("case_id").count().collect()}
    got = {r["case_id"]: (r["tp"], r["fp"], r["fn"]) for r in catalogue.QUERIES["entity_assignment"](spark, sf_dir).collect()}
    assert set(got) == set(n_left) | set(n_right)
    for case, (tp, fp, fn) in got.items():
        edges: dict = {}
        for r in pairs:
            if r["case_id"] == case:
                edges.setdefault(r["extracted"], set()).add(r["coded"])
        best = 0
        nodes = list(edges)
        for bits in range(1 << len(nodes)):
            some = [nodes[i] for i in range(len(nodes)) if bits >> i & 1]
            best = max(best, len(some) - len(set().union(*[edges[e] for e in some])) if some else 0)
        assert tp == len(nodes) - best and fp == n_left.get(case, 0) - tp and fn == n_right.get(case, 0) - tp


def test_assignment_is_one_to_one(spark):
    pairs = spark.createDataFrame([(1, e, c, "exact_code", 1.0) for e in range(3) for c in range(2)], "case_id long, extracted long, coded long, granularity string, score double")
    got = matching.assign(pairs, ["case_id"]).collect()
    assert len(got) == 2 and len({r["extracted"] for r in got}) == 2 and len({r["coded"] for r in got}) == 2


def test_required_columns_equal_the_formula(spark):
    for sd in (0.0, 0.03, 0.21, 1.7):
        got = spark.range(1).select(*stats.required(F.lit(sd), 0.05, 0.8, incomplete=0.1)).first()
        assert tuple(got) == stats.required_pairs(sd, 0.05, 0.8, incomplete=0.1)
    assert stats.required_pairs(0.21, 0.05, 0.8)[0] == -int(-(((NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)) * 0.21 / 0.05) ** 2) // 1)


def test_scratch_tables_go(spark):
    import os

    with scratch() as keep:
        a, b = materialize(spark.range(3), "a"), keep(materialize(spark.range(4), "b"))
    assert not os.path.exists(a._scratch_path.removeprefix("file:")) and b.count() == 4
    assert scratch_root(spark)


def test_a_cluster_must_name_its_scratch_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session)
