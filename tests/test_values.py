"""Known values and boundary cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from clinloom.functions import icd9, stats
from clinloom.functions import text as tx
from clinloom.operators import attempts, cohort, dialogue, evaluation, faults, knowledge, matching, statistics


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_charlson_of_the_known_case(spark):
    codes = spark.createDataFrame([(1, c) for c in ("428.0", "427.31", "443.9", "435.9", "250.00", "250.00")] + [(2, "250.40"), (2, "250.00"), (3, "V45.1"), (3, None), (None, "410")], "hadm_id long, code string")
    found = {r["hadm_id"]: (r["charlson"], r["high_acuity"], r["n_codes"]) for r in cohort.diagnosis_flags(codes).collect()}
    assert found == {1: (4, True, 5), 2: (2, False, 2), 3: (2, False, 1)}


def test_code_forms(spark):
    df = spark.createDataFrame([("e849.0",), ("V58.61",), ("428.0",), ("",)], "c string")
    got = rows(df.select(icd9.category(icd9.normalise(F.col("c"))), icd9.is_high_acuity(icd9.normalise(F.col("c")))))
    assert got == [("E849", False), ("V58", False), ("428", False), ("", False)]


def test_full_years_are_calendar_years(spark):
    df = spark.sql("select date'2020-02-29' b, date'2023-02-28' a union all select date'2000-06-01', date'2012-06-01' union all select date'2000-06-02', date'2012-06-01'")
    assert sorted(r[0] for r in df.select(cohort.full_years(F.col("b"), F.col("a"))).collect()) == [2, 11, 12]


def test_unknown_icu_stay_is_infinite(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None), (2, 0.5), (2, 0.25)], "hadm_id long, los double")
    assert dict(rows(cohort.icu_totals(df))) == {1: math.inf, 2: 0.75}


def test_icu_days_do_not_depend_on_the_order_of_stays(spark):
    stays = [(k, x) for k, order in enumerate([(0.84, 0.08, 0.08), (0.08, 0.84, 0.08), (0.08, 0.08, 0.84)]) for x in order] + [(8, math.nan), (8, 1.0), (9, math.inf), (9, 0.5)]
    got = dict(rows(cohort.icu_totals(spark.createDataFrame(stays, "hadm_id long, los double").coalesce(1))))
    assert [got[k] for k in (0, 1, 2)] == [1.0, 1.0, 1.0] and math.isnan(got[8]) and got[9] == math.inf


def test_criteria_boundaries(spark):
    base = dict(subject_id=1, hadm_id=1, admission_type="URGENT", expired=False, deathtime=None, ventilated=False, age=40, has_icu=False, icu_days=0.0, high_acuity=False, stay=3.0, charlson=0, note_category="Discharge summary ", note_chars=500)
    cases = [
        ({}, []), (dict(has_icu=True, icu_days=1.0), ["E1"]), (dict(has_icu=True, icu_days=0.99), []), (dict(has_icu=True, icu_days=math.inf), ["E1"]), (dict(age=11), ["E4"]), (dict(age=12), []),
        (dict(age=89), []), (dict(age=90), ["E5"]), (dict(stay=7.0), []), (dict(stay=7.1), ["E7"]), (dict(charlson=2), []), (dict(charlson=3), ["E8"]), (dict(note_chars=499), ["E9"]),
        (dict(admission_type=" newborn"), ["E4"]), (dict(expired=True, ventilated=True, high_acuity=True), ["E2", "E3", "E6"]), (dict(note_category="Nursing"), ["E9"]),
        (dict(deathtime="2020-01-01"), ["E2"]),
    ]
    df = spark.createDataFrame([{**base, **c, "hadm_id": i} for i, (c, _) in enumerate(cases)])
    got = dict(rows(df.select("hadm_id", cohort.fired(cohort.Criteria()))))
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_first_admission_and_flow(spark):
    df = spark.createDataFrame([(1, 1, 1, []), (1, 2, 2, []), (1, 0, 0, ["E2"]), (2, 3, 1, ["E1", "E7"])], "subject_id long, hadm_id long, admittime long, fired array<string>")
    out = cohort.with_first_admission(df)
    assert {r["hadm_id"]: r["fired"] for r in out.collect()} == {1: [], 2: ["E10"], 0: ["E2"], 3: ["E1", "E7"]}
    flow = {r["code"]: (r["entering"], r["excluded"], r["remaining"]) for r in cohort.exclusion_flow(out).collect()}
    assert flow["E1"] == (4, 1, 3) and flow["E2"] == (3, 1, 2) and flow["E10"] == (2, 1, 1)


def test_flow_of_nothing(spark):
    df = spark.createDataFrame([], "fired array<string>")
    assert [r["remaining"] for r in cohort.exclusion_flow(df).collect()] == [0] * 10


def test_sample_does_not_depend_on_order(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("subject_id"), F.col("id").alias("hadm_id"))
    a = cohort.hash_sample(df, 20, "s", "1").orderBy("selection_rank").collect()
    b = cohort.hash_sample(df.orderBy(F.desc("hadm_id")).repartition(7), 20, "s", "1").orderBy("selection_rank").collect()
    assert a == b and len(a) == 20
    import hashlib

    key = hashlib.sha256("\0".join(["cohort-sample-v1", "s", "1", str(a[0]["subject_id"]), str(a[0]["hadm_id"])]).encode()).hexdigest()
    assert a[0]["sample_key"] == key


def test_notes_in_order(spark):
    n = spark.sql("select * from values (1L, 9L, date'2020-01-02', 'Discharge summary', ' b '), (1L, 3L, null, 'discharge summary ', 'longest'), (1L, 4L, date'2020-01-01', 'Discharge summary', 'a'), (1L, 5L, null, 'Nursing', 'x'), (1L, 6L, null, 'Discharge summary', ' ') as t(hadm_id, row_id, chartdate, category, text)")
    assert rows(cohort.concatenated_notes(n)) == [(1, "longest\n\na\n\nb", 3, 3)]


def test_final_attempts(spark):
    df = spark.createDataFrame([("c", 1, "REJECT", 0.2), ("c", 2, "ACCEPT", 0.8), ("c", 3, "ACCEPT", 0.9), ("d", 1, "REJECT", 0.1), ("d", 2, "PASS", None)], "case_id string, attempt_index long, acceptance string, value double")
    first = {r["case_id"]: r["attempt_index"] for r in attempts.final_first_accepted(df, ["case_id"]).collect()}
    last = {r["case_id"]: (r["attempt_index"], r["value"]) for r in attempts.final_max_index(df, ["case_id"]).collect()}
    assert first == {"c": 2, "d": 2} and last == {"c": (3, 0.9), "d": (2, None)}
    assert attempts.duplicated_index(df.union(df.limit(1)), ["case_id"]).count() == 1


def test_gates_and_decision(spark):
    df = spark.createDataFrame([(0.8, 0.8, 1.0, 0.6, 1.0), (0.79, None, 1.0, 0.6, 1.0), (None, 0.8, 1.0, 0.6, 1.0)], "patient_factuality double, doctor_factuality double, knowledge_boundary double, naturalness double, structural_validity double")
    values = {c: F.col(c) for c in df.columns}
    got = rows(df.select(attempts.decide(values), attempts.composite(values)))
    assert [g[0] for g in got] == ["ACCEPT", "REJECT", "INCOMPLETE"] and got[0][1] == pytest.approx(0.78) and got[2][1] is None
    assert rows(df.limit(1).select(attempts.decide({})))[0][0] == "INCOMPLETE"


def test_costs(spark):
    df = spark.createDataFrame([("baseline", 2, 10, 5, 20), ("baseline", 2, 10, 5, 20)], "variant string, calls long, prompt_tokens long, completion_tokens long, wall_ms long")
    assert rows(attempts.costs(df, ["variant"], 1.0, 2.0)) == [("baseline", 2, 4, 20, 10, 40, pytest.approx(4e-5))]


def test_wilson(spark):
    df = spark.createDataFrame([(98, 100), (0, 10), (10, 10), (0, 0)], "k long, n long")
    got = rows(df.select(*stats.wilson(F.col("k"), F.col("n"))))
    assert got[0][1] < 0.98 < got[0][2] < 1 and got[1][1] == 0 and got[2][2] == pytest.approx(1) and got[3] == (None, None, None)
    with pytest.raises(ValueError):
        stats.wilson(F.col("k"), F.col("n"), 0.5)


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "label string, p_value double")
    got = {r["label"]: (round(r["holm"], 10), round(r["bh"], 10)) for r in statistics.adjusted(df).collect()}
    assert got == {"a": (0.03, 0.03), "b": (0.06, 0.04), "c": (0.06, 0.04)}


def test_paired(spark):
    df = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.8), ("c", "x", None), ("a", "y", 0.2), ("b", "y", 0.1), ("c", "y", 1.0)], "case_id string, arm string, value double")
    pairs = statistics.paired(df, "arm", "x", "y")
    assert rows(statistics.paired_summary(pairs)) == [(2, 1, pytest.approx(0.7))]
    n, observed, p = rows(statistics.sign_flip_exact(pairs))[0]
    assert (n, p) == (2, 0.5) and observed == pytest.approx(0.7)


def test_bootstrap_keeps_clusters(spark):
    one = spark.createDataFrame([(str(i), 0.5 + 0.04 * i) for i in range(10) for _ in range(3)], "case_id string, value double")
    many = one.withColumn("case_id", F.concat("case_id", F.monotonically_increasing_id().cast("string")))
    width = {}
    for name, df in (("clustered", one), ("loose", many)):
        b = statistics.bootstrap(statistics.clusters(df.withColumn("g", F.lit(1)), ["g"]), ["g"], 200, "s").first()
        width[name] = b["high"] - b["low"]
        assert b["estimate"] == pytest.approx(0.68)
    assert width["clustered"] > width["loose"]
    m = statistics.mersenne_bootstrap(one.withColumn("g", F.lit(1)), ["g"], 100).first()
    assert m["low"] < 0.68 < m["high"]


def test_auc_equals_pairs(spark):
    import random

    r = random.Random(1)
    data = [("f", r.random() < 0.4, r.randrange(8) / 8) for _ in range(200)]
    df = spark.createDataFrame(data, "fault string, is_corrupted boolean, score double")
    pos, neg = [s for _, c, s in data if c], [s for _, c, s in data if not c]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert statistics.auc(df, ["fault"]).first()["auc"] == pytest.approx(want)
    assert statistics.auc(df.where("is_corrupted"), ["fault"]).first()["auc"] is None


def test_power():
    plan = stats.power_plan([0.1, 0.0, 0.05, -0.02, 0.08, 0.04, 0.03, 0.06], 0.04, incomplete=0.1)
    assert plan["pilot_n"] == 8 and plan["total_80"] >= plan["complete_80"] >= 2 and plan["complete_90"] >= plan["complete_80"]
    assert stats.achieved_power(plan["paired_sd"], 0.04, plan["total_80"], incomplete=0.1) >= 0.78
    with pytest.raises(ValueError):
        stats.power_plan([0.1], 0.04)


def test_structure(spark):
    t = [("a", 0, "user", "hello"), ("a", 1, "user", "hello"), ("a", 2, "assistant", "  \n"), ("a", 3, "system", "Error generating reply"), ("b", 0, "user", "x")]
    df = spark.createDataFrame(t, "dialogue_id string, index int, role string, text string")
    found = {(r["dialogue_id"], r["check"], r["index"]) for r in dialogue.violations(df).collect()}
    assert found == {("a", "alternation", 1), ("a", "duplicate_turn", 1), ("a", "empty_turn", 2), ("a", "role_validity", 3), ("a", "error_sentinel", 3), ("b", "turn_bounds", None)}
    assert {r["dialogue_id"]: r["score"] for r in dialogue.structural_score(df, dialogue.violations(df)).collect()} == {"a": 0.0, "b": 0.0}


def test_symptoms_openings_loops(spark):
    t = [("a", i, "user" if i % 2 else "assistant", "What about **bold** the chest pain today then. More.") for i in range(8)]
    df = spark.createDataFrame(t, "dialogue_id string, index int, role string, text string")
    assert {r["symptom"]: r["mentions"] for r in dialogue.repeated_symptoms(df).collect()} == {"pain": 6, "chest pain": 6}
    o = {r["index"]: (r["opening"], r["repetitive"]) for r in dialogue.repetitive_openings(df).collect()}
    assert o[0] == ("what about the chest pain", False) and o[7][1]
    assert {r["index"] for r in dialogue.loops(df).where("looping").collect()} == {5, 6, 7}


def test_confusion_streak_decays(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([True, False, True, True, False])], "dialogue_id string, index int, c boolean")
    assert rows(dialogue.confusion_streak(df, F.col("c"))) == [("a", 2, True)]


def test_policy_paths_and_mask(spark):
    df = spark.sql("select named_struct('core', named_struct('diagnoses', array(named_struct('primary', 'heart failure', 'notes', 'n'))), 'context', named_struct('age', 40, 'history', 'Heart failure since'), 'extra', 'x') r")
    kind = df.schema["r"].dataType
    assert knowledge.paths(kind) == ["core", "core.diagnoses", "core.diagnoses[].primary", "core.diagnoses[].notes", "context", "context.age", "context.history", "extra"]
    p = knowledge.Policy("P", "1", frozenset({"context"}), frozenset({"core.diagnoses[].notes"}), frozenset({"context.history"}))
    view = knowledge.mask(df, "r", p, "Patient", ["heart failure"]).first()["view"].asDict(True)
    assert view == {"context": {"age": 40, "history": "[REDACTED] since"}}
    assert knowledge.mask(df, "r", p, "Doctor").first()["view"].asDict(True) == {"core": {"diagnoses": [{"notes": "n"}]}}
    assert knowledge.leakable(kind, p.patient_visible) == ["core", "core.diagnoses", "core.diagnoses[].primary", "core.diagnoses[].notes", "extra"]
    with pytest.raises(ValueError):
        knowledge.Policy("P", "1", frozenset(), frozenset(), frozenset({"extra"}))


def test_terms_and_redaction(spark):
    df = spark.createDataFrame([("Congestive heart failure, acute on chronic; MI",)], "t string")
    assert set(df.select(knowledge.diagnosis_terms(F.col("t"))).first()[0]) == {"Congestive heart failure", "CHF", "acute on chronic", "AC"}
    text, n = tx.redact(F.col("t"), ["failure", "heart failure", "mi"])
    assert tuple(df.select(text, n).first()) == ("Congestive [REDACTED], acute on chronic; [REDACTED]", 2)


def test_spans(spark):
    df = spark.createDataFrame([("héart  \n failure 🙂 end", 0, 5, "héart"), ("abc", 2, 9, "c"), ("abc", 0, 2, "xx"), (None, 0, 1, "a")], "note string, s int, e int, q string")
    assert [r[0] for r in df.select(knowledge.span_error(F.col("note"), F.col("s"), F.col("e"), F.col("q"))).collect()] == [None, "offsets out of range", "text differs", "missing note"]
    found = spark.createDataFrame([("x heart \n failure", "heart failure"), ("x a.c", "a.c"), ("x abc", "a.c")], "n string, q string")
    assert [r[0] for r in found.select(knowledge.locate(F.col("n"), F.col("q"))).collect()] == [2, 2, None]


MATCHER = matching.Matcher(
    ("lowercase", "strip_punctuation", "collapse_whitespace", "expand_abbreviations", "drop_coding_qualifiers", "brand_to_generic", "strip_dose_and_form"),
    ("exact_code", "exact_description", "generic_equivalent", "category_3digit", "description_overlap"),
    {"abbreviations": {"chf": "congestive heart failure"}, "coding_qualifiers": ("unspecified",), "brand_to_generic": {"lasix": "furosemide"}, "dose_units": ("mg",), "dose_forms": ("tablet",)},
)


def test_matcher_ladder(spark):
    cases = [("CHF", "Congestive heart failure, unspecified", "", "", "exact_description"), ("Lasix 40 mg tablet", "furosemide", "", "", "generic_equivalent"), ("x", "y", "428.0", "4280", "exact_code"), ("x", "y", "428.1", "428.0", "category_3digit"), ("acute pneumonia", "pneumonia", "", "", "description_overlap"), ("x", "y", "", "", "none")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, ca string, cb string, want string")
    df = MATCHER.normalise(MATCHER.normalise(df, "a", "na"), "b", "nb")
    level, score = MATCHER.compare("na", "nb", "ca", "cb")
    got = df.select("i", level.alias("g"), score.alias("s"), "want").collect()
    assert [r["g"] for r in got] == [r["want"] for r in got] and got[4]["s"] == pytest.approx(2 / 3)


def test_assignment_is_maximal(spark):
    pairs = spark.createDataFrame([(1, 1, 1, "exact_code", 1.0), (1, 1, 2, "description_overlap", 0.7), (1, 2, 1, "description_overlap", 0.9), (2, 1, 1, "exact_code", 1.0), (2, 2, 1, "exact_code", 1.0)], "case_id long, extracted long, coded long, granularity string, score double")
    got = {(r["case_id"], r["extracted"], r["coded"]) for r in matching.assign(pairs, ["case_id"]).collect()}
    assert got == {(1, 1, 2), (1, 2, 1), (2, 1, 1)}


def test_agreement(spark):
    full = spark.createDataFrame([(1, r, e) for r in range(3) for e in "ab"], "case_id long, rater long, entity string")
    assert statistics.agreement(full, 3).first()["kappa"] is None
    some = full.where("not (rater = 2 and entity = 'b')")
    a = statistics.agreement(some, 3).first()
    assert a["n_units"] == 2 and a["observed"] == pytest.approx(2 / 3) and a["kappa"] is not None
    assert statistics.pairwise_jaccard(some).first()["mean_jaccard"] == pytest.approx(2 / 3)


def test_parsing_and_scores(spark):
    answers = spark.createDataFrame([("a", 'Sure:\n```json\n[{"turn_index": 0, "role": "Patient", "type": "patient_fact", "text": "x"}, {"turn_index": 9, "role": "Patient", "type": "patient_fact", "text": "y"}]\n```'), ("b", "no json")], "dialogue_id string, response string")
    claims, bad = evaluation.parsed(answers, "response", evaluation.CLAIMS, "dialogue_id", "claim_index")
    assert claims.count() == 2 and rows(bad) == [("b", "unreadable response")]
    turns = spark.createDataFrame([("a", 0, "Patient", "x"), ("c", 0, "Patient", "z")], "dialogue_id string, index int, role string, text string")
    assert [r["reason"] for r in evaluation.misaligned_claims(claims, turns).collect()] == ["no such turn"]
    verdicts = spark.createDataFrame([("a", 0, "supported"), ("a", 1, "unsupported")], "dialogue_id string, claim_index int, verdict string")
    assert evaluation.misaligned_verdicts(claims, verdicts).count() == 0
    assert evaluation.misaligned_verdicts(claims, verdicts.limit(1)).count() == 1
    got = {r["dialogue_id"]: (r["score"], r["incomplete_reason"]) for r in evaluation.faithfulness(claims, verdicts, turns, "Patient").collect()}
    assert got == {"a": (0.5, None), "c": (None, "no factual claims")}


def test_faults_are_recovered(spark):
    t = spark.createDataFrame([("a", i, "user" if i % 2 else "assistant", f"t{i}") for i in range(6)], "dialogue_id string, index int, role string, text string")
    labels = spark.createDataFrame([("a", f, "thing") for f, role, _ in faults.FAULTS if role], "dialogue_id string, fault string, label string")
    got = faults.recovered(faults.inject(t, labels, "1")).collect()
    assert len(got) == 7 and all(r["recovered"] and r["n_hits"] == 1 for r in got)
    assert faults.inject(t, labels, "1").where("fault = 'empty_turn'").count() == 6


def test_study_helpers(spark):
    from clinloom.operators import studies

    assert studies.render("a {{x}}", {"x": "1"})[0] == "a 1"
    with pytest.raises(ValueError):
        studies.render("a {{x}} {{y}}", {"x": "1"})
    assert studies.balanced_object('text {"a": {"b": 1}} more}') == '{"a": {"b": 1}}' and studies.balanced_object("none") is None
    df = spark.createDataFrame([("p",), ("q",), ("p",)], "t string").select(studies.mock_response(F.col("t")).alias("r"))
    got = [r["r"] for r in df.collect()]
    assert got[0] == got[2] != got[1]
    grid = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a")], "case_id int, family string")
    assert rows(studies.missing_cells(grid, "case_id", "family")) == [(1, "b")]


def test_sign_flip_of_many_pairs(spark):
    import hashlib

    for shift in (0.0, 0.4):
        values = [((i * 37) % 41 - 20) / 20 + shift for i in range(41)]
        pairs = spark.createDataFrame([*enumerate(values), (99, None)], "case_id long, difference double")
        n, observed, p = statistics.sign_flip(pairs, resamples=500).collect()[0]
        sums = [0.0] * 540
        for i, x in enumerate(values):
            for part in range(9):
                bits = int(hashlib.sha256(f"0|{part}|{i}".encode()).hexdigest()[:15], 16)
                for k in range(60):
                    sums[part * 60 + k] += x if bits >> k & 1 else -x
        mean = abs(sum(values) / 41)
        want = (sum(abs(s / 41) + 1e-12 >= mean for s in sums[:500]) + 1) / 501
        assert n == 41 and abs(observed - mean) < 1e-9 and abs(p - want) < 1e-12
    few = pairs.where("case_id < 12")
    assert statistics.sign_flip(few).collect() == statistics.sign_flip_exact(few).collect()
