"""Readers that refuse, the costs of calls, and older profiles."""

import json

import pytest
from pyspark.sql import functions as F

from clinloom.functions import profiles
from clinloom.operators import attempts
from clinloom.sources import scored

PROVENANCE = {"scorer_id": "s", "model_family": "f", "model_id": "m", "model_digest": "d", "quantisation": "q", "reference_mode": "full_reference", "turn_scope": "all", "prompt_version": "1"}


def score(value=0.5, status="pass", **provenance):
    return {"value": value, "status": status, "provenance": {**PROVENANCE, **provenance}}


def dialogue(**given):
    return {"dialogue_id": "d1", "case_id": "c1", "policy": "P@1", "reference_mode": "policy_context", "scores": {"a": score()}, **given}


def write(folder, *lines, name="x.jsonl"):
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(folder)


def test_scores_are_rebuilt(spark, tmp_path):
    one = dialogue(scores={"a": score(), "b": score(None, "incomplete", incomplete_reason="no claims")})
    got = {r["dimension"]: r for r in scored.read_scores(spark, write(tmp_path, one, "", dialogue(dialogue_id="d2", scores={}))).collect()}
    assert set(got) == {"a", "b"} and (got["a"]["value"], got["b"]["value"], got["b"]["status"]) == (0.5, None, "incomplete")
    assert got["a"]["provenance"]["scorer_id"] == "s" and got["a"]["reference_mode"] == "policy_context"


@pytest.mark.parametrize(
    ("line", "error"),
    [
        ("{", "not valid JSON"),
        ("[1]", "expected a JSON object"),
        ({k: v for k, v in dialogue().items() if k != "policy"}, "fields are missing: policy"),
        (dialogue(reference_mode="other"), "unknown reference mode"),
        (dialogue(scores={"a": {"value": 0.1, "status": "pass"}}), "bad score 'a': fields are missing: provenance"),
        (dialogue(scores={"a": score(1.5)}), "bad score 'a': a value outside 0 to 1"),
        (dialogue(scores={"a": score("x")}), "bad score 'a': the value is no number"),
        (dialogue(scores={"a": score(None, "incomplete")}), "an incomplete score has no reason"),
        (dialogue(scores={"a": score(0.1, "odd")}), "unknown status"),
        (dialogue(scores={"a": score(reference_mode="other")}), "bad score 'a': unknown reference mode"),
    ],
)
def test_bad_scores_are_refused_with_their_line(spark, tmp_path, line, error):
    with pytest.raises(ValueError, match=rf"x\.jsonl:3: .*{error}"):
        scored.read_scores(spark, write(tmp_path, dialogue(), "", line))


def test_a_mode_may_be_null_in_a_score(spark, tmp_path):
    assert scored.read_scores(spark, write(tmp_path, dialogue(scores={"a": score(reference_mode=None)}))).count() == 1


def test_cases(spark, tmp_path):
    assert [r["case_id"] for r in scored.read_cases(spark, write(tmp_path, {"case_id": "1"}, " ", {"case_id": "2"}), "case_id string").orderBy("case_id").collect()] == ["1", "2"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="holds no cases"):
        scored.read_cases(spark, write(tmp_path / "none", "", "  "), "case_id string")
    (tmp_path / "bad").mkdir()
    with pytest.raises(ValueError, match=r"x\.jsonl:2: expected a JSON object"):
        scored.read_cases(spark, write(tmp_path / "bad", {"case_id": "1"}, "3"), "case_id string")


def test_fixtures(spark, tmp_path):
    whole = {"fixture_id": "f", "matcher": "m@1", "provenance": "p", "coded": [{"description": "Fever", "code": "780"}, {"description": "Cough"}], "cases": [{"extracted": "fever", "expects": "Fever"}, {"extracted": "x", "expects": None}]}
    rows = scored.read_fixtures(spark, write(tmp_path, json.dumps(whole, indent=1), name="a.json")).orderBy("extracted").collect()
    assert [(r["extracted"], r["expects"], len(r["coded"])) for r in rows] == [("fever", "Fever", 2), ("x", None, 2)]
    for bad, error in (({**whole, "cases": [{"extracted": "y", "expects": "Rash"}]}, "case 'y' expects 'Rash', which is not among"), ({k: v for k, v in whole.items() if k != "coded"}, "keys are missing: coded")):
        with pytest.raises(ValueError, match=error):
            scored.read_fixtures(spark, write(tmp_path, bad, name="b.json"))


def test_costs_of_calls(spark):
    calls = [
        [{"prompt_tokens": 5, "output_tokens": 2, "latency_ms": 7}, {"input_tokens": 3, "prompt_tokens": None, "completion_tokens": 1, "estimated_cost": 0.5}],
        [],
        None,
    ]
    supplied = [None, {"calls": 9, "wall_ms": 4}, None]
    df = spark.createDataFrame([(i, json.dumps(c) if c is not None else None, json.dumps(s) if s else None) for i, (c, s) in enumerate(zip(calls, supplied, strict=True))], "i int, calls string, cost string")
    got = [r["c"].asDict() for r in df.select("i", attempts.call_costs(F.col("calls"), F.col("cost")).alias("c")).orderBy("i").collect()]
    # A call that has prompt_tokens, even without a value, doesn't fall back to input_tokens.
    assert got[0] == {"calls": 2, "prompt_tokens": 5, "completion_tokens": 3, "wall_ms": 7, "estimated_cost": 0.5}
    assert got[1] == {"calls": 9, "prompt_tokens": 0, "completion_tokens": 0, "wall_ms": 4, "estimated_cost": 0.0}
    assert got[2] == {"calls": 0, "prompt_tokens": 0, "completion_tokens": 0, "wall_ms": 0, "estimated_cost": 0.0}


def test_profile_lists_of_structs_and_of_strings(spark):
    rows = [
        (0, ["aspirin", "statin"], ["nuts"], [{"description": "cough"}, {"description": ""}, {"description": None}]),
        (1, [], [], []),
        (2, None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, meds array<string>, allergies array<string>, symptoms array<struct<description: string>>")
    got = df.select("i", profiles.medications(F.col("meds")).alias("m"), profiles.allergies(F.col("allergies")).alias("a"), profiles.symptoms(F.col("symptoms"), named=True).alias("s")).orderBy("i").collect()
    assert tuple(got[0])[1:] == ("aspirin, statin", "nuts", "cough")
    for r in got[1:]:
        assert tuple(r)[1:] == ("Not specified in profile.", "None known or not specified in profile.", "No specific symptoms listed in profile to discuss.")
    one = spark.createDataFrame([((None, "F"),), (("40", None),), (None,)], "d struct<age: string, sex: string>")
    assert [r[0] for r in one.select(profiles.demographics(F.col("d"))).collect()] == ["Age: N/A, Sex: F", "Age: 40, Sex: N/A", "Not specified in profile."]


def test_nulls_mean_absent_and_names_are_aliased(spark):
    kind = "struct<core: struct<diagnoses: array<struct<primary: string, notes: string>>>, additional: struct<chief_complaint: string>>"
    df = spark.createDataFrame([(((([("x", None)],)), None),), (None,)], f"r {kind}")
    out = df.select(profiles.legacy(F.col("r"), df.schema["r"].dataType, "NO_DIAGNOSIS", "2.0").alias("p"))
    assert out.select("p.*").columns == ["Core", "Additional", "profile_type", "policy_version"]
    first, second = [r["p"] for r in out.collect()]
    assert first["Core"]["Diagnoses"][0].asDict() == {"Primary": "x", "Notes": ""} and first["Additional"]["Chief_Complaint"] == ""
    assert second["Core"]["Diagnoses"] == [] and second["profile_type"] == "NO_DIAGNOSIS"


def test_policies_decide_about_every_field(spark):
    from clinloom.operators import knowledge

    kind = spark.createDataFrame([], "core struct<diagnoses: array<struct<primary: string>>, symptoms: array<string>>, context struct<demographics: struct<age: int>>, title string").schema
    assert knowledge.surface(kind) == ["core.diagnoses", "core.symptoms", "context.demographics", "title"]
    policy = knowledge.Policy("P", "1", frozenset({"core.symptoms", "context.demographics.age", "title"}), frozenset({"core"}))
    assert knowledge.policy_issues(policy, ["core.diagnoses[].primary"], kind) == []
    assert knowledge.policy_issues(policy, ["title", "core.none"], kind) == ["unknown path core.none", "both visible and masked: title", "not classified: core.diagnoses"]


def test_queries_equal_sql(spark, sf_dir):
    from compare import oracle, spark_rows

    from clinloom.plans import catalogue

    for name in ("attempt_call_costs", "score_line_defects", "legacy_profiles"):
        assert spark_rows(catalogue.QUERIES[name](spark, sf_dir)) == oracle(catalogue.ORACLE_SQL[name], sf_dir)
