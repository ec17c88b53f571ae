"""Readers that refuse: cases, scored dialogues and matcher fixtures.

Each comes as a plan with a ``defect`` a row, null where the row is sound, and as a reader that
raises on the first defective row with its file and line. Defects are found by expressions on the
executors; only the row that is reported reaches the driver. Lines are numbered from 1 within
a file, blank ones included; the lines before a defective one are counted only where it is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.operators.evaluation import score_defect

# What a scored dialogue and its scores must have, and the values that may be in them.
DIALOGUE_KEYS = ("scores", "dialogue_id", "case_id", "policy", "reference_mode")
PROVENANCE_KEYS = ("reference_mode", "scorer_id", "model_family", "model_id", "model_digest", "quantisation", "turn_scope", "prompt_version")
REFERENCE_MODES = ("full_reference", "policy_context")
FIXTURE_KEYS = ("fixture_id", "matcher", "provenance", "coded", "cases")

PROVENANCE = "struct<scorer_id: string, model_family: string, model_id: string, model_digest: string, quantisation: string, reference_mode: string, turn_scope: string, prompt_version: string, sampling: string, fallback_used: boolean, incomplete_reason: string>"
SCORE = f"struct<value: double, status: string, provenance: {PROVENANCE}, detail: string>"
FIXTURE = "fixture_id string, matcher string, provenance string, coded array<struct<description: string, code: string>>, cases array<struct<extracted: string, expects: string, note: string, extracted_code: string>>"


def json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, value) of every line that isn't blank."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) != ''")


def object_defect(value: Column) -> Column:
    """Why a line is no JSON object; null if it is one."""
    parsed = F.try_parse_json(value)
    return F.when(parsed.isNull(), "not valid JSON").when(F.json_object_keys(value).isNull(), "expected a JSON object")


def _lacking(keys: Column, wanted: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(keys, F.array().cast("array<string>")))


def read_cases(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """The cases of JSON lines files by ``schema``; raises on a line that is no object and where there is no case at all."""
    lines = json_lines(spark, paths).withColumn("defect", object_defect(F.col("value")))
    refuse(spark, lines)
    if lines.isEmpty():
        raise ValueError(f"{paths} holds no cases")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def scores(lines: DataFrame) -> DataFrame:
    """(file, value, dialogue_id, case_id, policy, reference_mode, dimension, score, defect): a row a score of ``lines`` (file, value).

    A line that can't be read, or has no scores, is one row with a null dimension.
    """
    head = "dialogue_id string, case_id string, policy string, reference_mode string, scores map<string, string>"
    mode = F.col("reference_mode")
    keys = _lacking(F.json_object_keys("value"), DIALOGUE_KEYS)
    read = lines.withColumn("_r", F.from_json("value", head)).select(
        "file", "value", "_r.dialogue_id", "_r.case_id", "_r.policy", "_r.reference_mode", F.col("_r.scores").alias("_scores"),
        F.coalesce(object_defect(F.col("value")), F.when(F.size(keys) > 0, F.concat(F.lit("fields are missing: "), F.array_join(keys, ", ")))).alias("_line"),
    ).withColumn("_line", F.coalesce("_line", F.when(F.coalesce(~mode.isin(*REFERENCE_MODES), F.lit(True)), "unknown reference mode")))
    each = read.select("*", F.explode_outer("_scores").alias("dimension", "_text")).drop("_scores")
    each = each.withColumn("score", F.from_json("_text", SCORE))
    # Without a provenance its own fields aren't named too.
    held = F.json_object_keys(F.get_json_object("_text", "$.provenance"))
    provenance = F.when(F.get_json_object("_text", "$.provenance").isNotNull(), _lacking(held, PROVENANCE_KEYS)).otherwise(F.array().cast("array<string>"))
    lacking = F.concat(_lacking(F.json_object_keys("_text"), ("value", "status", "provenance")), F.transform(provenance, lambda k: F.concat(F.lit("provenance."), k)))
    own = F.col("score.provenance.reference_mode")
    typed = F.get_json_object("_text", "$.value").isNotNull() & F.col("score.value").isNull()
    bad = (
        F.when(F.col("dimension").isNull(), None)
        .when(F.size(lacking) > 0, F.concat(F.lit("fields are missing: "), F.array_join(lacking, ", ")))
        .when(typed, "the value is no number")
        .when(F.coalesce(~own.isin(*REFERENCE_MODES), F.lit(False)), "unknown reference mode")
        .otherwise(score_defect(F.col("score.value"), F.col("score.status"), F.col("score.provenance.incomplete_reason")))
    )
    named = F.when(bad.isNotNull(), F.concat(F.lit("bad score '"), "dimension", F.lit("': "), bad))
    return each.withColumn("defect", F.coalesce("_line", named)).drop("_line", "_text")


def read_scores(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(dialogue_id, case_id, policy, reference_mode, dimension, value, status, provenance); raises on a defective line."""
    rows = scores(json_lines(spark, paths))
    refuse(spark, rows)
    return rows.where("dimension is not null").select("dialogue_id", "case_id", "policy", "reference_mode", "dimension", "score.value", "score.status", "score.provenance")


def fixtures(files: DataFrame) -> DataFrame:
    """(file, fixture_id, matcher, provenance, extracted, expects, note, extracted_code, coded, defect): a row a case of ``files`` (file, value).

    A case may only expect what is among its fixture's coded rows; a null expectation says that nothing should match.
    """
    keys = _lacking(F.json_object_keys("value"), FIXTURE_KEYS)
    read = files.withColumn("_r", F.from_json("value", FIXTURE)).select(
        "file", "value", *[F.col(f"_r.{c}").alias(c) for c in ("fixture_id", "matcher", "provenance", "coded")], F.explode_outer("_r.cases").alias("_c"),
        F.coalesce(object_defect(F.col("value")), F.when(F.size(keys) > 0, F.concat(F.lit("fixture keys are missing: "), F.array_join(keys, ", ")))).alias("_file"),
    )
    labels = F.transform("coded", lambda c: c["description"])
    unknown = F.col("_c.expects").isNotNull() & ~F.coalesce(F.array_contains(labels, F.col("_c.expects")), F.lit(False))
    text = F.concat(F.lit("case '"), F.coalesce("_c.extracted", F.lit("")), F.lit("' expects '"), F.col("_c.expects"), F.lit("', which is not among the coded rows"))
    return read.withColumn("defect", F.coalesce("_file", F.when(unknown, text))).select("file", "value", "fixture_id", "matcher", "provenance", "_c.*", "coded", "defect")


def read_fixtures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The cases of fixture files, a JSON object each; raises on a fixture with a defect."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = fixtures(files)
    if bad := rows.where("defect is not null").orderBy("file", "defect").limit(1).collect():
        raise ValueError(f"{bad[0]['file']}: {bad[0]['defect']}")
    return rows.where("extracted is not null").drop("file", "value", "defect")


def refuse(spark: SparkSession, rows: DataFrame) -> None:
    """Raise on the first row of ``rows`` (file, value, defect) with a defect, naming its file and line."""
    bad = rows.where("defect is not null").select("file", "value", "defect").orderBy("file", "value", "defect").limit(1).collect()
    if not bad:
        return
    file, value, defect = bad[0]
    whole = spark.read.text(file).select("value", F.monotonically_increasing_id().alias("_at"))
    first = whole.where(F.col("value") == value).agg(F.min("_at").alias("at")).first()["at"]
    raise ValueError(f"{file}:{whole.where(F.col('_at') <= first).count()}: {defect}")
