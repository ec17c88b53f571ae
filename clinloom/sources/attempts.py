"""Attempt logs: JSON lines or JSON arrays, verified by content hash, one run, no attempt twice."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.session import ship

# Fields of an attempt record; the optional ones have a default.
FIELDS = ("dialogue_id", "run_id", "config_hash", "input_manifest_hash", "prompt_set_hash", "case_id", "variant", "attempt_index", "inputs", "dialogue", "evaluation", "cost")
OPTIONAL = ("record_version", "repair", "model_calls", "record_hash")
TEXTS = FIELDS[:7]
VERSION = "2.0"

RECORD = ", ".join(f"{c} {'int' if c == 'attempt_index' else 'string'}" for c in (*FIELDS, *OPTIONAL))
SCORES = "map<string, struct<value: double, status: string>>"


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def bad_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, text) of every line that is no JSON object, numbered from 1; files that hold an array have none.

    Files are read whole, one a row: for reports on files that are known to be bad.
    """
    whole = spark.read.text(paths, wholetext=True).select(_file(), "value").where("not startswith(ltrim(value), '[')")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "text")).where("trim(text) != ''")
    bad = F.try_parse_json("text").isNull() | ~F.startswith(F.ltrim("text"), F.lit("{"))
    return lines.where(bad).select("file", (F.col("at") + 1).alias("line"), "text")


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, value): the text of each record of JSON lines files and of files that hold one JSON array.

    Lines are read split by split; only where a line opens an array are files read whole.
    Blank lines and empty files count for nothing. A bad line raises with its file and number.
    """
    lines = spark.read.text(paths).select(_file(), "value").where("trim(value) != ''")
    opens = F.startswith(F.ltrim("value"), F.lit("["))
    arrays = lines.where(opens).select("file").distinct()
    out = lines
    if not arrays.isEmpty():
        whole = spark.read.text(paths, wholetext=True).select(_file(), "value").where("startswith(ltrim(value), '[')")
        items = F.from_json("value", "array<string>")
        sound = F.when(items.isNull(), F.raise_error(F.concat("file", F.lit(" does not hold a JSON array of records")))).otherwise(items)
        out = lines.join(arrays, "file", "left_anti").unionByName(whole.select("file", F.explode(sound).alias("value")))
    bad = out.where(F.try_parse_json("value").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))).select("file").distinct()
    if first := bad.limit(1).collect():
        at = bad_lines(spark, first[0]["file"]).orderBy("line").limit(1).collect()
        where = f"{first[0]['file']}:{at[0]['line']}: not a JSON object: {at[0]['text'][:80]}" if at else f"{first[0]['file']}: an item is not a JSON object"
        raise ValueError(where)
    return out


def record_hash(record: dict) -> str:
    """SHA-256 of a record's canonical JSON, its own hash left out."""
    body = {k: v for k, v in record.items() if k != "record_hash"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def record_defect(text: str) -> str | None:
    """What is wrong with a record; None if nothing is."""
    try:
        record = json.loads(text)
    except ValueError:
        record = None
    if not isinstance(record, dict):
        return "not a JSON object"
    if missing := sorted(set(FIELDS) - set(record)):
        return f"fields are missing: {', '.join(missing)}"
    if unknown := sorted(set(record) - set(FIELDS) - set(OPTIONAL)):
        return f"fields are unknown: {', '.join(unknown)}"
    if empty := [c for c in TEXTS if not str(record[c]).strip()]:
        return f"{empty[0]} is required"
    if not isinstance(record["attempt_index"], int) or record["attempt_index"] < 1:
        return "attempt_index must be at least 1"
    full = {"record_version": VERSION, "repair": None, "model_calls": [], **record}
    if record.get("record_hash") != record_hash(full):
        return "content hash does not match"
    return None


def defects(records: DataFrame) -> DataFrame:
    """``records`` (file, value) with ``defect``: null where the record is whole and its hash is its content's."""
    ship(records.sparkSession)

    @F.pandas_udf("string")
    def defect(values: pd.Series) -> pd.Series:
        return values.map(record_defect)

    return records.withColumn("defect", defect("value"))


def coordinates(inputs: Column, variant: Column, case_id: Column) -> tuple[Column, Column, Column]:
    """(variant, policy, case) of a record: of its inputs, else of itself; a policy object is written id@version."""
    given = F.from_json(inputs, "variant string, policy string, patient_policy_id string, case_id string")
    filled = lambda c: F.when(c != "", c)
    policy = F.coalesce(given["policy"], given["patient_policy_id"])
    pair = F.from_json(policy, "id string, version string")
    named = F.array_join(F.array_compact(F.array(filled(pair["id"]), filled(pair["version"]))), "@")
    named = F.when(F.startswith(F.ltrim(policy), F.lit("{")), named).otherwise(policy)
    return F.coalesce(filled(given["variant"]), filled(variant)), filled(named), F.coalesce(filled(given["case_id"]), filled(case_id))


def read_attempts(spark: SparkSession, paths: str | list[str], verify: bool = True) -> DataFrame:
    """One row an attempt: run_id, dialogue_id, case_id, variant, policy, attempt_index, acceptance, scores, costs.

    Raises on a record with a defect, on records of several runs, on an attempt that is there
    twice and on one without variant, policy or case. ``verify=False`` leaves the hashes unchecked.
    """
    records = read_records(spark, paths)
    if verify:
        records = defects(records)
        if bad := records.where("defect is not null").limit(1).collect():
            raise ValueError(f"{bad[0]['file']}: {bad[0]['defect']}: {bad[0]['value'][:80]}")
    r = records.select(F.from_json("value", RECORD).alias("r")).select("r.*")
    variant, policy, case = coordinates(F.col("inputs"), F.col("variant"), F.col("case_id"))
    evaluation = F.from_json("evaluation", f"acceptance struct<overall: string>, scores {SCORES}")
    cost = F.from_json("cost", "calls long, prompt_tokens long, completion_tokens long, wall_ms long")
    out = r.select(
        "run_id", "dialogue_id", case.alias("case_id"), variant.alias("variant"), policy.alias("policy"), "attempt_index",
        evaluation["acceptance"]["overall"].alias("acceptance"), evaluation["scores"].alias("scores"), *[F.coalesce(cost[c], F.lit(0)).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens", "wall_ms")],
    )
    runs = [x["run_id"] for x in out.select("run_id").distinct().limit(3).collect()]
    if len(runs) > 1:
        raise ValueError(f"records of several runs: {sorted(map(str, runs))}")
    if twice := out.groupBy("dialogue_id", "attempt_index").count().where("count > 1").limit(1).collect():
        raise ValueError(f"attempt {twice[0]['dialogue_id']}::{twice[0]['attempt_index']} is there more than once")
    if not out.where("variant is null or policy is null or case_id is null").isEmpty():
        raise ValueError("every attempt needs a variant, a policy and a case")
    return out


def long_scores(attempts: DataFrame) -> DataFrame:
    """(variant, policy, metric, case_id, value): a score that is incomplete or has no value is null."""
    s = attempts.select("variant", "policy", "case_id", F.explode("scores").alias("metric", "score"))
    value = F.when(F.lower(F.coalesce("score.status", F.lit(""))) != "incomplete", F.col("score.value"))
    return s.select("variant", "policy", "metric", "case_id", value.alias("value"))
