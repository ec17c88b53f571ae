"""Evaluation over model responses: parsing, alignment with the transcript, ratio scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIMS = "array<struct<turn_index:int,role:string,type:string,text:string>>"
VERDICTS = "array<struct<claim_index:int,verdict:string,justification:string>>"
FACTS = ("patient_fact", "doctor_fact")


def isolated(response: Column) -> Column:
    """The JSON array of a response: inside a code fence if there is one, from first to last bracket."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(response)
    return F.regexp_extract(body, r"(?s)\[.*\]", 0)


def parsed(df: DataFrame, response: str, schema: str, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejects): one row an item with its position, and the keys whose response can't be read."""
    read = df.withColumn("_items", F.from_json(isolated(F.col(response)), schema))
    bad = read.where(F.col("_items").isNull()).select(key, F.lit("unreadable response").alias("reason"))
    return read.select(key, F.posexplode("_items").alias(item, "_v")).select(key, item, "_v.*"), bad


def misaligned_claims(claims: DataFrame, turns: DataFrame) -> DataFrame:
    """Claims whose turn isn't in the transcript or has another role."""
    t = turns.select("dialogue_id", F.col("index").alias("turn_index"), F.col("role").alias("_role"))
    joined = claims.join(t, ["dialogue_id", "turn_index"], "left")
    reason = F.when(F.col("_role").isNull(), "no such turn").when(F.lower("_role") != F.lower("role"), "role differs")
    return joined.withColumn("reason", reason).where("reason is not null").drop("_role")


def misaligned_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Dialogues whose verdicts don't answer every claim exactly once."""
    c = claims.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n_claims"))
    v = verdicts.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n_verdicts"), F.countDistinct("claim_index").alias("n_distinct"), F.min("claim_index").alias("low"), F.max("claim_index").alias("high"))
    j = c.join(v, "dialogue_id", "full_outer").na.fill(0, ["n_claims", "n_verdicts", "n_distinct"])
    sound = (F.col("n_claims") == F.col("n_verdicts")) & (F.col("n_verdicts") == F.col("n_distinct")) & ((F.col("n_claims") == 0) | ((F.col("low") == 0) & (F.col("high") == F.col("n_claims") - 1)))
    return j.where(~sound)


def faithfulness(claims: DataFrame, verdicts: DataFrame, dialogues: DataFrame, role: str) -> DataFrame:
    """Supported share of a role's factual claims; unverifiable ones don't count; null with a reason if none does."""
    facts = claims.where((F.col("role") == role) & F.col("type").isin(*FACTS))
    joined = facts.join(verdicts.select("dialogue_id", "claim_index", "verdict"), ["dialogue_id", "claim_index"], "left")
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    n = joined.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("claims"), is_("supported").alias("supported"), is_("unsupported").alias("unsupported"), is_("unverifiable").alias("unverifiable"))
    out = dialogues.select("dialogue_id").distinct().join(n, "dialogue_id", "left").na.fill(0)
    value = F.try_divide(F.col("supported"), F.col("supported") + F.col("unsupported"))
    reason = F.when(F.col("claims") == 0, "no factual claims").when(value.isNull(), "no verifiable claims")
    return out.select("*", value.alias("score"), reason.alias("incomplete_reason"))


def boundary(dialogues: DataFrame, events: DataFrame) -> DataFrame:
    """1 for a dialogue without a leakage event, else 0."""
    n = events.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("events"))
    out = dialogues.select("dialogue_id").distinct().join(n, "dialogue_id", "left").na.fill(0)
    return out.withColumn("score", (F.col("events") == 0).cast("double"))


def render(turns: DataFrame) -> DataFrame:
    """(dialogue_id, transcript): lines of ``[index] role: text`` in order."""
    line = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), "role", F.lit(": "), "text")
    listed = F.array_sort(F.collect_list(F.struct("index", line.alias("line"))))
    return turns.groupBy("dialogue_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("transcript"))


def score_defect(value: Column, status: Column, reason: Column) -> Column:
    """Which rule a score breaks; null if none: an incomplete one has a reason and no value, any other a value from 0 to 1."""
    incomplete = F.lower(status) == "incomplete"
    return (
        F.when(F.coalesce(~F.lower(status).isin("pass", "fail", "incomplete"), F.lit(True)), "unknown status")
        .when(incomplete & value.isNotNull(), "an incomplete score carries a value")
        .when(incomplete & (F.coalesce(reason, F.lit("")) == ""), "an incomplete score has no reason")
        .when(~incomplete & value.isNull(), "a measured score has no value")
        .when(~incomplete & (F.isnan(value) | ~value.between(0.0, 1.0)), "a value outside 0 to 1")
    )


def judged_events(events: DataFrame, turns: DataFrame, paths: DataFrame) -> DataFrame:
    """Leakage ``events`` (dialogue_id, role, turn_index, field_path) with ``defect`` and ``leak``.

    ``paths`` (role, path, permitted) are the reference's paths and what each role may know; they
    are few and broadcast. An event of a turn that isn't there, of another role's turn or of a
    path that the reference hasn't got is defective; one of a permitted path is disclosure, no leak.
    """
    said = turns.select("dialogue_id", F.col("index").alias("turn_index"), F.lower("role").alias("_said"))
    known = paths.select(F.lower("role").alias("_of"), F.col("path").alias("field_path"), "permitted")
    held = events.withColumn("field_path", F.trim("field_path")).withColumn("_of", F.lower("role"))
    joined = held.join(said, ["dialogue_id", "turn_index"], "left").join(F.broadcast(known), ["_of", "field_path"], "left")
    defect = F.when(F.col("_said").isNull(), "no such turn").when(F.col("_said") != F.col("_of"), "role differs").when(F.col("permitted").isNull(), "no such path")
    leak = defect.isNull() & ~F.col("permitted")
    return joined.select("dialogue_id", "role", "turn_index", "field_path", defect.alias("defect"), leak.alias("leak"))
