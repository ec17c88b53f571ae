"""Fault injection: labelled corruptions of dialogues, chosen by hash.

Every (dialogue, fault) is corrupted independently; the turn is the one of least
SHA-256 of (seed, dialogue, fault, index) among those that qualify, so the choice needs no
generator state and any engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinloom.functions import text as tx

# Fault, role whose turn is corrupted, sentence that is added.
FAULTS = (
    ("role_order_violation", None, None),
    ("empty_turn", None, None),
    ("patient_diagnosis_leakage", "Patient", "I already know that my diagnosis is {label}."),
    ("patient_treatment_leakage", "Patient", "I already know the prescribed treatment is {label}."),
    ("fabricated_patient_symptom", "Patient", "I also have {label}."),
    ("doctor_hidden_fact_leakage", "Doctor", "Your hidden record states {label}."),
    ("fabricated_doctor_fact", "Doctor", "The record confirms {label}."),
)


def inject(turns: DataFrame, labels: DataFrame, seed: str) -> DataFrame:
    """All turns of all corrupted copies; ``hit`` marks the corrupted turn.

    ``labels`` has (dialogue_id, fault, label) for faults that add a sentence. A dialogue
    without a turn that qualifies has no copy for that fault.
    """
    spark = turns.sparkSession
    faults = spark.createDataFrame(FAULTS, "fault string, fault_role string, sentence string")
    w = Window.partitionBy("dialogue_id").orderBy("index")
    seen = turns.withColumn("_who", tx.role(F.col("role"))).withColumn("_before", F.lag("role").over(w))
    wide = seen.crossJoin(F.broadcast(faults)).join(labels, ["dialogue_id", "fault"], "left")
    fits = F.when(F.col("fault") == "role_order_violation", F.col("_before").isNotNull() & (F.col("_before") != F.col("role")))
    fits = fits.when(F.col("fault") == "empty_turn", F.lit(True)).otherwise((F.col("_who") == F.col("fault_role")) & F.col("label").isNotNull())
    draw = F.sha2(F.concat_ws("|", F.lit(seed), F.col("dialogue_id").cast("string"), "fault", F.col("index").cast("string")), 256)
    drawn = wide.withColumn("_draw", F.when(fits, draw))
    least = F.min("_draw").over(Window.partitionBy("dialogue_id", "fault"))
    marked = drawn.withColumn("_least", least).where("_least is not null").withColumn("hit", F.coalesce(F.col("_draw") == F.col("_least"), F.lit(False)))
    added = F.concat("text", F.when(F.col("text").rlike(r"[ \n]$") | (F.col("text") == ""), "").otherwise(" "), F.replace("sentence", F.lit("{label}"), "label"))
    text = F.when(~F.col("hit") | (F.col("fault") == "role_order_violation"), F.col("text")).when(F.col("fault") == "empty_turn", "").otherwise(added)
    role = F.when(F.col("hit") & (F.col("fault") == "role_order_violation"), F.col("_before")).otherwise(F.col("role"))
    return marked.select("dialogue_id", "fault", "index", role.alias("role"), text.alias("text"), "hit", "label")


def recovered(corrupted: DataFrame) -> DataFrame:
    """Per (dialogue, fault): whether the corruption can be told from the corrupted turns."""
    w = Window.partitionBy("dialogue_id", "fault").orderBy("index")
    seen = corrupted.withColumn("_before", F.lag("role").over(w))
    ok = F.when(F.col("fault") == "empty_turn", F.trim("text") == "").when(F.col("fault") == "role_order_violation", F.col("role") == F.col("_before")).otherwise(F.contains("text", "label"))
    return seen.where("hit").groupBy("dialogue_id", "fault").agg(F.count(F.lit(1)).alias("n_hits"), F.min("index").alias("hit_index"), F.bool_and(ok).alias("recovered"))
