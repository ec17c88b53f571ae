"""Clinical entities derived from the driver's tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.functions.text import strip
from clinloom.operators import cohort
from clinloom.sources.tables import load

GROUPS = 200


def admissions(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    days = F.when(F.col("o_orderkey") % 97 == 0, F.lit(-1)).otherwise((F.col("o_orderkey") % 12).cast("int"))
    return o.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").alias("admittime"),
        F.timestamp_add("DAY", days, F.col("o_orderdate")).alias("dischtime"),
        F.when(F.col("o_orderkey") % 53 == 0, F.lit("NEWBORN ")).otherwise(F.col("o_orderpriority")).alias("admission_type"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 20 == 0)).alias("expired"),
        F.when(F.col("o_orderkey") % 151 == 0, F.col("o_orderdate")).alias("deathtime"),
    )


def patients(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    dob = F.make_date((F.lit(1997) - k % 100).cast("int"), (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int"))
    return load(spark, d, "customer").select(k.alias("subject_id"), dob.alias("dob"), F.col("c_mktsegment").alias("segment"))


def icu_stays(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "lineitem").where("l_returnflag = 'R'")
    return i.select(F.col("l_orderkey").alias("hadm_id"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 25).alias("los"))


def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    raw = F.lpad((F.col("l_partkey") * 37 % 100000).cast("string"), 5, "0")
    code = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.substring(raw, 1, 3), F.lit("."), F.substring(raw, 4, 2))).otherwise(raw)
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), code.alias("code"))


def procedures(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("l_suppkey") % 25 == 0, F.concat(F.lit("96.7"), (F.col("l_suppkey") % 4).cast("string"))).otherwise(F.lpad((F.col("l_suppkey") * 11 % 10000).cast("string"), 4, "0"))
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), code.alias("code"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return load(spark, d, "documents").select(
        k.alias("row_id"), (k % GROUPS).alias("hadm_id"),
        F.when(k % 7 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (k % 30).cast("int"))).alias("chartdate"),
        F.when(k % 5 == 0, "Nursing").when(k % 2 == 0, "Discharge summary ").otherwise("discharge summary").alias("category"), "text",
    )


def note_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Length of each group's discharge notes; the texts themselves stay where they are."""
    n = notes(spark, d).where("lower(trim(category)) = 'discharge summary'")
    return n.groupBy("hadm_id").agg(F.sum(F.length(strip(F.col("text"), unicode=False)).cast("long")).alias("note_chars"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """One row an admission with everything the criteria read."""
    adm = admissions(spark, d).join(patients(spark, d).where("dob is not null"), "subject_id")
    icu = cohort.icu_totals(icu_stays(spark, d))
    dx = cohort.diagnosis_flags(diagnoses(spark, d))
    vent = cohort.ventilation_flags(procedures(spark, d))
    sized = note_sizes(spark, d).withColumnRenamed("hadm_id", "note_group")
    out = adm.join(icu, "hadm_id", "left").join(dx, "hadm_id", "left").join(vent, "hadm_id", "left")
    # At most GROUPS rows, whatever the number of documents.
    out = out.join(F.broadcast(sized), out.hadm_id % GROUPS == sized.note_group, "left")
    return out.select(
        "subject_id", "hadm_id", "admittime", "dischtime", "admission_type", "expired", "deathtime",
        cohort.full_years(F.col("dob"), F.to_date("admittime")).alias("age"),
        F.col("icu_days").isNotNull().alias("has_icu"), F.coalesce("icu_days", F.lit(0.0)).alias("icu_days"),
        F.coalesce("charlson", F.lit(0)).alias("charlson"), F.coalesce("high_acuity", F.lit(False)).alias("high_acuity"),
        F.coalesce("n_codes", F.lit(0)).alias("n_codes"), F.coalesce("ventilated", F.lit(False)).alias("ventilated"),
        cohort.stay_days(F.col("admittime"), F.col("dischtime")).alias("stay"),
        F.when(F.col("note_chars").isNotNull(), "Discharge summary").otherwise("").alias("note_category"),
        F.coalesce("note_chars", F.lit(0)).alias("note_chars"),
    )


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that can be evaluated, with the criteria each meets, E10 included. Without both dates and an age none can."""
    sound = candidates(spark, d).where(cohort.malformed_reason().isNull()).dropna(subset=["admittime", "dischtime", "age"])
    return cohort.with_first_admission(sound.withColumn("fired", cohort.fired(cohort.Criteria())))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempt records from events: a case is a user, a variant an event type, a policy a bucket of props."""
    e = load(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.when(F.col("event_id") % 11 != 0, F.least(F.lit(1.0), F.col("value") / 100))
    accepted = F.when(F.col("event_id") % 11 == 0, "INCOMPLETE").when(F.col("value") >= 60, F.when(F.col("event_id") % 2 == 0, "ACCEPT").otherwise("PASS")).otherwise("REJECT")
    return e.select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("variant"), F.concat(F.lit("P"), (k % 3).cast("string")).alias("policy"),
        F.col("event_id").alias("attempt_index"), "ts", value.alias("value"), accepted.alias("acceptance"),
        (F.col("event_id") % 5 + 1).alias("calls"), (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 300).alias("completion_tokens"), (F.col("event_id") % 7000).alias("wall_ms"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select(F.col("conv_id").alias("dialogue_id"), F.col("turn").alias("index"), "role", "text")


SQL = """
admissions AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
  o_orderdate + to_days(CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE (o_orderkey % 12)::INTEGER END) AS dischtime,
  CASE WHEN o_orderkey % 53 = 0 THEN 'NEWBORN ' ELSE o_orderpriority END AS admission_type,
  o_orderstatus = 'F' AND o_orderkey % 20 = 0 AS expired, CASE WHEN o_orderkey % 151 = 0 THEN o_orderdate END AS deathtime FROM orders),
patients AS (SELECT c_custkey AS subject_id, c_mktsegment AS segment,
  make_date((1997 - c_custkey % 100)::INTEGER, (c_custkey % 12 + 1)::INTEGER, (c_custkey % 28 + 1)::INTEGER) AS dob FROM customer),
icu_stays AS (SELECT l_orderkey AS hadm_id, CASE WHEN l_linenumber <> 7 THEN l_quantity / 25 END AS los
  FROM lineitem WHERE l_returnflag = 'R'),
diagnoses AS (SELECT hadm_id, CASE WHEN p % 3 = 0 THEN substr(raw, 1, 3) || '.' || substr(raw, 4, 2) ELSE raw END AS code
  FROM (SELECT l_orderkey AS hadm_id, l_partkey AS p, lpad((l_partkey * 37 % 100000)::VARCHAR, 5, '0') AS raw FROM lineitem)),
procedures AS (SELECT l_orderkey AS hadm_id, CASE WHEN l_suppkey % 25 = 0 THEN '96.7' || (l_suppkey % 4)::VARCHAR
  ELSE lpad((l_suppkey * 11 % 10000)::VARCHAR, 4, '0') END AS code FROM lineitem),
notes AS (SELECT doc_id AS row_id, doc_id % 200 AS hadm_id, text,
  CASE WHEN doc_id % 7 <> 0 THEN DATE '2020-01-01' + (doc_id % 30)::INTEGER END AS chartdate,
  CASE WHEN doc_id % 5 = 0 THEN 'Nursing' WHEN doc_id % 2 = 0 THEN 'Discharge summary ' ELSE 'discharge summary' END AS category FROM documents),
attempts AS (SELECT user_id AS case_id, event_type AS variant, 'P' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 3)::VARCHAR AS policy,
  event_id AS attempt_index, ts, CASE WHEN event_id % 11 <> 0 THEN least(1.0, value / 100) END AS value,
  CASE WHEN event_id % 11 = 0 THEN 'INCOMPLETE' WHEN value >= 60 THEN CASE WHEN event_id % 2 = 0 THEN 'ACCEPT' ELSE 'PASS' END ELSE 'REJECT' END AS acceptance,
  event_id % 5 + 1 AS calls, event_id % 1000 AS prompt_tokens, event_id % 300 AS completion_tokens, event_id % 7000 AS wall_ms FROM events),
turns AS (SELECT conv_id AS dialogue_id, turn AS index, role, text,
  CASE WHEN lower(role) IN ('user', 'patient') THEN 'Patient' WHEN lower(role) IN ('assistant', 'doctor', 'physician') THEN 'Doctor' END AS who FROM conversations)
"""
