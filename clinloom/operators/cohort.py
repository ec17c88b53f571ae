"""Cohort operators: candidates, exclusion criteria, flow, first admission, hash-ranked sample.

Inputs are admission-shaped DataFrames; see ``clinloom.sources.tables`` for the schemas.
Code lists are reduced to one row an admission (bits and flags) before any join, so a join
never carries arrays of codes that no later step reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.functions import icd9, lenient

#: First part of every sample key, unless the caller names another to reproduce older samples.
SAMPLE_TAG = "cohort-sample-v1"
ORDER = ("E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8", "E9", "E10")


@dataclass(frozen=True)
class Criteria:
    """Thresholds of the exclusion criteria."""

    icu_days: float = 1.0
    least_age: float = 12
    age_below: float = 90
    stay_days: float = 7.0
    charlson: int = 2
    note_chars: int = 500
    categories: tuple[str, ...] = ("discharge summary",)


def full_years(born: Column, at: Column) -> Column:
    """Completed calendar years between two dates."""
    early = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(at) - F.year(born) - F.when(early, 1).otherwise(0)


def stay_days(admitted: Column, discharged: Column) -> Column:
    """Length of stay in days, as a double."""
    return (F.unix_micros(discharged.cast("timestamp")) - F.unix_micros(admitted.cast("timestamp"))) / 86_400_000_000


def icu_totals(stays: DataFrame) -> DataFrame:
    """(hadm_id, icu_days): the sum of stays, infinite if any length is unknown.

    Summed as decimals, so that three stays of a day in all are a day in whatever order they are added; as
    doubles some are a bit less. Twelve places are more than lengths have; what no decimal holds is summed as it is.
    """
    exact = F.col("los").try_cast("decimal(38,12)")
    known = F.when(F.bool_or(exact.isNull()), F.sum("los").cast("double")).otherwise(F.sum(exact).cast("double"))
    total = F.when(F.bool_or(F.col("los").isNull()), F.lit(float("inf"))).otherwise(known)
    return stays.where("hadm_id is not null").groupBy("hadm_id").agg(total.alias("icu_days"))


def distinct_codes(codes: DataFrame) -> DataFrame:
    """(hadm_id, codes): normalised distinct codes in order; null keys and codes don't count."""
    held = codes.where("hadm_id is not null and code is not null").select("hadm_id", icd9.normalise(F.col("code")).alias("code"))
    return held.groupBy("hadm_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def diagnosis_flags(codes: DataFrame) -> DataFrame:
    """(hadm_id, charlson, high_acuity, n_codes) by map-side bit unions instead of code lists."""
    held = codes.where("hadm_id is not null and code is not null").select("hadm_id", icd9.normalise(F.col("code")).alias("code"))
    bits = held.select("hadm_id", "code", icd9.charlson_mask(F.col("code")).alias("mask"), icd9.is_high_acuity(F.col("code")).alias("acute"))
    found = bits.groupBy("hadm_id").agg(F.bit_or("mask").alias("mask"), F.bool_or("acute").alias("high_acuity"), F.countDistinct("code").alias("n_codes"))
    return found.select("hadm_id", icd9.charlson_score(F.col("mask")).alias("charlson"), "high_acuity", "n_codes")


def ventilation_flags(codes: DataFrame) -> DataFrame:
    hit = icd9.normalise(F.col("code")).isin(*icd9.VENTILATION)
    return codes.where("hadm_id is not null and code is not null").groupBy("hadm_id").agg(F.bool_or(hit).alias("ventilated"))


def concatenated_notes(notes: DataFrame, category: str = "discharge summary") -> DataFrame:
    """One row an admission: its notes joined in order of (dated, date, row), and the longest one's row.

    Undated notes come first; empty notes are skipped; of equally long ones the first counts.
    """
    kept = notes.where((F.lower(F.trim("category")) == category) & F.col("hadm_id").isNotNull())
    kept = kept.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")).where("text != ''")
    item = F.struct(F.col("chartdate").isNotNull().alias("dated"), "chartdate", "row_id", "text")
    joined = kept.groupBy("hadm_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    sized = F.transform("items", lambda x, i: F.struct(F.length(x["text"]).alias("n"), (-i).alias("p"), x["row_id"].alias("row_id")))
    return joined.select("hadm_id", F.array_join(F.transform("items", lambda x: x["text"]), "\n\n").alias("note_text"), F.array_max(sized)["row_id"].alias("longest_row"), F.size("items").alias("n_notes"))


def fired(c: Criteria) -> Column:
    """The criteria E1 to E9 that an admission meets, in order."""
    kind = F.lower(F.trim("admission_type"))
    tests = [
        F.coalesce(F.col("has_icu") & (F.col("icu_days") >= c.icu_days), F.lit(False)),
        F.coalesce(F.col("expired"), F.lit(False)) | F.col("deathtime").isNotNull(),
        F.col("ventilated"),
        kind.isin("newborn", "neonatal") | (F.col("age") < c.least_age),
        F.col("age") >= c.age_below,
        F.col("high_acuity"),
        F.col("stay") > c.stay_days,
        F.col("charlson") > c.charlson,
        ~F.lower(F.trim("note_category")).isin(*c.categories) | (F.col("note_chars") < c.note_chars),
    ]
    return F.array_compact(F.array(*[F.when(t, F.lit(code)) for code, t in zip(ORDER, tests, strict=False)]))


def malformed_reason() -> Column:
    """Why an admission can't be evaluated; null if it can. Identifiers are positive; the first reason counts."""
    return (
        F.when(F.coalesce(F.col("subject_id") <= 0, F.lit(True)) | F.coalesce(F.col("hadm_id") <= 0, F.lit(True)), "identifier")
        .when(F.col("age") < 0, "negative age")
        .when(F.col("dischtime") < F.col("admittime"), "discharge before admission")
    )


#: Columns of a candidate and what they are read as; deathtime and row_id may be missing or null.
CANDIDATE = {
    "subject_id": "long", "hadm_id": "long", "admittime": "timestamp", "dischtime": "timestamp", "age_years": "double", "admission_type": "text", "has_icu_stay": "flag",
    "hospital_expire_flag": "flag", "procedure_icd9_codes": "codes", "diagnosis_icd9_codes": "codes", "note_text": "text", "note_category": "text",
}


def parsed_candidates(raw: DataFrame) -> DataFrame:
    """``raw`` candidates with typed columns and a ``reason``: the first column that can't be read, or null.

    A required column that isn't there raises: a missing one must not look like a reassuring false.
    """
    if missing := sorted(set(CANDIDATE) - set(raw.columns)):
        raise ValueError(f"candidates lack required columns: {', '.join(missing)}")
    read = {"long": lenient.as_long, "double": lenient.as_double, "timestamp": lenient.as_timestamp, "flag": lenient.as_bool, "codes": lenient.as_codes, "text": lambda c: F.coalesce(c.cast("string"), F.lit(""))}
    listed = {f.name for f in raw.schema if isinstance(f.dataType, T.ArrayType)}
    typed = {c: F.array_compact(F.coalesce(F.col(c), F.array())).cast("array<string>") if c in listed else read[kind](F.col(c)) for c, kind in CANDIDATE.items()}
    reason = F.coalesce(*[F.when(typed[c].isNull(), F.lit(c)) for c, kind in CANDIDATE.items() if kind not in ("codes", "text")])
    if "deathtime" in raw.columns:
        given = F.nullif(lenient.as_text(F.col("deathtime")), F.lit(""))
        typed["deathtime"] = lenient.as_timestamp(given)
        reason = F.coalesce(reason, F.when(given.isNotNull() & typed["deathtime"].isNull(), F.lit("deathtime")))
    else:
        typed["deathtime"] = F.lit(None).cast("timestamp")
    typed["row_id"] = lenient.as_long(F.col("row_id")) if "row_id" in raw.columns else F.lit(None).cast("long")
    return raw.select(*[c.alias(n) for n, c in typed.items()], reason.alias("reason"))


def with_first_admission(df: DataFrame) -> DataFrame:
    """E10 added to every admission of a subject but the first of those that meet no other criterion."""
    w = Window.partitionBy("subject_id", F.size("fired") == 0).orderBy("admittime", "hadm_id")
    later = (F.size("fired") == 0) & (F.row_number().over(w) > 1)
    return df.withColumn("fired", F.when(later, F.array(F.lit("E10"))).otherwise(F.col("fired")))


def exclusion_flow(df: DataFrame) -> DataFrame:
    """Ten rows: those entering, excluded by (first criterion met) and remaining after each step."""
    spark = df.sparkSession
    first = df.groupBy(F.try_element_at("fired", F.lit(1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    steps = spark.createDataFrame([(i, c) for i, c in enumerate(ORDER, 1)], "step int, code string")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = steps.join(F.broadcast(first.where("code is not null")), "code", "left").crossJoin(F.broadcast(total))
    gone = F.coalesce("n", F.lit(0)).cast("long")
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("excluded", gone).withColumn("entering", F.col("total") - F.coalesce(F.sum("excluded").over(before), F.lit(0)))
    return out.select("step", "code", "entering", "excluded", (F.col("entering") - F.col("excluded")).alias("remaining"))


def sample_key(snapshot: str, seed: str, subject: Column, hadm: Column, tag: str = SAMPLE_TAG) -> Column:
    """The hash by which a sample is ranked: the same admissions whatever the order of the input."""
    parts = [F.lit(tag), F.lit(snapshot), F.lit(seed), subject.cast("string"), hadm.cast("string")]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def hash_sample(df: DataFrame, n: int, snapshot: str, seed: str, tag: str = SAMPLE_TAG) -> DataFrame:
    """The ``n`` admissions of least key, ranked from 1."""
    keyed = df.withColumn("sample_key", sample_key(snapshot, seed, F.col("subject_id"), F.col("hadm_id"), tag))
    least = keyed.orderBy("sample_key", "subject_id", "hadm_id").limit(n)
    return least.withColumn("selection_rank", F.row_number().over(Window.orderBy("sample_key", "subject_id", "hadm_id")))


class Shortage(ValueError):
    """Fewer eligible admissions than were asked for; carries the exclusion flow, which tells why."""

    def __init__(self, requested: int, available: int, flow: list):
        self.requested, self.available, self.flow = requested, available, flow
        super().__init__(f"requested {requested} cases, but only {available} are eligible: " + "; ".join(f"{r['code']} excluded {r['excluded']} of {r['entering']}" for r in flow))


def select_cases(evaluated: DataFrame, n: int, snapshot: str, seed: str, tag: str = SAMPLE_TAG) -> DataFrame:
    """The hash sample of ``n`` eligible admissions; raises if an admission is there twice or too few are eligible."""
    if n <= 0 or not snapshot.strip():
        raise ValueError("n must be positive and the snapshot's hash given")
    if not evaluated.groupBy("subject_id", "hadm_id").count().where("count > 1").isEmpty():
        raise ValueError("an admission is in the candidates more than once")
    eligible = evaluated.where(F.size("fired") == 0)
    available = eligible.count()
    if available < n:
        raise Shortage(n, available, exclusion_flow(evaluated).orderBy("step").collect())
    return hash_sample(eligible, n, snapshot, seed, tag)


def audit(evaluated: DataFrame, selected: DataFrame) -> DataFrame:
    """(hadm_id, subject_id, status, fired) of every evaluated admission: excluded, selected, or eligible and not sampled."""
    picked = selected.select("hadm_id", F.lit(True).alias("_picked"))
    status = F.when(F.size("fired") > 0, "excluded").when(F.col("_picked"), "selected").otherwise("eligible_not_sampled")
    return evaluated.join(picked, "hadm_id", "left").select("hadm_id", "subject_id", status.alias("status"), "fired")
