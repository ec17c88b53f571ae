"""Operators over attempt records: final attempts, summaries, rates, costs, gates.

A record has case_id, variant, policy, attempt_index, a nullable value (null: not measured),
an acceptance and costs. A value that was not measured is null from end to end and leaves
every mean; it is counted by itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.functions.stats import wilson

# Thresholds of the gates and weights of the reported composite.
THRESHOLDS = {"patient_factuality": 0.80, "doctor_factuality": 0.80, "knowledge_boundary": 1.0, "naturalness": 0.60, "structural_validity": 1.0}
COMPOSITE = {"naturalness": 0.4, "knowledge_boundary": 0.3, "patient_factuality": 0.3}


def accepted(overall: Column, also_pass: bool = False) -> Column:
    """Whether an outcome counts as accepted; tables also take PASS, aggregates don't."""
    return F.coalesce(F.upper(overall).isin("ACCEPT", "PASS") if also_pass else F.upper(overall) == "ACCEPT", F.lit(False))


def final_first_accepted(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per key the first accepted attempt, or else the last one."""
    ok = accepted(F.col("acceptance"))
    order = [ok.desc(), F.when(ok, F.col("attempt_index")).otherwise(-F.col("attempt_index")).asc()]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def final_max_index(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per key the attempt of greatest index, by one map-side aggregate."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("attempt_index")).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def duplicated_index(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose attempts repeat an index: such a log must be refused."""
    return df.groupBy(*key, "attempt_index").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def gate(value: Column, threshold: float) -> Column:
    return F.when(value.isNull(), "incomplete").when(value >= threshold, "pass").otherwise("fail")


def decide(values: Mapping[str, Column], thresholds: Mapping[str, float] = THRESHOLDS) -> Column:
    """REJECT if a gate fails, else INCOMPLETE if one isn't measured, else ACCEPT."""
    gates = [gate(values[d], t) if d in values else F.lit("incomplete") for d, t in thresholds.items()]
    failed, missing = F.lit(False), F.lit(False)
    for g in gates:
        failed, missing = failed | (g == "fail"), missing | (g == "incomplete")
    return F.when(failed, "REJECT").when(missing, "INCOMPLETE").otherwise("ACCEPT")


def composite(values: Mapping[str, Column]) -> Column:
    """The weighted score; null if any of its terms is."""
    total = F.lit(0.0)
    for name, weight in COMPOSITE.items():
        total = total + weight * values[name]
    return total


def summary(finals: DataFrame) -> DataFrame:
    """Attempts, cases and acceptance: overall, by variant and by policy in one pass."""
    marked = finals.withColumn("_ok", accepted(F.col("acceptance")))
    sets = marked.groupingSets([[], ["variant"], ["policy"]], "variant", "policy")
    out = sets.agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("finals"),
        F.count_if("_ok").alias("n_accepted"),
        F.count_if(F.col("value").isNull()).alias("n_incomplete"),
        F.avg("value").alias("mean_value"),
    )
    return out.withColumn("acceptance_rate", F.try_divide(F.col("n_accepted"), F.col("finals")))


def dimension_summary(long: DataFrame, threshold: Column) -> DataFrame:
    """Of (dimension, value): measured, incomplete, passed, failed and the mean of what was measured."""
    measured = F.col("value").isNotNull()
    return long.groupBy("dimension").agg(
        F.count_if(measured).alias("measured"),
        F.count_if(~measured).alias("incomplete"),
        F.count_if(measured & (F.col("value") >= threshold)).alias("passed"),
        F.count_if(measured & (F.col("value") < threshold)).alias("failed"),
        F.avg("value").alias("mean_value"),
    )


def acceptance_rates(finals: DataFrame, by: Sequence[str], confidence: float = 0.95) -> DataFrame:
    counted = finals.groupBy(*by).agg(F.count_if(accepted(F.col("acceptance"), True)).alias("n_accepted"), F.count(F.lit(1)).alias("n_total"))
    rate, low, high = wilson(F.col("n_accepted"), F.col("n_total"), confidence)
    return counted.select(*by, "n_accepted", "n_total", rate.alias("rate"), low.alias("low"), high.alias("high"))


def incomplete_rates(finals: DataFrame, by: Sequence[str]) -> DataFrame:
    missing = F.col("value").isNull()
    return finals.groupBy(*by).agg(F.count_if(missing).alias("n_incomplete"), F.count(F.lit(1)).alias("n_total"), F.avg(missing.cast("double")).alias("rate"))


def costs(attempts: DataFrame, by: Sequence[str], prompt_price: float, completion_price: float) -> DataFrame:
    """Sums over all attempts, not only final ones; prices are for a million tokens."""
    sums = [F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens", "wall_ms")]
    out = attempts.groupBy(*by).agg(F.count(F.lit(1)).alias("attempts"), *sums)
    return out.withColumn("estimated_cost", (F.col("prompt_tokens") * prompt_price + F.col("completion_tokens") * completion_price) / 1e6)


# Where a call's tokens and time are; the second name counts where a call hasn't got the first.
CALL_FIELDS = {"prompt_tokens": ("prompt_tokens", "input_tokens"), "completion_tokens": ("completion_tokens", "output_tokens"), "wall_ms": ("latency_ms",)}
COST = "struct<calls: bigint, prompt_tokens: bigint, completion_tokens: bigint, wall_ms: bigint, estimated_cost: double>"


def call_costs(calls: Column, supplied: Column | None = None) -> Column:
    """The costs (``COST``) of an attempt's model calls, a JSON array of objects; fields of ``supplied``, a JSON object, take their place.

    A field that is there without a value counts as zero. Null or no calls cost nothing.
    """
    held = F.coalesce(F.from_json(calls, "array<map<string, string>>"), F.array().cast("array<map<string, string>>"))

    def at(call: Column, names: tuple[str, ...]) -> Column:
        first = call[names[0]]
        for other in names[1:]:
            first = F.when(F.map_contains_key(call, names[0]), first).otherwise(call[other])
        return F.coalesce(first.try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))

    total = lambda value, zero: F.aggregate(held, zero, lambda a, c: a + value(c))
    sums = {"calls": F.size(held).cast("bigint")}
    sums |= {k: total(lambda c, n=n: at(c, n), F.lit(0).cast("bigint")) for k, n in CALL_FIELDS.items()}
    sums["estimated_cost"] = total(lambda c: F.coalesce(c["estimated_cost"].try_cast("double"), F.lit(0.0)), F.lit(0.0))
    if supplied is not None:
        given = F.from_json(supplied, COST)
        sums = {k: F.coalesce(given[k], v) for k, v in sums.items()}
    return F.struct(*[v.alias(k) for k, v in sums.items()])


def condition_summary(attempts: DataFrame, by: Sequence[str], prompt_price: float = 0.0, completion_price: float = 0.0) -> DataFrame:
    """Per condition: attempts and cases, accepted cases and terminal failures, their rates, sums of costs, and cost a case.

    A case is accepted by any of its attempts. Attempts are summed up by case first, so a condition's shuffle has a row a case.
    """
    sums = ("calls", "prompt_tokens", "completion_tokens", "wall_ms")
    ok = F.coalesce(accepted(F.col("acceptance")), F.lit(False))
    cases = attempts.groupBy(*by, "case_id").agg(F.count(F.lit(1)).alias("attempts"), F.max(ok).alias("_ok"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    out = cases.groupBy(*by).agg(F.sum("attempts").alias("attempts"), F.count(F.lit(1)).alias("cases"), F.count_if("_ok").alias("accepted_cases"), *[F.sum(c).alias(c) for c in sums])
    n, cost = F.col("cases"), (F.col("prompt_tokens") * prompt_price + F.col("completion_tokens") * completion_price) / 1e6
    return out.select(
        *by, "attempts", "cases", "accepted_cases", (n - F.col("accepted_cases")).alias("terminal_failures"), (F.col("accepted_cases") / n).alias("acceptance_rate"), (F.col("attempts") / n).alias("attempts_per_case"),
        *sums, cost.alias("estimated_cost"), (cost / n).alias("cost_per_case"),
    )


def latest(new: DataFrame, old: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    return new.unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti"))
