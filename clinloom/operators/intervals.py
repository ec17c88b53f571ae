"""Case-clustered bootstrap intervals of detectors, grounding and scores.

Cases are numbered by hash order and drawn by SHA-256 (see ``statistics``), so any engine can
repeat the draws. Observations are summed up by case before any is drawn; a case is a row for
each time that it is drawn, and its sums are added up where it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.operators.statistics import RANGES, matched, resampled, resampled_sums


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def summarised(replicates: DataFrame, by: Sequence[str], metrics: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """(by, metric, estimate, low, high) from one row a replicate; replicate -1 is the estimate.

    A metric that no replicate has gets a zero-width interval.
    """
    long = replicates.select(*by, "replicate", F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "value"))
    drawn, tail = F.when(F.col("replicate") >= 0, F.col("value")), (1 - confidence) / 2
    out = long.groupBy(*by, "metric").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("estimate"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high")
    )
    return out.select(*by, "metric", "estimate", F.coalesce("low", "estimate").alias("low"), F.coalesce("high", "estimate").alias("high"))


def _prf() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def detector_intervals(df: DataFrame, by: Sequence[str], resamples: int = 2000, seed: str = "0", confidence: float = 0.95) -> DataFrame:
    """Precision, recall, F1, AUC and localisation of a detector, with intervals over cases.

    ``df`` has case_id, is_corrupted, predicted, score, truth_turn and predicted_turns.
    Localisation is the share of detected corruptions whose turn is among the predicted ones.
    A class without both kinds of observations has a null AUC; replicates without both don't count for it.
    """
    truth, said = F.col("is_corrupted"), F.col("predicted")
    found = truth & said & F.coalesce(F.array_contains("predicted_turns", F.col("truth_turn")), F.lit(False))
    n = {"tp": truth & said, "fp": ~truth & said, "fn": truth & ~said, "located": found, "pos": truth, "neg": ~truth}
    held = df.groupBy(*by, "case_id", "score").agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    cuts = held.groupBy(*by).agg(F.percentile_approx("score", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])).alias("_cuts"))
    held = matched(held, cuts, by, "left").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    drawn = matched(resampled(df.select(*by, "case_id").distinct(), by, resamples, seed), held, [*by, "case_id"])
    at = drawn.groupBy(*by, "replicate", "_range", "score").agg(*[F.sum(k).alias(k) for k in n])
    # Scores are ranked inside ranges; a range starts with what the ranges before it have.
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("neg").over(back(Window.partitionBy(*by, "replicate", "_range").orderBy("score"))), F.lit(0))
    parts = at.withColumn("_inside", inside).groupBy(*by, "replicate", "_range").agg(*[F.sum(k).alias(k) for k in n], F.sum(F.col("pos") * (F.col("_inside") + F.col("neg") / 2)).alias("wins"))
    before = F.coalesce(F.sum("neg").over(back(Window.partitionBy(*by, "replicate").orderBy("_range"))), F.lit(0))
    sums = parts.withColumn("wins", F.col("wins") + F.col("pos") * before).groupBy(*by, "replicate").agg(*[F.sum(k).alias(k) for k in (*n, "wins")])
    each = sums.select(*by, "replicate", *_prf(), F.try_divide(F.col("wins"), F.col("pos") * F.col("neg")).alias("auc"), ratio(F.col("located"), F.col("tp")).alias("localisation"))
    return summarised(each, by, ("precision", "recall", "f1", "auc", "localisation"), confidence)


def count_intervals(cases: DataFrame, by: Sequence[str], resamples: int = 2000, seed: str = "0", confidence: float = 0.95) -> DataFrame:
    """Precision, recall and F1 of summed counts with intervals; ``cases`` has case_id, tp, fp and fn."""
    sums = resampled_sums(cases.select(*by, "case_id", "tp", "fp", "fn"), by, ["tp", "fp", "fn"], resamples, seed)
    return summarised(sums.select(*by, "replicate", *_prf()), by, ("precision", "recall", "f1"), confidence)


def score_rows(scores: DataFrame, resamples: int = 2000, seed: str = "0", confidence: float = 0.95, by: Sequence[str] = ("variant", "policy", "metric")) -> DataFrame:
    """Per group of (case_id, value): cases and scores measured, incomplete ones, and the pooled mean with its interval.

    A group in which nothing was measured has null estimates and says so.
    """
    by = list(by)
    counts = scores.groupBy(*by).agg(
        F.count_distinct(F.when(F.col("value").isNotNull(), F.col("case_id"))).alias("n_cases"), F.count("value").alias("n_scores"), F.count_if(F.col("value").isNull()).alias("n_incomplete")
    )
    cases = scores.where("value is not null").groupBy(*by, "case_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    means = resampled_sums(cases, by, ["total", "n"], resamples, seed).select(*by, "replicate", (F.col("total") / F.col("n")).alias("mean"))
    rows = matched(counts, _mean_rows(means, by, confidence), by, "left")
    method = F.when(F.col("n_scores") > 0, f"case-clustered percentile bootstrap (B={resamples})").otherwise("all scores INCOMPLETE")
    return rows.select(*by, "estimate", "low", "high", F.lit(confidence).alias("confidence"), method.alias("method"), "n_cases", "n_scores", "n_incomplete")


def _mean_rows(means: DataFrame, by: Sequence[str], confidence: float) -> DataFrame:
    drawn, tail = F.when(F.col("replicate") >= 0, F.col("mean")), (1 - confidence) / 2
    return means.groupBy(*by).agg(F.max(F.when(F.col("replicate") < 0, F.col("mean"))).alias("estimate"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high"))
