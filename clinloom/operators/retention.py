"""Retention: what of the coded record can still be told from a dialogue, policy by policy.

Facts are extracted by a model of a family that had no part in making the dialogue; they are
tables of entities here. They are matched to the coded ones one to one, and each policy's
counts get intervals over cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.operators import intervals, matching


def checked(cases: DataFrame) -> DataFrame:
    """``cases`` (policy, case_id, extractor, generators); raises on a case that is there twice, and where the extractor also generated."""
    if twice := cases.groupBy("policy", "case_id").count().where("count > 1").limit(1).collect():
        raise ValueError(f"retention case {twice[0]['case_id']}/{twice[0]['policy']} is there more than once")
    if same := cases.where(F.array_contains("generators", F.col("extractor"))).limit(1).collect():
        raise ValueError(f"family {same[0]['extractor']} both generated and extracted case {same[0]['case_id']}")
    return cases


def retention(cases: DataFrame, extracted: DataFrame, coded: DataFrame, pairs: DataFrame, resamples: int = 2000, seed: str = "0") -> DataFrame:
    """(policy, metric, estimate, low, high) over the checked ``cases``.

    ``extracted`` (policy, case_id, extracted), ``coded`` (policy, case_id, coded) and the graded
    ``pairs`` of both. A case without entities on either side counts with zeros.
    """
    by = ["policy", "case_id"]
    counts = matching.grounding_counts(extracted, coded, matching.assign(pairs, by), by)
    full = checked(cases).select(*by).join(counts.select(*by, "tp", "fp", "fn"), by, "left").na.fill(0)
    return intervals.count_intervals(full, ["policy"], resamples, seed)
