"""Policy discrimination: can the policy be told from the text? TF-IDF and logistic regression.

Cases, not dialogues, are split, by hash rank, so no case is on both sides. Terms are the
words and word pairs of the training side, all of them, by 64-bit hashes. Neither they nor their
coefficients are ever together: see ``logistic``. Only the strongest are looked up in the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.operators import logistic
from clinloom.operators.statistics import auc, hash_ranked

#: ``weighted`` refuses more terms than this rather than leave them out: it has them as one vocabulary.
MOST_TERMS = 1 << 24


def case_split(df: DataFrame, share: float = 0.25, seed: str = "0") -> DataFrame:
    """``df`` with ``test``: true for round(n * share) of the n cases, at least one and not all, of least hash.

    Halves round to even. With fewer than two cases there is nothing to hold out and it raises.
    """
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    cases = df.select("case_id").distinct()
    n = cases.count()
    if n == 1:
        raise ValueError("one case can't be split")
    held = max(1, min(n - 1, round(n * share)))
    ranked = hash_ranked(cases, [], "case_id", "_rank", digest=F.sha2(F.concat_ws("|", F.lit(seed), F.col("case_id").cast("string")), 256))
    return df.join(ranked.select("case_id", (F.col("_rank") < held).alias("test")), "case_id")


@F.udf(VectorUDT())
def _sublinear(v):
    """1 + log of each count; one of the few steps on vectors that no built-in has."""
    return SparseVector(v.size, v.indices, 1 + np.log(v.values))


def terms(text: str) -> Column:
    """Words of two characters or more, lower-cased, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.array_compact(pairs))


@dataclass(frozen=True)
class Discrimination:
    """The held-out result: rows a policy, accuracy, macro one-vs-rest AUC and the strongest terms a policy."""

    by_policy: DataFrame
    accuracy: float | None
    macro_auc: float | None
    top: DataFrame


def weighted(train: DataFrame, test: DataFrame, column: str = "_terms") -> tuple[DataFrame, DataFrame, Sequence[str]]:
    """Both sides with ``features``: sublinear counts times log((1 + n) / (1 + df)) + 1 of the training side, at length 1."""
    counter = CountVectorizer(inputCol=column, outputCol="_counts", vocabSize=MOST_TERMS, minDF=1.0).fit(train)
    if len(counter.vocabulary) >= MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    held = counter.transform(train)
    idf = IDF(inputCol="_counts", outputCol="_i").fit(held).idf.toArray() + 1
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_logs", outputCol="_weights")
    norm = Normalizer(inputCol="_weights", outputCol="features", p=2.0)
    made = lambda df: norm.transform(scale.transform(df.withColumn("_logs", _sublinear("_counts"))))
    return made(held), made(counter.transform(test)), counter.vocabulary


def discriminate(df: DataFrame, share: float = 0.25, seed: str = "0", top: int = 10) -> Discrimination:
    """A classifier of ``policy`` by ``text``, fitted on the training cases and judged on the others.

    Regularised as a unit of squared weights against the summed loss. Null texts don't count;
    policies that only the test side has are judged wrong, with a null AUC.
    """
    if top < 1:
        raise ValueError("top must be positive")
    parts = case_split(df.where("text is not null and policy is not null"), share, seed)
    met = parts.groupBy("policy").agg(F.count_if(~F.col("test")).alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    met.sort(key=lambda r: (not r["n"], str(r["policy"])))  # those that only the test side has come last
    names, held = [r["policy"] for r in met], [r["n"] for r in met if r["n"]]
    k, n = len(held), sum(held)
    if k < 2:
        raise ValueError("at least two policies are needed")
    kind = parts.schema["policy"].dataType
    named = lambda i: F.element_at(F.array(*(F.lit(p).cast(kind) for p in names)), i + 1)
    labels = df.sparkSession.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("label", T.IntegerType()), T.StructField("policy", kind)]))
    hashed = parts.join(F.broadcast(labels), "policy").select("label", "test", F.transform(terms("text"), lambda t: F.xxhash64(t)).alias("terms"))
    model = logistic.fit(hashed, k, n, sum(r["chars"] for r in met), held)
    said = model.said.withColumn("policy", named(F.col("label")))
    right = F.col("label") == F.array_position("scores", F.array_max("scores")) - 1
    counts = said.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_correct"))
    each = F.transform("scores", lambda p, i: F.struct(i.alias("k"), p.alias("score")))
    long = said.select("label", F.explode(each).alias("x")).select(named(F.col("x.k")).alias("policy"), F.col("x.score").alias("score"), (F.col("label") == F.col("x.k")).alias("is_corrupted"))
    rows = counts.join(auc(long, ["policy"]).select("policy", "auc"), "policy", "left").withColumn("accuracy", F.col("n_correct") / F.col("n")).withColumn("n_policies", F.lit(k))
    total = rows.agg((F.sum("n_correct") / F.sum("n")).alias("accuracy"), F.avg("auc").alias("auc")).first()
    return Discrimination(rows, total["accuracy"], total["auc"], _strongest(parts, model.strongest(top), named, top))


def _strongest(parts: DataFrame, strongest: DataFrame, named: Callable[[Column], Column], top: int) -> DataFrame:
    """The ``top`` terms of each policy, equals by term, of the (term, k, weight) of so many hashes a part; these few are looked up in the training texts."""
    place = F.rank().over(Window.partitionBy("k").orderBy(F.desc("weight")))
    some = strongest.withColumn("place", place).where(F.col("place") <= top).drop("place")
    words = parts.where("not test").select(F.explode(terms("text")).alias("feature")).withColumn("term", F.xxhash64("feature"))
    strong = words.join(F.broadcast(some), "term").select("k", "feature", "weight").distinct()
    ranked = strong.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("weight"), "feature")))
    return ranked.where(F.col("rank") <= top).select(named(F.col("k")).alias("policy"), "rank", "feature", "weight")
