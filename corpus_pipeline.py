"""A training corpus from raw documents: quality, near duplicates, PII, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a
DataFrame; what one stage returns is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``.

Defined cases, of every stage: null texts are as empty ones (the quality score decides on them as on others), rows with
null or repeated ids are rows of their own, an empty table gives an empty one, columns beyond those of ``documents`` stay whatever
their names, and texts are worked on whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm import ngram_jaccard, nnls_pack, pfair_mix, pii_feistel, quality_cnn
from clinloom.llm.queries import PII_KEY, QUALITY_KEEP, byte_bpe
from clinloom.llm.slices import private
from clinloom.session import discard, materialize, release, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on the labelled ones, doesn't reject."""
    model = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = private(docs, "score")["score"]
    return quality_cnn.score(docs, model, name=score).where(F.col(score) >= QUALITY_KEEP).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group: five-word shingles, Jaccard of at least 0.8."""
    return ngram_jaccard.keep_one(docs, words=5, num=80, den=100)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms in their texts; lengths don't change."""
    spans = private(docs, "pii")["pii"]
    return pii_feistel.pseudonymize(docs, PII_KEY, spans=spans).drop(spans)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the Pfair schedule, over all partitions."""
    return pfair_mix.in_schedule_order(pfair_mix.mix(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 ids."""
    return nnls_pack.pack(docs, byte_bpe())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL can't express the stages' models; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``; a stage's tables go when the next one's documents are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(before)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
