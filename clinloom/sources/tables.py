"""Table loading: driver tables, the six-table clinical extract, JSON lines, Parquet cache.

Schemas are declared, never inferred; columns are selected at once, so pruning and
predicates reach the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables and columns of the clinical extract.
EXTRACT = {
    "ADMISSIONS": "SUBJECT_ID bigint, HADM_ID bigint, ADMITTIME timestamp_ntz, DISCHTIME timestamp_ntz, DEATHTIME timestamp_ntz, ADMISSION_TYPE string, HOSPITAL_EXPIRE_FLAG int, RELIGION string, MARITAL_STATUS string, ETHNICITY string, INSURANCE string",
    "PATIENTS": "SUBJECT_ID bigint, DOB timestamp_ntz, GENDER string",
    "NOTEEVENTS": "ROW_ID bigint, SUBJECT_ID bigint, HADM_ID bigint, CHARTDATE date, CATEGORY string, TEXT string",
    "ICUSTAYS": "HADM_ID bigint, LOS double",
    "PROCEDURES_ICD": "HADM_ID bigint, ICD9_CODE string",
    "DIAGNOSES_ICD": "HADM_ID bigint, ICD9_CODE string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def missing_files(folder: str, names: Iterable[str] = EXTRACT) -> list[str]:
    return [n for n in names if not Path(folder, f"{n}.csv").exists()]


def read_extract(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a CSV extract with exactly its declared columns; notes may span lines."""
    if gone := missing_files(folder, [name]):
        raise FileNotFoundError(f"missing from the extract: {gone}")
    path = f"{folder}/{name}.csv"
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    wanted = [c.strip().split() for c in EXTRACT[name].split(",")]
    return header.select(*[F.expr(f"try_cast(`{c}` AS {kind})").alias(c) for c, kind in wanted])


def read_lines(spark: SparkSession, paths: str | list[str], schema: str, line_number: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line raises with its text.

    With ``line_number`` a rising ``line`` column keeps the files' order.
    """
    raw = spark.read.text(paths).where("trim(value) != ''")
    if line_number:
        raw = raw.withColumn("line", F.monotonically_increasing_id())
    read = raw.withColumn("_r", F.from_json("value", schema))
    names = [f.strip().split()[0].split(":")[0] for f in _top_level(schema)]
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))
    sound = F.when(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"), bad).otherwise(F.col("_r"))
    kept = ["line"] if line_number else []
    return read.withColumn("_s", sound).select(*kept, *[F.col(f"_s.{n}").alias(n) for n in names])


def _top_level(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word]


def snapshot_hash(folder: str, names: Iterable[str] = EXTRACT) -> str:
    """SHA-256 over names and bytes of the extract's files, in a fixed order."""
    digest = hashlib.sha256()
    for name in names:
        digest.update(name.encode() + b"\0")
        with open(Path(folder, f"{name}.csv"), "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return f"sha256:{digest.hexdigest()}"


def cached(spark: SparkSession, df: DataFrame, folder: str, name: str, stamp: str) -> DataFrame:
    """A Parquet copy of ``df`` for this stamp; the committer makes it whole or absent."""
    path = f"{folder}/{name}-{hashlib.sha256(stamp.encode()).hexdigest()[:16]}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
