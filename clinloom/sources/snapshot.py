"""Snapshot hashes of extracts of any size: a hash tree over fixed ranges of files, computed on the executors.

A cohort is only reproducible if the extract it came from is identified, by its bytes: sizes and times of
change let another extract pass as the same. A file's digest is the SHA-256 of its ranges' SHA-256 digests,
in order; an extract's is that of its files' names and digests. The range is part of the scheme's name,
so hashes of different ranges, and of other schemes, never compare equal. The driver lists files and holds
one digest a file; no task reads more than a range at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.session import ship
from clinloom.sources.extract import ExtractError, file_system, list_files

RANGE = 64 << 20
BLOCK = 1 << 20


def range_hashes(spark: SparkSession, files: Sequence[tuple[str, str, int]], size: int = RANGE) -> DataFrame:
    """(name, at, digest) of every range of files (name, path, bytes); an empty file has one empty range."""
    if size <= 0:
        raise ValueError("a range has at least one byte")
    ship(spark)
    listed = spark.createDataFrame(list(files), "name string, path string, bytes long")
    ranges = listed.select("name", "path", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("bytes") / size) - 1).cast("long"))).alias("at"))
    tasks = max(1, min(10_000, sum(-(-n // size) for _, _, n in files)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                system, own = file_system(path)
                digest, left = hashlib.sha256(), size
                with system.open_input_file(own) as f:
                    f.seek(at * size)
                    while left and (block := f.read(min(BLOCK, left))):
                        digest.update(block)
                        left -= len(block)
                digests.append(digest.digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary())], names=["name", "at", "digest"])

    return ranges.repartition(tasks, "path", "at").mapInArrow(run, "name string, at long, digest binary")


def file_hashes(spark: SparkSession, files: Sequence[tuple[str, str, int]], size: int = RANGE) -> DataFrame:
    """(name, digest): the SHA-256, in hexadecimal, of each file's range digests in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", F.lower(F.hex("digest")).alias("h")))), lambda x: x["h"])
    return range_hashes(spark, files, size).groupBy("name").agg(F.sha2(F.unhex(F.array_join(ordered, "")), 256).alias("digest"))


def tree_hash(spark: SparkSession, folder: str, tables: Sequence[str], suffix: str = ".csv", size: int = RANGE) -> str:
    """The hash of an extract's tables in this order; a table is a file or a folder of files of that suffix."""
    files: list[tuple[str, str, int]] = []
    for table in tables:
        root = f"{folder.rstrip('/')}/{table}{suffix}"
        found = list_files(root, suffix)
        if not found:
            raise ExtractError(f"{root} holds no file")
        _, base = file_system(root)
        scheme = root[: root.index("://") + 3] if "://" in root else ""
        files += [(f"{table}{path[len(base):]}", f"{scheme}{path}", n) for path, n in found]
    held = {r["name"]: r["digest"] for r in file_hashes(spark, files, size).collect()}
    whole = hashlib.sha256("".join(f"{name}\n{n}\n{held[name]}\n" for name, _, n in files).encode())
    return f"tree-sha256-{size}:{whole.hexdigest()}"
