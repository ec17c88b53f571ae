"""A log of attempts that a run can be resumed from, without reading what is already in it.

Rows are dealt by a hash of their case to buckets; an append writes its rows as a folder of buckets, the case filter
of each bucket, and last a marker. Only folders with a marker are read, so a job that dies between
data and marker has written nothing; a batch that is delivered again finds its marker and writes nothing either.

Filters are Bloom filters over the cases of a bucket of an append. Before appending or resuming, the cases in question are
held against the filters of their buckets, and only the buckets of appends that may have them are read, key columns alone.

The first append fixes the identity of the run (``locks.run_identity``), by a file that must not exist yet;
later ones under another are refused. Markers and identity are small files of the file system's own, made
whole by renaming; one writer appends at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.session import ship
from clinloom.sources.locks import LockError, assert_identity

BUCKETS = 64
#: Bits a case in a filter, and how many of them it sets: about one case in 200 is taken for another.
BITS, HASHES = 12, 7


class _Files:
    """Small files of a folder in any of Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file that is whole or absent, and must not exist yet."""
        draft = self.path(f"_draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        if self.exists(name) or not self.fs.rename(draft, self.path(name)):
            self.fs.delete(draft, False)
            raise FileExistsError(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _places(hashed: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash in a filter of ``size`` (a power of two): (rows, HASHES)."""
    h = hashed.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def filter_of(hashed: np.ndarray) -> bytes:
    size = max(64, 1 << int(len(hashed) * BITS - 1).bit_length()) if len(hashed) else 64
    bits = np.zeros(size, np.uint8)
    bits[_places(hashed, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_have(packed: bytes, hashed: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    return bits[_places(hashed, len(bits))].all(1)


class AttemptLog:
    """Rows with a case and an attempt, each (case, attempt) once."""

    def __init__(self, spark: SparkSession, root: str, identity: Mapping[str, str], case: str = "case_id", attempt: str = "attempt_index", buckets: int = BUCKETS):
        self.spark, self.root, self.identity, self.case, self.attempt, self.buckets = spark, root.rstrip("/"), dict(identity), case, attempt, buckets
        self.files = _Files(spark, root)
        ship(spark)
        if self.files.exists("run.json"):
            stated = json.loads(self.files.read("run.json"))
            assert_identity(stated["identity"], self.identity, f"the log {root}")
            if (stated["case"], stated["attempt"], stated["buckets"]) != (case, attempt, buckets):
                raise LockError(f"the log {root} is dealt by {stated['case']}, {stated['attempt']} to {stated['buckets']} buckets")
        else:
            self.files.create("run.json", json.dumps({"identity": self.identity, "case": case, "attempt": attempt, "buckets": buckets}, sort_keys=True))

    def _hash(self) -> Column:
        return F.xxhash64(F.col(self.case).cast("string"))

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_hash", self._hash()).withColumn("bucket", F.pmod("_hash", F.lit(self.buckets)).cast("int"))

    def commits(self) -> list[dict]:
        """What has been appended, in order."""
        return [json.loads(self.files.read(f"commits/{name}")) for name in self.files.names("commits")]

    def read(self) -> DataFrame | None:
        """All rows; None before the first append."""
        done = self.commits()
        if not done:
            return None
        return self._of([c["folder"] for c in done])

    def _of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/append={f}" for f in folders]).drop("append", "bucket")

    def _near(self, keys: DataFrame) -> DataFrame | None:
        """Keys of the log's rows that may be of the given cases: only buckets of appends whose filters say so are read."""
        folders = [c["folder"] for c in self.commits()]
        if not folders:
            return None
        wanted = self._dealt(keys.select(self.case).distinct())
        held = self.spark.read.option("basePath", f"{self.root}/filters").parquet(*[f"{self.root}/filters/append={f}" for f in folders])

        def hits(key, cases, filters):
            hashed = cases.column("_hash").to_numpy()
            found = [a for a, f in zip(filters.column("append").to_pylist(), filters.column("filter").to_pylist(), strict=True) if len(hashed) and may_have(f, hashed).any()]
            return pa.table({"append": pa.array(found, pa.string()), "bucket": pa.array([key[0].as_py()] * len(found), pa.int32())})

        pairs = wanted.select("bucket", "_hash").groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(hits, "append string, bucket int").collect()  # at most a row a file
        self.touched = sorted((r["append"], r["bucket"]) for r in pairs)
        if not pairs:
            return None
        paths = [f"{self.root}/data/append={a}/bucket={b}" for a, b in self.touched]
        return self.spark.read.parquet(*paths)

    def append(self, rows: DataFrame, batch: str) -> int:
        """Append the rows of a batch whose (case, attempt) the log hasn't; how many these were. A batch is appended once."""
        marker = f"commits/{batch}.json"
        if self.files.exists(marker):
            return 0
        fresh = rows.dropDuplicates([self.case, self.attempt])
        near = self._near(rows)
        if near is not None:
            fresh = fresh.join(near.select(self.case, self.attempt), [self.case, self.attempt], "left_anti").select(*rows.columns)
        folder = f"{batch}-{uuid.uuid4().hex[:12]}"
        dealt = self._dealt(fresh).repartition(min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
        dealt.drop("_hash").write.partitionBy("bucket").parquet(f"{self.root}/data/append={folder}")
        written = self._written(folder)
        n = 0
        if written is not None:
            self._filters(self._dealt(written.select(self.case)), folder)
            n = written.count()
        if n:
            self._commit(marker, {"batch": batch, "folder": folder, "rows": n})
        else:
            self.files.delete(f"data/append={folder}")
        return n

    def _written(self, folder: str) -> DataFrame | None:
        if not any(name.startswith("bucket=") for name in self.files.names(f"data/append={folder}")):
            return None
        return self._of([folder])

    def _commit(self, marker: str, what: dict) -> None:
        self.files.create(marker, json.dumps(what, sort_keys=True))

    def _filters(self, dealt: DataFrame, folder: str) -> None:
        def build(key, rows):
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([filter_of(rows.column("_hash").to_numpy())], pa.binary())})

        made = dealt.select("bucket", "_hash").distinct().groupBy("bucket").applyInArrow(build, "bucket int, filter binary")
        made.coalesce(1).write.parquet(f"{self.root}/filters/append={folder}")

    def vacuum(self) -> list[str]:
        """Delete what was written without a marker; its names. Not while an append runs."""
        live = {f"append={c['folder']}" for c in self.commits()}
        gone = [f"{kind}/{name}" for kind in ("data", "filters") for name in self.files.names(kind) if name.startswith("append=") and name not in live]
        for name in gone:
            self.files.delete(name)
        return gone

    def open_cases(self, cases: DataFrame, accepted: Column, most: int) -> DataFrame:
        """The next attempt of each given case that is neither accepted nor out of attempts: (case, attempts, next_attempt)."""
        wanted = cases.select(self.case).distinct()
        near = self._near(wanted)
        if near is None:
            return wanted.select(self.case, F.lit(0).cast("long").alias("attempts"), F.lit(1).cast("long").alias("next_attempt"))
        had = near.groupBy(self.case).agg(F.count(F.lit(1)).alias("attempts"), F.max(F.coalesce(accepted, F.lit(False))).alias("done"))
        joined = wanted.join(had, self.case, "left")
        left = joined.where(~F.coalesce("done", F.lit(False)) & (F.coalesce("attempts", F.lit(0)) < most))
        return left.select(self.case, F.coalesce("attempts", F.lit(0)).alias("attempts"), (F.coalesce("attempts", F.lit(0)) + 1).alias("next_attempt"))

    def append_stream(self, stream: DataFrame, checkpoint: str):
        """Append every micro-batch that is there under its number, then stop; a batch that is run again adds nothing."""
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.append(batch, f"{number:012d}") and None)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
