"""Incremental ingestion of attempt records and dialogues: an extension to the batch operators.

Records are appended once by id, whatever is delivered again; dialogue state is a fold that
is kept per dialogue and dropped when it is over or silent for long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clinloom.session import ship

ATTEMPT = "attempt_id string, case_id string, variant string, policy string, attempt_index long, ts timestamp, value double, acceptance string"
TURN = "dialogue_id string, index int, role string, text string, ts timestamp"


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """JSON lines that arrive as files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def append_once(batch: DataFrame, log: str, key: str = "attempt_id") -> int:
    """Append the rows of a batch whose id isn't in the log; returns how many were new.

    Ids are compared by a left anti join, so neither side is collected; a batch that is
    delivered again after a failure appends nothing.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        fresh = fresh.join(spark.read.schema(batch.schema).parquet(log).select(key), key, "left_anti").select(*batch.columns)
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(log)
    fresh.unpersist()
    return n


def append_stream(stream: DataFrame, log: str, checkpoint: str, key: str = "attempt_id") -> StreamingQuery:
    """Run ``append_once`` for every micro-batch that is available, then stop."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: append_once(batch, log, key) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Acceptance and measured means a variant and event-time window; late rows up to the watermark count."""
    held = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "variant")
    ok = F.coalesce(F.upper("acceptance").isin("ACCEPT", "PASS"), F.lit(False))
    out = held.agg(F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("accepted"), F.count("value").alias("measured"), F.avg("value").alias("mean_value"))
    return out.select("window.start", "variant", "attempts", "accepted", "measured", "mean_value")


STATE = "turns int, streak int, longest int, openings array<string>"
OUTPUT = "dialogue_id string, turns int, longest_streak int, repeated_openings int, ended boolean"


def dialogue_state(stream: DataFrame, confused: str, limit: int = 3, history: int = 5, timeout_ms: int | None = None) -> DataFrame:
    """Per dialogue and micro-batch: turns, confusion streak, repeated openings, whether it ended.

    ``confused`` is a pattern; the streak falls by one on other turns, not below 0. At the
    limit the dialogue has ended and its state is dropped, as after the timeout, if one is set.
    """
    ship(stream.sparkSession)
    marked = stream.select("dialogue_id", "index", F.coalesce(F.col("text").rlike(confused), F.lit(False)).alias("confused"), F.lower(F.substring_index(F.coalesce("text", F.lit("")), " ", 3)).alias("opening"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, streak, longest, openings = state.get if state.exists else (0, 0, 0, [])
        if state.hasTimedOut:
            state.remove()
            return
        openings, repeated, ended = list(openings), 0, False
        for row in pd.concat(list(batches)).sort_values("index").itertuples():
            turns += 1
            streak = streak + 1 if row.confused else max(0, streak - 1)
            longest = max(longest, streak)
            repeated += row.opening in openings
            openings = [*openings, row.opening][-history:]
            if streak >= limit:
                ended = True
                break
        if ended:
            state.remove()
        else:
            state.update((turns, streak, longest, openings))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], turns, longest, repeated, ended)], columns=["dialogue_id", "turns", "longest_streak", "repeated_openings", "ended"])

    return marked.groupBy("dialogue_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
