"""Extendible hashing: shards that split only where they are too large.

A directory is indexed by the leading bits of a 60-bit hash of the key (the first 15 hex
digits of the MD5 of the key as text, which any engine can repeat). A bucket whose
rows exceed the byte limit is split on one more bit, until each fits. Buckets that fit
are never split, so neighbours may have different depths, as in the classic structure.

Everything is DataFrame code. Rows are read once into (key, bytes, hash); byte sums per
fine directory cell are aggregated with map-side combine, and the sums of all shorter
prefixes come from those cells, so no bucket's rows are ever gathered to decide a split.
Only cells that are still too large are refined on further bits.

Defined cases: a null key hashes like an empty one; a null text has 0 bytes; equal keys
share all bits, so when they alone exceed the limit they go to numbered overflow pages of
that bucket, each within the limit; a single row above the limit gets a page of its own.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinloom.session import materialize

#: Bits of a key's hash.
BITS = 60
#: Directory bits added beyond the least depth that could hold all bytes.
FINE_BITS = 5
#: Bits by which cells that are still too large are refined at a time.
STEP_BITS = 8


def _prefix(bits: int):
    return F.lit(0).cast("long") if bits == 0 else F.shiftright("_h", BITS - bits)


def _depths(base: DataFrame, bits: int, start: int, limit: int) -> DataFrame:
    """Per cell of ``bits`` bits: its bytes and the least depth >= start whose bucket fits (null: none)."""
    cells = base.groupBy(_prefix(bits).alias("_cell")).agg(F.sum("_bytes").alias("_sum"))
    wide = cells.select("_cell", "_sum", F.explode(F.sequence(F.lit(start), F.lit(bits))).alias("_d"))
    wide = wide.withColumn("_p", F.expr(f"shiftrightunsigned(_cell, {bits} - _d)"))
    sums = wide.groupBy("_d", "_p").agg(F.sum("_sum").alias("_total"))
    fits = sums.where(F.col("_total") <= limit).select("_d", "_p")
    found = wide.join(fits, ["_d", "_p"]).groupBy("_cell").agg(F.min("_d").alias("_depth"))
    return cells.select("_cell").join(found, "_cell", "left")


def assign_shards(df: DataFrame, key: str, size, limit_bytes: int, seed: str = "") -> DataFrame:
    """(key, n_bytes, shard, depth, page) for every row of ``df``.

    ``size`` is a column or expression for a row's bytes. ``shard`` is the bucket's bit
    string followed, on overflow pages, by ``+page``.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    base = df.select(
        F.col(key).alias("_key"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("_bytes"),
        F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long").alias("_h"),
    )
    base = materialize(base, "shards-base")
    total = base.agg(F.sum("_bytes").alias("b")).first()["b"] or 0
    bits = min(24, max(1, (max(1, total) // limit_bytes).bit_length() + FINE_BITS))
    start, rest, parts = 0, base, []
    while True:
        cells = materialize(_depths(rest, bits, start, limit_bytes), "shards-cells")
        keyed = rest.withColumn("_cell", _prefix(bits))
        done = cells.where(F.col("_depth").isNotNull())
        parts.append(
            keyed.join(done, "_cell").select(
                "_key", "_bytes", F.col("_depth").cast("int").alias("_depth"),
                F.expr(f"if(_depth = 0, 0L, shiftright(_h, {BITS} - cast(_depth as int)))").alias("_p"),
                F.lit(0).cast("long").alias("_page"),
            )
        )
        left = cells.where(F.col("_depth").isNull()).select("_cell")
        if left.isEmpty():
            break
        rest = keyed.join(left, "_cell", "left_semi").drop("_cell")
        if bits == BITS:
            parts.append(_overflow(rest, limit_bytes))
            break
        start, bits = bits, min(BITS, bits + STEP_BITS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    name = F.expr("if(_depth = 0, '', lpad(bin(_p), _depth, '0'))")
    return out.select(
        F.col("_key").alias(key),
        F.col("_bytes").alias("n_bytes"),
        F.when(F.col("_page") > 0, F.concat(name, F.lit("+"), F.col("_page").cast("string"))).otherwise(name).alias("shard"),
        F.col("_depth").alias("depth"),
        F.col("_page").alias("page"),
    )


def _overflow(rest: DataFrame, limit: int) -> DataFrame:
    """Pages for buckets of one hash value, dealt to as many slots as the bytes need.

    A page is a run of one slot whose bytes stay within the limit: a new page begins where
    the running sum passes into the next limit-sized stretch, and a row that straddles the
    border is a page by itself.
    """
    need = rest.groupBy("_h").agg(F.sum("_bytes").alias("_all"))
    slots = need.select("_h", F.ceil(F.col("_all") / F.lit(limit)).cast("long").alias("_slots"))
    dealt = rest.withColumn("_row", F.monotonically_increasing_id()).join(slots, "_h")
    dealt = dealt.withColumn("_slot", F.pmod(F.xxhash64("_row"), F.col("_slots")))
    w = Window.partitionBy("_h", "_slot").orderBy("_row")
    end = F.sum("_bytes").over(w)
    run = dealt.withColumn("_end", end).withColumn("_lo", F.floor((F.col("_end") - F.col("_bytes")) / F.lit(limit)))
    run = run.withColumn("_hi", F.floor((F.greatest(F.col("_end"), F.lit(1)) - 1) / F.lit(limit)))
    local = F.when(F.col("_lo") >= F.col("_hi"), 2 * F.col("_lo")).otherwise(2 * F.col("_lo") + 1)
    page = local * F.col("_slots") + F.col("_slot") + 1
    return run.select("_key", "_bytes", F.lit(BITS).alias("_depth"), F.col("_h").alias("_p"), page.cast("long").alias("_page"))


def write_shards(df: DataFrame, assigned: DataFrame, key: str, path: str) -> None:
    """Write the rows of ``df`` (unique ``key``) to ``path``, one folder ``shard=b<bits>`` for each shard."""
    joined = df.join(assigned.select(key, F.concat(F.lit("b"), "shard").alias("shard")), key)
    joined.repartition("shard").write.mode("errorifexists").partitionBy("shard").parquet(path)
