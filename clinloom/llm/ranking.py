"""Exact ranks within groups that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.llm.slices import private


def ranked(df: DataFrame, group: str, order: Column, ranges: str, name: str) -> DataFrame:
    """``df`` with the 0-based rank of each row within its non-null ``group``.

    Rows are dealt to hash ranges of ``order`` (a long hash), of which column ``ranges`` gives
    their group's number; they are ranked inside a (group, range), and shifted by the counts
    of the ranges before. So a task ranks about as many rows of a large group as of a small
    one. Ties are broken by a hash of all columns; columns that can't be hashed don't count.
    """
    own = private(df, "o", "b", "n", "before", "r", "t")
    o, b = own["o"], own["b"]
    cut = F.shiftright(F.col(o), 33) + F.lit(1 << 30)
    keyed = df.withColumn(o, order).withColumn(b, F.floor(cut * F.col(ranges) / F.lit(1 << 31)).cast("long"))
    counts = keyed.groupBy(group, b).agg(F.count(F.lit(1)).alias(own["n"]))
    back = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(group, b, F.coalesce(F.sum(own["n"]).over(back), F.lit(0)).alias(own["before"]))
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    keyed = keyed.withColumn(own["t"], F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    inside = Window.partitionBy(group, b).orderBy(o, own["t"])
    out = keyed.withColumn(own["r"], F.row_number().over(inside) - 1).join(shift, [group, b])
    return out.withColumn(name, F.col(own["before"]) + F.col(own["r"])).drop(*own.values())
