"""Document fingerprints from prefix polynomial hashes.

For a text c_0 .. c_(n-1) of code points the modular prefix array holds the sums of
c_i * b^i. The hash of any span is then a difference of two entries brought to a common
power, so whether two spans are equal takes constant time, the hashes of all spans of one
width take a few vector operations, and the longest common extension of two positions is
found by binary search. Positions are compared under two moduli.

A fingerprint is ``length:whole:sketch``. ``whole`` is the hash of the full text under both
moduli. ``sketch`` is the ``KEEP`` least mixed hashes of all spans of ``WIDTH`` code points
(a shorter text is one span). Two fingerprints' likeness is 1 where length and whole agree,
else the share of common spans (Dice), estimated from the least hashes of the union.

``edited_neighbours`` compares every document with its edited text, for which it needs the
next document by id. Ids are cut into ranges at quantiles (as many as partitions x 8); each
row goes to its range, the first row of a range also to the range before, and each range is
read in order, holding one row back. One shuffle of the texts, no window over all rows, no
join; what the driver holds is one id for each range.

Defined cases: a null text counts as empty and has the sketch of an empty span; a null id
comes before all ids; of repeated ids the smaller text comes first; a single document is its
own next one; an empty table gives an empty result; extra columns are ignored; a text of any length is
hashed in blocks, so a task holds it, its successor and its edited text, and arrays of ``BLOCK`` code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.llm.slices import slices
from clinloom.session import ship

WIDTH, KEEP = 8, 64
#: Two primes below 2^31 and a base for each.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
_BITS = np.uint64(40)
#: Code points whose prefix arrays are held at a time (some 80 bytes each).
BLOCK = 1 << 17


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int, modulus: int):
        self.base, self.modulus = base, modulus
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            step = pow(self.base, k, self.modulus)
            back = pow(step, -1, self.modulus)
            self.up = np.concatenate([self.up, self.up * np.uint64(step) % np.uint64(self.modulus)])
            self.down = np.concatenate([self.down, self.down * np.uint64(back) % np.uint64(self.modulus)])


_POWERS = [_Powers(b, m) for b, m in zip(BASES, MODULI, strict=True)]


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Prefix:
    """Modular prefix arrays of one text."""

    def __init__(self, text: str | None):
        points = code_points(text) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for p in _POWERS:
            p.grow(self.n + 1)
            m = np.uint64(p.modulus)
            out = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * p.up[: self.n] % m, out=out[1:])
            self.sums.append(out)

    def span(self, start: int, end: int, which: int = 0) -> int:
        """The hash of a span, the same wherever the span stands."""
        p = _POWERS[which]
        return int(self.sums[which][end] - self.sums[which][start]) % p.modulus * int(p.down[start]) % p.modulus

    def whole(self) -> int:
        return self.span(0, self.n, 0) << 31 | self.span(0, self.n, 1)

    def spans(self, width: int) -> np.ndarray:
        """The hashes of all spans of a width, under the first modulus."""
        p, s = _POWERS[0], self.sums[0]
        m = np.uint64(p.modulus)
        return (s[width:] - s[:-width]) % m * p.down[: self.n + 1 - width] % m


def equal_spans(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether a[i:i+length] and b[j:j+length] are equal, by both moduli."""
    return i + length <= a.n and j + length <= b.n and all(a.span(i, i + length, w) == b.span(j, j + length, w) for w in (0, 1))


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """The length of the longest common text from a[i] and b[j] on."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if equal_spans(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x >> (np.uint64(64) - _BITS)


def sketch(prefix: Prefix) -> np.ndarray:
    """The least mixed hashes, distinct and ascending."""
    width = min(WIDTH, prefix.n)
    found = _mixed(prefix.spans(width)) if width else np.zeros(1, np.uint64)
    if len(found) > 8 * KEEP:
        low = np.partition(found, 4 * KEEP)[: 4 * KEEP]
        least = np.unique(low)[:KEEP]
        if len(least) == KEEP:
            return least
    return np.unique(found)[:KEEP]


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Share of common spans of two fingerprints (length, whole, sketch), 0 to 1."""
    if a[:2] == b[:2]:
        return 1.0
    union = np.union1d(a[2], b[2])[:KEEP]
    both = np.isin(union, a[2], assume_unique=True) & np.isin(union, b[2], assume_unique=True)
    jaccard = both.sum() / len(union)
    return float(2 * jaccard / (1 + jaccard))


def printed(text: str) -> tuple[tuple[int, int, np.ndarray], Prefix]:
    """(fingerprint, prefix arrays of the first block) of a text, a block at a time.

    A block's hash is carried to its place by the base's power there; blocks overlap by what a span reaches over.
    """
    n, whole, least, first = len(text), [0, 0], np.zeros(0, np.uint64), None
    for a in range(0, max(n, 1), BLOCK):
        block = Prefix(text if n <= BLOCK else text[a : a + BLOCK + WIDTH - 1])
        first = first or block
        for w, p in enumerate(_POWERS):
            whole[w] = (whole[w] + block.span(0, min(BLOCK, n - a), w) * pow(p.base, a, p.modulus)) % p.modulus
        if block.n >= WIDTH or n < WIDTH:
            least = sketch(block) if not a else np.unique(np.concatenate([least, sketch(block)]))[:KEEP]
    return (n, whole[0] << 31 | whole[1], least), first


def fingerprint(text: str | None) -> tuple[int, int, np.ndarray]:
    return printed(text or "")[0]


def shared_prefix(a: str, b: str, first: tuple[Prefix, Prefix]) -> int:
    """The length of the common start of two texts, block by block; ``first`` are the prefix arrays of their first blocks."""
    at = 0
    while True:
        pair = first if not at else (Prefix(a[at : at + BLOCK]), Prefix(b[at : at + BLOCK]))
        found = min(common_extension(pair[0], 0, pair[1], 0), BLOCK)
        at += found
        if found < BLOCK:
            return at


def written(print_: tuple[int, int, np.ndarray]) -> str:
    return f"{print_[0]:x}:{print_[1]:016x}:" + "".join(f"{x:010x}" for x in print_[2].tolist())


def parsed(text: str) -> tuple[int, int, np.ndarray]:
    n, whole, rest = text.split(":")
    return int(n, 16), int(whole, 16), np.array([int(rest[i : i + 10], 16) for i in range(0, len(rest), 10)], np.uint64)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by the first as many code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_OUT = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in SCHEMA.split(", ")])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, guest, doc_id, text) in order; guests only serve as the next document."""
    held, ready, rows = None, False, []

    def close(row: tuple, following: tuple) -> None:
        text, own = edited(row[3], following[3]), row[4]
        changed, start = printed(text)
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((row[2], own[0], digest, written(own), written(changed), likeness(own, changed), likeness(own, following[4]), shared_prefix(row[3], text, (row[5], start))))

    for batch in slices(batches, 3):
        for bucket, guest, key, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if guest and not ready:
                continue
            row = (bucket, guest, key, text or "", *printed(text or ""))
            if ready and held[0] == bucket:
                close(held, row)
            held, ready = row, not guest
            if len(rows) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)
                rows.clear()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def _placed(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """``rows`` with the ``bucket`` of _id: how many cuts are below it.

    Cuts are looked up in two steps of about their number's square root: first the run of
    cuts, by its last one, then the place in it, which comes with a broadcast row a run.
    """
    width = max(1, round(len(cuts) ** 0.5))
    runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    schema = "_run int, _first int, _cuts array<long>"
    table = rows.sparkSession.createDataFrame([(i, min(i * width, len(cuts)), run) for i, run in enumerate([*runs, []])], schema)
    lasts = F.lit([run[-1] for run in runs]).cast("array<long>")
    found = rows.withColumn("_run", F.size(F.filter(lasts, lambda c: c < F.col("_id")))).join(F.broadcast(table), "_run")
    return found.withColumn("bucket", F.col("_first") + F.size(F.filter("_cuts", lambda c: c < F.col("_id")))).drop("_run", "_first", "_cuts")


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likenesses."""
    spark = docs.sparkSession
    ship(spark)
    ranges = ranges or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts)) if ranges > 1 else []
    placed = _placed(rows.withColumn("_id", order), cuts)
    heads = sorted((r["bucket"], r["m"]) for r in placed.groupBy("bucket").agg(F.min("_id").alias("m")).collect())
    before = {m: heads[i - 1][0] for i, (_, m) in enumerate(heads)}
    table = spark.createDataFrame(list(before.items()), "_id long, _before int")
    placed = placed.join(F.broadcast(table), "_id", "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_before").alias("bucket"), F.lit(1).alias("guest"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    placed = placed.select("at.bucket", "at.guest", "doc_id", "text")
    dealt = placed.repartition("bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")
    return dealt.mapInArrow(_compare, SCHEMA)
