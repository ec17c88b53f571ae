"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents. With weight w its i-th block (from 0) may run
from slot floor(i / w) on and must run before slot ceil((i + 1) / w); in every slot the
released block with the earliest deadline runs. On one resource this meets all deadlines,
so after any number of slots t a source has had within one block of w * t.

Weights are integer shares of a quantum Q by largest remainder. Q grows with the number of
slots, so that rounding moves no source by more than a block over the whole schedule. The
driver simulates each phase up to its end, one step a block. When a source runs out, the
others go on with their weights renormalised and rounded anew: a new phase. A block has
``BLOCK_ROWS`` rows, or so many times two more that there are at most about ``MAX_SLOTS``
blocks: the schedule, a row a block, is bounded whatever the size of the corpus, and so are
the driver's work and what is broadcast. A document's block is arithmetic on its rank within
its source, which is found without gathering a source in one task. No document is dropped or
repeated.

Ties: of blocks released with equal deadlines the one of the source that comes first in order
runs; of equal remainders the source that comes first gets the share; rows of a source are
ordered by a hash of doc_id, then by a hash of all their values, so a task that runs again
gives the same order, and rows that still tie are equal in every column.

Defined cases: a null source is a source of its own; sources without a given weight raise;
a repeated doc_id is a row of its own; an empty table gives an empty result; other columns
are kept, but columns named as an output column are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.llm.ranking import ranked
from clinloom.llm.slices import private

#: Documents in a block, unless that makes more than MAX_SLOTS blocks.
BLOCK_ROWS, MAX_SLOTS = 64, 1 << 17
#: Weights are rounded to multiples of 1 / QUANTUM, or finer ones in a longer schedule.
QUANTUM = 1000
#: Rows of a source that a task ranks, in expectation.
RANKED_ROWS = 16_384
#: More distinct sources than this are refused: the schedule is held on the driver.
MAX_SOURCES = 4096
NULL = "\x00"
OUTPUT = ("block", "offset", "phase", "release", "deadline", "slot")


def shares(weights: Mapping[str, float], quantum: int = QUANTUM) -> dict[str, int]:
    """Integer shares of ``quantum`` by largest remainder; less than 1 is 1, at the cost of the heaviest."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    total, quantum = sum(weights.values()), max(quantum, 2 * len(weights))
    exact = {s: quantum * w / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    for s in by_rest[: max(0, quantum - sum(out.values()))]:
        out[s] += 1
    over = sum(out.values()) - quantum
    while over > 0:
        for s in sorted((s for s in out if out[s] > 1), key=lambda s: (exact[s] - out[s], -out[s], s))[:over]:
            out[s] -= 1
            over -= 1
    return out


def fine_quantum(blocks: Mapping[str, int]) -> int:
    """A quantum whose rounding, over all slots and sources, is at most about half a block."""
    slots = sum(blocks.values())
    return max(QUANTUM, min(2 * slots * len(blocks), (1 << 62) // max(slots, 1)))


def edf(share: Mapping[str, int], left: Mapping[str, int] | None = None) -> dict[str, list[int]]:
    """Slots of each source's blocks, earliest deadline first, until a source has had ``left`` blocks.

    Without ``left``, one period of sum(share) slots. Equal deadlines go to the first source in order.
    """
    period = sum(share.values())
    slots: dict[str, list[int]] = {s: [] for s in share}
    waiting = [(0, s) for s in sorted(share)]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []  # (deadline, source)
    for t in range(period if left is None else sum(left.values())):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // share[s]), s))
        deadline, s = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        slots[s].append(t)
        if left is not None and len(slots[s]) == left[s]:
            break
        if left is not None or len(slots[s]) < share[s]:
            heapq.heappush(waiting, (len(slots[s]) * period // share[s], s))
    return slots


def schedule(weights: Mapping[str, float], blocks: Mapping[str, int], quantum: int | None = None) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, phase, release, deadline, slot) of every block of the whole schedule, phase by phase.

    A phase ends when a source has had all its blocks; among equals all that end then leave.
    """
    quantum = quantum or fine_quantum(blocks)
    left = {s: n for s, n in blocks.items() if n > 0}
    base = phase = 0
    while left:
        share = shares({s: weights[s] for s in left}, quantum)
        period, slots, length = sum(share.values()), edf(share, left), 0
        for s, taken in slots.items():
            first, length = blocks[s] - left[s], length + len(taken)
            for i, t in enumerate(taken):
                yield s, first + i, phase, base + i * period // share[s], base - (-(i + 1) * period // share[s]), base + t
        left = {s: n - len(slots[s]) for s, n in left.items() if n > len(slots[s])}
        base, phase = base + length, phase + 1


def block_size(rows: Mapping[str, int], least: int = BLOCK_ROWS, most: int = MAX_SLOTS) -> int:
    """Rows of a block: ``least`` times a power of two, so that there are at most ``most`` blocks and one a source."""
    size = least
    while sum(rows.values()) // size > most:
        size *= 2
    return size


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, quantum: int | None = None, temper: float = 0.5) -> DataFrame:
    """``df`` (with doc_id and source) plus block, offset, phase, release, deadline and slot.

    Without ``weights`` a source's target is its number of documents to the power
    ``temper``. Release and deadline are slots of the whole schedule; slot orders blocks
    and offset orders the documents of a block.
    """
    df = df.drop(*OUTPUT)
    own = private(df, "source", "ranges", "rank")
    source = own["source"]
    named = df.withColumn(source, F.coalesce(F.col("source"), F.lit(NULL)))
    counts = named.groupBy(source).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = {r[source]: r["n"] for r in counts}
    given = {s: n**temper for s, n in rows.items()} if weights is None else {s: weights[None if s == NULL and None in weights else s] for s in rows}
    size = block_size(rows, block_rows)
    plan = list(zip(*schedule(given, {s: -(-n // size) for s, n in rows.items()}, quantum), strict=True)) or [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [source, "block", "phase", "release", "deadline", "slot"]
    table = df.sparkSession.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(plan, kinds, strict=True)], names=names))
    ranges = df.sparkSession.createDataFrame([(s, -(-n // RANKED_ROWS)) for s, n in rows.items()], f"`{source}` string, `{own['ranges']}` long")
    out = ranked(named.join(F.broadcast(ranges), source), source, F.xxhash64("doc_id"), own["ranges"], own["rank"])
    out = out.withColumn("block", F.expr(f"{own['rank']} div {size}")).withColumn("offset", F.col(own["rank"]) % size)
    # One row a block: at most MAX_SLOTS and one for each source, whatever the size of the corpus.
    return out.join(F.broadcast(table), [source, "block"]).select(*df.columns, *OUTPUT)


def in_schedule_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` sorted over all partitions: written files hold the mixture in order."""
    return mixed.orderBy("slot", "offset")
