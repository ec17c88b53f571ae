"""Source divergence audit: how the terms of a language's sources differ from each other and from the language.

A language keeps the terms that occur in enough of its documents. A group (language, source) and the
language itself give each kept term a smoothed share in billionths, in whole numbers. Two groups
diverge by the sum of their shares' differences over all kept terms; a group's own terms are those
it gives more than its language does.

Terms are integers where the work is done: a chunk is a run of the kept terms in UTF-8 order, a sorted
array in which ``searchsorted`` finds ids, so ids are in UTF-8 order too and settle ties as they are.
``bincount`` makes a chunk's counts of all groups a dense matrix, a row a group.

1. One pass over the texts counts occurrences and documents of each (language, source, term) within a
   task, so a frequent term arrives at the shuffle once a task, however large its source. Counts
   are added up by group, then by term, where terms in too few documents go.
2. Kept terms are dealt by range of (language, term). Each task goes through its chunks and adds up
   the differences of all pairs of groups; it keeps the best terms of each group so far.
3. Sums of pairs are added over tasks, terms are ranked over what the tasks kept.

What reaches the driver and every task is one row of totals a group: sources, not terms or documents.
A result has a row a pair of sources, so their number is small against the corpus by nature; chunks
get fewer terms where there are more of them. Whole numbers are exact up to 9 * 10^15 occurrences of
a language, above which this raises.

Defined cases: null text, language and source are ''; a source without terms, or a language without
kept terms, has its rows in ``pair`` (difference 0 where the language keeps none) and none in ``term``;
repeated rows count as often as they occur; an empty table gives an empty result; other columns are
ignored; a text of any length is cut into terms in one pass, and a term may have any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.llm.slices import slices
from clinloom.session import discard, materialize, ship

#: A term: ASCII letters and all bytes of other characters. A-Z are lower-cased before.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents a kept term is in at least, occurrences added to each count, parts of a share, and terms of a group that are given.
LEAST, SMOOTH, PARTS, TOP = 30, 5, 1000, 50
#: Terms, and bytes of terms, that a task holds before it hands its counts on.
HELD, HELD_BYTES = 250_000, 24 << 20
#: Numbers in a chunk's matrix of groups x terms.
CHUNK = 1 << 20


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, d) of a task's texts: occurrences and documents."""
    said: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = size = 0
    for batch in batches:
        for part in slices([batch], 2):
            texts = part.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                found = TERM.findall(text.lower())  # of bytes: A-Z only
                terms = set(found)
                own = said.setdefault((lang, source), Counter())
                new = terms.difference(own)
                held += len(new)
                size += sum(map(len, new))
                own.update(found)
                docs.setdefault((lang, source), Counter()).update(terms)
            if held >= HELD or size >= HELD_BYTES:
                yield from _rows(said, docs)
                said, docs, held, size = {}, {}, 0, 0
    yield from _rows(said, docs)


def _rows(said: dict[tuple[str, str], Counter], docs: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
    for (lang, source), counted in said.items():
        terms, k = list(counted), len(counted)
        within = docs[lang, source]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counted.values()), pa.int64()), pa.array([within[t] for t in terms], pa.int64())],
            names=["lang", "source", "term", "n", "d"],
        )


def share(count: np.ndarray, total: int | np.ndarray, smooth: int, kept: int) -> np.ndarray:
    """1 + floor(PARTS^3 (count + smooth) / (total + smooth * kept)), exact in 64 bits: a factor of the scale at a time."""
    over = np.asarray(total + smooth * kept, np.int64)
    whole, rest = np.divmod(count + smooth, over)
    for _ in range(3):
        more, rest = np.divmod(rest * PARTS, over)
        whole = whole * PARTS + more
    return whole + 1


class Chunks:
    """Adds up a task's chunks of one language after the other."""

    def __init__(self, groups: dict[str, tuple[list[str], np.ndarray, int]], smooth: int, top: int):
        self.groups, self.smooth, self.top = groups, smooth, top
        self.lang: str | None = None

    def begin(self, lang: str) -> None:
        self.lang = lang
        self.sources, self.totals, self.kept = self.groups[lang]
        self.sums = np.zeros((len(self.sources),) * 2, np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, object))] * len(self.sources)

    def width(self, lang: str) -> int:
        return max(1, CHUNK // len(self.groups[lang][0]))

    def add(self, kept: np.ndarray, terms: np.ndarray, group: np.ndarray, n: np.ndarray) -> None:
        """One chunk: its sorted terms, and the rows (term, group, n) that say where they occur."""
        high, wide = len(self.sources), len(kept)
        ids = np.searchsorted(kept, terms)
        dense = np.bincount(group * wide + ids, n, high * wide).astype(np.int64).reshape(high, wide)
        p = share(dense, self.totals[:, None], self.smooth, self.kept)
        q = share(dense.sum(0), int(self.totals.sum()), self.smooth, self.kept)
        for i in range(high - 1):
            self.sums[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(1)
        over = np.where(dense > 0, p - q, 0)
        for i in range(high):
            own = np.flatnonzero(over[i] > 0)
            value, name = np.append(self.best[i][0], over[i][own]), np.append(self.best[i][1], kept[own])
            # Chunks come in order, so a stable sort leaves equal values in UTF-8 order.
            first = np.argsort(-value, kind="stable")[: self.top]
            first.sort()  # back in order of terms, for the next chunk
            self.best[i] = value[first], name[first]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.lang is None:
            return
        both = self.sums + self.sums.T
        for i, source in enumerate(self.sources):
            others = [j for j in range(len(self.sources)) if j != i]
            parts = ["pair"] * len(others) + ["term"] * len(self.best[i][0])
            items = [self.sources[j] for j in others] + list(self.best[i][1])
            values = np.append(both[i][others].astype(np.int64), self.best[i][0])
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(parts), pa.string()), pa.array([source] * len(parts), pa.string()), pa.array(parts, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _chunked(groups: dict[str, tuple[list[str], np.ndarray, int]], smooth: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums and best terms of rows (lang, term, sources, counts) that come in order."""
        work = Chunks(groups, smooth, top)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)] if len(langs) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                lang = langs[a]
                if lang != work.lang:
                    yield from work.end()
                    work.begin(lang)
                for i in range(a, b, work.width(lang)):
                    part = batch.slice(i, min(b - i, work.width(lang)))
                    kept = np.array(part.column(1).to_pylist(), object)
                    sizes = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                    group = pc.index_in(part.column(2).flatten(), pa.array(work.sources, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
                    work.add(kept, np.repeat(kept, sizes), group, part.column(3).flatten().to_numpy(zero_copy_only=False))
        yield from work.end()

    return run


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, smooth: int = SMOOTH, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): all other sources of ``pair``, and the ``top`` terms of ``term``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(_text(lang).alias("lang"), _text(source).alias("source"), _text(text).alias("text"))
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n long, d long")
    by_group = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = by_group.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("at"))
    kept = materialize(by_term.where(F.col("d") >= least).select("lang", "term", F.col("at.source").alias("sources"), F.col("at.n").alias("counts")), "kept-terms")

    found = materialize(rows.select("lang", "source").distinct(), "groups", 1)
    sizes = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    terms = {r["lang"]: r["v"] for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")).collect()}
    groups: dict[str, tuple[list[str], np.ndarray, int]] = {}
    for r in found.join(sizes, ["lang", "source"], "left").orderBy("lang", "source").collect():  # a row of totals a group
        names, totals, _ = groups.setdefault(r["lang"], ([], [], terms.get(r["lang"], 0)))
        names.append(r["source"])
        totals.append(r["n"] or 0)
    for name, (names, totals, v) in groups.items():
        if (sum(totals) + smooth * v) * PARTS >= 1 << 63:
            raise OverflowError(f"{sum(totals)} occurrences of terms in {name!r} are too many for 64 bits")
        groups[name] = names, np.array(totals, np.int64), v

    dealt = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    parts = materialize(dealt.mapInArrow(_chunked(groups, smooth, top), "lang string, source string, part string, item string, value long"), "divergence")
    discard(kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = found.join(found.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    own = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(own)
