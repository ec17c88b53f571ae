"""Substring dedup: words of passages that a document of a smaller id has too are taken out.

A window is ``words`` consecutive words. A document loses every word covered by a window whose words
also stand in a row in a document of a smaller id, whatever is left of that one.

The references, all documents, are cut into shards such that a passage can only match inside its own
shard, so each shard's suffix automaton goes just where that shard's passages are streamed past it; a
broadcast of all automata would grow with the corpus and meet every document. A shard is named by an anchor:

1. The anchor of a window is the least hash of its ``gram``-word grams. It depends on the window's words alone,
   so equal windows have equal anchors, and neighbouring windows mostly share theirs: a passage is a run of
   windows of one anchor. Equal texts are one text from here on, by the digest of their words.
2. Anchors that only one text has lead nowhere; a grouped minimum and maximum of the texts (combined within a
   task, so a frequent passage costs a row a task) leaves the others. Passages with such anchors are joined to
   their texts, cut out, and equal ones become one, with the least id that has it.
3. A shard's passages are streamed in order of ids past the automaton of those before: matching statistics,
   held at a window's length, give for each window the least id of a document that has it, as a state
   keeps the id that it was made for. Spans that aren't in the automaton yet are added to it.
4. What was found goes back to all documents that have the passage; windows of a smaller id make spans.

An anchor of more than ``SPLIT`` different passages (a common line in ever other surroundings) would make an
automaton without bound: its passages are cut to single windows, which are grouped by themselves. Copies of a
whole text need no windows: all but the least id lose all their words, if there are enough for a window.

Nothing is collected or broadcast. Words are compared by themselves where it counts: 64-bit hashes only choose
anchors; texts, passages and windows are named by 128 bits of a digest or more.

Defined cases: null text has no words; a row with a null id is in no order, so it loses nothing and
takes nothing; rows with equal ids don't take from each other; a text with fewer words than a window
loses nothing; an empty table gives an empty result; clashing extra columns are left out of the work
and stay in ``kept``; texts of any length are hashed in blocks (about 40 bytes of memory a word, and
two copies of the text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.llm.ngram_jaccard import mix
from clinloom.llm.slices import private, slices
from clinloom.session import discard, materialize, release, ship

#: Words of a window, and of the grams whose least hash is its anchor.
WORDS, GRAM = 13, 5
#: Passages of an anchor that are one automaton.
SPLIT = 2048
#: Words hashed at a time, texts that a task knows it has seen, and bytes of a word above which it is hashed by itself.
BLOCK, SEEN, LONG = 1 << 19, 200_000, 512

U = np.uint64
_TURN = U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def identity(text: bytes) -> tuple[list[bytes], bytes]:
    """A text's words, and the SHA-256 of them joined by spaces. ``bytes.split`` cuts at just the six ASCII spaces."""
    words = text.split()
    return words, hashlib.sha256(b" ".join(words)).digest()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, read eight bytes at a time."""
    raw = np.frombuffer(text + b" " * 8, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    loads = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), BLOCK):
        at, size = starts[a : a + BLOCK], ends[a : a + BLOCK] - starts[a : a + BLOCK]
        h = mix(size.astype(np.uint64) * _TURN ^ (loads[at] & _MASK[np.minimum(size, 8)]))
        live, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(live):
            h[live] = mix(h[live] * _TURN ^ (loads[at[live] + k] & _MASK[np.minimum(size[live] - k, 8)]))
            k += 8
            live = live[size[live] > k]
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(text[at[i] : at[i] + size[i]], digest_size=8).digest(), "little")
        out[a : a + BLOCK] = h
    return out


def runs(word: np.ndarray, first: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, anchor) of all runs of windows. ``first``: where each text's words begin, and the end of the last."""
    parts = []
    reach = words - gram + 1  # grams in a window
    for a in range(0, max(0, len(word) - words + 1), BLOCK):
        own = word[a : a + BLOCK + words - 1]
        n = len(own) - words + 1
        joint = np.zeros(len(own) - gram + 1, np.uint64)
        for k in range(gram):
            joint = joint * _TURN + own[k : k + len(joint)]
        joint = mix(joint)
        least, width = joint, 1
        while width < reach:
            step = min(width, reach - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        start = np.arange(a, a + n)
        text = np.searchsorted(first, start, "right") - 1
        valid = start + words <= first[np.minimum(text + 1, len(first) - 1)]
        start, text, least = start[valid], text[valid], least[:n][valid]
        if not len(start):
            continue
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)])
        begin = np.flatnonzero(new)
        # A text that repeats itself has long runs: they are cut, so that a passage stays short.
        length = np.diff(np.append(begin, len(start)))
        pieces = -(-length // reach)
        head = np.repeat(begin, pieces) + reach * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(head + reach, np.repeat(begin + length, pieces))
        parts.append((text[head], start[head] - first[text[head]], stop - head, least[head].view(np.int64)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _texts(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in slices([batch], at):
            yield part, [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _texts(batches, 1):
        made = [identity(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([d for _, d in made], pa.binary()), pa.array([_short(d) for _, d in made], pa.int64()), pa.array([len(w) for w, _ in made], pa.int64())],
            names=["doc_id", "digest", "t", "n_words"],
        )


def _anchors(words: int, gram: int, places: bool):
    """Rows (anchor, t), or (anchor, t, start, n): of each text once in a while, however many copies a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, texts in _texts(batches, 0):
            if len(seen) > SEEN:
                seen.clear()
            hashes, t, first = [], [], [0]
            for text in texts:
                cut, digest = identity(text)
                if len(cut) < words or digest in seen:
                    continue
                seen.add(digest)
                hashes.append(word_hashes(text))
                t.append(_short(digest))
                first.append(first[-1] + len(hashes[-1]))
            if not t:
                continue
            text, start, n, anchor = runs(np.concatenate(hashes), np.array(first), words, gram)
            arrays = [pa.array(anchor), pa.array(np.array(t, np.int64)[text])]
            if places:
                arrays += [pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "t", "start", "n"][: len(arrays)])

    return run


def _passages(words: int):
    """Rows (doc_id, digest, start, anchor, key, passage) for rows (doc_id, text, digest, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 1):
            rows: list[list] = [[] for _ in range(6)]
            for doc, text, digest, found in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                cut, own = identity(text)
                if own != digest:
                    continue
                for r in found:
                    if r["start"] + r["n"] + words - 1 > len(cut):
                        continue  # another text's with the same short name
                    passage = b" ".join(cut[r["start"] : r["start"] + r["n"] + words - 1])
                    for column, value in zip(rows, (doc, digest, r["start"], r["anchor"], hashlib.md5(passage).digest(), passage), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, types, strict=True)], names=["doc_id", "digest", "start", "anchor", "key", "passage"])

    return run


class Automaton:
    """A suffix automaton over words. Each state keeps the id for which it was made: the least, as ids come in order."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, length: int, first: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _clone(self, p: int, word: bytes) -> int:
        """The state of the strings of ``next[p][word]`` that are no longer than p's by more than the word."""
        q = self.next[p][word]
        c = self._state(self.length[p] + 1, self.first[q])
        self.next[c] = dict(self.next[q])
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # of a text before
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, word)
                continue
            now, p = self._state(self.length[last] + 1, doc), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word)
            last = now

    def least(self, words: list[bytes], long: int) -> list[int | None]:
        """Matching statistics held at ``long`` words: for each window the least id that has it, None where there is none."""
        out, state, size = [], 0, 0
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(word)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            while size >= long and self.length[self.link[state]] >= long:
                state = self.link[state]
            size = min(size, long)
            if k >= long - 1:
                out.append(self.first[state] if size == long else None)
        return out


class Shard:
    """Passages of one shard, in order of ids: the least id of each window. The automaton is made when a second passage comes."""

    def __init__(self, words: int):
        self.words, self.held, self.alone = words, None, None

    def pass_by(self, passage: list[bytes], doc: int) -> list[int]:
        if self.alone is None:
            self.alone = passage, doc
            return [doc] * (len(passage) - self.words + 1)
        if self.held is None:
            self.held = Automaton()
            self.held.add(*self.alone)
        known = self.held.least(passage, self.words)
        new = [k for k, d in enumerate(known) if d is None]
        if new:
            self.held.add(passage[new[0] : new[-1] + self.words], doc)
        return [doc if d is None else d for d in known]


def _shards(words: int):
    """Rows (anchor, key, firsts) for rows (anchor, first, key, passage) that come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, shard = None, None
        for batch in batches:
            found = []
            for a, first, passage in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != anchor or shard is None:
                    anchor, shard = a, Shard(words)
                found.append(shard.pass_by(passage.split(), first))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int64()))], names=["anchor", "key", "firsts"])

    return run


def _windows(words: int):
    """Rows (anchor, key, k, window, first): the windows of passages, each by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for a, first, key, passage in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                cut = passage.split()
                for k in range(len(cut) - words + 1):
                    for column, value in zip(rows, (a, key, k, hashlib.md5(b" ".join(cut[k : k + words])).digest(), first), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, types, strict=True)], names=["anchor", "key", "k", "window", "first"])

    return run


FIRSTS = "anchor long, key binary, firsts array<long>"


def _firsts(suspects: DataFrame, words: int) -> DataFrame:
    """(anchor, key, firsts) of the different passages of ``suspects``."""
    different = materialize(suspects.groupBy("anchor", "key", "passage").agg(F.min("doc_id").alias("first")).select("anchor", "first", "key", "passage"), "passages")
    crowded = materialize(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("anchor"), "crowded", 1)
    few = different.join(crowded, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "first", "key")
    out = materialize(few.select("anchor", "first", "key", "passage").mapInArrow(_shards(words), FIRSTS), "firsts")
    if crowded.isEmpty():
        discard(different, crowded)
        return out
    many = different.join(crowded, "anchor", "left_semi").select("anchor", "first", "key", "passage")
    windows = many.mapInArrow(_windows(words), "anchor long, key binary, k int, window binary, first long")
    least = windows.groupBy("window").agg(F.min("first").alias("least"))
    found = windows.join(least, "window").groupBy("anchor", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "least"))), lambda x: x["least"]).alias("firsts"))
    split = materialize(found, "firsts-split")
    discard(different, crowded)
    return out.union(split)


def repeats(docs: DataFrame, words: int = WORDS, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_words, copy, windows) for every (id, text): which of its windows a smaller id has.

    ``copy``: a smaller id has all of the text, and ``windows`` is null. Else windows are places of words, from 0.
    """
    if not 0 < gram <= words:
        raise ValueError("a gram has at least one word and at most a window's")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = rows.mapInArrow(_whole, "doc_id long, digest binary, t long, n_words long").groupBy("doc_id", "digest", "t", "n_words").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    whole = materialize(whole, "whole-texts")
    least = materialize(whole.groupBy("digest", "t").agg(F.min("doc_id").alias("doc_id")), "first-texts")

    only = rows.select("text")
    pairs = only.mapInArrow(_anchors(words, gram, False), "anchor long, t long")
    shared = materialize(pairs.groupBy("anchor").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a != b").select("anchor"), "anchors")
    release(spark)
    placed = only.mapInArrow(_anchors(words, gram, True), "anchor long, t long, start int, n int").join(shared, "anchor")
    by_text = placed.groupBy("t").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("runs"))
    where = materialize(least.join(by_text, "t").select("doc_id", "digest", "runs"), "suspects")
    discard(shared)
    release(spark)
    cut = rows.join(where, "doc_id").select("doc_id", "text", "digest", "runs")
    suspects = materialize(cut.mapInArrow(_passages(words), "doc_id long, digest binary, start int, anchor long, key binary, passage binary"), "cut-passages")
    discard(where)
    release(spark)
    found = suspects.drop("passage").join(_firsts(suspects, words), ["anchor", "key"])
    smaller = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    places = found.select("doc_id", "digest", smaller.alias("w")).where(F.size("w") > 0).groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("w")).alias("windows"))
    all_rows = whole.join(least.select("digest", F.col("doc_id").alias("least")), "digest").join(places, ["doc_id", "digest"], "left")
    copy = (F.col("least") < F.col("doc_id")) & (F.col("n_words") >= words)
    out = materialize(all_rows.select("doc_id", "digest", "n_words", copy.alias("copy"), F.when(~copy, F.coalesce("windows", F.array().cast("array<int>"))).alias("windows")), "repeats")
    discard(suspects, whole, least)
    release(spark)
    return out


def kept(docs: DataFrame, found: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text", spans: str = "removed", n_words: str = "n_words") -> DataFrame:
    """``docs`` with what is left of each text (its words joined by spaces), ``n_words`` and the spans of words that were ``removed``.

    ``found`` is of ``repeats``. Columns of those two names are replaced, all others are kept.
    """
    docs = docs.drop(spans, n_words)
    ship(docs.sparkSession)
    own = private(docs, "id", "digest", "copy", "windows")
    right = found.select(*[F.col(c).alias(own[k]) for c, k in (("doc_id", "id"), ("digest", "digest"), ("copy", "copy"), ("windows", "windows"))])
    joined = docs.join(right, F.col(f"`{doc_id}`").cast("long") == F.col(own["id"]), "left").drop(own["id"])
    at, names = docs.columns.index(text), [*docs.columns, n_words, spans]
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, at):
            width = part.num_columns
            pick, left, counts, gone = [], [], [], []
            for k, (raw, digest, copy, windows) in enumerate(zip(texts, *(part.column(width - 3 + c).to_pylist() for c in range(3)), strict=True)):
                cut, name = identity(raw)
                if digest is not None and digest != name:
                    continue  # another text of this id
                pieces = [(0, len(cut))] if copy else merged(windows or [], words)
                pick.append(k)
                counts.append(len(cut))
                gone.append([{"start": a, "end": b} for a, b in pieces])
                left.append(b" ".join(w for a, b in zip([0, *(b for _, b in pieces)], [*(a for a, _ in pieces), len(cut)], strict=True) for w in cut[a:b]))
            columns = [c for k, c in enumerate(part.take(pa.array(pick, pa.int64())).columns) if k < width - 3]
            columns[at] = pa.array(left, pa.binary()).cast(part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, span)], names=names)

    return joined.mapInArrow(run, schema)


def merged(windows: list[int], words: int) -> list[tuple[int, int]]:
    """The maximal spans that windows cover."""
    out: list[tuple[int, int]] = []
    for a in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], a + words
        else:
            out.append((a, a + words))
    return out
