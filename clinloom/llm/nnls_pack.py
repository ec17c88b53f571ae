"""Packing token sequences: window-filling combinations by non-negative least squares.

A document is its token ids and a closing id 0. Whole windows of a long document are
sequences by themselves; what is left of each document is a remainder shorter than a
window. The remainders of a block of documents are counted by length, the combinations of
at most three lengths that fill a window exactly are enumerated; of each length those few are
kept that the histogram supports best, and their repeat counts are solved against it by
non-negative least squares (projected gradient with momentum over the sparse combinations),
rounded to the nearest as far as pieces last, and used. So few columns give large counts, which
rounding hardly moves: of 8,187 remainders of sf0.1 (3,648 windows) the plan fills 3,527. What remains is packed
greedily: the longest first, then the longest that still fits; a window that nothing fits
is filled by cutting one piece. Only less than a window then remains, and goes on to the
next block; at the end of a partition it is cut into sequences of powers of two, which
need no padding.

Packing is local to a partition of the scan, so no text or id is shuffled, and a block
bounds what is held in memory. Sequence numbers carry the partition's number, so a lost
task that runs again gives the same rows.

Ids are found once for each distinct stretch between single spaces and kept in a bounded
cache: byte-level pieces begin at such a space, so cutting the text there changes no id. A text
that spells an added token of the tokenizer (such as an end-of-text mark) is given to it whole:
the tokenizer makes that token's id of it, wherever it stands.

Defined cases: a null or empty text has the one token 0; repeated rows are packed as rows
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from clinloom.llm.slices import slices
from clinloom.session import ship

WINDOW = 1024
#: Remainders that are counted, solved and packed at a time.
BLOCK = 8192
#: Distinct stretches whose ids a worker keeps; beyond, only those that are met just then stay.
CACHE = 800_000
#: Longer stretches are not kept.
CACHED_CHARS = 48
#: Combinations kept for each length in each of their places, and steps of the solver.
KEPT, STEPS = 2, 600

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OUT = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
_SINGLE_SPACE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Marks of ASCII: never part of a word's piece, and joined to each other.
_MARKS = string.punctuation
_MARK_SET = frozenset(_MARKS)
#: Stretches that are given to the tokenizer as one text.
JOINED = 2000


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = sorted(t.content for t in self._tokenizer.get_added_tokens_decoder().values() if t.content)
        self._between = self._mark()
        self._opens = self._spaced()
        self._kept: dict[str, bytes] = {}

    def _mark(self) -> tuple[str, int] | None:
        """An added token and its id that takes nothing of its neighbours, can't begin or end inside of another one, and gives other text no id; else None."""
        for own, t in sorted(self._tokenizer.get_added_tokens_decoder().items()):
            m, others = t.content, [a for a in self._added if a != t.content]
            if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized) and not any(m.startswith(m[i:]) for i in range(1, len(m))):
                if not any(a in m or m in a or a.startswith(m[i:]) or a.endswith(m[:i]) for a in others for i in range(1, len(m))) and self._tokenizer.encode(m, add_special_tokens=False).ids == [own]:
                    return m, own
        return None

    def _spaced(self) -> np.ndarray:
        """By id: does its token begin with a space, which byte-level vocabularies write as a letter of their own?"""
        out = np.zeros(max(self._tokenizer.get_vocab().values()) + 1, bool)
        out[[i for t, i in self._tokenizer.get_vocab().items() if t[:1] == "\u0120"]] = True
        return out

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The text cut before each single space or line feed that has no white space around it."""
        if "\x01" not in text and text.count(" ") + text.count("\n") + 1 == len(text.split()):
            return text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")
        return _SINGLE_SPACE.sub("\x01", text).split("\x01") if "\x01" not in text else [text]

    def _ids(self, ask: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each stretch with its ids. Many are one text: words behind a space follow each other as they are, as a piece begins at
        such a space and has none inside; others have a mark of the tokenizer's own between them, which ends pieces on both sides.
        """
        words, rest = [], []
        for s in ask:
            (words if s[:1] == " " and s[1:].isalpha() else rest).append(s)
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, self._tokenizer.encode_batch_fast(list(map("".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at, data = (np.flatnonzero(self._opens[ids]) * 4).tolist(), ids.tobytes()
            if len(at) == len(group):
                yield from zip(group, map(data.__getitem__, map(slice, at, [*at[1:], len(data)])), strict=True)
            else:
                rest += group
        yield from self._marked(rest)

    def _marked(self, ask: list[str]) -> Iterator[tuple[str, bytes]]:
        if self._between is None:
            for s, e in zip(ask, self._tokenizer.encode_batch_fast(ask, add_special_tokens=False), strict=True):
                yield s, array("I", e.ids).tobytes()
            return
        mark, own = self._between
        groups = [ask[i : i + JOINED] for i in range(0, len(ask), JOINED)]
        for group, e in zip(groups, self._tokenizer.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at, data = (np.flatnonzero(ids == own) * 4).tolist(), ids.tobytes()
            yield from zip(group, map(data.__getitem__, map(slice, [0, *(x + 4 for x in at)], [*at, len(data)])), strict=True)

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        """Ids of stretches not seen before; what ends in marks is put together from word and marks."""
        kept, ends, need, ask = self._kept, {}, set(), []
        for s in new:
            if s[-1:] in _MARK_SET and (word := s.rstrip(_MARKS)) and word[-1].isalnum():
                ends[s] = word
                need.add(word)
                need.add(s[len(word) :])
            else:
                ask.append(s)
        ask += [s for s in need.difference(ask) if s not in kept]
        found = dict(self._ids(ask))
        get = lambda s: found[s] if s in found else kept[s]
        for s, word in ends.items():
            found[s] = get(word) + get(s[len(word) :])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {i for i, t in enumerate(texts) if any(a in t for a in self._added)}
        out = self._encode_plain(["" if i in special else t for i, t in enumerate(texts)])
        for i in special:
            out[i] = array("I", self._tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        cut = [self.stretches(t) if t else [] for t in texts]
        seen = set().union(*cut)
        if len(self._kept) > CACHE:
            self._kept = {s: b for s in seen if (b := self._kept.get(s)) is not None}
        kept = self._kept
        found = self._encode_new(list(seen.difference(kept)))
        if max(map(len, found), default=0) <= CACHED_CHARS:
            kept.update(found)
        else:
            long = {s: b for s, b in found.items() if len(s) > CACHED_CHARS}
            kept.update((s, b) for s, b in found.items() if len(s) <= CACHED_CHARS)
            return [b"".join([kept[s] if s in kept else long[s] for s in x]) for x in cut]
        return [b"".join(map(kept.__getitem__, x)) for x in cut]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def combinations(present: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of three lengths (0: unused) from ``present`` that sum to the window."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    a = present[present <= window // 2]
    pairs = a[has[window - a]]
    rows = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    for x in present[present <= window // 3]:
        y = present[(present >= x) & (present <= (window - x) // 2)]
        y = y[has[window - x - y]]
        rows.append(np.stack([np.full_like(y, x), y, window - x - y], 1))
    return np.concatenate(rows)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x that bring the lengths used, A x, close to the histogram."""
    if not len(combos):
        return np.zeros(0)
    size, flat = len(histogram), combos.ravel()
    used = combos > 0
    rows_of = np.bincount(flat, minlength=size)
    step = 1.0 / max(1.0, 3.0 * rows_of[1:].max())
    target = histogram.astype(float)
    target[0] = 0
    x = np.zeros(len(combos))
    z, pace = x, 1.0
    for _ in range(steps):
        rest = np.bincount(flat, np.repeat(z, 3), minlength=size) - target
        rest[0] = 0
        new = np.maximum(0, z - step * (rest[combos] * used).sum(1))
        next_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        z = new + (pace - 1) / next_pace * (new - x)
        x, pace = new, next_pace
    return x


def supported(combos: np.ndarray, histogram: np.ndarray, keep: int = KEPT) -> np.ndarray:
    """Of the combinations with a length in a place the ``keep`` whose rarest length is most frequent; the first of equals."""
    support = np.where(combos > 0, histogram[combos], 1 << 30).min(1)
    order = np.argsort(-support, kind="stable")
    take = np.zeros(len(combos), bool)
    for place in range(combos.shape[1]):
        held = combos[order, place]
        by_length = np.argsort(held, kind="stable")
        first = np.searchsorted(held[by_length], held[by_length], "left")
        take[order[by_length[(np.arange(len(held)) - first < keep) & (held[by_length] > 0)]]] = True
    return combos[take]


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) to use, never more of a length than the histogram has.

    Ties: combinations of equal counts are used in the order in which they are enumerated.
    """
    left = histogram.copy()
    combos = supported(combinations(np.flatnonzero(left[1:window]) + 1, window), left)
    x = solve_counts(combos, left)
    out = []
    for i in np.argsort(-x, kind="stable"):
        n = int(x[i] + 0.5)
        if n < 1:
            break
        lengths = tuple(int(v) for v in combos[i] if v)
        need = {v: lengths.count(v) for v in lengths}
        n = min(n, *(int(left[v]) // k for v, k in need.items()))
        if n:
            for v, k in need.items():
                left[v] -= n * k
            out.append((lengths, n))
    return out


class Packer:
    """Packs documents' ids; ``rows`` gathers (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, block: int = BLOCK):
        self.window, self.block, self.next = window, block, first_sequence
        self.rows: list[tuple] = []
        self.pool: dict[int, list[tuple]] = {}  # length -> pieces (doc_id, start, ids, doc_tokens)
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        full = total // w
        for i in range(full):
            self._emit([(doc_id, i * w, ids[4 * i * w : 4 * (i + 1) * w], total)])
        if total % w:
            self._hold((doc_id, full * w, ids[4 * full * w :], total))
        if self.held >= self.block:
            self._pack()

    def finish(self) -> None:
        self._pack()
        pieces = [p for n in sorted(self.pool, reverse=True) for p in self.pool[n]]
        total = sum(len(p[2]) // 4 for p in pieces)
        self.pool, self.held = {}, 0
        for bit in reversed(range(self.window.bit_length())):
            if total >> bit & 1:
                self._emit(self._take(pieces, 1 << bit))

    def _hold(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]) // 4, []).append(piece)
        self.held += 1

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    @staticmethod
    def _take(pieces: list[tuple], room: int) -> list[tuple]:
        """Pieces of ``room`` ids from the front of a list, the last one cut."""
        out = []
        while room:
            doc_id, start, ids, total = pieces.pop(0)
            n = len(ids) // 4
            if n > room:
                pieces.insert(0, (doc_id, start + room, ids[4 * room :], total))
                ids, n = ids[: 4 * room], room
            out.append((doc_id, start, ids, total))
            room -= n
        return out

    def _pack(self) -> None:
        histogram = np.zeros(self.window + 1, np.int64)
        for n, pieces in self.pool.items():
            histogram[n] = len(pieces)
        for lengths, repeats in plan(histogram, self.window):
            for _ in range(repeats):
                self._emit([self.pool[n].pop() for n in lengths])
        self._greedy()
        self.pool = {n: p for n, p in self.pool.items() if p}
        self.held = sum(map(len, self.pool.values()))

    def _greedy(self) -> None:
        lengths = sorted(n for n, p in self.pool.items() if p)
        total = sum(n * len(self.pool[n]) for n in lengths)

        def pop(i: int) -> tuple:
            n = lengths[i]
            piece = self.pool[n].pop()
            if not self.pool[n]:
                lengths.pop(i)
            return piece

        while total >= self.window:
            room, chosen = self.window, []
            while room:
                i = bisect_right(lengths, room) - 1
                piece = pop(i if i >= 0 else -1)
                if i < 0:
                    doc_id, start, ids, n = piece
                    rest = (doc_id, start + room, ids[4 * room :], n)
                    size = len(rest[2]) // 4
                    if not self.pool.get(size):
                        insort(lengths, size)
                    self.pool.setdefault(size, []).append(rest)
                    piece = (doc_id, start, ids[: 4 * room], n)
                chosen.append(piece)
                room -= len(piece[2]) // 4
            self._emit(chosen)
            total -= self.window


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    packer, tool = Packer((context.partitionId() if context else 0) << 36, window), encoder(path)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packer.rows, strict=True)], schema=_OUT)
        packer.rows.clear()
        return out

    for part in slices(batches, 1):
        keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
        for key, ids in zip(keys, tool.encode([t or "" for t in texts]), strict=True):
            packer.add(key, ids + b"\0\0\0\0")
        if packer.rows:
            yield flush()
    packer.finish()
    if packer.rows:
        yield flush()


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The pieces of all documents of ``df`` in sequences of at most ``window`` ids.

    ``tokenizer`` is the path of a tokenizers JSON file that every executor has.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    ship(df.sparkSession)
    return df.select(df[key].cast("long").alias("doc_id"), text).mapInArrow(lambda batches: pack_batches(batches, tokenizer, window), SCHEMA)
