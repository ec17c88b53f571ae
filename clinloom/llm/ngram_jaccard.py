"""N-gram Jaccard join: all documents whose shingle sets are alike, as components.

Words are the runs of bytes other than white space, lower-cased in A-Z; a document's set
holds the distinct shingles of ``words`` words (a shorter document's whole sequence is its
one shingle; a document without words has the empty set and no link). Two documents link
when ``den`` * |intersection| >= ``num`` * |union|. The join is exact: no link is lost.

1. One pass over the texts gives each document's set size and a 64-bit hash of its set.
   Equal sets are one node from here on, however many copies there are.
2. Size-derived bound: linked sets of sizes a, b differ in at most
   H = (a + b)(den - num) / (den + num) shingles. So if the space of shingle hashes is cut
   into H + 1 parts, one part at least is the same in both. Sizes fall in classes such that
   linked sets are in the same or in neighbouring classes; a node writes one key for each
   part, for its own class and for the next. Parts with next to no shingles say little, so
   a class has some parts more than H + 1 and a node leaves out up to as many of those.
   Small sets use the usual prefix of their least shingles instead.
   Of each key a task deals one node by the key and the others anywhere, as those are known to
   share it, so a key arrives at the shuffle once a task, however large its group.
   Linked sets share more than one key: where H + 1 + e parts are made, e + 1 at least are the
   same in both, less those left out. A node that shares fewer of a class's keys with any others
   has no link by them and leaves these keys. So the many that have a key or two in common by
   chance, more and more of them as the table grows, are no candidates.
3. Nodes that still share a key are candidates. Their sets are made again from the texts, and
   documents x shingles incidence matrices are multiplied block by block; a product row
   holds a document's overlap counts. Pairs whose overlap is below num (a + b) / (num + den)
   go. A component of candidates of up to ``GROUP`` nodes and ``BLOCK_SHINGLES`` shingles is one
   block. In a larger one, each node is first compared with the least node of each of its keys,
   in blocks of a pivot and up to ``LEAVES`` others. All blocks keep to that many shingles, in
   expectation, unless one set alone has more.
4. Links found give components. In the large ones, keys whose nodes are still in different
   components are looked at again: nodes outside a group's largest component against all of
   the group, in blocks of the same product. What shares a key inside one component needs no
   more work, so near copies in their thousands cost one row each, not a pair each.

With ``links`` every row also gets its number of links, so every candidate pair is verified
and not only what connects components: steps 3 and 4 are then one product. A candidate
component of more than GROUP nodes or ``BLOCK_SHINGLES`` shingles is cut by size class and hash into tiles, every pair of
nodes of the same or neighbouring classes is in one tile, and a tile adds up its links per node,
each for the number of rows it stands for. A tile's output is a row a node, not a row a pair.

Before sets go to a block of a large component, sketches do: a bit for each bucket of shingle
hashes, set where the bucket holds an odd number. Sets differ in at least as many shingles as
their sketches in bits, so a row that no other row of the block can link to by that bound is
left out, and its set (some thirty times its sketch) is not sent. No link is lost.

Nothing is collected; candidate ids are broadcast only up to ``BROADCAST_ROWS`` of them and
joined otherwise. Intermediate tables go to the shared scratch folder.

Defined cases: null text is empty; rows with a repeated id are documents of their own, each in
its own text's component; a row with a null id is in no component (null) and linked with
nothing, so no component goes through one; at threshold 1 equal sets link; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.llm.components import components
from clinloom.llm.slices import private, slices
from clinloom.session import discard, materialize, release, scratch, ship

#: Leaves of a pivot's block, rows of a group that is multiplied whole, and pivots of a chunk of a larger group.
LEAVES, GROUP, CHUNK = 256, 1024, 1024
#: Shingles of all rows of a block: what bounds a task's memory where documents are long.
BLOCK_SHINGLES = 1 << 20
#: Pairs whose product costs as much as sending one set to a block.
PAIRS_A_ROW = 100
#: More candidate ids than this are joined by a shuffle, not by broadcast.
BROADCAST_ROWS = 500_000
#: Sets up to this size (and linkable to one) use prefix keys.
SMALL = 24
#: Bytes of text whose words are hashed at a time, and keys that a task combines at a time.
SLAB_BYTES, COMBINE = 1 << 20, 750_000

U = np.uint64
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_TURN = U(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, U(0xD1342543DE82EF95)))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        slab, size, j = [], 0, i
        while j < len(texts) and (not slab or size < SLAB_BYTES):
            slab.append((texts[j] or "").encode("utf-8", "surrogatepass"))
            size += len(slab[-1])
            j += 1
        out += _slab_sets(slab, words)
        i = j
    return out


def _slab_sets(slab: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join([b"", *slab, b""]), np.uint8)
    first = np.concatenate([[1], np.cumsum([len(t) + 1 for t in slab]) + 1])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(slab)
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    body, inner = data[starts[0] :], ~space[starts[0] :]
    at = starts - starts[0]
    run = np.diff(np.append(at, len(body)))
    place = np.arange(len(body)) - np.repeat(at, run)
    place[~inner] = 0
    power = _powers(1 << int(place.max()).bit_length())
    word = mix(np.add.reduceat(np.where(inner, _BYTE[body] * power[place], U(0)), at))
    edges = np.searchsorted(starts, first)
    if len(word) >= words:
        joint = np.zeros(len(word) - words + 1, np.uint64)
        for k in range(words):
            joint = joint * _TURN + mix(word[k : len(word) - words + 1 + k] + U(k))
        joint = mix(joint)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joint[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in word[a:b]:
                whole = mix(whole ^ w)
            out.append(whole)
        else:
            out.append(none)
    return out


def node_of(grams: np.ndarray) -> int | None:
    """A hash of a set, as a signed 64-bit number; None for the empty set."""
    if not len(grams):
        return None
    both = (int(mix(grams).sum()) + len(grams) * int(_TURN)) & _ALL
    return int(mix(np.array([both], np.uint64)).view(np.int64)[0])


class Classes:
    """Size classes and numbers of parts for one threshold num / den, made as far as sizes have been asked for."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.num, self.den = num, den
        self.weak = 1 if 100 * num >= 88 * den else 0
        self.top: list[int] = []  # largest size of each class
        self.parts: list[int] = []
        self.spare: list[int] = []
        self._below, self._low = 1, 1

    def _add(self) -> None:
        high = self._low * self.den // self.num
        need = 2 * high * (self.den - self.num) // (self.den + self.num) + 1
        extra = 0
        for _ in range(30):
            mean = self._below / (need + extra)
            p = math.exp(-mean) * (1 + mean * self.weak)
            m = (need + extra) * p
            extra = min(need, math.ceil(m + 2 * math.sqrt(m)))
        self.top.append(high)
        self.parts.append(need + extra)
        self.spare.append(extra)
        self._below, self._low = self._low, high + 1

    def of(self, size: int) -> int:
        """The class of a size; it and the next one are there afterwards."""
        while len(self.top) < 2 or self.top[-2] < size:
            self._add()
        return bisect_left(self.top, size)

    def linked(self, both: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)


@lru_cache(maxsize=8)
def classes(num: int, den: int) -> Classes:
    return Classes(num, den)


#: Family of the prefix keys: one key in common is enough. Those of parts are named by ``_family``.
PREFIX = 1 << 2 | 2


def _family(k: int, need: int) -> int:
    """Names the keys that a set has of class k, of which a linked set shares at least ``need`` if they link by that class."""
    return need << 2 | k & 1


def keys_by_family(grams: np.ndarray, c: Classes) -> list[tuple[int, np.ndarray]]:
    """The keys of one set by families (see ``_family``): of two sets that link, there is a class of which they share as many as both need.

    Of the e + 1 parts or more that are the same in both, a set leaves out no more than it has weak ones; a set that
    leaves out none can meet one that leaves out e.
    """
    n, out = len(grams), []
    if not n or c.num == c.den:
        return []
    if n * c.num <= SMALL * c.den:
        prefix = n - -(-n * c.num // c.den) + 1
        out.append((PREFIX, mix(grams[:prefix] ^ U(0xA5A5A5A5))))
    if n > SMALL:
        own, content = c.of(n), np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ _TURN))])
        for k in (own, own + 1):
            m = c.parts[k]
            part = ((grams >> U(32)) * U(m) >> U(32)).astype(np.int64)
            held = np.bincount(part, minlength=m)
            end = np.cumsum(held)
            total = content[end] - content[end - held]
            key = mix(total + mix(np.arange(m, dtype=np.uint64) * _MIX1 + U((k + 1) * int(_MIX2) & _ALL)))
            weak = held <= c.weak
            left_out = int(weak.sum())
            out.append((_family(k, c.spare[k] + 1 - left_out), key[~weak]) if left_out <= c.spare[k] else (_family(k, 1), key))
    return out


def keys_of(grams: np.ndarray, c: Classes) -> np.ndarray:
    """The keys of one set: two sets that link have one in common; none at threshold 1, where only equal sets do."""
    return np.concatenate([np.zeros(0, np.uint64), *(key for _, key in keys_by_family(grams, c))])


def _nodes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets = shingle_sets(part.column(1).to_pylist(), words)
            named = part.column(0).is_valid().to_pylist()
            nodes = [node_of(s) if known else None for s, known in zip(sets, named, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())], names=["doc_id", "n_shingles", "node"])

    return run


def _with_node(words: int, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows with the hash of the set of column ``at`` as one more column."""
        for part in slices(batches, at):
            nodes = [node_of(s) for s in shingle_sets(part.column(at).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.int64())], names=[*part.schema.names, name])

    return run


def _combined(keys: list[np.ndarray], nodes: list[int], families: list[int]) -> pa.RecordBatch:
    """Rows (deal, key, node, family, alone): each key's least node, dealt by the key and perhaps alone with it here, and its other nodes."""
    key, held = np.concatenate(keys).view(np.int64), [len(k) for k in keys]
    node, family = np.repeat(np.array(nodes, np.int64), held), np.repeat(np.array(families, np.int32), held)
    order = np.lexsort((node, key))
    key, node, family = key[order], node[order], family[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    new = head | np.concatenate([[True], node[1:] != node[:-1]])
    key, node, family, head = key[new], node[new], family[new], head[new]
    alone = head & np.append(head[1:], True)
    by_node = np.argsort(node, kind="stable")  # a node's rows side by side compress better
    key, node, family, head, alone = key[by_node], node[by_node], family[by_node], head[by_node], alone[by_node]
    deal = np.where(head, key, mix((key ^ node).view(np.uint64)).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, key, node, family, alone)], names=["deal", "key", "node", "family", "alone"])


def _keys(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, keys, nodes, families, seen, held = classes(num, den), [], [], [], set(), 0
        for part in slices(batches, 0):
            for grams in shingle_sets(part.column(0).to_pylist(), words):
                node = node_of(grams)
                if node is None or node in seen:
                    continue
                seen.add(node)
                for family, key in keys_by_family(grams, c):
                    keys.append(key)
                    nodes.append(node)
                    families.append(family)
                    held += len(key)
                if held >= COMBINE:
                    yield _combined(keys, nodes, families)
                    keys, nodes, families, seen, held = [], [], [], set(), 0
        if held:
            yield _combined(keys, nodes, families)

    return run


ROWS = "block long, role int, node long, root long, copies long, grams array<long>"


def _sketches(words: int):
    """Rows (node, n_shingles, sketch) for rows (node, text), where the text's set is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            made = [(n, s) for n, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), words), strict=True) if node_of(s) == n]
            columns = [pa.array([n for n, _ in made], pa.int64()), pa.array([len(s) for _, s in made], pa.int64()), pa.array([sketch_of(s) for _, s in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n_shingles", "sketch"])

    return run


def _sets(words: int):
    """Rows (block, role, node, root, copies, text) with sets for texts, where the set is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 5):
            made = shingle_sets(part.column(5).to_pylist(), words)
            sound = [k for k, (n, s) in enumerate(zip(part.column(2).to_pylist(), made, strict=True)) if node_of(s) == n]
            grams = pa.array([made[k].view(np.int64) for k in sound], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(sound, pa.int64())) for c in range(5)), grams], names=["block", "role", "node", "root", "copies", "grams"])

    return run


class Block:
    """Rows of an incidence matrix: documents x the shingles that occur in the block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        joined = np.concatenate(sets)
        values, self.columns = np.unique(joined, return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.width = len(values)

    def overlaps(self, i: int, rows: np.ndarray) -> np.ndarray:
        """The product row of document i with the given rows: shingles in common."""
        mark = np.zeros(self.width, np.int32)
        mark[self.columns[self.ends[i] - self.sizes[i] : self.ends[i]]] = 1
        if len(rows) == len(self.sizes):
            return np.add.reduceat(mark[self.columns], self.ends - self.sizes)
        pick = np.concatenate([self.columns[self.ends[r] - self.sizes[r] : self.ends[r]] for r in rows])
        size = self.sizes[rows]
        return np.add.reduceat(mark[pick], np.cumsum(size) - size)


#: Roles of rows that are compared with others: see ``block_links``.
SOURCES = (1, 2, 4, 5, 7)


def block_links(nodes: list[int], sets: list[np.ndarray], roles: list[int], roots: list[int], copies: list[int], c: Classes) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a block that join different components, as far as needed to connect all that link; and links per node.

    Roles: 1, pivots, against 0, leaves; or 2, strays, against 3, a chunk of all; or 4, all pairs.
    All pairs are verified and counted, for the other node's copies, with 5 against 6 and among 7.
    """
    group = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    own = np.array([group[r] for r in roots])
    role, block, out = np.array(roles), Block(sets), []
    copy, count = np.array(copies, np.int64), np.zeros(len(nodes), np.int64)
    sources = np.flatnonzero(np.isin(role, SOURCES))
    for i in sources.tolist():
        rows, a = _partners(role, own, i), block.sizes[i]
        rows = rows[(block.sizes[rows] * c.num <= a * c.den) & (block.sizes[rows] * c.den >= a * c.num)] if len(rows) else rows
        if not len(rows):
            continue
        hit = rows[c.linked(block.overlaps(i, rows), a, block.sizes[rows])]
        if role[i] >= 5:
            count[i] += copy[hit].sum()
            count[hit] += copy[i]
        for r in hit[own[hit] != own[i]].tolist():
            if own[r] != own[i]:
                out.append((nodes[i], nodes[r]))
                own[own == own[r]] = own[i]
    return out, count


def _products(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, role, node, root, copies, grams) with the rows of a block together."""
        c = classes(num, den)
        nodes, sets, roles, roots, copies, seen, block = [], [], [], [], [], set(), None

        def close() -> pa.RecordBatch:
            found, count = block_links(nodes, sets, roles, roots, copies, c) if len(nodes) > 1 else ([], np.zeros(0, np.int64))
            some = np.flatnonzero(count).tolist()
            a = pa.array([a for a, _ in found] + [nodes[i] for i in some], pa.int64())
            b = pa.array([b for _, b in found] + [None] * len(some), pa.int64())
            return pa.RecordBatch.from_arrays([a, b, pa.array([None] * len(found) + count[some].tolist(), pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            grams = batch.column(5)
            values, offsets = grams.values.to_numpy(), grams.offsets.to_numpy()
            for r, (b, role, node, root, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if b != block:
                    if nodes:
                        yield close()
                    nodes, sets, roles, roots, copies, seen, block = [], [], [], [], [], set(), b
                if (node, role) in seen:  # a repeated id's text
                    continue
                seen.add((node, role))
                nodes.append(node)
                sets.append(values[offsets[r] : offsets[r + 1]].copy())
                roles.append(role)
                roots.append(root)
                copies.append(n)
        if nodes:
            yield close()

    return run


def sketch_of(grams: np.ndarray) -> bytes:
    """Parities of the set's shingles in a power of two of buckets, as bits; at least two buckets a shingle.

    Two sets differ in at least as many shingles as their sketches (folded to one size) in bits.
    """
    bits = 1 << max(8, (2 * len(grams) - 1).bit_length())
    held = np.bincount((mix(grams ^ _MIX2) & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((held & 1).astype(np.uint8)).tobytes()


class Sketches:
    """The sketches of a block's rows; tells which rows may link to one of them."""

    def __init__(self, sketches: list[bytes], sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        self.width = np.array([len(x) for x in sketches])
        self._at: dict[int, np.ndarray] = {}  # by width: where a row stands among those of its width
        self._by: dict[tuple[int, int], np.ndarray] = {}  # by own width and the width it is folded to
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self._by[w, w] = np.frombuffer(b"".join(sketches[r] for r in rows.tolist()), np.uint64).reshape(len(rows), w // 8)
            self._at[w] = np.full(len(sketches), -1)
            self._at[w][rows] = np.arange(len(rows))

    def _folded(self, own: int, to: int) -> np.ndarray:
        if (own, to) not in self._by:
            wide = self._folded(own, 2 * to)
            half = wide.shape[1] // 2
            self._by[own, to] = wide[:, :half] ^ wide[:, half:]
        return self._by[own, to]

    def near(self, i: int, rows: np.ndarray, c: Classes) -> np.ndarray:
        """Those of ``rows`` whose size and sketch allow a link to row ``i``."""
        a = self.sizes[i]
        rows = rows[(self.sizes[rows] * c.num <= a * c.den) & (self.sizes[rows] * c.den >= a * c.num)]
        out, own = [], int(self.width[i])
        for w in np.unique(self.width[rows]).tolist():
            some, to = rows[self.width[rows] == w], min(w, own)
            mine = self._folded(own, to)[self._at[own][i]]
            apart = np.bitwise_count(self._folded(w, to)[self._at[w][some]] ^ mine).sum(1, dtype=np.int64)
            out.append(some[apart * (c.den + c.num) <= (a + self.sizes[some]) * (c.den - c.num)])
        return np.concatenate(out) if out else rows


def _partners(role: np.ndarray, own: np.ndarray, i: int) -> np.ndarray:
    """The rows of a block that row ``i`` is to be compared with, by their roles; see ``block_links``."""
    if role[i] >= 5:
        rows = np.flatnonzero(role == (6 if role[i] == 5 else 7))
        return rows[rows > i] if role[i] == 7 else rows
    if role[i] == 4:
        rows = np.flatnonzero(own != own[i])
        return rows[rows > i]
    return np.flatnonzero((role == (0 if role[i] == 1 else 3)) & (own != own[i]))


def _sifted(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (block, role, node, root, n_shingles, sketch), a block's together: (block, role, node, root) of those that may link in it."""
        c, held, block = classes(num, den), [], None

        def close() -> pa.RecordBatch:
            rows = list({(r[1], r[2]): r for r in held}.values())
            role = np.array([r[1] for r in rows])
            group = {r: i for i, r in enumerate(dict.fromkeys(r[3] for r in rows))}
            own, keep = np.array([group[r[3]] for r in rows]), np.zeros(len(rows), bool)
            sketches = Sketches([r[5] for r in rows], [r[4] for r in rows])
            for i in np.flatnonzero(np.isin(role, SOURCES)).tolist():
                hit = sketches.near(i, _partners(role, own, i), c)
                if len(hit):
                    keep[i] = keep[hit] = True
            some = [rows[i] for i in np.flatnonzero(keep).tolist()]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], kind) for k, kind in enumerate(kinds)], names=["block", "role", "node", "root"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if row[0] != block:
                    if len(held) > 1:
                        yield close()
                    held, block = [], row[0]
                held.append(row)
        if len(held) > 1:
            yield close()

    return run


def _sift(blocks: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``blocks`` (block, role, node, root) whose sketch allows a link in their block: only their sets need be sent."""
    full = blocks.join(sketches, "node").select("block", "role", "node", "root", "n_shingles", "sketch")
    return full.repartition("block").sortWithinPartitions("block").mapInArrow(_sifted(num, den), "block long, role int, node long, root long")


def _multiply(full: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b, null) found in blocks and links per node (a, null, n); ``full`` has (block, role, node, root, copies, grams)."""
    full = full.select("block", "role", "node", "root", "copies", "grams").repartition("block").sortWithinPartitions("block")
    return full.mapInArrow(_products(num, den), "a long, b long, n long")


def _beside(small: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast where it is known to be small."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _pieces(rows: Column, shingles: Column, most: int) -> Column:
    """Into how many blocks so many rows with so many shingles are cut."""
    return F.greatest(F.ceil(rows / most), F.ceil(shingles / BLOCK_SHINGLES))


def _tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """Blocks in which every pair of a cell's nodes that sizes allow to link meets once; ``members`` has (cell, node, n_shingles).

    Sizes are classed by their logarithm, at a base a hair over den / num: sets that link are
    in the same or in neighbouring classes.
    """
    base = math.log(den / num) * (1 + 1e-9) if num < den else 1.0
    sized = members.withColumn("k", F.floor(F.log("n_shingles") / base))
    held = materialize(sized.groupBy("cell", "k").agg(_pieces(F.count(F.lit(1)), F.sum("n_shingles"), GROUP).alias("m")), "held")
    beside = lambda by, name: held.select("cell", (F.col("k") + by).alias("k"), F.col("m").alias(name))
    dealt = sized.join(held, ["cell", "k"]).join(beside(-1, "above"), ["cell", "k"], "left").join(beside(1, "below"), ["cell", "k"], "left")
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("node"), "m"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("q")
    own = dealt.select("cell", "k", "node", "p", up_to("m"))
    own = own.select(F.xxhash64("cell", "k", F.least("p", "q"), "k", F.greatest("p", "q")).alias("block"), F.expr("if(p = q, 7, if(p < q, 5, 6))").alias("role"), "node")
    low = dealt.where("above is not null").select("cell", "k", "node", "p", up_to("above"))
    low = low.select(F.xxhash64("cell", "k", "p", F.col("k") + 1, "q").alias("block"), F.lit(5).alias("role"), "node")
    high = dealt.where("below is not null").select("cell", "k", "node", "p", up_to("below"))
    high = high.select(F.xxhash64("cell", F.col("k") - 1, "q", "k", "p").alias("block"), F.lit(6).alias("role"), "node")
    return own.unionByName(low).unionByName(high).withColumn("root", F.col("node"))


def _first_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks of a pivot and at most about LEAVES leaves; ``pairs`` has (node, peer, n_shingles: the node's)."""
    many = pairs.groupBy("peer").agg(_pieces(F.count(F.lit(1)), F.sum("n_shingles"), LEAVES).alias("salts")).where("salts > 1")
    salted = pairs.join(many, "peer", "left").withColumn("block", F.xxhash64("peer", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1)))))
    leaves = salted.select("block", F.lit(0).alias("role"), "node", F.col("node").alias("root"))
    pivots = salted.select("block", F.lit(1).alias("role"), F.col("peer").alias("node"), F.col("peer").alias("root")).distinct()
    return leaves.unionByName(pivots)


def _groups(members: DataFrame, by: str, *more: Column) -> DataFrame:
    """Per group: its size and shingles, its most frequent root, and those of members of another root; ``more``: b, a minimum, s and t, sums."""
    roots = members.groupBy(by, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"), *more)
    again = [F.min("b").alias("b"), F.sum("s").alias("s"), F.sum("t").alias("t")] if more else []
    held = roots.groupBy(by).agg(F.sum("n").alias("size"), F.sum("m").alias("shingles"), F.max(F.struct("n", "root", "m")).alias("top"), *again)
    return held.select(by, *(["b", "s", "t"] if more else []), "size", "shingles", F.col("top.root").alias("giant"), (F.col("size") - F.col("top.n")).alias("strays"), (F.col("shingles") - F.col("top.m")).alias("stray_shingles"))


def _group_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of groups (gid, node, root, giant, size, shingles, strays, stray_shingles): a small group whole, else its strays against all."""
    small = (F.col("size") <= GROUP) & (F.col("shingles") <= BLOCK_SHINGLES)
    one = rows.where(small).select(F.col("gid").alias("block"), F.lit(4).alias("role"), "node", "root")
    wide = rows.where(~small).withColumn("l", _pieces(F.col("size"), F.col("shingles"), GROUP)).withColumn("p", _pieces(F.col("strays"), F.col("stray_shingles"), CHUNK))
    own_l, own_p = F.pmod(F.xxhash64("node"), "l"), F.pmod(F.xxhash64("node", F.lit(1)), "p")
    leaves = wide.where("p > 0").select("gid", "node", "root", own_l.alias("l"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("p"), F.lit(3).alias("role"))
    pivots = wide.where("root != giant").select("gid", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("l") - 1)).alias("l"), own_p.alias("p"), F.lit(2).alias("role"))
    many = leaves.unionByName(pivots).select(F.xxhash64("gid", "l", "p").alias("block"), "role", "node", "root")
    return one.unionByName(many)


def _each_of(held: DataFrame, what: str, named: DataFrame, *fields: str) -> DataFrame:
    """The distinct (node, what) of ``held`` whose node is in ``named``, with its fields; a node meets ``named`` as one row, however much it holds."""
    packed = held.groupBy("node").agg(F.collect_set(what).alias(what))
    return packed.join(named, "node").select("node", *fields, F.explode(what).alias(what))


def _second_blocks(shared: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks that test every pair that shares a key and is in different components; ``sizes`` has (node, n_shingles).

    A candidate component is tested as one group or key by key, whichever costs less in
    pairs compared and sets sent.
    """
    named = sizes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n_shingles")
    held = shared.select("node", "key").union(shared.select("peer", "key"))
    members = materialize(_each_of(held, "key", named, "root", "n_shingles"), "members")
    n = members.count()
    # All that is asked of a key is found in one grouping, and meets its nodes in one join. Of keys with the same nodes one is
    # enough, those inside one component are done, and both nodes of a key with two have been compared already.
    stats = ["size", "shingles", "giant", "strays", "stray_shingles"]
    signs = [F.sum(F.shiftright(F.xxhash64("node", *salt), 20)).alias(name) for name, salt in (("s", []), ("t", [F.lit(1)]))]
    lists = _groups(members, "key", F.min("node").alias("b"), *signs).where("size > 2 and strays > 0")
    once = lists.groupBy("size", "s", "t").agg(F.min(F.struct("key", "b", *stats)).alias("x")).select("x.*")
    once = materialize(once, "once", n)
    every, members = members, materialize(members.join(_beside(once), "key"), "members", n)
    discard(every)
    if members.isEmpty():
        return members.select(F.col("key").alias("block"), F.lit(4).alias("role"), "node", "root")
    n = members.count()
    cells = components(members.select(F.col("node").alias("a"), "b"))
    whole = materialize(cells.select("node", F.col("root").alias("cell")).join(named, "node"), "whole", n)
    discard(cells)
    key_cost = F.col("size") * F.col("strays") / PAIRS_A_ROW + F.col("size")
    pieces = once.join(whole.select(F.col("node").alias("b"), "cell"), "b").groupBy("cell").agg(F.sum(key_cost).alias("pieces"))
    sent = F.col("size") * F.ceil(F.col("strays") / CHUNK) + F.col("strays") * F.ceil(F.col("size") / GROUP)
    at_once = F.col("size") * F.col("strays") / PAIRS_A_ROW + sent
    at_hand = (F.col("size") <= GROUP) & (F.col("shingles") <= BLOCK_SHINGLES)
    cells_done = materialize(_groups(whole, "cell").join(pieces, "cell").withColumn("as_whole", at_hand | (at_once <= F.col("pieces"))), "cells", n)
    one = whole.join(cells_done.where("as_whole"), "cell").withColumn("gid", F.xxhash64(F.lit(0), "cell"))
    by_key = materialize(whole.join(cells_done.where("not as_whole"), "cell", "left_semi").select("node"), "by_key", n)
    keyed = members.join(_beside(by_key), "node", "left_semi").withColumn("gid", F.xxhash64(F.lit(1), "key"))
    fields = ["gid", "node", "root", "giant", "size", "shingles", "strays", "stray_shingles"]
    return _group_blocks(one.select(*fields).unionByName(keyed.select(*fields)))


def _labels(rows: DataFrame, shared: DataFrame, pairs: DataFrame, ids: DataFrame, words: int, num: int, den: int, links: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(node, root) of the components of all links among nodes that share a key; with ``links`` also (node, n) of their links."""
    cells = components(pairs.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    nodes = cells.count()
    placed = materialize(cells.join(ids, "node"), "cells", nodes)
    sizes = materialize(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m")), "sizes", nodes)
    wanted = placed.join(sizes, "root").withColumn("small", (F.col("n") <= GROUP) & (F.col("m") <= BLOCK_SHINGLES))
    wanted = wanted.select(F.col("least").alias("doc_id"), F.xxhash64("root").alias("block"), F.lit(7 if links else 4).alias("role"), "node", F.col("node").alias("root"), "copies", "small", "n_shingles", F.col("root").alias("cell"))
    wanted = materialize(wanted, "wanted", nodes)
    discard(cells, placed, sizes)

    # A small candidate component is one block, in which all its pairs are settled.
    small, large = wanted.where("small"), wanted.where("not small")
    full = rows.join(_beside(small), "doc_id").select("block", "role", "node", "root", "copies", "text").mapInArrow(_sets(words), ROWS)
    found = materialize(_multiply(full, num, den), "found")

    def sketched() -> DataFrame:
        of = rows.join(_beside(large), "doc_id").select("node", "text").mapInArrow(_sketches(words), "node long, n_shingles long, sketch binary")
        return materialize(of.dropDuplicates(["node"]), "sketches")

    def linked(blocks: DataFrame, sketches: DataFrame) -> DataFrame:
        """Links in blocks; only rows that their sketches leave are looked up again and sent with their sets."""
        sifted = materialize(_sift(blocks, sketches, num, den), "sifted")
        sifted = materialize(sifted.join(large.select("node", "doc_id", "copies"), "node"), "sifted", sifted.count())
        part = rows.join(_beside(sifted), "doc_id").select("block", "role", "node", "root", "copies", "text").mapInArrow(_sets(words), ROWS)
        out = materialize(_multiply(part, num, den), "found")
        release(rows.sparkSession)
        return out

    if links:
        tiled = None
        if not large.isEmpty():
            sketches = sketched()
            tiles = materialize(_tiles(large.select("cell", "node", "n_shingles"), num, den), "tiles")
            tiled = linked(tiles, sketches)
            discard(sketches, tiles)
        every = found if tiled is None else found.union(tiled)
        labels = components(every.where("b is not null").select("a", "b"))
        counts = materialize(every.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "counts")
        discard(wanted, found, *([] if tiled is None else [tiled]))
        release(rows.sparkSession)
        return labels, counts
    found = found.select("a", "b")
    stars = materialize(_each_of(pairs, "peer", large.select("node", "n_shingles"), "n_shingles"), "stars")
    if stars.isEmpty():
        labels = components(found)
    else:
        sketches = sketched()
        first = linked(_first_blocks(stars), sketches)
        labels = components(found.union(first.select("a", "b")))
        blocks = materialize(_second_blocks(shared.join(large.select("node"), "node", "left_semi"), labels, large.select("node", "n_shingles")), "blocks")
        second = linked(blocks, sketches)
        if not second.where("b is not null").isEmpty():
            before = labels
            labels = components(before.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second.select("a", "b")))
            discard(before)
        discard(sketches, first, blocks, second)
    discard(wanted, found, stars)
    release(rows.sparkSession)
    return labels, None


def _enough(met: DataFrame) -> DataFrame:
    """(key, node) of those of ``met`` (key, node, family) whose node shares as many keys of the family as a link by them takes."""
    held = met.groupBy("node", "family").agg(F.collect_set("key").alias("keys"))
    return held.where(F.size("keys") >= F.shiftright("family", 2)).select("node", F.explode("keys").alias("key"))


def _starred(members: DataFrame) -> DataFrame:
    """(key, node, peer) for (key, node): the least node of a key with all its others."""
    members = materialize(members, "members")
    least = members.groupBy("key").agg(F.min("node").alias("peer"), F.max("node").alias("most")).where("peer < most").select("key", "peer")
    return members.join(least, "key").where("peer != node").select("key", "node", "peer")


def _linked_nodes(rows: DataFrame, ids: DataFrame, words: int, num: int, den: int, links: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """``_labels`` of the nodes that share a key, or None where none do."""
    dealt = rows.select("text").mapInArrow(_keys(words, num, den), "deal long, key long, node long, family int, alone boolean")
    of_deal = Window.partitionBy("deal")
    least, most = F.min("node").over(of_deal), F.max(F.when(F.col("alone"), F.col("node")).otherwise(F.lit((1 << 63) - 1))).over(of_deal)
    met = materialize(dealt.withColumn("met", least != most).where("met").select("key", "node", "family"), "met")
    del dealt
    release(met.sparkSession)
    shared = materialize(_starred(_enough(met)), "shared")
    discard(met)
    release(shared.sparkSession)
    pairs = materialize(shared.select("node", "peer").distinct(), "pairs", shared.count())
    found = (None, None) if pairs.isEmpty() else _labels(rows, shared, pairs, ids, words, num, den, links)
    discard(shared, pairs)
    return found


def _joined(docs: DataFrame, words: int, num: int, den: int, key: str, text: str, links: bool) -> tuple[DataFrame, list[DataFrame]]:
    """What ``join_components`` returns, with the hashes of node and component, and the written tables that it reads."""
    ship(docs.sparkSession)
    with scratch() as keep:
        out, held = _placed(docs, words, num, den, key, text, links)
        for df in held:
            keep(df)
    return out, held


def _placed(docs: DataFrame, words: int, num: int, den: int, key: str, text: str, links: bool) -> tuple[DataFrame, list[DataFrame]]:
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    known = materialize(rows.mapInArrow(_nodes(words), f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, node long"), "nodes")
    ids = materialize(known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("doc_id").alias("copies"), F.first("n_shingles").alias("n_shingles")), "ids", known.count())

    labels, counts = (None, None) if num == den else _linked_nodes(rows.where("doc_id is not null"), ids, words, num, den, links)
    held = [known, ids]
    if labels is None:
        named = ids.select("node", F.col("node").alias("root"), F.col("least").alias("component_id"))
    else:
        rooted, n = ids.join(labels, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), ids.count()
        rooted = materialize(rooted, "rooted", n)
        tops = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "tops", n)
        named = materialize(rooted.join(tops, "root").select("node", "root", "component_id"), "named", n)
        discard(rooted, tops, labels)
        held.append(named)
    out = known.join(named, "node", "left")
    fields = [F.col("doc_id"), F.col("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    if links:
        linked = ids.select("node", "copies", F.lit(0).cast("long").alias("n")) if counts is None else ids.select("node", "copies").join(counts, "node", "left")
        out = out.join(linked, "node", "left")
        held += [] if counts is None else [counts]
        fields.append(F.when(F.col("node").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return out.select(*fields, "node", "root"), held


def join_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; with ``links`` also n_links, the other rows it links to."""
    return _joined(docs, words, num, den, key, text, links)[0].drop("node", "root")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with only the document of the least id of each component; rows with a null id or without words stay.

    Of a component's rows that have its least id, the one of the least set hash, then text, stays.
    """
    with scratch() as keep:
        return _kept(docs, words, num, den, key, text, keep)


def _kept(docs: DataFrame, words: int, num: int, den: int, key: str, text: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``keep_one`` returns; ``keep`` is given the written tables that it reads."""
    found, held = _joined(docs, words, num, den, key, text, False)
    found = materialize(found.where("node is not null").select(F.col("doc_id").alias(key), "node", "root", "component_id"), "components")
    discard(*held)
    repeated = materialize(found.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    gone = found.where(F.col("component_id") < F.col(key))
    if repeated.isEmpty():
        gone = keep(materialize(gone.select(key), "gone"))
        return docs.join(_beside(gone), key, "left_anti").select(*docs.columns)
    # Rows that share an id are told apart by their sets.
    names = private(docs, "node", "place")
    keep(repeated)
    gone = keep(materialize(gone.join(repeated, key, "left_anti").select(key), "gone"))
    once = docs.join(_beside(gone), key, "left_anti").join(_beside(repeated), key, "left_anti").select(*docs.columns)
    several = docs.join(_beside(repeated), key, "left_semi").select(*docs.columns)
    several = several.mapInArrow(_with_node(words, several.columns.index(text), names["node"]), T.StructType([*several.schema.fields, T.StructField(names["node"], T.LongType())]))
    least = found.where(F.col("component_id") == F.col(key)).join(repeated, key, "left_semi").groupBy(key, "root").agg(F.min("node").alias(names["node"]))
    least = keep(materialize(least.select(key, names["node"]), "kept"))
    own = F.row_number().over(Window.partitionBy(key, names["node"]).orderBy(text))
    first = several.join(_beside(least), [key, names["node"]], "left_semi").withColumn(names["place"], own).where(F.col(names["place"]) == 1)
    several = several.where(F.col(names["node"]).isNull()).select(*docs.columns).unionByName(first.select(*docs.columns))
    return once.unionByName(several)
