"""Multinomial logistic regression over all terms of a corpus, without a vector of terms anywhere.

From zero, every gradient and so every iterate of the fit is a sum of training rows: with X the
rows (TF-IDF at length 1), the coefficients are X' A for some A, a row a document and a column a
class. The fit is therefore done on A and on the margins X X' A, both as long as the documents
and not as the vocabulary, which is hundreds of times longer. It is the same problem with the
same solution, found by conjugate gradients, whose steps along a line need margins only.

1. Documents are dealt into blocks. A block's distinct terms (64-bit hashes) and its counts are
   cut into as many parts of the hash space as bound a part's entries.
2. A part's blocks meet once: its terms are numbered, counted in training documents and
   weighted. A row of ``parts`` is a part's whole matrix, in arrays, sorted by document. Its
   training rows are written once more for the iterations: terms with the same counts in the
   same documents have equal columns, and m of them are one whose weights are sqrt(m) as great.
3. One product X X' R an iteration: a task adds a part's rows to coefficients of that part's
   terms, which no one else needs, and multiplies them out again; margins are summed by block.
   Residuals of a row add up to zero over the classes, so the last class is less the others' sum.
4. A block's margins, A and directions are one row, written after each iteration. The driver
   has their inner products, the intercepts, and while a product runs the residuals it sends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.session import discard, materialize, release, ship

#: Documents and entries of a block, and characters of text for which a part is made.
BLOCK_ROWS, BLOCK_ENTRIES, PART_CHARS = 4096, 1 << 21, 1 << 22
#: The fit ends at this share of the first gradient's length, or after so many steps; a step is tried so often.
TOLERANCE, ITERATIONS, TRIALS = 1e-4, 200, 12

ENTRIES = "part int, block long, test boolean, terms binary, rows binary, ids binary, counts binary, labels binary"
PARTS = "part int, hashes binary, idf binary, blocks array<long>, tests array<boolean>, sizes array<long>, rows binary, ids binary, counts binary"
TRAINED = "part int, idf binary, blocks array<long>, sizes array<long>, rows binary, ids binary, counts binary"
STATE = "block long, state binary, sums array<double>"


def _rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_ENTRIES = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("test", pa.bool_()), *((c, pa.binary()) for c in ("terms", "rows", "ids", "counts", "labels"))])
_PARTS = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("idf", pa.binary()), ("blocks", pa.list_(pa.int64())), ("tests", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("rows", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
_TRAINED = pa.schema([f for f in _PARTS if f.name not in ("hashes", "tests")])


def _entries(parts: int):
    """Rows (label, test, terms: array<long>) as blocks: one row with the labels (part -1), and one for each part that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        named = TaskContext.get().partitionId() << 32
        held: dict[bool, list] = {False: [], True: []}
        entries = {False: 0, True: 0}

        def close(test: bool) -> pa.RecordBatch:
            nonlocal named
            terms = np.concatenate([t for _, t in held[test]])
            row = np.repeat(np.arange(len(held[test])), [len(t) for _, t in held[test]])
            known, ids = np.unique(terms, return_inverse=True)
            pairs, counts = np.unique(row * len(known) + ids, return_counts=True)
            row, ids = np.divmod(pairs, max(1, len(known)))
            part = (((known.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            # Hashes are sorted as signed numbers; parts are ranges of the unsigned ones.
            of = part[ids]
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(parts + 1))
            out = {"part": [-1], "block": [named], "test": [test], "terms": [None], "rows": [None], "ids": [None], "counts": [None], "labels": [np.array([y for y, _ in held[test]], np.int32).tobytes()]}
            for p in np.flatnonzero(np.diff(ends)).tolist():
                mine = order[ends[p] : ends[p + 1]]
                used, place = np.unique(ids[mine], return_inverse=True)
                for name, value in {"part": p, "block": named, "test": test, "terms": known[used].tobytes(), "rows": row[mine].astype(np.uint16).tobytes(), "ids": place.astype(np.int32).tobytes(), "counts": counts[mine].astype(np.int32).tobytes(), "labels": None}.items():
                    out[name].append(value)
            named += 1
            held[test], entries[test] = [], 0
            return _rows(out, _ENTRIES)

        for batch in batches:
            lists = batch.column(2)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, (label, test) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                terms = values[offsets[k] : offsets[k + 1]].copy()
                held[test].append((label, terms))
                entries[test] += len(terms)
                if len(held[test]) >= BLOCK_ROWS or entries[test] >= BLOCK_ENTRIES:
                    yield close(test)
        for test in (False, True):
            if held[test]:
                yield close(test)

    return run


def _joined(n: int):
    """A part's rows, which are together, as one row: training blocks first; terms of test rows only are dropped."""

    def one(blocks: list[dict]) -> pa.RecordBatch:
        blocks.sort(key=lambda b: (b["test"], b["block"]))
        terms = [np.frombuffer(b["terms"], np.int64) for b in blocks]
        hashes, place = np.unique(np.concatenate(terms), return_inverse=True)
        starts = np.cumsum([0, *map(len, terms)])
        ids = [place[s + np.frombuffer(b["ids"], np.int32)] for s, b in zip(starts, blocks, strict=False)]
        rows, counts = [np.frombuffer(b["rows"], np.uint16) for b in blocks], [np.frombuffer(b["counts"], np.int32) for b in blocks]
        train = [i for i, b in zip(ids, blocks, strict=True) if not b["test"]]
        df = np.bincount(np.concatenate(train), minlength=len(hashes)) if train else np.zeros(len(hashes), np.int64)
        known = df > 0
        new = np.cumsum(known) - 1
        keep = [known[i] for i in ids]
        cut = lambda arrays, kind: np.concatenate([a[k] for a, k in zip(arrays, keep, strict=True)]).astype(kind).tobytes()
        idf = np.log((1 + n) / (1 + df[known])) + 1
        out = {"part": [blocks[0]["part"]], "hashes": [hashes[known].tobytes()], "idf": [idf.tobytes()], "blocks": [[b["block"] for b in blocks]], "tests": [[b["test"] for b in blocks]], "sizes": [[int(k.sum()) for k in keep]]}
        out |= {"rows": [cut(rows, np.uint16)], "ids": [cut([new[i] for i in ids], np.int32)], "counts": [cut(counts, np.int32)]}
        return _rows(out, _PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield one(held)
                    held = []
                held.append(row)
        if held:
            yield one(held)

    return run


class _Part:
    """A row of PARTS as a matrix, of the training rows or of all."""

    def __init__(self, row: dict, every: bool):
        tests = row["tests"]
        self.blocks = [b for b, t in zip(row["blocks"], tests, strict=True) if every or not t]
        self.trained = sum(not t for t in tests)
        self.sizes = row["sizes"][: len(self.blocks)]
        n = sum(self.sizes)
        self.idf = np.frombuffer(row["idf"])
        self.rows, self.ids, counts = (np.frombuffer(row[c], kind, n) for c, kind in (("rows", np.uint16), ("ids", np.int32), ("counts", np.int32)))
        logs = 1 + np.log(np.arange(1, counts.max(initial=1) + 1))
        self.weights = self.idf[self.ids] * logs[counts - 1]

    def cuts(self) -> Iterator[tuple[int, int, int]]:
        end = np.cumsum(self.sizes).tolist()
        return zip(self.blocks, [0, *end[:-1]], end, strict=True) if end else iter(())

    def coefficients(self, sent: dict[int, np.ndarray], k: int) -> np.ndarray:
        own = [sent[block][self.rows[a:b]] for block, a, b in list(self.cuts())[: self.trained]]
        if not own:
            return np.zeros((len(self.idf), k))
        own = np.concatenate(own)
        ids, weights = self.ids[: len(own)], self.weights[: len(own)]
        return np.stack([np.bincount(ids, weights * own[:, j], len(self.idf)) for j in range(k)], 1)

    def margins(self, per_term: Callable[[np.ndarray, np.ndarray], np.ndarray], into: dict[int, np.ndarray], lengths: dict[int, int], k: int) -> None:
        """Adds ``per_term(ids, weights)``, an array an entry, to each block's rows, which the entries are sorted by."""
        for block, a, b in self.cuts():
            if a == b:
                continue
            rows = self.rows[a:b]
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            if block not in into:
                into[block] = np.zeros((lengths[block], k))
            into[block][rows[starts]] += np.add.reduceat(per_term(self.ids[a:b], self.weights[a:b]), starts, axis=0)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold the greatest."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}")


def _marks(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits of each (place, count), whose sum over a term's entries tells its column from others."""
    x = at.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _trained(lengths: dict[int, int]):
    """Rows of PARTS to rows of TRAINED: the training rows, with terms of equal columns as one, frequent ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = _starts(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                blocks = [b for b, t in zip(row["blocks"], row["tests"], strict=True) if not t]
                sizes = row["sizes"][: len(blocks)]
                if not (n := sum(sizes)):
                    continue
                rows, ids, counts = (np.frombuffer(row[c], kind, n) for c, kind in (("rows", np.uint16), ("ids", np.int32), ("counts", np.int32)))
                idf = np.frombuffer(row["idf"])
                columns = np.zeros(len(idf), np.uint64)
                np.add.at(columns, ids, _marks(np.repeat([starts[b] for b in blocks], sizes) + rows, counts))
                _, first, group, alike = np.unique(columns, return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(idf[first], kind="stable")
                new = np.empty(len(order), np.int64)
                new[order] = np.arange(len(order))
                one = np.zeros(len(idf), bool)
                one[first] = True
                keep = one[ids]
                ends = np.concatenate([[0], np.cumsum(keep)])[np.cumsum([0, *sizes])]
                out = {"part": [row["part"]], "idf": [(idf[first] * np.sqrt(alike))[order].tobytes()], "blocks": [blocks], "sizes": [np.diff(ends).tolist()], "rows": [rows[keep].tobytes()]}
                yield _rows(out | {"ids": [_narrow(new[group][ids[keep]]).tobytes()], "counts": [_narrow(counts[keep]).tobytes()]}, _TRAINED)

    return run


def _starts(lengths: dict[int, int]) -> dict[int, int]:
    """The place of each block's first document where all blocks are in a row."""
    return dict(zip(sorted(lengths), np.cumsum([0, *(lengths[b] for b in sorted(lengths))]).tolist(), strict=False))


def _iterated(sent, lengths: dict[int, int]):
    """Rows of TRAINED to a task's sums of X X' R by block; ``sent`` has R as classes x documents, blocks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, residuals, met = _starts(lengths), sent.value, set()
        into = np.zeros(residuals.shape)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, idf = sum(row["sizes"]), np.frombuffer(row["idf"])
                at = np.repeat([starts[b] for b in row["blocks"]], row["sizes"]) + np.frombuffer(row["rows"], np.uint16)
                ids, counts = (_widened(row[c], n).astype(np.intp) for c in ("ids", "counts"))
                weights = idf[ids] * (1 + np.log(np.arange(1, counts.max() + 1)))[counts - 1]
                for r, z in zip(residuals, into, strict=True):
                    own = np.bincount(ids, r[at] * weights, len(idf))
                    z += np.bincount(at, own[ids] * weights, len(z))
                met.update(row["blocks"])
        for block in sorted(met):
            z = into[:, starts[block] : starts[block] + lengths[block]]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([z.T.tobytes()], pa.binary())], names=["block", "kind", "data"])

    return run


def _product(sent, k: int, lengths: dict[int, int]):
    """Rows of PARTS to a task's sums of X X' R by block; ``sent`` has R by block. Without it: the rows' squared lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part = _Part(batch.slice(i, 1).to_pylist()[0], True)
                if sent is None:
                    part.margins(lambda ids, w: (w * w)[:, None], into, lengths, 1)
                else:
                    c = part.coefficients(sent.value, k)
                    part.margins(lambda ids, w: w[:, None] * c[ids], into, lengths, k)  # noqa: B023
        for block, z in into.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([z.tobytes()], pa.binary())], names=["block", "kind", "data"])

    return run


_SENT = "block long, kind int, data binary"

def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray | None]]:
    """Of rows (block, kind, data), a block's together and kind 0 first: block, the data of kind 0, the others' sum."""
    block, own, total = None, None, None
    for batch in batches:
        for b, kind, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if b != block:
                if block is not None:
                    yield block, own, total
                block, own, total = b, None, None
            if kind == 0:
                own = data
            else:
                total = np.frombuffer(data).copy() if total is None else total + np.frombuffer(data)
    if block is not None:
        yield block, own, total


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Block:
    """Labels, inverse lengths, and of each class: A and its margins Z, direction P and its Q, gradient G and its H."""

    labels: np.ndarray
    scale: np.ndarray
    v: np.ndarray  # 6 x rows x classes

    @classmethod
    def read(cls, data: bytes, k: int) -> Block:
        n = len(data) // (12 + 48 * k)
        return cls(np.frombuffer(data, np.int32, n), np.frombuffer(data[4 * n :], np.float64, n), np.frombuffer(data[12 * n :]).reshape(6, n, k))

    def write(self) -> bytes:
        return self.labels.tobytes() + self.scale.tobytes() + self.v.tobytes()

    def moved(self, at: Move) -> Block:
        """The new direction -G + turn * P, and a step along it."""
        a, z, p, q, g, h = self.v
        p, q = at.turn * p - g, at.turn * q - h
        return Block(self.labels, self.scale, np.stack([a + at.step * p, z + at.step * q, p, q, g, h]))

    def residual(self, intercepts: np.ndarray) -> np.ndarray:
        r = softmax(self.v[1] + intercepts)
        r[np.arange(len(r)), self.labels] -= 1
        return r


@dataclass
class Move:
    """How far the last direction is kept, the step, and the intercepts' direction with it."""

    turn: float
    step: float
    b: np.ndarray
    toward: np.ndarray

    def slopes(self, block: Block) -> list[float]:
        """Of the summed loss at the end of the step: first and second derivative along it; and <A, Q>, <P, Q> of the squares."""
        end = block.moved(self)
        a, z, p, q = end.v[:4]
        way, m = q + self.toward, softmax(z + self.b + self.step * self.toward)
        mean = (m * way).sum(1)
        first = mean - way[np.arange(len(way)), block.labels]
        return [float(first.sum()), float(((m * way * way).sum(1) - mean * mean).sum()), float((a * q).sum()), float((p * q).sum())]


def _each(state: DataFrame, k: int, make: Callable[[Block], list[float]]) -> np.ndarray:
    """Sums over the blocks of what ``make`` says of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.array(make(Block.read(d, k))) for batch in batches for d in batch.column(0).to_pylist()]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, 0).tolist()], pa.list_(pa.float64()))], names=["sums"])

    return np.sum([r["sums"] for r in state.select("state").mapInArrow(run, "sums array<double>").collect()], 0)


@dataclass
class Fit:
    """A fitted model: rows (label, scores) of the test documents, and (term, k, weight) of at least so many strongest terms of each part and class."""

    said: DataFrame
    strongest: Callable[[int], DataFrame]
    steps: int


def fit(docs: DataFrame, k: int, n: int, chars: int, counts: list[int], tolerance: float | None = None) -> Fit:
    """A multinomial regression on the training rows of ``docs`` (label int, test boolean, terms array<long>: hashes, with repeats).

    ``k`` classes with ``counts`` of the ``n`` training rows, texts of about ``chars`` characters in all. A
    unit of squared coefficients weighs as much as the summed loss of a document; intercepts are free.
    """
    tolerance = TOLERANCE if tolerance is None else tolerance
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship(spark)
    parts = chars // PART_CHARS + 1
    entries = materialize(docs.select("label", "test", "terms").mapInArrow(_entries(parts), ENTRIES), "entries")
    # A file of few parts: Spark's reader has a file's rows in memory at once if they are few and long.
    matrix = entries.where("part >= 0").drop("labels").repartition(parts // 2 + 1, "part").sortWithinPartitions("part").mapInArrow(_joined(n), PARTS)
    matrix = materialize(matrix, "matrix")
    known = materialize(entries.where("part < 0").select("block", "test", "labels"), "blocks")
    discard(entries)
    lengths = {r["block"]: r["n"] for r in known.select("block", (F.octet_length("labels") / 4).cast("long").alias("n")).collect()}
    release(spark)

    slim = matrix.drop("hashes").withColumn("hashes", F.lit(None).cast("binary"))
    product = lambda sent, width: slim.mapInArrow(_product(sent, width, lengths), _SENT)
    together = lambda own, more: own.select("block", F.lit(0).alias("kind"), own.columns[-1]).toDF("block", "kind", "data").unionByName(more).repartition("block").sortWithinPartitions("block", "kind")

    def stated(block: int, data: bytes, sums: list[float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([sums], pa.list_(pa.float64()))], names=["block", "state", "sums"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, labels, squares in _summed(batches):
            y = np.frombuffer(labels, np.int32)
            s = np.zeros(len(y)) if squares is None else np.where(squares > 0, 1 / np.sqrt(np.where(squares > 0, squares, 1)), 0)
            yield stated(block, Block(y, s, np.zeros((6, len(y), k))).write(), [])

    scaled = materialize(together(known.select("block", "labels"), product(None, 1)).mapInArrow(first, STATE), "state")
    tests = known.where("test").select("block")
    state = scaled.join(F.broadcast(tests), "block", "left_anti")
    trained = {r["block"]: lengths[r["block"]] for r in known.where("not test").select("block").collect()}
    columns = materialize(matrix.mapInArrow(_trained(trained), TRAINED), "columns")

    def residuals(frame: DataFrame, make: Callable[[Block], np.ndarray]) -> dict[int, np.ndarray]:
        """What ``make`` says of each training block, scaled as its rows are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = [Block.read(d, k) for d in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(make(x) * x.scale[:, None]).tobytes() for x in blocks], pa.binary())], names=["block", "data"])

        rows = frame.select("block", "state").mapInArrow(run, "block long, data binary").toArrow()
        return {b.as_py(): np.frombuffer(d.as_py()).reshape(-1, k) for b, d in zip(rows["block"], rows["data"], strict=True)}

    prior = np.log(np.maximum(counts, 1))
    move = Move(0.0, 0.0, prior - prior.mean(), np.zeros(k))
    start, last, steps, length = None, None, 0, 1.0
    while True:
        # The gradient where the last move ended, and its margins by one product.
        b = move.b + move.step * move.toward
        by_block = residuals(state, lambda x: x.moved(move).residual(b))  # noqa: B023
        sent = sc.broadcast(np.concatenate([by_block[block][:, :-1] for block in sorted(trained)]).T.copy())

        def arrive(batches: Iterator[pa.RecordBatch], move=move, b=b) -> Iterator[pa.RecordBatch]:
            for block, data, z in _summed(batches):
                x = Block.read(data, k).moved(move)
                r = x.residual(b)
                g = r / n + x.v[0] / n
                h = x.v[1] / n
                if z is not None:
                    z = z.reshape(-1, k - 1) * x.scale[:, None] / n
                    h = h + np.column_stack([z, -z.sum(1)])
                before = x.v[5]
                sums = [(g * h).sum(), (g * before).sum(), *(r.sum(0) / n)]
                yield stated(block, Block(x.labels, x.scale, np.stack([*x.v[:4], g, h])).write(), [float(s) for s in sums])

        fresh = materialize(together(state.select("block", "state"), columns.mapInArrow(_iterated(sent, trained), _SENT)).mapInArrow(arrive, STATE), "state")
        sent.destroy()
        if steps:
            discard(state)
        state = fresh
        sums = np.sum([r["sums"] for r in state.select("sums").collect()], 0)
        down = sums[2:]
        square = sums[0] + down @ down
        start = square if start is None else start
        steps += 1
        if square <= tolerance * tolerance * start or steps > ITERATIONS:
            break
        turn = 0.0 if last is None else max(0.0, (square - sums[1] - down @ last[1]) / last[0])
        toward = -down if last is None else turn * move.toward - down
        last = (square, down)

        # Along a line the objective is convex: Newton's steps on its slope, kept in what is known to hold its zero.
        low, high, at = 0.0, np.inf, length
        for _ in range(TRIALS):
            move = Move(turn, at, b, toward)
            first_, second, aq, pq = _each(state, k, move.slopes)
            slope, bend = (first_ + aq) / n, (second + pq) / n
            if abs(slope) <= 0.05 * square:
                break
            low, high = (at, high) if slope < 0 else (low, at)
            newton = at - slope / bend if bend > 0 else np.inf
            at = newton if low < newton < high else (low + high) / 2 if np.isfinite(high) else 2 * at
        length = move.step
        if steps % 10 == 0:
            release(spark)

    sent = sc.broadcast(residuals(state, lambda x: x.v[0]))
    b = move.b + move.step * move.toward
    known_tests = scaled.join(F.broadcast(tests), "block", "left_semi")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, z in _summed(batches):
            if data is None:  # a training block
                continue
            x = Block.read(data, k)
            m = np.zeros((len(x.labels), k)) if z is None else z.reshape(-1, k) * x.scale[:, None]
            scores = softmax(m + b)
            yield pa.RecordBatch.from_arrays([pa.array(x.labels), pa.array(scores.tolist(), pa.list_(pa.float64()))], names=["label", "scores"])

    said = materialize(together(known_tests.select("block", "state"), product(sent, k)).mapInArrow(judge, "label int, scores array<double>"), "said")
    discard(state, scaled, known, columns)

    def strongest(top: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    hashes, c = np.frombuffer(row["hashes"], np.int64), _Part(row, False).coefficients(sent.value, k)
                    for j in range(k if len(c) else 0):
                        some = np.flatnonzero(c[:, j] >= np.partition(c[:, j], max(0, len(c) - top))[max(0, len(c) - top)])
                        yield pa.RecordBatch.from_arrays([pa.array(hashes[some]), pa.array(np.full(len(some), j, np.int32)), pa.array(c[some, j])], names=["term", "k", "weight"])

        return matrix.mapInArrow(run, "term long, k int, weight double")

    return Fit(said, strongest, steps)
