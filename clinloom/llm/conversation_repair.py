"""Conversation structure repair: the cheapest edits that make a conversation well-formed.

A conversation is well-formed if its role initials read ``(s?(ua)+)?``. Edits run over its rows in
order: Keep (0), Rerole to user or assistant (2), Delete (3; the only edit of a blank or repeated
row), Insert an empty user or assistant row anywhere (2); a truncated row that stays adds 1.

The edits are paths in a layered graph of nodes (rows read, state of the grammar). Minimum costs
from the start (forward) and to the end (backward) tell which arcs lie on a cheapest path: those
where forward + arc + backward is the optimum. These tight arcs form a DAG without dead ends, so
the ASCII-least audit is found by going through it with a set of nodes: at each step the least
letter on a tight arc out of the set, and the nodes that its arcs lead to.

1. Rows become narrow: turn, role, a digest of role and text, and a fault code; the first turn of
   each (conversation, role, text) is a grouped minimum with map-side combine, joined back.
2. Narrow rows are sorted over all partitions by range, so a conversation of any size is cut into
   segments, one a partition. A segment is a code a row. Segments are (min, +) products, so a
   conversation that crosses partitions needs only their 4 x 4 matrices: these are at most two
   rows a partition, and the driver chains them to each segment's costs before and after it.
3. Each segment walks its own part of the DAG. Audits are joined in segment order.
4. The texts meet their conversation's audit in one sorted stream, which applies the letters row
   by row; neither a conversation's rows nor its texts are held.

What one task does for one conversation is to stream its texts in order, as one digest of
them is asked for; no other step has a conversation as its unit.

Defined cases: null role or text is one space, a null turn comes first, null ids are one
conversation; rows of one turn are ordered by role, then by digest of the text; rows equal in
turn, role and text are each other's duplicates; a role's initial is its first character, an
empty role can't be kept; a conversation without rows isn't in ``audits`` but gets zeros from
``with_all``; an empty table gives an empty result; extra columns are ignored; texts of any
length are only hashed and trimmed.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.llm.slices import slices
from clinloom.session import materialize, ship

#: Costs of the edits.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a.
START, ACCEPT = (0, -1, -1, -1), (0, -1, -1, 0)
FAR = 1 << 50
#: What counts as white space.
SPACE = " \t\n\x0b\x0c\r"
#: Codes of segments up to this length are looked up.
SHORT = 96


def _row_arcs() -> list[list[tuple[str, int, int, int]]]:
    """Arcs (letter, from, to, cost) by row code: 0 must go; 1 + x, 5 + x (cut off) for initials s, u, a, other."""
    gone = [("D", q, q, DELETE) for q in range(4)]
    follow = [(0, 2), (1, 2), (3, 2), (2, 3)]
    out = [gone]
    for more in (0, CUT):
        for x in "sua-":
            keep = {"s": [(0, 1)], "u": follow[:3], "a": follow[3:], "-": []}[x]
            out.append(gone + [("K", q, r, more) for q, r in keep] + [("R", q, r, REROLE + more) for q, r in follow])
    return out


ROW_ARCS = _row_arcs()
INSERTS = [(0, 2), (1, 2), (3, 2), (2, 3)]


def _vector(v: tuple[int, ...]) -> list[int]:
    return [FAR if x < 0 else x for x in v]


def forward(codes: bytes, entry: list[int]) -> array:
    """Least costs to the four nodes before each row and after the last, given those at the segment's border."""
    out = array("q", entry)
    a, b, c, d = entry
    for code in codes:
        c = min(c, min(a, b, d) + INSERT)
        d = min(d, c + INSERT)
        out[-2:] = array("q", (c, d))
        v = [FAR] * 4
        now = (a, b, c, d)
        for _, q, r, cost in ROW_ARCS[code]:
            if now[q] + cost < v[r]:
                v[r] = now[q] + cost
        a, b, c, d = v
        out.extend(v)
    return out


def backward(codes: bytes, leave: list[int], last: bool) -> array:
    """Least costs from the same nodes to the end, given those at the segment's other border."""
    v = list(leave)
    if last:
        v = _before_inserts(v)
    rows = [v]
    for code in reversed(codes):
        w = [FAR] * 4
        for _, q, r, cost in ROW_ARCS[code]:
            if v[r] + cost < w[q]:
                w[q] = v[r] + cost
        v = _before_inserts(w)
        rows.append(v)
    out = array("q")
    for v in reversed(rows):
        out.extend(v)
    return out


def _before_inserts(w: list[int]) -> list[int]:
    u = min(w[2], w[3] + INSERT)
    return [min(w[0], u + INSERT), min(w[1], u + INSERT), u, min(w[3], u + INSERT)]


def walk(codes: bytes, ahead: array, back: array, best: int, start: int, last: bool) -> tuple[str, int]:
    """The least letters on tight arcs from a node of the segment's border, and the state they end in."""
    nodes, i, n, out = {start}, 0, len(codes), []
    if last:  # costs after the last row get their inserts, as before a row
        c = min(ahead[-2], min(ahead[-4], ahead[-3], ahead[-1]) + INSERT)
        ahead[-2:] = array("q", (c, min(ahead[-1], c + INSERT)))
    while i < n or last:
        step: dict[str, set[int]] = {}
        for q in nodes:
            cost = ahead[4 * i + q]
            for a, r in INSERTS:
                if a == q and cost + INSERT + back[4 * i + r] == best:
                    step.setdefault("I", set()).add(r)
            if i < n:
                for letter, a, r, own in ROW_ARCS[codes[i]]:
                    if a == q and cost + own + back[4 * i + 4 + r] == best:
                        step.setdefault(letter, set()).add(r)
        if not step:
            break
        letter = min(step)
        out.append(letter)
        nodes = step[letter]
        i += letter != "I"
    return "".join(out), min(nodes)


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return _short(codes) if len(codes) <= SHORT else _solve(codes)


def _solve(codes: bytes) -> tuple[int, str]:
    back = backward(codes, _vector(ACCEPT), True)
    return back[0], walk(codes, forward(codes, _vector(START)), back, back[0], 0, True)[0]


_short = lru_cache(maxsize=50_000)(_solve)


def transfer(codes: bytes) -> list[list[int]]:
    """Least costs from each state at the segment's start to each at its end."""
    return [list(forward(codes, [0 if q == p else FAR for q in range(4)])[-4:]) for p in range(4)]


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that a hash of conversation and turn deals out.

    Of twenty: 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    fault, said = F.crc32(key.cast("binary")) % 20, F.coalesce(F.col(text), F.lit(" "))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"),
    ).drop("_copy")


def _clean(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _digest() -> Column:
    return F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))


def _narrow(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, code, blank, later): later rows have an earlier turn with their role and text."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial, end = F.substring("role", 1, 1), F.substring(bare, -1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    blank = bare == ""
    rows = turns.select(
        "conv_id", "turn", "role", _digest().alias("key"), blank.alias("blank"),
        F.when(blank, 0).otherwise(kind + F.when(end.isin(".", "!", "?"), 0).otherwise(4)).cast("int").alias("code"),
    )
    firsts = rows.where("not blank").groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    joined = rows.join(firsts, rows.conv_id.eqNullSafe(firsts.c) & (rows.key == firsts.k), "left")
    later = F.coalesce(F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first"), F.lit(False))
    return joined.select("conv_id", "turn", "role", "key", "code", "blank", later.alias("later"))


@dataclass
class Segment:
    """What a conversation's rows in one partition come to."""

    conv: int | str | None
    codes: bytearray
    first: str = ""
    last: str = ""
    low: int | None = None
    high: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    seen: tuple = ()

    def add(self, turn: int | None, role: str, key: str, code: int, blank: bool, later: bool) -> None:
        initial = role[:1]
        if not self.codes:
            self.first = initial
        elif not _legal(self.last, initial):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        again = not blank and (later or self.seen == (turn, key))
        self.seen = (turn, key)
        self.blank += blank
        self.duplicate += again
        self.truncated += code > 4 and not again
        self.codes.append(0 if again else code)


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au") and bool(before)


SEGMENT = pa.schema([
    ("seg", pa.int64()), ("edge", pa.bool_()), ("codes", pa.binary()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("matrix", pa.list_(pa.int64())),
])
SEGMENT_DDL = "seg long, edge boolean, codes binary, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, matrix array<long>"
FLUSH = 4096


def _segments(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), *SEGMENT])

    def rows(ready: list[Segment], seg: int, edges: set[int]) -> pa.RecordBatch:
        out = []
        for s in ready:
            edge = id(s) in edges
            out.append({
                "conv_id": s.conv, "seg": seg, "edge": edge, "codes": bytes(s.codes), "first": s.first, "last": s.last, "low": s.low, "high": s.high, "turns": s.turns,
                "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated, "illegal": s.illegal, "matrix": sum(transfer(bytes(s.codes)), []) if edge else None,
            })
        return pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, now, ready, edges = TaskContext.get().partitionId(), None, [], set()
        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is None:
                        now = Segment(conv, bytearray())
                        edges.add(id(now))  # the first of the partition
                    else:
                        now = Segment(conv, bytearray())
                    ready.append(now)
                    if len(ready) > FLUSH:
                        yield rows(ready[:-1], seg, edges)
                        ready = ready[-1:]
                        edges = edges & {id(now)}
                now.add(*row)
        if ready:
            edges.add(id(ready[-1]))
            yield rows(ready, seg, edges)

    return run, schema


@dataclass
class Border:
    """A segment of a conversation that others share: costs before and after it, and what its border adds."""

    entry: list[int]
    leave: list[int]
    last: bool
    best: int
    illegal: int = 0
    turns: int = 0
    start: int = 0


def _times(v: list[int], m: list[int], by_row: bool) -> list[int]:
    if by_row:
        return [min(min(v[p] + m[4 * p + q] for p in range(4)), FAR) for q in range(4)]
    return [min(min(m[4 * p + q] + v[q] for q in range(4)), FAR) for p in range(4)]


def _borders(edges: list) -> dict[tuple, Border]:
    """Borders by (conversation, segment) of the conversations that lie in several partitions."""
    groups: dict = {}
    for e in edges:
        groups.setdefault(e["conv_id"], []).append(e)
    out = {}
    for conv, own in groups.items():
        if len(own) < 2:
            continue
        own.sort(key=lambda e: e["seg"])
        entries, leaves = [_vector(START)], [_vector(ACCEPT)]
        for e in own[:-1]:
            entries.append(_times(entries[-1], e["matrix"], True))
        after = _before_inserts(_vector(ACCEPT))
        for e in reversed(own[1:]):
            after = _times(after, e["matrix"], False)
            leaves.append(after)
        best = _times(after, own[0]["matrix"], False)[0]
        for k, (e, entry, leave) in enumerate(zip(own, entries, reversed(leaves), strict=True)):
            b = out[conv, e["seg"]] = Border(entry, leave, k == len(own) - 1, best)
            if k:
                b.illegal = int(not _legal(own[k - 1]["last"], e["first"]))
                known = next((p["high"] for p in reversed(own[:k]) if p["high"] is not None), None)
                b.turns = -int(known is not None and known == e["low"])
    return out


def _walked(codes: bytes, b: Border, start: int) -> tuple[str, int]:
    return walk(codes, forward(codes, b.entry), backward(codes, b.leave, b.last), b.best, start, b.last)


def _tight(codes: bytes, b: Border) -> list[int]:
    """The state in which the segment's walk ends, for each state in which a cheapest path can enter it; else -1."""
    back = backward(codes, b.leave, b.last)
    return [_walked(codes, b, q)[1] if b.entry[q] + back[q] == b.best else -1 for q in range(4)]


def _pieces(borders: dict[tuple, Border], kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("seg", pa.int64()), ("piece", pa.string()), ("cost", pa.int64()), *[(c, pa.int64()) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                b = borders.get((row["conv_id"], row["seg"]))
                if b is None:
                    row["cost"], row["piece"] = solve(row["codes"])
                else:
                    row["piece"] = _walked(row["codes"], b, b.start)[0]
                    row["cost"] = b.best if b.last else 0
                    row["illegal"] += b.illegal
                    row["turns"] += b.turns
                out.append({c: row[c] for c in schema.names})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def audits(turns: DataFrame) -> DataFrame:
    """A row a conversation: gaps, blank, duplicate, truncated, illegal, cost (longs) and the audit's letters.

    ``turns`` has conv_id (of any simple type), turn, role and text.
    """
    spark = turns.sparkSession
    ship(spark)
    narrow = _narrow(_clean(turns))
    order = ["conv_id", "turn", "role", "key"]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    name, kind = narrow.schema["conv_id"].dataType.simpleString(), _arrow(narrow)
    run, _ = _segments(kind)
    segments = materialize(dealt.mapInArrow(run, f"conv_id {name}, {SEGMENT_DDL}"), "segments")
    borders = _borders(segments.where("edge").drop("codes").collect())  # two rows a partition at most
    if borders:
        _chain(segments, borders, name, kind)
    counts = ("turns", "blank", "duplicate", "truncated", "illegal")
    ddl = f"conv_id {name}, seg long, piece string, cost long, low long, high long, " + ", ".join(f"{c} long" for c in counts)
    whole = segments.mapInArrow(_pieces(borders, kind), ddl).groupBy("conv_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in (*counts, "cost")],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "piece"))), lambda x: x["piece"]), "").alias("audit"),
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def _chain(segments: DataFrame, borders: dict[tuple, Border], name: str, kind: pa.DataType) -> None:
    """Give each border the state in which its segment's walk starts."""
    schema = pa.schema([("conv_id", kind), ("seg", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["conv_id"], r["seg"], r["codes"]) for r in batch.to_pylist() if (r["conv_id"], r["seg"]) in borders]
            yield pa.RecordBatch.from_pylist([{"conv_id": c, "seg": s, "ends": _tight(codes, borders[c, s])} for c, s, codes in rows], schema)

    ends = segments.where("edge").select("conv_id", "seg", "codes").mapInArrow(run, f"conv_id {name}, seg long, ends array<long>").collect()
    state: dict = {}
    for r in sorted(ends, key=lambda r: r["seg"]):
        borders[r["conv_id"], r["seg"]].start = at = state.get(r["conv_id"], 0)
        state[r["conv_id"]] = r["ends"][at]


def with_all(found: DataFrame, turns: DataFrame) -> DataFrame:
    """``found`` with a row of zeros and an empty audit for conversations of ``turns`` that it hasn't."""
    ids = turns.select(F.col("conv_id").alias("_id")).distinct()
    joined = ids.join(found, ids["_id"].eqNullSafe(found["conv_id"]), "left")
    zero = [F.coalesce(c, F.lit("" if c == "audit" else 0)).alias(c) for c in found.columns if c != "conv_id"]
    return joined.select(F.col("_id").alias("conv_id"), *zero)


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit row, then its rows in order, in one partition."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit("").alias("key"), *FACTS)
    rows = _clean(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", _digest().alias("key"), *[F.lit(None).cast("long").alias(c) for c in FACTS])
    return heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key").drop("key")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(None, audit row) where a conversation begins, then (letter, (role, text)) for each edit."""
    letters, at, state, conv = "", 0, "", None

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            state = "a" if state == "u" else "u"
            at += 1
            yield "I", ("user" if state == "u" else "assistant", "")

    for batch in batches:
        for part in slices([batch], 4):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if row[1] == 0:
                    yield from inserted()
                    letters, at, state, conv = row[4], 0, "", row[0]
                    yield None, row
                    continue
                yield from inserted()
                letter, role = letters[at], row[3]
                at += 1
                if letter == "R":
                    role = "assistant" if state == "u" else "user"
                if letter != "D":
                    state = role[:1]
                yield letter, (role, row[4])
    yield from inserted()


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, at, edit, role, text); at counts from 0, deleted rows are gone. ``found`` is of ``audits``."""
    ship(turns.sparkSession)
    kind = _arrow(_clean(turns))
    schema = pa.schema([("conv_id", kind), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, out, held = None, 0, [], 0
        for letter, what in _applied(batches):
            if letter is None:
                conv, at = what[0], 0
            elif letter != "D":
                out.append({"conv_id": conv, "at": at, "edit": letter, "role": what[0], "text": what[1]})
                at, held = at + 1, held + len(what[1])
                if len(out) >= FLUSH or held > 1 << 21:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    return _stream(turns, found).mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, at long, edit string, role string, text string")


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256, of each conversation's repaired ``role:text`` joined by newlines."""
    ship(turns.sparkSession)
    kind = _arrow(_clean(turns))
    schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in FACTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, any_row, out = None, None, False, []

        def close() -> None:
            if head is not None:
                out.append({"conv_id": head[0], **dict(zip(FACTS, head[5:], strict=True)), "audit": head[4], "repaired_sha256": digest.hexdigest()})

        for letter, what in _applied(batches):
            if letter is None:
                close()
                if len(out) >= FLUSH:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                head, digest, any_row = what, hashlib.sha256(), False
            elif letter != "D":
                digest.update(("\n" * any_row + f"{what[0]}:{what[1]}").encode("utf-8", "surrogatepass"))
                any_row = True
        close()
        yield pa.RecordBatch.from_pylist(out, schema)

    ddl = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string"
    return _stream(turns, found).mapInArrow(run, ddl)
