import random
from fractions import Fraction
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from clinloom.llm import pfair_mix as m
from clinloom.llm import queries


@pytest.mark.parametrize("seed", range(30))
def test_period_meets_windows(seed):
    r = random.Random(seed)
    share = {f"s{i}": r.randint(1, 40) for i in range(r.randint(1, 12))}
    q, slots = sum(share.values()), m.edf(share)
    assert sorted(t for s in slots.values() for t in s) == list(range(q))
    for s, a in share.items():
        for i, t in enumerate(slots[s]):
            assert i * q // a <= t < -(-(i + 1) * q // a)
        for t in range(q + 1):
            assert abs(sum(x < t for x in slots[s]) - a * t / q) < 1


def slot_by_slot(weights, blocks, quantum):
    """The schedule by its definition: in each slot, of the released blocks the one of the earliest deadline."""
    left, out, t, phase = {s: n for s, n in blocks.items() if n}, {}, 0, 0
    while left:
        share, base, had = m.shares({s: weights[s] for s in left}, quantum), t, dict.fromkeys(left, 0)
        q = sum(share.values())
        while all(had[s] < n for s, n in left.items()):
            windows = {s: (Fraction(had[s] * q, share[s]), Fraction((had[s] + 1) * q, share[s])) for s in left}
            free = [(ceil(b), s) for s, (a, b) in windows.items() if floor(a) <= t - base]
            deadline, s = min(free)
            out[s, blocks[s] - left[s] + had[s]] = (phase, base + floor(windows[s][0]), base + deadline, t)
            had[s], t = had[s] + 1, t + 1
        left, phase = {s: n - had[s] for s, n in left.items() if n > had[s]}, phase + 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_schedule_equals_slot_by_slot(seed):
    r = random.Random(seed)
    weights = {f"s{i}": r.choice([1.0, r.random() + 0.01]) for i in range(r.randint(1, 7))}
    blocks = {s: r.choice([0, 1, 5, 5, 90]) for s in weights}
    quantum = r.choice([50, m.fine_quantum(blocks)])
    got = list(m.schedule(weights, blocks, quantum))
    assert {(s, b): tuple(x) for s, b, *x in got} == slot_by_slot(weights, blocks, quantum) and len(got) == sum(blocks.values())
    assert sorted(x[5] for x in got) == list(range(sum(blocks.values())))


def test_many_sources_take_little_time():
    """Work grows with sources times phases, not with its cube: 1,000 sources that run out one by one."""
    import time

    n = 1000
    blocks = {f"s{i:04d}": 1 + i // 25 for i in range(n)}
    began = time.time()
    got = list(m.schedule({s: float(b) ** 0.5 for s, b in blocks.items()}, blocks))
    assert len(got) == sum(blocks.values()) and time.time() - began < 30


def test_blocks_grow_with_the_corpus():
    assert m.block_size({"a": 10**6}) == 64
    for n in (10**7, 10**9, 10**12):
        size = m.block_size({"a": n // 3, "b": n - n // 3})
        assert size % 64 == 0 and n // size <= m.MAX_SLOTS < 4 * n // size


def test_shares():
    assert sum(m.shares({"a": 1, "b": 2, "c": 1e-9}, 100).values()) == 100 and m.shares({"a": 1, "b": 1}, 10) == {"a": 5, "b": 5}
    with pytest.raises(ValueError):
        m.shares({"a": 0})


@pytest.mark.parametrize("scale", [1, 20])
def test_deviation_from_the_unrounded_target(scale):
    n = {"big": 33333 * scale, **{f"s{i:02d}": 3509 * scale for i in range(19)}, "rare": 1}
    weights, blocks = {s: x**0.5 for s, x in n.items()}, {s: -(-x // 64) for s, x in n.items()}
    plan = {}
    for s, _, phase, _, _, slot in m.schedule(weights, blocks):
        plan.setdefault(phase, []).append((slot, s))
    assert {s: sum(x == s for p in plan.values() for _, x in p) for s in n} == blocks
    for now in plan.values():
        total, had = sum(weights[s] for s in {s for _, s in now}), dict.fromkeys(n, 0)
        for i, (_, s) in enumerate(sorted(now), 1):
            had[s] += 1
            assert abs(had[s] - i * weights[s] / total) < 1.5


def check(rows, block_rows):
    """Ranks are whole, slots are filled once, windows hold."""
    by, slot_of = {}, {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["block"], r["offset"]))
        assert r["release"] <= r["slot"] < r["deadline"] and slot_of.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    assert sorted(slot_of) == list(range(len(slot_of)))
    for got in by.values():
        assert sorted(got) == [divmod(i, block_rows) for i in range(len(got))]


def test_mix(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 100 = 1 then null else concat('s', id % 7) end as source", "id as slot")
    rows = m.mix(df, block_rows=16, quantum=100).collect()
    assert len(rows) == 5000
    check(rows, 16)
    first = [r for r in rows if r["phase"] == 0]
    weights = m.shares({s: n**0.5 for s, n in {x: sum(r["source"] == x for r in rows) for x in {r["source"] for r in rows}}.items() if n}, 100)
    end = max(r["slot"] for r in first) + 1
    for s, a in weights.items():
        for t in range(0, end + 1, 7):
            done = len({r["block"] for r in first if r["source"] == s and r["slot"] < t})
            assert abs(done - a * t / 100) < 1


def test_given_weights_and_order(spark):
    df = spark.range(800).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', 'b') as source")
    mixed = m.mix(df, {"a": 3, "b": 1}, block_rows=10, quantum=4)
    check(mixed.collect(), 10)
    ordered = m.in_schedule_order(mixed).select("source").collect()
    head = [r["source"] for r in ordered[:400]]
    assert head.count("a") == 300
    with pytest.raises(KeyError):
        m.mix(df, {"a": 1}).count()


def test_no_column_is_lost(spark):
    names = ["_source", "__source", "_rank", "__rank", "_ranges", "_o", "_b", "__o", "_n", "_t", "_r", "_before", "__p", "n", "m"]
    df = spark.range(300).selectExpr("id as doc_id", "concat('s', id % 3) as source", *[f"id * {i + 2} as {c}" for i, c in enumerate(names)], "map('a', id) as held")
    got = m.mix(df, block_rows=4)
    assert got.columns == [*df.columns, *m.OUTPUT]
    for r in got.collect():
        assert r["source"] == f"s{r['doc_id'] % 3}" and [r[c] for c in names] == [r["doc_id"] * (i + 2) for i in range(len(names))]


def test_ties_are_broken_by_all_columns(spark):
    df = spark.range(400).selectExpr("id % 2 as doc_id", "'s' as source", "concat('t', id) as text")
    one = {(r["text"], r["block"], r["offset"]) for r in m.mix(df.repartition(5), block_rows=4).collect()}
    assert len(one) == 400 and one == {(r["text"], r["block"], r["offset"]) for r in m.mix(df.orderBy(F.desc("text")).repartition(3, "text"), block_rows=4).collect()}


def test_ranges_do_not_matter(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    want = {tuple(r) for r in m.mix(df).collect()}
    monkeypatch.setattr(m, "RANKED_ROWS", 7)
    assert {tuple(r) for r in m.mix(df).collect()} == want


def test_odd_rows(odd, empty):
    rows = m.mix(odd, block_rows=2).collect()
    assert len(rows) == odd.count() and m.mix(empty).count() == 0
    check(rows, 2)


def test_query(spark, sf_dir):
    rows = queries.op5_pfair_mix(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs)
    check(rows, m.BLOCK_ROWS)
    n = {s: sum(r["source"] == s for r in docs) for s in {r["source"] for r in docs}}
    blocks = {s: -(-x // m.BLOCK_ROWS) for s, x in n.items()}
    want = slot_by_slot({s: x**0.5 for s, x in n.items()}, blocks, m.fine_quantum(blocks))
    assert {(r["source"], r["block"]): (r["phase"], r["release"], r["deadline"], r["slot"]) for r in rows} == want
