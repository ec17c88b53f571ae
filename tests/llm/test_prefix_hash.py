import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clinloom.llm import prefix_hash as ph
from clinloom.llm import queries

text = st.text(alphabet="ab é🙂", max_size=40)


@settings(max_examples=150, deadline=None)
@given(text, text, st.data())
def test_spans_and_extensions(a, b, data):
    p, r = ph.Prefix(a), ph.Prefix(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, 12))
    assert ph.equal_spans(p, i, r, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert ph.common_extension(p, i, r, j) == want
    assert [int(x) for x in p.spans(3)] == [p.span(k, k + 3) for k in range(len(a) - 2)] if len(a) >= 3 else True


@settings(max_examples=80, deadline=None)
@given(text, text)
def test_fingerprints(a, b):
    x, y = ph.fingerprint(a), ph.fingerprint(b)
    assert ph.likeness(x, x) == 1 and ph.likeness(x, y) == ph.likeness(y, x) and 0 <= ph.likeness(x, y) <= 1
    assert (ph.written(x) == ph.written(y)) == (a == b) and ph.written(ph.parsed(ph.written(x))) == ph.written(x)


def mixed(x):
    """The product's mixing of a span's hash, with Python's integers."""
    m = (1 << 64) - 1
    x = (x ^ x >> 15) * 0x9E3779B97F4A7C15 & m
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & m
    return x >> 24


def spans(t):
    """The set of a text's real substrings of eight code points; a shorter text is one."""
    return {t[i : i + ph.WIDTH] for i in range(max(1, len(t) - ph.WIDTH + 1))}


def polynomial(span):
    """The hash of a span by its definition: its code points, each one more, times powers of the base."""
    return sum((ord(c) + 1) * pow(ph.BASES[0], i, ph.MODULI[0]) for i, c in enumerate(span)) % ph.MODULI[0]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc é🙂", max_size=150), st.text(alphabet="abc é🙂", max_size=150))
def test_likeness_equals_sets_of_substrings(a, b):
    """With sketches as large as the sets the likeness is the exact Dice share; in general that of the least hashes."""
    x, y = ph.fingerprint(a), ph.fingerprint(b)
    hashes = [sorted({mixed(polynomial(s)) for s in spans(t)}) for t in (a, b)]
    assert [f[2].tolist() for f in (x, y)] == [h[: ph.KEEP] for h in hashes]
    union = sorted(set(hashes[0][: ph.KEEP]) | set(hashes[1][: ph.KEEP]))[: ph.KEEP]
    both = sum(h in hashes[0][: ph.KEEP] and h in hashes[1][: ph.KEEP] for h in union)
    j = both / len(union)
    assert abs(ph.likeness(x, y) - (1.0 if a == b else 2 * j / (1 + j))) < 1e-12
    s, t = spans(a), spans(b)
    if len(s | t) <= ph.KEEP:
        assert abs(ph.likeness(x, y) - 2 * len(s & t) / (len(s) + len(t))) < 1e-12


def test_many_cuts_are_found(spark):
    import bisect

    cuts = sorted({(i * 7919) % 100_003 - 50_000 for i in range(3000)} | {-(1 << 63)})
    rows = spark.range(-60_000, 60_000, 37).withColumnRenamed("id", "_id")
    for some in (cuts, cuts[:1], cuts[:2], []):
        for r in ph._placed(rows, some).collect()[::50]:
            assert r["bucket"] == bisect.bisect_left(some, r["_id"])


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (k, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = map(ph.fingerprint, (t, e, n))
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), ph.written(a), ph.written(b), ph.likeness(a, b), ph.likeness(a, c)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("ranges", [1, 2, 3, 8, 64])
def test_neighbours(spark, odd, ranges):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = ph.edited_neighbours(odd.repartition(3), ranges=ranges).collect()
    assert sorted(repr(tuple(r)[:7]) for r in got) == brute(rows)


def test_small_tables(spark, odd, empty):
    assert ph.edited_neighbours(empty).count() == 0
    one = ph.edited_neighbours(odd.where("doc_id = 10")).first()
    assert one["near_next"] == 1.0


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op4_prefix_hash(spark, sf_dir).collect()
    assert sorted(repr(tuple(r)[:7]) for r in got) == brute(rows)
    long = [r for r in got if r["n_chars"] >= 64]
    assert sum(r["near_edited"] > r["near_next"] for r in long) / len(long) > 0.99


def test_blocks_change_nothing(monkeypatch):
    """Fingerprints and common starts are the same however texts are cut into blocks."""
    import random

    deal = random.Random(2)
    texts = ["".join(deal.choices("ab🙂é", k=n)) for n in (0, 1, 7, 8, 9, 15, 16, 17, 23, 31, 32, 33, 100, 257)]
    whole = [ph.fingerprint(t) for t in texts]
    for block in (8, 16, 33):
        monkeypatch.setattr(ph, "BLOCK", block)
        for t, known in zip(texts, whole, strict=True):
            found = ph.fingerprint(t)
            assert found[:2] == known[:2] and found[2].tolist() == known[2].tolist()
            for cut in (0, len(t) // 2, len(t)):
                other = t[:cut] + "#" + t[cut:]
                assert ph.shared_prefix(t, other, (ph.printed(t)[1], ph.printed(other)[1])) == cut


def test_a_very_long_text_in_little_memory():
    import tracemalloc

    text = "the same words again and again " * 160_000  # 5 million
    tracemalloc.start()
    ph.fingerprint(text)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
