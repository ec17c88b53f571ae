import zlib

import numpy as np
import pytest

from clinloom.llm import quality_cnn as q
from clinloom.llm import queries


@pytest.fixture
def model():
    r = np.random.default_rng(1)
    return q.Model(*(r.normal(size=s).astype(np.float32) for s in ((256, q.EMBED), (q.HALF * q.EMBED, 2 * q.FILTERS), q.FILTERS, q.FILTERS)), 0.1)


def brute(model, text):
    data = text.ljust(max(2, -(-len(text) // q.HALF)) * q.HALF, b"\0")
    w = np.concatenate([model.left[:, : q.FILTERS], model.left[:, q.FILTERS :]])
    best = np.full(q.FILTERS, -np.inf)
    for i in range(0, len(data) - q.HALF, q.HALF):
        best = np.maximum(best, model.embed[list(data[i : i + 2 * q.HALF])].ravel() @ w)
    return float(np.maximum(best + model.bias, 0) @ model.unit + model.intercept)


@pytest.mark.parametrize("slab", [1, 2, 3, 7, 64, 1 << 16])
def test_equals_brute_force(model, monkeypatch, slab):
    monkeypatch.setattr(q, "SLAB", slab)
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 7, 8, 9, 15, 16, 17, 24, 25, 300, 8 * 65, 8)]
    assert np.allclose(model.logits(*q.to_blocks(texts)), [brute(model, t) for t in texts], atol=1e-3)


@pytest.mark.parametrize("slab", [1, 2, 5, 64, 1 << 15])
def test_winners_do_not_depend_on_slabs(model, monkeypatch, slab):
    r = np.random.default_rng(4)
    blocks, first = q.to_blocks([bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (0, 5, 16, 17, 300, 8 * 40, 33)])
    both = model.embed[blocks].reshape(len(blocks), -1) @ model.left
    got = both[:-1, : q.FILTERS] + both[1:, q.FILTERS :]
    end = np.append(first[1:], len(blocks)) - 1
    want = np.stack([a + got[a:b].argmax(0) for a, b in zip(first, end, strict=True)])
    monkeypatch.setattr(q, "SLAB", slab)
    at, best = q._winners(model, blocks, first)
    assert np.allclose(best, np.take_along_axis(got, want, 0), atol=1e-4) and np.allclose(np.take_along_axis(got, at, 0), best, atol=1e-4)


def test_learns_a_marker():
    r = np.random.default_rng(3)
    words = lambda n: " ".join("".join(chr(97 + c) for c in r.integers(0, 26, 5)) for _ in range(n))
    texts, labels = [], []
    for i in range(400):
        bad = i % 2
        t = words(40)
        texts.append((t[:100] + "#$%#$%" * 5 + t[100:] if bad else t).encode())
        labels.append(1 - bad)
    m = q.fit(texts[:300], np.array(labels[:300], float), 0.5)
    p = q.score_texts(m, [t.decode() for t in texts[300:]])
    assert ((p >= 0.5) == np.array(labels[300:])).mean() > 0.95


def test_one_class_only():
    assert q.score_texts(q.fit([b"a", b"b"], np.ones(2), 1.0), ["x"])[0] > 0.99
    assert q.score_texts(q.fit([], np.zeros(0), 0.5), [None])[0] == 0.5


def test_odd_rows(odd, empty, model):
    out = q.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert q.score(empty, model).count() == 0
    assert q.train(odd, empty.selectExpr("doc_id", "1 as quality")).intercept == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in queries.op2_quality_cnn(spark, d).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(out[k]["predicted"], v) for k, v in labels.items() if out[k]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items()) and len(out) == 1000
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert sum(p == v for p, v in held) / len(held) > 0.9
    assert sum(p for p, v in held if v) / sum(v for _, v in held) > 0.97
