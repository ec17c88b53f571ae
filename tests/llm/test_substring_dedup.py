import hashlib
import random
import re

import numpy as np
import pytest

from clinloom.llm import queries
from clinloom.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, long):
    """By the definition: (id, words, removed, kept) of each row, in no order."""
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in cut:
        if i is not None:
            for k in range(len(w) - long + 1):
                key = tuple(w[k : k + long])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - long + 1):
            if i is not None and least[tuple(w[k : k + long])] < i:
                gone |= set(range(k, k + long))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def got(docs, **more):
    left = sd.kept(docs, sd.repeats(docs, **more), words=more.get("words", sd.WORDS))
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["text"] or "") for r in left.collect()), key=str)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in queries.QUERIES["op13_substring_dedup"](spark, path).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert found == sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows, 13))
    assert sum(r[2] for r in found)


def repetitive(seed, n=120):
    """Texts of few words, so that passages repeat in and across texts, in all kinds of surroundings."""
    deal = random.Random(seed)
    vocabulary = ["a", "b", "c", "ünï", "日本", "longer-word-than-eight", "x" * 700]
    common = [[deal.choice(vocabulary) for _ in range(deal.randint(3, 30))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(deal.randint(0, 4)):
            text += deal.choice(common) if deal.random() < 0.5 else [deal.choice(vocabulary) for _ in range(deal.randint(0, 12))]
        rows.append((deal.choice([i, i, 1000 - i]), deal.choice([" ", "\n", "\t \x0b"]).join(text)))
    return rows + [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (None, None), (2000, None), rows[9], rows[9], (1999, "a b " * 400), (3, "a b " * 300), (1998, "b a " * 50)]


@pytest.mark.parametrize(("seed", "words", "gram", "split"), [(1, 4, 2, 2048), (2, 5, 1, 2), (3, 5, 5, 0), (4, 13, 5, 2048)])
def test_repetitive(spark, monkeypatch, seed, words, gram, split):
    """Copies, repeated ids, null ids, texts that repeat themselves; anchors with too many passages for one automaton."""
    monkeypatch.setattr(sd, "SPLIT", split)
    rows = repetitive(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(df, words=words, gram=gram) == plain(rows, words)


def test_odd_and_empty(spark, odd, empty):
    assert got(odd) == plain([(r["doc_id"], r["text"]) for r in odd.collect()], 13)
    left = sd.kept(odd, sd.repeats(odd))
    assert set(odd.columns) < set(left.columns) and left.where("_b = 7").count() == odd.count()
    assert got(empty) == []


def test_automaton_against_search():
    deal = random.Random(9)
    for long in (1, 2, 3, 5):
        for _ in range(60):
            passages = [([bytes([97 + deal.randint(0, 2)]) for _ in range(deal.randint(long, 14))], d) for d in range(8)]
            held, seen = sd.Automaton(), {}
            shard = sd.Shard(long)
            for words, doc in passages:
                windows = [tuple(words[k : k + long]) for k in range(len(words) - long + 1)]
                assert held.least(words, long) == [seen.get(w) for w in windows]
                held.add(words, doc)
                for w in windows:
                    seen.setdefault(w, doc)
                assert shard.pass_by(words, doc) == [seen[w] for w in windows]


def test_runs_in_blocks(monkeypatch):
    """Equal windows have equal anchors, blocks and texts cut runs only, and every window is in one run."""
    rng = np.random.default_rng(3)
    word, first = rng.integers(0, 5, 400).astype(np.uint64), np.array([0, 3, 200, 200, 390, 400])
    by_window = {}
    for block in (1 << 19, 50, 17):
        monkeypatch.setattr(sd, "BLOCK", block)
        covered = set()
        for text, start, n, anchor in zip(*sd.runs(word, first, 6, 2), strict=True):
            for k in range(first[text] + start, first[text] + start + n):
                assert k + 6 <= first[text + 1] and k not in covered
                covered.add(k)
                assert by_window.setdefault(tuple(word[k : k + 6]), anchor) == anchor
        assert covered == {k for a, b in zip(first, first[1:], strict=False) for k in range(a, b - 5)}


def test_long_texts():
    text = b"one two " * 500_000 + b"z" * 5_000_000
    hashes = sd.word_hashes(text)
    assert len(hashes) == 1_000_001 and len(set(hashes.tolist())) == 3
    assert sd.word_hashes(b"").tolist() == [] and len(sd.word_hashes(b"  a\x0bb ")) == 2
