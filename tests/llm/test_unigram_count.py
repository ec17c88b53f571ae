import math
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from clinloom.llm import queries
from clinloom.llm import unigram_count as u

PATH = public_tokenizers.path("piece_bpe_32k.model")


def exact(pieces, floor):
    vocab = [("<unk>", 0.0), *pieces, *[(f"<0x{b:02X}>", floor) for b in range(256)]]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    return lambda s: len(t.encode("▁" + s.replace(" ", "▁"), add_special_tokens=False).ids) if s else 0


@pytest.fixture(scope="module")
def real():
    pieces = u.vocabulary(PATH)
    return u.Counter(pieces), exact(pieces, min(s for _, s in pieces))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ▁\né日🙂.", max_size=30))
def test_equals_the_tokenizer(real, text):
    assert real[0].count(text)[0] == real[1](text)


#: Scores with many equal paths, so that the tie rules decide.
TIED = [(p, -float(len(p))) for p in ("a", "b", "ab", "ba", "aba", "bab", "▁", "▁a", "▁ab", "aa", "bb", "abab")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c", max_size=24))
def test_ties(text):
    assert u.Counter(TIED).count(text)[0] == exact(TIED, -4.0)(text)


def test_score_is_the_best_of_all_segmentations():
    c, table = u.Counter(TIED), dict(TIED)

    def best(s):
        if not s:
            return 0.0
        return max([table[s[:n]] + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in table] + ([c._unknown + best(s[1:])] if s[0] not in table else []))

    for text in ("abab ab", "aab c ba", "bbb"):
        assert c.count(text)[1] == best("▁" + text.replace(" ", "▁"))


def log_probabilities(seed, pieces):
    r = random.Random(seed)
    drawn = {p: r.random() + 0.001 for p in pieces}
    return [(p, math.log(x / sum(drawn.values()))) for p, x in drawn.items()]


FRACTIONAL = log_probabilities(1, [p for p, _ in TIED] + ["▁b", "▁▁", "▁▁a", "c", "bc", "é"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab cé\n🙂", max_size=60))
def test_fractional_scores(text):
    c, floor = u.Counter(FRACTIONAL), min(s for _, s in FRACTIONAL)
    assert c.count(text)[0] == exact(FRACTIONAL, floor)(text)


#: Tenths add up differently from different starts, so that rounding decides between equal paths.
TENTHS = [("a", -0.1), ("b", -0.2), ("ab", -0.3), ("ba", -0.3), ("aba", -0.4), ("▁", -0.1), ("▁a", -0.2), ("aa", -0.2), ("bb", -0.4), ("▁ab", -0.4)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ", min_size=1, max_size=80))
def test_rounding_decides_as_in_the_tokenizer(text):
    assert u.Counter(TENTHS).count(text)[0] == exact(TENTHS, -0.4)(text)


def test_fractional_scores_of_long_texts():
    r = random.Random(4)
    for pieces in (FRACTIONAL, TENTHS):
        c, e = u.Counter(pieces), exact(pieces, min(s for _, s in pieces))
        for _ in range(30):
            text = "".join(r.choice("aabb  c") for _ in range(3000))
            assert c.count(text)[0] == e(text)


def test_pieces_across_words():
    pieces = [("a", -1.0), ("b", -1.0), ("▁", -1.0), ("a▁b", -1.5), ("b\na", -1.2), ("\n", -1.0)]
    c, e = u.Counter(pieces), exact(pieces, -1.5)
    for text in ("a b", "a b\na b", "b\n\na", "ab ba a b"):
        assert c.count(text)[0] == e(text)


def test_cache_bound(real, monkeypatch):
    monkeypatch.setattr(u, "CACHE", 3)
    c = u.Counter(TIED)
    assert [c.count("ab ba aab bba")[0] for _ in range(3)] == [exact(TIED, -4.0)("ab ba aab bba")] * 3


def test_odd_rows(odd, empty, real):
    out = u.count_tokens(odd, PATH).collect()
    assert len(out) == odd.count() and all(r["n_pieces"] == real[1](r["text"] or "") for r in out if "\x00" not in (r["text"] or ""))
    assert u.count_tokens(empty, PATH).count() == 0


def test_query(spark, sf_dir, real):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op7_unigram_count(spark, sf_dir).collect()
    assert len(out) == len(texts) and all(r["n_pieces"] == real[1](texts[r["doc_id"]]) for r in out)


def test_count_only_equals_the_walk_with_paths():
    """Whole-number scores: rings of the last ends give what the walk that keeps all of them gives."""
    import random

    deal = random.Random(11)
    for _ in range(60):
        pieces = list({"".join(deal.choices("ab▁é", k=deal.randint(1, 5))): float(-deal.randint(0, 6)) for _ in range(deal.randint(1, 12))}.items())
        tool = u.Counter(pieces)
        for _ in range(20):
            text = "".join(deal.choices("ab▁éz🙂", k=deal.randint(0, 40)))
            assert tool.count_only(text) == tool.viterbi(text)[:2]


def test_long_stretch_in_little_memory():
    """Many characters without a space: the walk takes their four bytes each, as the automaton reads them, and no more."""
    import tracemalloc

    tool = u.Counter([("a", -1.0), ("ab", -1.0), ("abab", -3.0)])
    text = "ab" * 100_000
    tracemalloc.start()
    assert tool.count_only(text) == (100_000, -100_000.0)
    assert tracemalloc.get_traced_memory()[1] < 5 * len(text)
    tracemalloc.stop()
