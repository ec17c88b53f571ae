import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clinloom.llm import nnls_pack as k
from clinloom.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB' \n\t.!é🙂\x01s", max_size=30))
def test_stretches_change_no_id(plain, text):
    assert "".join(k.Encoder.stretches(text)).replace("\x01", "") == text.replace("\x01", "")
    assert np.frombuffer(k.encoder(PATH).encode([text])[0], "<u4").tolist() == plain(text)


@pytest.mark.parametrize("mark", [True, False])
def test_stretches_are_given_to_the_tokenizer_together(plain, mark):
    """Thousands of new words are a few texts for the tokenizer; without a mark to put between them, each is one."""

    class Counting:
        def __init__(self, tool):
            self.tool, self.texts = tool, 0

        def __getattr__(self, name):
            return getattr(self.tool, name)

        def encode_batch_fast(self, texts, **more):
            self.texts += len(texts)
            return self.tool.encode_batch_fast(texts, **more)

    encoder = k.Encoder(PATH)
    encoder._tokenizer = counted = Counting(encoder._tokenizer)
    assert encoder._between == ("<|endoftext|>", 50256)
    if not mark:
        encoder._between = None
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abé'<|>9", k=r.randint(1, 9))) + r.choice(["", ",", ".", "?!", "<|"]) for _ in range(1500)) for _ in range(4)] + ["", "\x01", "<|endoftext", "x" * 500]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain(t) for t in texts]
    assert (counted.texts < 10) == mark


def test_added_tokens_in_the_text(plain):
    """Where the text spells an added token, the ids are the tokenizer's own: at ends, doubled, against words and marks."""
    t = "<|endoftext|>"
    texts = ["hello" + t, t + "hello", t + t, f"it's {t}  don't\n\n've", f"a {t} b", f"x!{t}?y", f"end.{t}\n{t}", "<|endoftext |>", "<|endoftext|", f" {t} " * 3, "no mark here", "", f"{t}\x01 a b"]
    for text, ids in zip(texts, k.encoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text), text
    assert plain("hello" + t) == [31373, 50256]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "a", " ", "\n", ".", "<|", "|>", "endoftext", "é"]), max_size=12))
def test_added_tokens_anywhere(plain, parts):
    text = "".join(parts)
    assert np.frombuffer(k.encoder(PATH).encode([text])[0], "<u4").tolist() == plain(text)


def test_equals_the_other_library(plain):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "The quick brown fox's 123 jumps!! over\n the lazy dog. " * 20
    assert e.encode_ordinary(text) == np.frombuffer(k.encoder(PATH).encode([text])[0], "<u4").tolist()


def check(rows, docs, window=k.WINDOW):
    """Every id in one piece, sequences gapless, full or a power of two; documents' ids as given."""
    by_doc, by_seq = {}, {}
    for doc, start, length, crc, total, seq, offset in rows:
        by_doc.setdefault(doc, []).append((start, length, crc, total))
        by_seq.setdefault(seq, []).append((offset, length))
    assert set(by_doc) == set(docs)
    for doc, ids in docs.items():
        at = 0
        for start, length, crc, total in sorted(by_doc[doc]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    return by_seq


@pytest.mark.parametrize("seed", range(12))
def test_packer(seed):
    r = random.Random(seed)
    pick = [lambda: r.randrange(1, 200), lambda: 40, lambda: r.choice([16, 48, 64, 63]), lambda: int(r.paretovariate(0.7)) % 3000 + 1][seed % 4]
    docs = {i: [r.randrange(50_000) for _ in range(pick())] + [0] for i in range(r.choice([0, 1, 5, 300]))}
    p = k.Packer(5, 64, 37)
    for i, ids in docs.items():
        p.add(i, np.array(ids, "<u4").tobytes())
    p.finish()
    seqs = check(p.rows, docs, 64)
    assert sum(sum(n for _, n in s) < 64 for s in seqs.values()) <= 6


def test_least_squares_finds_an_exact_cover():
    h = np.zeros(65, np.int64)
    for a, n in ((40, 30), (24, 30), (10, 12), (54, 12), (20, 8), (22, 16)):
        h[a] += n
    used = np.zeros(65, np.int64)
    for lengths, n in k.plan(h, 64):
        assert sum(lengths) == 64
        for x in lengths:
            used[x] += n
    assert (used <= h).all() and used.sum() >= 0.9 * h.sum()
    combos = k.combinations(np.array([10, 20, 22, 24, 40, 54]), 64)
    assert {tuple(sorted(c)) for c in combos.tolist()} == {(0, 24, 40), (0, 10, 54), (20, 20, 24), (20, 22, 22)}
    x = k.solve_counts(combos, h, 4000)
    res = np.bincount(combos.ravel(), np.repeat(x, 3), minlength=65)[1:] - h[1:]
    grad = np.array([sum(res[v - 1] for v in c if v) for c in combos.tolist()])
    assert (x >= 0).all() and (grad > -0.05).all() and abs((grad * x).sum()) < 1.0


def test_most_windows_come_from_the_plan():
    r = np.random.default_rng(5)
    lengths = r.integers(1, 1024, 6000)
    h = np.bincount(lengths, minlength=1025)
    planned = k.plan(h)
    used = np.zeros(1025, np.int64)
    for combo, n in planned:
        assert sum(combo) == 1024 and n > 0
        for x in combo:
            used[x] += n
    assert (used <= h).all() and sum(n for _, n in planned) > 0.8 * lengths.sum() / 1024


def test_supported_combinations():
    h = np.zeros(65, np.int64)
    h[[10, 54, 20, 44, 30, 34, 24, 40]] = [5, 5, 1, 9, 3, 3, 2, 2]
    combos = k.combinations(np.flatnonzero(h[1:64]) + 1, 64)
    few = {tuple(c) for c in k.supported(combos, h, 1).tolist()}
    assert few <= {tuple(c) for c in combos.tolist()} and {x for c in few for x in c if x} == {x for c in combos.tolist() for x in c if x}
    assert len(k.supported(combos[:0], h)) == 0


def test_odd_rows(odd, empty, plain):
    keyed = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = {r["doc_id"]: plain(r["text"] or "") + [0] for r in keyed.collect()}
    check([tuple(r) for r in k.pack(keyed.repartition(3), PATH).collect()], docs)
    assert k.pack(empty, PATH).count() == 0
    assert {r["doc_id"] for r in k.pack(odd, PATH).collect()} == {r["doc_id"] for r in odd.collect()}
    with pytest.raises(ValueError):
        k.pack(odd, PATH, window=1000)


def test_query(spark, sf_dir, plain):
    docs = {r["doc_id"]: plain(r["text"]) + [0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [tuple(r) for r in queries.op8_nnls_pack(spark, sf_dir).collect()]
    check(rows, docs)
    assert len(rows) < 1.3 * sum(-(-len(x) // 1024) for x in docs.values()) + 20


def test_batches_are_streamed(plain):
    texts = ["some words here " * n for n in range(1, 60)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": [t]}) for i, t in enumerate(texts)]
    rows = [tuple(r.values()) for b in k.pack_batches(iter(batches), PATH) for r in b.to_pylist()]
    check(rows, {i: plain(t) + [0] for i, t in enumerate(texts)})


def test_words_behind_a_space_need_no_mark_between_them(plain):
    """A mark between new words was a piece of its own for the tokenizer, for each of them."""
    encoder, given = k.Encoder(PATH), []

    class Seen:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return self.real.encode_batch_fast(texts, **how)

    encoder._tokenizer = Seen(encoder._tokenizer)
    texts = [" ".join(f"{a}{b}qu" for a in ("xy", "ß", "日本", "é", "LL", "ªº") for b in ("ab", "ñ", "语", "Zo")), "one two, it's 3 x y a  b Ġc d́e  f\n g ᾳ ǅ ﬁ", " ", " a", "a "]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain(t) for t in texts]
    joined = next(t for t in given if " ßabqu" in t)
    assert joined.count(" ") > 20 and "<|endoftext|>" not in joined
    encoder._kept.clear()
    encoder._opens[:] = False  # a vocabulary that writes spaces otherwise
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain(t) for t in texts]
