import zlib

import numpy as np
import pytest

from clinloom.llm import language_id as li
from clinloom.llm import queries


@pytest.fixture(scope="module")
def model():
    texts = {"aa": "lorem ipsum dolor sit amet " * 20, "bb": "zażółć gęślą jaźń krótko " * 20}
    return li.build(dict(li.count_sample(iter(texts.items()))))


def test_backoff_order(model):
    known = model.word_score("ipsum")
    assert known is model.tables[0]["ipsum"]
    # An unseen word is scored by its longest known n-grams only.
    grams = [g for g in li.grams_of("ipsumx", 5) if g in model.tables[5]]
    assert grams and np.allclose(model.word_score("ipsumx"), np.mean([model.tables[5][g] for g in grams], axis=0))
    word = "qmq"
    assert not [g for n in (5, 4, 3, 2) for g in li.grams_of(word, n) if g in model.tables[n]]
    assert np.allclose(model.word_score(word), model.tables[1]["m"])
    assert model.word_score("ж") is None


def brute(model, text):
    words = li.words_of(text or "")
    if not words:
        return "und", 0.0
    total = np.zeros(len(model.languages))
    for w in words:
        s = model.word_score(w)
        total += 0 if s is None else s
    p = np.exp(total - total.max())
    return model.languages[int(total.argmax())], float(p.max() / p.sum())


def test_predictions_equal_brute_force(model, monkeypatch):
    texts = [None, "", "123 !?", "Lorem, ipsum! dolor-sit", "ŻAŻÓŁĆ gęślą", "жж", "lorem zażółć", "x" * 500, "a\nb\tc"] * 2
    monkeypatch.setattr(li, "CACHE", 3)
    own = li.Model(model.languages, model.tables)
    for _ in range(3):
        labels, scores = own.predict(texts)
        want = [brute(model, t) for t in texts]
        assert labels == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want])


def test_odd_rows(odd, empty, model):
    out = li.identify(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out) and li.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in out if not (r["text"] or "").strip()} == {"und"}
    assert li.train(empty).languages == []
    assert li.identify(odd, li.train(empty)).where("lang_pred != 'und'").count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries.op6_language_id(spark, d).collect()
    assert len(out) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in out if r["held_out"]]
    assert sum(held) / len(held) > 0.97


def test_numerals_are_no_letters(spark):
    assert li.words_of("½ ² Ⅷ ① 5a a½b x²") == ["a", "a", "b", "x"]
    model = li.build(li.count_sample([("de", "der die das der die das ½"), ("en", "the a an the a an")]))
    labels, scores = model.predict(["½ ²", "Ⅷ ①", "7 _ !", "der ½", "²der"])
    assert labels == ["und", "und", "und", "de", "de"] and scores[:3] == [0.0, 0.0, 0.0]
