import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import oracle, spark_rows

from clinloom.llm import queries
from clinloom.llm import source_divergence as sd


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    found = spark_rows(queries.QUERIES["op12_source_divergence"](spark, f"/root/testdata/{folder}"))
    assert found[1] and found == oracle(queries.ORACLE_SQL["op12_source_divergence"], f"/root/testdata/{folder}")


def plain(rows, least, smooth, top):
    """By the definition, in Python's whole numbers."""
    counts, within, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = "".join(c.lower() if c.isascii() else c for c in (text or ""))
        terms = "".join(c if c.isalpha() and c.isascii() or not c.isascii() else " " for c in terms).split(" ")
        terms = [t for t in terms if t]
        counts[lang, source].update(terms)
        within[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, d in within[lang].items() if d >= least), key=lambda t: t.encode())
        sources = sorted(s for x, s in groups if x == lang)
        every = Counter()
        for s in sources:
            every.update(counts[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + smooth) // (total + smooth * len(kept)) for t in kept]

        q, p = shares(every), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            term = [(t, a - b) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top}
    return out


def test_plain(spark, odd, monkeypatch):
    """Many chunks, ties, nulls, sources and languages without terms, a term in other scripts, flushes in a task."""
    monkeypatch.setattr(sd, "CHUNK", 12)
    monkeypatch.setattr(sd, "HELD", 20)
    deal = random.Random(5)
    words = ["Alpha", "alpha", "beta-2", "ünï", "Ünï", "日本", "é", "z" * 300, "a1b2", "x_y", " ", "𝒳", "�", "K"]
    rows = [(" ".join(deal.choices(words, k=deal.randint(0, 9))), deal.choice(["en", "de", None]), deal.choice(["s1", "s2", "日", None])) for _ in range(150)]
    rows += [("12 34", "en", "digits only"), (None, "fr", None), ("", "fr", "empty"), *[rows[0]] * 5]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for least, top in ((3, 4), (1, 50), (10**6, 5)):
        assert {tuple(r) for r in sd.divergence(df, least=least, top=top).collect()} == plain(rows, least, 5, top)
    found = sd.divergence(odd, least=1).select("lang", "source", "part", "item", "value", "rank").collect()
    assert {tuple(r) for r in found} == plain([(r["text"], r["lang"], r["source"]) for r in odd.collect()], 1, 5, 50)


def test_empty(spark, empty):
    assert sd.divergence(empty).count() == 0


def test_shares_are_exact():
    deal = random.Random(1)
    for _ in range(200):
        total, kept = deal.randint(1, 9 * 10**15), deal.randint(1, 10**9)
        count = deal.randint(0, total)
        assert int(sd.share(np.array([count]), total, 5, kept)[0]) == 1 + 10**9 * (count + 5) // (total + 5 * kept)
