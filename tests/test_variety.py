"""Draws that can be repeated, alias tables whose parts add up, and frequencies within bounds."""

import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from clinloom.operators import variety as v

PHRASES = v.Phrases(("I see", "Right"), ("That's hard",), ("Now",), ("Um...", "Well...", "Uh..."), ("Yes,",), ("Maybe,", "Perhaps,"), {"pain": ("Where?", "Since when?"), "fever": ("How high?",)}, weights={"hesitations": (6, 3, 1)})


def number(seed, dialogue, turn, slot):
    return int(hashlib.sha256(f"{seed}|{dialogue}|{turn}|{slot}".encode()).hexdigest()[:13], 16)


def chosen(n, phrases, weights=None):
    """By the definition: each place of an alias table has as many parts as its weight."""
    keep, alias = v.alias_table(weights or [1.0] * len(phrases))
    at, rest = divmod(n * len(phrases), v.WHOLE)
    return phrases[at if rest < keep[at] else alias[at]]


@pytest.mark.parametrize("weights", [(1,), (1, 1, 1), (6, 3, 1), (0, 5, 0, 1e-9), tuple(range(1, 50)), (0.1,) * 7])
def test_alias_tables_add_up(weights):
    keep, alias = v.alias_table(weights)
    parts = [Fraction(0)] * len(weights)
    for j, (k, a) in enumerate(zip(keep, alias, strict=True)):
        assert 0 <= k <= v.WHOLE
        parts[j] += Fraction(k, v.WHOLE)
        parts[a] += 1 - Fraction(k, v.WHOLE)
    for w, p in zip(weights, parts, strict=True):
        assert abs(float(p) / len(weights) - w / sum(weights)) < 1e-12


def test_refused_weights(spark):
    for bad in ((), (0, 0), (1, -1), (1, float("nan")), (1,) * (v.MOST + 1)):
        with pytest.raises(ValueError):
            v.alias_table(bad)
    with pytest.raises(ValueError):
        v.choose(F.lit(1), ("a", "b"), (1.0,))


def test_turns_against_plain(spark):
    rows = [(d, k, ("doctor", "patient", "nurse")[k % 3], ("pain here", "a Fever", "nothing", None)[(d + k) % 4], (d + k) % 2 == 0, d % 5 == 0, (0.4, 0.9)[d % 2], k // 2, ("", "synthesis")[k % 2], k % 3 == 1) for d in range(40) for k in range(14)]
    df = spark.createDataFrame(rows, "dialogue_id long, index int, role string, text string, uncertain boolean, confident boolean, directness double, symptoms int, phase string, term boolean").repartition(3)
    c = v.Chances()
    for r in v.varied(df, "s", PHRASES).collect():
        n = lambda slot, r=r: number("s", r["dialogue_id"], r["index"], slot)
        p = lambda slot, q, n=n: n(slot) < int(q * v.WHOLE)
        said, k = [], r["index"]
        if r["role"] == "patient":
            said += [chosen(n("hesitations"), PHRASES.hesitations, (6, 3, 1))] * p("hesitate", 0.7 if r["uncertain"] else 0.4)
            said += ["Yes,"] if r["confident"] else [chosen(n("uncertain"), PHRASES.uncertain)] * r["uncertain"]
        elif r["role"] == "doctor":
            said += [chosen(n("acknowledgments"), PHRASES.acknowledgments) + "."] * (not p("silent", 0.3)) + ["That's hard."] * r["uncertain"] + ["Now"] * (k % 4 == 0)
        assert r["prefix"] == " ".join(said) and r["response"] == " ".join([*said, r["text"] or ""]).strip()
        assert r["filler"] == (r["role"] == "patient" and p("filler", max(c.filler_least, c.filler - k * c.filler_falls) * (0.5 if r["directness"] > 0.7 else 1)))
        assert (r["summarise"], r["explain"], r["clarify"]) == (8 <= k <= 12 and r["symptoms"] >= 3 and p("summarise", 0.4), r["phase"] == "synthesis" and k >= 8 and p("explain", 0.5), r["term"] and k >= 3 and p("clarify", 0.3))
        low = (r["text"] or "").lower()
        assert r["follow_up"] == (chosen(n("follow"), PHRASES.follow_ups["pain"]) if "pain" in low else "How high?" if "fever" in low else "When did this start?")


def test_frequencies(spark):
    """Over many turns each phrase and habit is as frequent as it should be, within five standard deviations."""
    n = 40_000
    df = spark.range(n).select(F.col("id").alias("dialogue_id"), F.lit(1).alias("index"), F.lit("patient").alias("role"), F.lit("x").alias("text"))
    got = v.varied(df, "f", PHRASES).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = {"": 0.6, "Um...": 0.24, "Well...": 0.12, "Uh...": 0.04}
    assert {r["prefix"] for r in got} == set(wanted)
    for r in got:
        p = wanted[r["prefix"]]
        assert abs(r["n"] - n * p) < 5 * (n * p * (1 - p)) ** 0.5
    assert v.varied(df.where("false"), "f", PHRASES).count() == 0
