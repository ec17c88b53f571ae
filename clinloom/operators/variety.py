"""Variety of turns: which phrases a turn gets, and when a role summarises, explains or asks, by draws that anyone can repeat.

A draw is a number of 52 bits from the SHA-256 of seed, dialogue, turn and slot; slots name what is drawn, so one draw more
or less changes no other. A choice among weighted phrases takes one draw and one look-up in an alias table, in whole
numbers throughout. All of it is columns: rows need nothing of each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.functions import text as tx

BITS = 52
WHOLE = 1 << BITS
#: Phrases of a choice: with more, a draw times their number would leave 64 bits.
MOST = 1 << 10


def draw(seed: str, dialogue: Column, turn: Column, slot: str) -> Column:
    """A whole number from 0 up to 2^52."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), dialogue.cast("string"), turn.cast("string"), F.lit(slot)).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def happens(number: Column, probability: Column | float) -> Column:
    """Whether a draw falls below a probability."""
    return number < F.floor((F.lit(probability) if isinstance(probability, float) else probability) * WHOLE).cast("long")


def alias_table(weights: Sequence[float]) -> tuple[list[int], list[int]]:
    """(thresholds, aliases): place j stays if the rest of the draw is below its threshold, else its alias is taken.

    Each place has 2^52 parts; a place that has fewer of its own is filled up from one that has more.
    """
    n = len(weights)
    if not 0 < n <= MOST or any(not w >= 0 for w in weights) or not 0 < sum(weights) < float("inf"):
        raise ValueError(f"1 to {MOST} weights are needed, none of them negative, and one above 0")
    parts = [round(w / sum(weights) * n * WHOLE) for w in weights]
    parts[max(range(n), key=parts.__getitem__)] += n * WHOLE - sum(parts)
    keep, alias = parts[:], list(range(n))
    short, long = [j for j in range(n) if keep[j] < WHOLE], [j for j in range(n) if keep[j] > WHOLE]
    while short:
        a, b = short.pop(), long[-1]
        alias[a] = b
        keep[b] -= WHOLE - keep[a]
        if keep[b] <= WHOLE:
            long.pop()
            if keep[b] < WHOLE:
                short.append(b)
    return keep, alias


def choose(number: Column, phrases: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """One of the phrases by a draw; evenly, without weights."""
    keep, alias = alias_table(weights or [1.0] * len(phrases))
    if len(keep) != len(phrases):
        raise ValueError("each phrase needs a weight")
    at = F.shiftright(number * len(phrases), BITS).cast("int")
    rest = (number * len(phrases)).bitwiseAND(F.lit(WHOLE - 1))
    taken = F.when(rest < F.get(F.lit(keep).cast("array<long>"), at), at).otherwise(F.get(F.lit(alias).cast("array<int>"), at))
    return F.get(F.array(*map(F.lit, phrases)), taken)


@dataclass(frozen=True)
class Phrases:
    """What can be said, with weights where they aren't even. Follow-ups are by symptom; the first that is named counts."""

    acknowledgments: Sequence[str]
    empathy: Sequence[str]
    transitions: Sequence[str]
    hesitations: Sequence[str]
    confident: Sequence[str]
    uncertain: Sequence[str]
    follow_ups: Mapping[str, Sequence[str]] = field(default_factory=dict)
    generic: Sequence[str] = ("When did this start?",)
    weights: Mapping[str, Sequence[float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Chances:
    """How likely each thing is."""

    silent: float = 0.3
    hesitate: float = 0.4
    hesitate_uncertain: float = 0.7
    filler: float = 0.5
    filler_least: float = 0.2
    filler_falls: float = 0.03
    direct: float = 0.7
    summarise: float = 0.4
    explain: float = 0.5
    clarify: float = 0.3


def varied(turns: DataFrame, seed: str, phrases: Phrases, chances: Chances = Chances()) -> DataFrame:
    """``turns`` with what their role adds (``prefix``), the whole ``response``, and the draws of habits.

    ``turns`` has dialogue_id, index, role and text, and may have uncertain, confident, directness, symptoms (discussed so far),
    phase and term (whether a medical one was used); what it hasn't is false, 0.5, 0 and ''. Roles other than
    patient and doctor add nothing.
    """
    c = chances
    have = lambda name, other: F.coalesce(F.col(name), F.lit(other)) if name in turns.columns else F.lit(other)
    d = lambda slot: draw(seed, F.col("dialogue_id"), F.col("index"), slot)
    pick = lambda slot: choose(d(slot), getattr(phrases, slot), phrases.weights.get(slot))
    who, unsure, turn = tx.role(F.col("role")), have("uncertain", False), F.col("index")
    hesitation = F.when(happens(d("hesitate"), F.when(unsure, c.hesitate_uncertain).otherwise(c.hesitate)), pick("hesitations"))
    starter = F.when(have("confident", False), pick("confident")).when(unsure, pick("uncertain"))
    acknowledged = F.when(~happens(d("silent"), c.silent), F.concat(pick("acknowledgments"), F.lit(".")))
    doctor = F.array(acknowledged, F.when(unsure, F.concat(pick("empathy"), F.lit("."))), F.when(turn % 4 == 0, pick("transitions")))
    said = F.array_compact(F.when(who == "Patient", F.array(hesitation, starter)).when(who == "Doctor", doctor).otherwise(F.array().cast("array<string>")))
    base = F.greatest(F.lit(c.filler_least), F.lit(c.filler) - turn * c.filler_falls) * F.when(have("directness", 0.5) > c.direct, 0.5).otherwise(1.0)
    low, follow = F.lower("text"), choose(d("generic"), phrases.generic)
    for symptom, questions in reversed(phrases.follow_ups.items()):
        follow = F.when(F.contains(low, F.lit(symptom)), choose(d("follow"), questions)).otherwise(follow)
    late = have("phase", "").isin("synthesis", "conclusion") & (turn >= 8)
    return turns.select(
        "*", F.array_join(said, " ").alias("prefix"), F.trim(F.array_join(F.concat(said, F.array(F.coalesce("text", F.lit("")))), " ")).alias("response"),
        (F.coalesce(who == "Patient", F.lit(False)) & happens(d("filler"), base)).alias("filler"), (turn.between(8, 12) & (have("symptoms", 0) >= 3) & happens(d("summarise"), c.summarise)).alias("summarise"),
        (late & happens(d("explain"), c.explain)).alias("explain"), (have("term", False) & (turn >= 3) & happens(d("clarify"), c.clarify)).alias("clarify"), follow.alias("follow_up"),
    )
