"""Dialogue operators: structural checks, repetition, openings, loops, statistics.

Turns are (dialogue_id, index, role, text). Windows are per dialogue, whose length is
bounded by its maximum of turns; nothing is ordered over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.functions import text as tx

TURNS = (4, 40)
REPEATED, RECENT = 3, 6


def _ordered() -> Window:
    return Window.partitionBy("dialogue_id").orderBy("index")


def recent_turns(turns: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` turns of each dialogue."""
    back = Window.partitionBy("dialogue_id").orderBy(F.col("index").desc())
    return turns.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n).drop("_r")


def repeated_symptoms(turns: DataFrame, words: tuple[str, ...] = tx.SYMPTOMS, least: int = REPEATED) -> DataFrame:
    """(dialogue_id, symptom, mentions) named in at least ``least`` of the last turns."""
    low = recent_turns(turns).withColumn("low", F.lower("text"))
    named = low.select("dialogue_id", F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("low"), w))).alias("symptom"))
    return named.groupBy("dialogue_id", "symptom").agg(F.count(F.lit(1)).alias("mentions")).where(F.col("mentions") >= least)


def violations(turns: DataFrame, bounds: tuple[int, int] = TURNS, repeated: DataFrame | None = None, unicode: bool = True) -> DataFrame:
    """(dialogue_id, check, index): every failed check; the index is null for whole dialogues."""
    w = _ordered()
    who, own = tx.role(F.col("role")), tx.strip(F.col("text"), unicode)
    seen = turns.withColumn("_role", who).withColumn("_text", own)
    seen = seen.withColumn("_before", F.lag("_role").over(w)).withColumn("_said", F.lag("_text").over(w))
    checks = [
        F.when(F.col("_role").isNull(), "role_validity").when(F.col("_role") == F.col("_before"), "alternation"),
        F.when(F.col("_text") == "", "empty_turn"),
        F.when((F.col("_text") != "") & (F.col("_text") == F.col("_said")), "duplicate_turn"),
        F.when(tx.has_sentinel(F.col("text")), "error_sentinel"),
    ]
    found = seen.select("dialogue_id", "index", F.explode(F.array_compact(F.array(*checks))).alias("check")).select("dialogue_id", "check", "index")
    sized = turns.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") < bounds[0]) | (F.col("n") > bounds[1]))
    whole = sized.select("dialogue_id", F.lit("turn_bounds").alias("check"), F.lit(None).cast("int").alias("index"))
    often = (repeated_symptoms(turns) if repeated is None else repeated).select("dialogue_id").distinct()
    return found.unionByName(whole).unionByName(often.select("dialogue_id", F.lit("repetition").alias("check"), F.lit(None).cast("int").alias("index")))


def structural_score(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(dialogue_id, turns, violations, score): 1 without a violation, else 0."""
    sizes = turns.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("turns"))
    counts = found.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("violations"))
    out = sizes.join(counts, "dialogue_id", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    return out.withColumn("score", (F.col("violations") == 0).cast("double"))


def repetitive_openings(turns: DataFrame, history: int = 5, above: float = 0.7, least: int = 2) -> DataFrame:
    """Each turn's opening, and whether it is like at least two of the role's last five."""
    w = Window.partitionBy("dialogue_id", "role").orderBy("index").rowsBetween(-history, -1)
    seen = turns.withColumn("opening", tx.opening(F.col("text"))).withColumn("past", F.collect_list("opening").over(w))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    alike = F.size(F.filter("past", lambda p: tx.jaccard(words(F.col("opening")), words(p), 0.0) > above))
    return seen.select("dialogue_id", "index", "role", "opening", alike.alias("alike"), ((F.col("opening") != "") & (alike >= least)).alias("repetitive"))


# What marks a turn as a question.
QUESTIONS = ("what", "how", "when", "where", "why", "can you", "could you")


def loops(turns: DataFrame, window: int = RECENT) -> DataFrame:
    """Per turn: whether the last turns repeat a message of a role, or hold three questions of the doctor."""
    w = _ordered().rowsBetween(1 - window, 0)
    item = F.struct(tx.role(F.col("role")).alias("who"), F.lower(F.substring("text", 1, 100)).alias("said"))
    seen = turns.withColumn("_w", F.collect_list(item).over(w))

    def said(who: str) -> Column:
        return F.transform(F.filter("_w", lambda x: x["who"] == who), lambda x: x["said"])

    def again(messages: Column) -> Column:
        return F.coalesce(F.try_element_at(messages, F.lit(-1)) == F.try_element_at(messages, F.lit(-2)), F.lit(False))

    asked = F.filter(said("Doctor"), lambda m: m.rlike("|".join(QUESTIONS)))
    looping = (F.size("_w") >= window) & (again(said("Doctor")) | again(said("Patient")) | (F.size(asked) >= 3))
    return seen.select("dialogue_id", "index", looping.alias("looping"))


def dialogue_stats(turns: DataFrame) -> DataFrame:
    """Turns, words and turns of each role."""
    who = tx.role(F.col("role"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return turns.groupBy("dialogue_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(words.cast("long")).alias("words"), F.count_if(who == "Patient").alias("patient_turns"),
        F.count_if(who == "Doctor").alias("doctor_turns"), F.count_if(who.isNull()).alias("other_turns"),
    )


def confusion_streak(turns: DataFrame, confused: Column, limit: int = 2) -> DataFrame:
    """Per dialogue the greatest streak (one up when confused, one down otherwise, not below 0), and whether it reached the limit."""
    marked = turns.withColumn("_c", confused)
    listed = marked.groupBy("dialogue_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "_c"))), lambda x: x["_c"]).alias("c"))
    fold = F.expr("aggregate(c, named_struct('now', 0, 'most', 0), (s, x) -> named_struct('now', if(x, s.now + 1, greatest(0, s.now - 1)), 'most', greatest(s.most, if(x, s.now + 1, greatest(0, s.now - 1)))), s -> s.most)")
    return listed.select("dialogue_id", fold.alias("longest_streak"), (fold >= limit).alias("ended"))
