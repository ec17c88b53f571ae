"""Operators around a study: repair plans, seeds, coverage, grids, older judges and heuristics."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.functions.text import role, strip

REPAIR_VERSION = "targeted-repair.v1"
# What is repaired when a dimension fails, and how. The composite only reports and is no target.
REPAIRS = (
    ("patient_factuality", ("patient_prompt",), "Remove or explicitly qualify only the unsupported patient statements identified by the factuality evaluator; do not change doctor behaviour or disclosure policy."),
    ("doctor_factuality", ("doctor_prompt",), "Remove or qualify only unsupported doctor assertions; retain questions, diagnostic hypotheses, and the configured patient knowledge boundary."),
    ("knowledge_boundary", ("patient_prompt", "patient_context_guard"), "Prevent only the located prohibited disclosures and reinforce the configured policy boundary without adding facts from masked reference fields."),
    ("naturalness", ("patient_style", "doctor_style"), "Revise only the evaluator-located conversational phrasing or flow; preserve all clinical content, policy masking, factual claims, and turn budget."),
    ("structural_validity", ("orchestration",), "Correct only the reported deterministic structure violations: role order, empty turns, repetition, provider sentinels, or turn bounds."),
)


def repair_plan(failed: DataFrame) -> DataFrame:
    """Of (case_id, position, dimension): one action for each failed dimension, in order; an unknown dimension raises.

    A repeated dimension counts once, at its first position.
    """
    rules = failed.sparkSession.createDataFrame([(d, list(t), x) for d, t, x in REPAIRS], "dimension string, targets array<string>, directive string")
    steps = failed.groupBy("case_id", "dimension").agg(F.min("position").alias("position")).join(F.broadcast(rules), "dimension", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown failed dimension "), F.coalesce("dimension", F.lit("null"))))
    directive = F.when(F.col("directive").isNull(), unknown).otherwise(F.col("directive"))
    listed = F.array_sort(F.collect_list(F.struct("position", "dimension", "targets", directive.alias("directive"))))
    actions = F.transform(listed, lambda x: F.struct(x["dimension"].alias("dimension"), x["targets"].alias("targets"), x["directive"].alias("directive")))
    return steps.groupBy("case_id").agg(actions.alias("actions")).withColumn("repair_version", F.lit(REPAIR_VERSION))


def json_string(text: Column) -> Column:
    """A text as JSON in ASCII: quotes, backslashes and control characters escaped, others as UTF-16 escapes."""
    def escape(c: Column) -> Column:
        code = F.ascii(c)
        four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
        wide = code - 65536
        pair = F.concat(four(F.lit(0xD800) + F.floor(wide / 1024)), four(F.lit(0xDC00) + wide % 1024))
        short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
        out = F.when(c.isin('"', "\\"), F.concat(F.lit("\\"), c))
        for at, letter in short.items():
            out = out.when(code == at, "\\" + letter)
        return out.when((code >= 32) & (code < 127), c).when(code < 65536, four(code)).otherwise(pair)

    plain = text.rlike(r'^[ !#-\[\]-~]*$')
    escaped = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escape), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"'))


def attempt_seed(base_seed: Column, case_id: Column, policy: Column, attempt_index: Column, stream: str = "generation") -> Column:
    """A seed below 2^31: the first 64 bits of SHA-256 of the canonical JSON of five named fields.

    An attempt below 1 raises, and so does a null, which would be another payload's text.
    """
    parts = [
        F.lit('{"attempt_index":'), attempt_index.cast("long").cast("string"), F.lit(',"base_seed":'), base_seed.cast("long").cast("string"), F.lit(',"case_id":'), json_string(case_id.cast("string")),
        F.lit(',"patient_policy_ref":'), json_string(policy.cast("string")), F.lit(',"stream":'), json_string(F.lit(stream)), F.lit("}"),
    ]
    text = F.concat(*parts)
    sound = F.coalesce(attempt_index >= 1, F.lit(False)) & text.isNotNull()
    seed = (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % 2147483648).cast("long")
    return F.when(sound, seed).otherwise(F.raise_error(F.lit("a seed needs all its fields and an attempt of at least 1")))


def judge_answers(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """The older judge: yes-answers by statements; 0 without patient turns, 1 without statements."""
    n = turns.groupBy("dialogue_id").agg(F.count_if(F.col("patient")).alias("patient_turns"))
    a = answers.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("statements"), F.count_if(F.lower("answer") == "yes").alias("yes"))
    out = n.join(a, "dialogue_id", "left").na.fill(0)
    score = F.when(F.col("patient_turns") == 0, 0.0).when(F.col("statements") == 0, 1.0).otherwise(F.col("yes") / F.greatest("statements", F.lit(1)))
    return out.withColumn("score", score)


def missing_cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """Combinations of the distinct values of two columns that have no row; the columns' side must be few."""
    few = df.select(column).distinct()
    if few.limit(1001).count() > 1000:
        raise ValueError(f"too many distinct values of {column} for a grid")
    return df.select(row).distinct().crossJoin(F.broadcast(few)).join(df.select(row, column).distinct(), [row, column], "left_anti")


def coverage(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """How many wanted keys are there, and how many are not."""
    there = have.select(key).distinct().withColumn("_there", F.lit(True))
    j = wanted.select(key).distinct().join(there, key, "left")
    return j.agg(F.count_if(F.col("_there").isNotNull()).alias("covered"), F.count_if(F.col("_there").isNull()).alias("missing"))


def last_wins(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The value of greatest ``order`` for each key."""
    return df.groupBy(*by).agg(F.max_by("value", order).alias("value"))


def matcher_errors(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of (expected, matched): a match of the wrong row is a false positive and a miss at once."""
    e, m = F.col("expected"), F.col("matched")
    right = F.coalesce(e == m, F.lit(False))
    return df.groupBy(*by).agg(
        F.count_if(right).alias("tp"), F.count_if(m.isNotNull() & ~right).alias("fp"), F.count_if(e.isNotNull() & ~right).alias("fn"), F.count_if(e.isNull() & m.isNull()).alias("tn"), F.count(F.lit(1)).alias("n_cases")
    )


def reordered(df: DataFrame, first: Column, position: str, n: int) -> DataFrame:
    """The first ``n`` rows, those that pass ``first`` before the others, each in their order."""
    return df.withColumn("passed", first).orderBy(F.desc("passed"), position).limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc("passed"), position)))


def phase(turn: Column) -> Column:
    """The conversation's phase at a doctor's turn, counted from 1."""
    return F.when(turn <= 3, "opening").when(turn <= 8, "exploration").when(turn <= 11, "synthesis").otherwise("conclusion")


# Words by which a patient's mood is told, the first that occurs counts; and words of an inquiry.
MOODS = (
    ("anxious", ("worried", "scared", "afraid", "concerned", "anxious")),
    ("frustrated", ("frustrated", "annoyed", "tired of")),
    ("in_pain", ("hurts", "painful", "terrible", "awful")),
    ("confused", ("confused", "don't understand", "unclear")),
)
INQUIRIES = ("when", "where", "how long", "describe", "what does", "scale", "worse", "better", "trigger", "happen", "associated", "any other")
SUBSTANTIAL_TURNS, COVERING_QUESTIONS, SHORTEST = 6, 3, 10


def _holds(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def mood(text: Column) -> Column:
    """What a patient's message sounds like; neutral if no word tells."""
    low, out = F.lower(text), F.lit("neutral")
    for name, words in reversed(MOODS):
        out = F.when(_holds(low, words), name).otherwise(out)
    return out


def valid_response(text: Column) -> Column:
    """Whether an agent's answer can be used: at least ten characters and no error report."""
    return F.coalesce((F.length(strip(text)) >= SHORTEST) & ~F.contains(text, F.lit("[ERROR:")), F.lit(False))


def conversation_checks(turns: DataFrame) -> DataFrame:
    """Per dialogue: turns, unusable answers, doctor's inquiries, whether it is substantial and covers the symptoms."""
    doctor = F.coalesce(role(F.col("role")) == "Doctor", F.lit(False))
    asked = doctor & _holds(F.lower("text"), INQUIRIES)
    out = turns.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(~valid_response(F.col("text"))).alias("invalid"), F.count_if(asked).alias("inquiries"))
    substantial = F.col("turns") >= SUBSTANTIAL_TURNS
    return out.withColumn("substantial", substantial).withColumn("covered", substantial & (F.col("inquiries") >= COVERING_QUESTIONS))


def style(age: Column) -> Column:
    """A patient's way of talking by age: traits from 0 to 1."""
    traits = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("formality", "verbosity", "directness", "anxiety_level", "medical_literacy"), v, strict=True)])
    return F.when(age < 30, traits(0.3, 0.5, 0.7, 0.5, 0.6)).when(age < 60, traits(0.5, 0.6, 0.6, 0.5, 0.5)).otherwise(traits(0.7, 0.7, 0.4, 0.6, 0.5))


def render(template: str, slots: Mapping[str, str]) -> tuple[str, str]:
    """A prompt and its version; a slot that is left over raises."""
    out = template
    for name, value in slots.items():
        out = out.replace("{{" + name + "}}", value)
    if left := re.findall(r"\{\{\w+\}\}", out):
        raise ValueError(f"slots without a value: {left}")
    return out, hashlib.sha256(template.encode()).hexdigest()[:12]


def mock_response(prompt: Column) -> Column:
    """A stand-in for a model's answer: text that only depends on the prompt."""
    return F.concat(F.lit("response "), F.substring(F.sha2(prompt, 256), 1, 12))


def balanced_object(text: str | None) -> str | None:
    """The first balanced {...} of a text, braces counted without regard to strings."""
    if text is None:
        return None
    start = text.find("{")
    depth = 0
    for i in range(max(start, 0), len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if start >= 0 and depth == 0:
            return text[start : i + 1]
    return None
