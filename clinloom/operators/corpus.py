"""Operators around a dialogue corpus: turns of several writings, joins that refuse, profiles as text, older counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.functions.text import role

# Names under which a turn's role and text are written, the first that is there counts.
ROLE_KEYS, TEXT_KEYS = ("role", "speaker"), ("text", "content", "message", "utterance")
# The older judge's weights and threshold.
JUDGE, REALISTIC = {"naturalness": 0.40, "profile_compliance": 0.30, "ragas_faithfulness": 0.30}, 0.70
# Families of comparisons and how their p-values are adjusted.
FAMILIES = (
    ("F1", "architecture: five variants pairwise on the primary outcome", "holm"),
    ("F2", "policy sensitivity: three policies pairwise per metric", "holm"),
    ("F3", "judge-family agreement across independent evaluators", "holm"),
    ("F4", "detector performance across seven injected fault classes", "bh"),
)
MISSING, UNSPECIFIED = "not provided", "Not specified in profile."


def adapted_turns(dialogues: DataFrame, turns: str = "dialogue") -> DataFrame:
    """(dialogue_id, index, role, text) of an array of maps; a turn without role or text, or of an unknown role, raises."""
    each = dialogues.select("dialogue_id", F.posexplode(turns).alias("index", "_t"))
    first = lambda keys: F.coalesce(*[F.col("_t")[k] for k in keys])
    where = F.concat(F.lit("turn "), F.col("index").cast("string"))
    who, said = first(ROLE_KEYS), first(TEXT_KEYS)
    named = F.when(role(who).isNull(), F.raise_error(F.concat(where, F.when(who.isNull(), " has no role").otherwise(" has an unknown role")))).otherwise(role(who))
    return each.select("dialogue_id", "index", named.alias("role"), F.when(said.isNull(), F.raise_error(F.concat(where, F.lit(" has no text")))).otherwise(said).alias("text"))


def with_references(dialogues: DataFrame, references: DataFrame, policies: tuple[str, ...]) -> DataFrame:
    """``dialogues`` (case_id, dialogue_id, policy) with their case's reference; refuses what can't be scored.

    Raises on a repeated dialogue, an unknown policy, a case with two references and a dialogue whose case has none.
    """
    checks = {
        "dialogue is there twice": dialogues.groupBy("dialogue_id").count().where("count > 1").select(F.col("dialogue_id").cast("string").alias("x")),
        "policy is unknown": dialogues.where(F.coalesce(~F.col("policy").isin(*policies), F.lit(True))).select(F.coalesce("policy", F.lit("null")).alias("x")),
        "case has two references": references.groupBy("case_id").count().where("count > 1").select(F.col("case_id").cast("string").alias("x")),
        "case has no reference": dialogues.join(references.select("case_id"), "case_id", "left_anti").select(F.col("case_id").cast("string").alias("x")),
    }
    for what, found in checks.items():
        if bad := found.limit(1).collect():
            raise ValueError(f"{what}: {bad[0]['x']}")
    return dialogues.join(references, "case_id")


def note_lookup(notes: DataFrame, patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """Notes with their patient's and admission's columns; a note that misses either is left out."""
    return notes.join(patients, "subject_id").join(admissions, ["subject_id", "hadm_id"])


def first_note(notes: DataFrame, by: tuple[str, ...] = ("hadm_id",)) -> DataFrame:
    """Per key the first discharge summary, else the first note, by row_id: a grouped minimum, combined before the shuffle."""
    summary = F.coalesce(F.contains(F.lower("category"), F.lit("discharge summary")), F.lit(False))
    return notes.groupBy(*by).agg(F.min_by(F.struct("row_id", "text"), F.struct(~summary, "row_id")).alias("_n")).select(*by, F.col("_n.row_id").alias("row_id"), F.col("_n.text").alias("text"))


def safe_component(name: Column) -> Column:
    """A name that can be part of a path: its safe characters, 72 at most, and eight digits of its hash."""
    text = name.cast("string")
    clean = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    short = F.substring(clean, 1, 72)
    return F.concat(F.when(short == "", "case").otherwise(short), F.lit("-"), F.substring(F.sha2(text, 256), 1, 8))


def judged(values: dict[str, Column]) -> tuple[Column, Column]:
    """(score, decision) of the older judge: a weighted sum cut to 0 to 1, realistic from the threshold on."""
    total = F.lit(0.0)
    for name, weight in JUDGE.items():
        total = total + weight * values[name]
    score = F.when(total.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return score, F.when(score >= REALISTIC, "REALISTIC").when(score.isNotNull(), "UNREALISTIC")


def symptoms_for_turn(symptoms: Column, mentioned: Column, turn: Column) -> Column:
    """What a patient may bring up at a turn: of the symptoms not mentioned yet one up to turn 2, two up to 5, then three."""
    pressing = lambda s: F.contains(s, F.lit("pain")) | F.contains(s, F.lit("hurt")) | F.contains(s, F.lit("breath")) | F.contains(s, F.lit("chest"))
    low = F.filter(F.transform(symptoms, lambda s: F.lower(F.trim(s))), lambda s: s != "")
    ordered = F.concat(F.filter(low, pressing), F.filter(low, lambda s: ~pressing(s)))
    left = F.filter(ordered, lambda s: ~F.array_contains(mentioned, s))
    return F.slice(left, 1, F.when(turn <= 2, 1).when(turn <= 5, 2).otherwise(3))


def _listed(items: Column, sep: str) -> Column:
    kept = F.filter(items, lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(F.coalesce(F.size(kept) > 0, F.lit(False)), F.array_join(kept, sep)).otherwise(F.lit(UNSPECIFIED))


def diagnoses_text(diagnoses: Column) -> Column:
    """``primary (notes); primary``: what isn't provided stays out."""
    return _listed(F.transform(diagnoses, lambda d: F.when(F.coalesce(d["notes"], F.lit("")).isin("", MISSING), d["primary"]).when(d["primary"] != "", F.concat(d["primary"], F.lit(" ("), d["notes"], F.lit(")")))), "; ")


def treatments_text(treatments: Column) -> Column:
    """Procedure, treatment and names of medications of each treatment, joined by semicolons; treatments by bars."""
    given = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", MISSING), c)

    def one(t: Column) -> Column:
        names = F.filter(F.transform(t["medications"], lambda m: m["name"]), lambda n: F.coalesce(n != "", F.lit(False)))
        medications = F.when(F.size(names) > 0, F.concat(F.lit("medications: "), F.array_join(names, ", ")))
        return F.array_join(F.array_compact(F.array(given(t["procedure"]), given(t["treatment"]), medications)), "; ")

    return _listed(F.transform(treatments, one), " | ")


def profile_statistics(records: DataFrame) -> DataFrame:
    """Per profile type: successes, failures, realistic ones and others among the successes, and their mean judge score."""
    ok, real = F.coalesce(F.col("success"), F.lit(False)), F.coalesce(F.col("is_realistic"), F.lit(False))
    return records.groupBy(F.coalesce("profile_type", F.lit("UNKNOWN")).alias("profile_type")).agg(
        F.count_if(ok).alias("success"), F.count_if(~ok).alias("fail"), F.count_if(ok & real).alias("realistic"), F.count_if(ok & ~real).alias("non_realistic"), F.avg(F.when(ok, F.col("judge_score"))).alias("avg_judge_score")
    )


def variant_counts(attempts: DataFrame) -> DataFrame:
    """Per variant how many attempts end in an acceptance, as the notebook counts: whatever ends with ACCEPT."""
    hit = F.coalesce(F.endswith(F.upper("acceptance"), F.lit("ACCEPT")), F.lit(False))
    return attempts.groupBy(F.coalesce("variant", F.lit("?")).alias("variant")).agg(F.count_if(hit).alias("accepted"), F.count(F.lit(1)).alias("total"))


def measured_mean(df: DataFrame, value: str = "value") -> float:
    """The mean of what was measured; raises where nothing was."""
    found = df.agg(F.avg(value).alias("m")).first()["m"]
    if found is None:
        raise ValueError("no measured value to average")
    return found
