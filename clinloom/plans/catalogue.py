"""The query catalogue: Spark plans by name, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.functions import icd9, stats
from clinloom.functions import text as tx
from clinloom.operators import attempts as at
from clinloom.operators import cohort, corpus, decomposition, dialogue, discriminate, evaluation, faults, intervals, knowledge, matching, retention, statistics, studies
from clinloom.plans import proxies as px
from clinloom.plans import records
from clinloom.plans.oracle import ORACLE_SQL
from clinloom.sources.tables import load

QUERIES: dict = {}
__all__ = ["ORACLE_SQL", "QUERIES"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c, name: str | None = None):
    """Rounded to six places: sums may differ in the last bit between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def r12(name: str):
    """An interval's number to twelve places: of 2,000 draws many are ties at six, which engines round either way."""
    return F.round(name, 12).alias(name)


# --- cohort -----------------------------------------------------------------


@query
def cohort_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = px.candidates(spark, d)
    unknown = F.col("icu_days") == float("inf")
    return c.select(
        "hadm_id", "subject_id", "age", "has_icu", unknown.alias("icu_unknown"), r6(F.when(~unknown, F.col("icu_days")), "icu_days"),
        "charlson", "high_acuity", "n_codes", "ventilated", r6("stay"), "note_chars",
    )


@query
def cohort_exclusion_flow(spark: SparkSession, d: str) -> DataFrame:
    return cohort.exclusion_flow(px.evaluated(spark, d))


@query
def cohort_audit_status(spark: SparkSession, d: str) -> DataFrame:
    e = px.evaluated(spark, d)
    return e.select("hadm_id", "subject_id", F.array_join("fired", ",").alias("fired"), F.when(F.size("fired") == 0, "eligible").otherwise("excluded").alias("status"))


@query
def cohort_selected_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluated admission's status once twenty eligible ones are sampled."""
    e = px.evaluated(spark, d)
    a = cohort.audit(e, cohort.select_cases(e, 20, "snapshot", "20260914"))
    return a.select("hadm_id", "subject_id", F.array_join("fired", ",").alias("fired"), "status")


@query
def lenient_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as a text extract has them, read leniently; what can't be read is named."""
    a = px.admissions(spark, d)
    k = F.col("hadm_id")
    words = F.element_at(F.array(*map(F.lit, (" True", "f", "1", "No", "0", "maybe"))), (k % 6 + 1).cast("int"))
    listed = F.when(k % 4 == 0, F.lit("{}")).otherwise(F.concat(F.lit("{"), (k % 900).cast("string"), F.lit(', "'), (F.col("subject_id") % 900).cast("string"), F.lit('"}')))
    at = F.when(k % 89 == 0, "soon").otherwise(F.date_format("admittime", "yyyy-MM-dd"))
    raw = a.select(
        F.col("subject_id").cast("string").alias("subject_id"), k.cast("string").alias("hadm_id"), at.alias("admittime"), F.lit("2020-01-01T10:00:00").alias("dischtime"), F.lit("40.5").alias("age_years"),
        F.lit("URGENT").alias("admission_type"), words.alias("has_icu_stay"), F.lit("0").alias("hospital_expire_flag"), listed.alias("procedure_icd9_codes"), F.lit(None).cast("string").alias("diagnosis_icd9_codes"),
        F.lit("note").alias("note_text"), F.lit("Discharge summary").alias("note_category"),
    )
    c = cohort.parsed_candidates(raw)
    return c.select("hadm_id", "subject_id", "has_icu_stay", F.date_format("admittime", "yyyy-MM-dd").alias("admitted"), F.array_join("procedure_icd9_codes", "|").alias("codes"), F.coalesce("reason", F.lit("")).alias("reason"))


@query
def cohort_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    s = cohort.hash_sample(px.admissions(spark, d).select("subject_id", "hadm_id"), 100, "snapshot", "20260914")
    return s.select("selection_rank", "subject_id", "hadm_id", "sample_key")


@query
def cohort_first_admission(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's first admission by (time, id): a grouped minimum, combined before the shuffle."""
    a = px.admissions(spark, d)
    return a.groupBy("subject_id").agg(F.min_by("hadm_id", F.struct("admittime", "hadm_id")).alias("hadm_id"), F.count(F.lit(1)).alias("n_admissions"))


@query
def cohort_malformed(spark: SparkSession, d: str) -> DataFrame:
    c = px.admissions(spark, d).join(px.patients(spark, d), "subject_id")
    c = c.withColumn("age", cohort.full_years(F.col("dob"), F.to_date("admittime")))
    return c.select(cohort.malformed_reason().alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def cohort_selected_semi(spark: SparkSession, d: str) -> DataFrame:
    picked = cohort.hash_sample(px.admissions(spark, d).select("subject_id", "hadm_id"), 500, "snapshot", "1").select("hadm_id")
    return px.diagnoses(spark, d).join(picked, "hadm_id", "left_semi").groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    done = px.diagnoses(spark, d).select("hadm_id").distinct()
    return px.admissions(spark, d).select("hadm_id", "subject_id").join(done, "hadm_id", "left_anti")


@query
def full_outer_case_counts(spark: SparkSession, d: str) -> DataFrame:
    a = px.icu_stays(spark, d).groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n_left"))
    b = px.procedures(spark, d).groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n_right"))
    j = a.join(b, "hadm_id", "full_outer")
    return j.agg(
        F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("n_left").isNotNull() & F.col("n_right").isNotNull()).alias("n_both"),
        F.count_if(F.col("n_right").isNull()).alias("only_left"), F.count_if(F.col("n_left").isNull()).alias("only_right"),
    )


@query
def icu_days_null_poison(spark: SparkSession, d: str) -> DataFrame:
    t = cohort.icu_totals(px.icu_stays(spark, d))
    unknown = F.col("icu_days") == float("inf")
    return t.select("hadm_id", unknown.alias("icu_unknown"), r6(F.when(~unknown, F.col("icu_days")), "icu_days"))


@query
def codes_distinct_by_hadm(spark: SparkSession, d: str) -> DataFrame:
    return cohort.distinct_codes(px.diagnoses(spark, d)).select("hadm_id", F.array_join("codes", ",").alias("codes"), F.size("codes").cast("long").alias("n_codes"))


@query
def charlson_score(spark: SparkSession, d: str) -> DataFrame:
    return cohort.diagnosis_flags(px.diagnoses(spark, d)).select("hadm_id", "charlson")


@query
def high_acuity_flag(spark: SparkSession, d: str) -> DataFrame:
    c = icd9.normalise(F.col("code"))
    return px.diagnoses(spark, d).select(c.alias("code")).distinct().select("code", icd9.is_high_acuity(F.col("code")).alias("high_acuity"), icd9.category(F.col("code")).alias("category"))


@query
def demographics_left(spark: SparkSession, d: str) -> DataFrame:
    a = px.admissions(spark, d).join(px.patients(spark, d), "subject_id", "left")
    return a.select("hadm_id", F.coalesce("segment", F.lit("not provided")).alias("segment"), F.coalesce(F.date_format("dob", "yyyy-MM-dd"), F.lit("not provided")).alias("dob"))


@query
def notes_concat_ordered(spark: SparkSession, d: str) -> DataFrame:
    n = cohort.concatenated_notes(px.notes(spark, d))
    return n.select("hadm_id", "longest_row", F.col("n_notes").cast("long").alias("n_notes"), F.md5(F.col("note_text").cast("binary")).alias("text_md5"))


@query
def note_top1(spark: SparkSession, d: str) -> DataFrame:
    """The newest note of each group; rank = 1 lets the window keep one row a task before the shuffle."""
    w = Window.partitionBy("hadm_id").orderBy(F.col("chartdate").desc_nulls_last(), F.col("row_id").desc())
    n = px.notes(spark, d).where("lower(category) = 'discharge summary'").select("hadm_id", "row_id", "chartdate")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("hadm_id", "row_id", F.date_format("chartdate", "yyyy-MM-dd").alias("chartdate"))


# --- attempts ---------------------------------------------------------------


@query
def attempts_final_first_accepted(spark: SparkSession, d: str) -> DataFrame:
    f = at.final_first_accepted(px.attempts(spark, d), ["case_id", "policy", "variant"])
    return f.select("case_id", "policy", "variant", "attempt_index", "acceptance", r6("value"))


@query
def attempts_final_max_index(spark: SparkSession, d: str) -> DataFrame:
    f = at.final_max_index(px.attempts(spark, d).drop("ts"), ["case_id", "variant"])
    return f.select("case_id", "variant", "attempt_index", "acceptance", r6("value"))


@query
def attempts_summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    s = at.summary(at.final_first_accepted(px.attempts(spark, d), ["case_id", "policy", "variant"]))
    return s.select(F.coalesce("variant", F.lit("*")).alias("variant"), F.coalesce("policy", F.lit("*")).alias("policy"), "finals", "n_accepted", "n_incomplete", r6("mean_value"), r6("acceptance_rate"))


@query
def acceptance_wilson(spark: SparkSession, d: str) -> DataFrame:
    a = at.acceptance_rates(at.final_max_index(px.attempts(spark, d), ["case_id", "variant"]), ["variant"])
    return a.select("variant", "n_accepted", "n_total", r6("rate"), r6("low"), r6("high"))


@query
def incomplete_rates(spark: SparkSession, d: str) -> DataFrame:
    r = at.incomplete_rates(at.final_max_index(px.attempts(spark, d), ["case_id", "variant"]), ["variant"])
    return r.select("variant", "n_incomplete", "n_total", r6("rate"))


@query
def cost_by_variant(spark: SparkSession, d: str) -> DataFrame:
    c = at.costs(px.attempts(spark, d), ["variant"], 3.0, 15.0)
    return c.select("variant", "attempts", "calls", "prompt_tokens", "completion_tokens", "wall_ms", r6("estimated_cost"))


def _dimensions():
    k = F.col("attempt_index")
    shifted = lambda n: F.when(k % (11 + n) != 0, F.least(F.lit(1.0), F.col("raw") / (60 + 10 * n)))
    return {name: shifted(i) for i, name in enumerate(at.THRESHOLDS)}


@query
def score_gate_decide(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.col("event_id").alias("attempt_index"), F.col("value").alias("raw"))
    values = _dimensions()
    return e.select("attempt_index", at.decide(values).alias("decision"), at.composite(values).alias("composite"))


@query
def json_scores_explode(spark: SparkSession, d: str) -> DataFrame:
    """Scores by dimension out of a JSON map, summarised a dimension."""
    e = load(spark, d, "events")
    k = F.from_json("props", "map<string, double>")["k"]
    scores = F.create_map(F.lit("first"), F.when(F.col("event_id") % 11 != 0, k / 100), F.lit("second"), F.when(F.col("event_id") % 13 != 0, 1 - k / 100))
    long = e.select(F.explode(scores).alias("dimension", "value"))
    s = at.dimension_summary(long, F.lit(0.8))
    return s.select("dimension", "measured", "incomplete", "passed", "failed", r6("mean_value"))


@query
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    a = px.attempts(spark, d).select("case_id", "variant", "attempt_index", "value")
    old = at.final_max_index(a.where("attempt_index % 2 = 0"), ["case_id", "variant"])
    new = at.final_max_index(a.where("attempt_index % 2 = 1"), ["case_id", "variant"])
    return at.latest(new, old, ["case_id", "variant"]).select("case_id", "variant", "attempt_index", r6("value"))


@query
def best_scoring_attempt(spark: SparkSession, d: str) -> DataFrame:
    a = px.attempts(spark, d).where("value > 0")
    best = a.groupBy("case_id").agg(F.max_by(F.struct("attempt_index", "value"), F.struct(F.round("value", 6), -F.col("attempt_index"))).alias("b"))
    return best.select("case_id", F.col("b.attempt_index").alias("attempt_index"), r6(F.col("b.value"), "value"))


# --- statistics -------------------------------------------------------------


def _case_values(spark: SparkSession, d: str) -> DataFrame:
    """The last measured value of every (case, policy, variant)."""
    a = px.attempts(spark, d)
    return a.groupBy("variant", "policy", "case_id").agg(F.max_by("value", "attempt_index").alias("value"))


@query
def e0_curves(spark: SparkSession, d: str) -> DataFrame:
    v = _case_values(spark, d)
    g = v.groupBy("variant", "policy").agg(F.count("value").alias("n_cases"), F.count_if(F.col("value").isNull()).alias("n_incomplete"), F.avg("value").alias("mean_value"))
    return g.select("variant", "policy", "n_cases", "n_incomplete", r6("mean_value"))


@query
def e0_paired(spark: SparkSession, d: str) -> DataFrame:
    v = _case_values(spark, d)
    value = lambda p: F.max(F.when(F.col("policy") == p, F.col("value")))
    arms = v.groupBy("variant", "case_id").agg(value("P0").alias("a"), value("P2").alias("b"))
    diff = F.col("a") - F.col("b")
    g = arms.groupBy("variant").agg(F.count(diff).alias("n_cases"), F.count_if(diff.isNull()).alias("n_dropped"), F.avg(diff).alias("mean_difference"))
    return g.select("variant", "n_cases", "n_dropped", r6("mean_difference"))


@query
def paired_difference_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    value = lambda p: F.max(F.when(F.col("policy") == p, F.col("value")))
    arms = _case_values(spark, d).groupBy("variant", "case_id").agg((value("P0") - value("P2")).alias("value"))
    b = statistics.bootstrap(statistics.clusters(arms, ["variant"]), ["variant"], 2000, "7")
    return b.select("variant", "cases", r12("estimate"), r12("low"), r12("high"))


@query
def mersenne_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    v = _case_values(spark, d)
    return statistics.mersenne_bootstrap(v, ["variant"]).select("variant", "cases", r6("estimate"), r6("low"), r6("high"))


@query
def sign_flip_exact(spark: SparkSession, d: str) -> DataFrame:
    """Over twelve sites, the groups of cases that an exact test can enumerate."""
    v = _case_values(spark, d).groupBy((F.col("case_id") % 12).alias("case_id"), "policy").agg(F.avg("value").alias("value"))
    s = statistics.sign_flip_exact(statistics.paired(v, "policy", "P0", "P2"))
    return s.select("n_cases", r6("observed"), r6("p_value"))


@query
def sign_flip_paired(spark: SparkSession, d: str) -> DataFrame:
    """Over all paired cases; by Monte Carlo where there are more than twenty."""
    v = _case_values(spark, d).groupBy("case_id", "policy").agg(F.avg("value").alias("value"))
    s = statistics.sign_flip(statistics.paired(v, "policy", "P0", "P2"))
    return s.select("n_cases", r6("observed"), r6("p_value"))


def _pvalues(spark: SparkSession, d: str) -> DataFrame:
    p = F.conv(F.substring(F.sha2(F.concat_ws("|", "variant", "policy"), 256), 1, 4), 16, 10).cast("double") / 65536
    return _case_values(spark, d).select("variant", "policy").distinct().select(F.concat_ws("/", "variant", "policy").alias("label"), (p / 10).alias("p_value"))


@query
def holm_bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    return statistics.adjusted(_pvalues(spark, d)).select("label", r6("p_value"), r6("holm"), r6("bh"))


@query
def power_derivation(spark: SparkSession, d: str) -> DataFrame:
    """Sample sizes from the spread of paired differences, one row a variant."""
    v = _case_values(spark, d)
    value = lambda p: F.max(F.when(F.col("policy") == p, F.col("value")))
    arms = v.groupBy("variant", "case_id").agg(value("P0").alias("a"), value("P1").alias("b"))
    diff = F.col("a") - F.col("b")
    spread = arms.groupBy("variant").agg(F.count(diff).alias("pilot_n"), F.stddev_samp(diff).alias("sd")).where("sd is not null")
    complete_80, total_80 = stats.required(F.col("sd"), 0.05, 0.8, incomplete=0.1)
    complete_90, total_90 = stats.required(F.col("sd"), 0.05, 0.9, incomplete=0.1)
    return spread.select("variant", "pilot_n", r6("sd", "paired_sd"), complete_80.alias("complete_80"), total_80.alias("total_80"), complete_90.alias("complete_90"), total_90.alias("total_90"))


#: By which values are multiplied, a metric each: with many digits, so that no mean is a rounding's exact half.
FACTORS = (0.9864863, 0.8901573, 0.8107183, 0.7442893, 0.6879113)


def _long_scores(spark: SparkSession, d: str) -> DataFrame:
    """Five metrics of every final attempt, of which each is missing now and then."""
    f = at.final_max_index(px.attempts(spark, d).drop("ts"), ["case_id", "variant"])
    k, shifted = F.col("attempt_index"), F.map_from_arrays(F.array(*map(F.lit, at.THRESHOLDS)), F.array(*[F.when(F.col("attempt_index") % (11 + i) != 0, F.col("value") * factor) for i, factor in enumerate(FACTORS)]))
    return f.where(k.isNotNull()).select("variant", "policy", "case_id", F.explode(shifted).alias("metric", "value"))


@query
def study_score_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every (variant, policy, metric) with its pooled mean, its interval, and what was not measured."""
    r = intervals.score_rows(_long_scores(spark, d), seed="3")
    return r.select("variant", "policy", "metric", r12("estimate"), r12("low"), r12("high"), "method", "n_cases", "n_scores", "n_incomplete")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues under three policies, both reference modes and both dimensions, from events."""
    e, k = px.attempts(spark, d), F.col("attempt_index")
    policy = F.element_at(F.array(*map(F.lit, decomposition.POLICIES)), (F.substring("policy", 2, 1).cast("int") + 1))
    mode = F.element_at(F.array(*map(F.lit, decomposition.MODES)), (k % 2 + 1).cast("int"))
    both = F.map_from_arrays(F.array(F.lit(decomposition.PATIENT), F.lit(decomposition.DOCTOR)), F.array(F.col("value"), F.when(k % 7 != 0, F.col("value") * 0.9)))
    return e.select("case_id", k.alias("dialogue_id"), policy.alias("policy"), mode.alias("mode"), F.explode(both).alias("dimension", "value"))


@query
def trend_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Reference scope, turn scope and gradient: paired differences of cells."""
    c = decomposition.compared(_scored(spark, d), seed="5")
    return c.select("section", "key", "n_cases", "n_dropped", r12("estimate"), r12("low"), r12("high"), "excludes_zero")


# --- dialogues --------------------------------------------------------------


@query
def structural_violations(spark: SparkSession, d: str) -> DataFrame:
    v = dialogue.violations(px.turns(spark, d), unicode=False)
    return v.select("dialogue_id", "check", F.coalesce("index", F.lit(-1)).alias("turn_index"))


@query
def structural_score(spark: SparkSession, d: str) -> DataFrame:
    t = px.turns(spark, d)
    return dialogue.structural_score(t, dialogue.violations(t, unicode=False))


@query
def symptom_repetition_last6(spark: SparkSession, d: str) -> DataFrame:
    """With words that occur in the synthetic dialogues in place of symptoms."""
    return dialogue.repeated_symptoms(px.turns(spark, d), ("the", "la", "der", "que", "and"))


@query
def opening_repetition(spark: SparkSession, d: str) -> DataFrame:
    o = dialogue.repetitive_openings(px.turns(spark, d), above=0.1, least=1)
    return o.select("dialogue_id", "index", F.size(F.split("opening", " ")).cast("long").alias("n_words"), F.col("alike").cast("long").alias("alike"), "repetitive")


@query
def loop_detection(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.loops(px.turns(spark, d), 4)


@query
def dialogue_stats(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.dialogue_stats(px.turns(spark, d))


@query
def confusion_streak(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.confusion_streak(px.turns(spark, d), F.length("text") % 3 == 0)


@query
def transcript_render(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.render(px.turns(spark, d))
    return r.select("dialogue_id", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


# --- texts, knowledge -------------------------------------------------------

TERMS = ("the", "of the", "und", "que", "license")


@query
def redact_terms(spark: SparkSession, d: str) -> DataFrame:
    text, n = tx.redact(F.col("text"), TERMS, unicode=False)
    return load(spark, d, "documents").select("doc_id", n.cast("long").alias("n_redacted"), F.md5(text.cast("binary")).alias("text_md5"))


LIGHT, HEAVY = ("license", "the", "der"), ("idiot", "stupid")


@query
def light_case_filter(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    hit = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("low"), w))
    seen = load(spark, d, "documents").select("doc_id", low.alias("low"))
    reason = F.when(F.size(hit(HEAVY)) > 0, F.concat(F.lit("excluded: "), F.array_join(hit(HEAVY), ","))).when(F.size(hit(LIGHT)) > 0, F.concat(F.lit("included: "), F.array_join(hit(LIGHT), ","))).otherwise("no term")
    return seen.select("doc_id", reason.alias("reason")).withColumn("passed", F.startswith("reason", F.lit("included")))


@query
def evidence_audit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    start, end = (k % 50).cast("int"), (k % 50 + k % 9 * 5).cast("int")
    quoted = F.when(k % 4 == 0, F.lit("elsewhere")).otherwise(F.substr("text", start + 1, F.greatest(F.lit(0), end - start)))
    e = load(spark, d, "documents").select("doc_id", knowledge.span_error(F.col("text"), start, end, quoted).alias("error"))
    return e.groupBy(F.coalesce("error", F.lit("sound")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """A nested reference for each order: demographics, diagnoses, treatments, medications."""
    items = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = load(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    named = items.join(parts, items.l_partkey == parts.p_partkey)
    lists = named.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("p_name").alias("primary"), F.concat(F.lit("seen with "), "p_brand").alias("notes")))).alias("diagnoses"),
        F.array_sort(F.collect_list(F.struct(F.col("p_brand").alias("name"), F.col("l_suppkey").cast("string").alias("dosage")))).alias("medications"),
    )
    o = load(spark, d, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"))
    core = F.struct("diagnoses", F.array(F.struct(F.lit("procedure").alias("procedure"), F.col("medications"))).alias("treatments"))
    context = F.struct(F.struct(F.col("o_orderpriority").alias("admission_type"), F.year("o_orderdate").alias("year")).alias("demographics"), F.col("medications").alias("current_medications"))
    additional = F.struct(F.concat(F.lit("comes with "), F.col("diagnoses")[0]["primary"]).alias("chief_complaint"))
    return o.select(F.col("o_orderkey").alias("case_id"), F.struct(core.alias("core"), context.alias("context"), additional.alias("additional")).alias("reference"))


STRICT = knowledge.Policy("NO_DIAGNOSIS", "2.0", frozenset({"core.treatments[].procedure", "context.demographics", "additional.chief_complaint"}), frozenset({"context.demographics"}), frozenset({"additional.chief_complaint"}))


@query
def scr_mask_policy(spark: SparkSession, d: str) -> DataFrame:
    m = knowledge.mask(_references(spark, d), "reference", STRICT, "Patient", ("red", "blue", "ring"), unicode=False)
    return m.select("case_id", "view.context.demographics.*", F.col("view.additional.chief_complaint").alias("chief_complaint"), F.size("view.core.treatments").cast("long").alias("n_treatments"))


@query
def leakable_paths(spark: SparkSession, d: str) -> DataFrame:
    kind = _references(spark, d).schema["reference"].dataType
    rows = [(role, p) for role in ("Patient", "Doctor") for p in knowledge.leakable(kind, STRICT.visible(role))]
    return spark.createDataFrame(rows, "role string, path string")


# --- matching ---------------------------------------------------------------

RULES = matching.Matcher(
    ("lowercase", "strip_punctuation", "collapse_whitespace", "apply_synonyms", "drop_stopwords", "collapse_whitespace"),
    ("exact_code", "exact_description", "category_3digit", "description_overlap"),
    {"synonyms": {"ring": "gear", "hot": "red"}, "stopwords": ("small", "the")},
    0.6,
    False,
)


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(extracted, coded) entities of cases; a case is a run of twenty parts."""
    few = load(spark, d, "part")
    case = F.expr("p_partkey div 20").alias("case_id")
    left = few.where("p_size % 2 = 0").select(case, F.col("p_partkey").alias("extracted"), F.upper(F.col("p_name")).alias("e_text"), F.lpad((F.col("p_partkey") * 37 % 1000).cast("string"), 4, "4").alias("e_code"))
    right = few.where("p_size % 2 = 1").select(case, F.col("p_partkey").alias("coded"), F.concat("p_name", F.lit(", the")).alias("c_text"), F.lpad((F.col("p_partkey") * 41 % 1000).cast("string"), 4, "4").alias("c_code"))
    return left, right


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    left, right = _entities(spark, d)
    # Each text is normalised once, before it meets its candidates.
    j = RULES.normalise(left, "e_text", "e").join(RULES.normalise(right, "c_text", "c"), "case_id")
    level, score = RULES.compare("e", "c", "e_code", "c_code")
    return j.select("case_id", "extracted", "coded", level.alias("granularity"), score.alias("score"))


@query
def matcher_normalise(spark: SparkSession, d: str) -> DataFrame:
    n = RULES.normalise(load(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" -- "), "p_type").alias("t")), "t", "normal")
    return n.select("p_partkey", "normal", F.array_join("normal_trace", ",").alias("trace"))


@query
def matcher_best(spark: SparkSession, d: str) -> DataFrame:
    best = matching.best_candidate(_pairs(spark, d), ["case_id", "extracted"], "coded")
    return best.select("case_id", "extracted", "coded", "granularity", r6("score"))


@query
def dice_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", tx.tokens(F.lower(F.concat_ws(" ", "p_name", "p_type"))).alias("t"))
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    return j.select(F.col("a.p_partkey").alias("p_partkey"), r6(tx.dice(F.col("a.t"), F.col("b.t")), "dice"), r6(tx.jaccard(F.col("a.t"), F.col("b.t"), 1.0), "jaccard"))


@query
def entity_assignment(spark: SparkSession, d: str) -> DataFrame:
    left, right = _entities(spark, d)
    assigned = matching.assign(_pairs(spark, d), ["case_id"])
    g = matching.grounding_counts(left, right, assigned, ["case_id"])
    return g.select("case_id", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "lineitem")
    return i.select(F.expr("l_orderkey div 10").alias("case_id"), (F.col("l_linenumber") % 3).alias("rater"), (F.col("l_partkey") % 40).alias("entity"))


@query
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    a = statistics.agreement(_ratings(spark, d), 3)
    return a.select("n_units", r6("observed"), r6("expected"), r6("kappa"))


@query
def pairwise_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return statistics.pairwise_jaccard(_ratings(spark, d)).select("n_pairs", r6("mean_jaccard"))


def _detector(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars")
    j = docs.join(load(spark, d, "labels"), "doc_id")
    score = F.floor(F.col("n_chars") / 100) / 100
    return j.select("doc_id", F.col("lang").alias("fault"), (F.col("toxic") == 1).alias("is_corrupted"), score.alias("score"), (score >= 0.2).alias("predicted"))


@query
def detector_confusion(spark: SparkSession, d: str) -> DataFrame:
    c = statistics.confusion(_detector(spark, d), ["fault"])
    return c.select("fault", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"))


@query
def detector_auc(spark: SparkSession, d: str) -> DataFrame:
    return statistics.auc(_detector(spark, d), ["fault"]).select("fault", "positives", "negatives", r6("auc"))


@query
def detector_intervals(spark: SparkSession, d: str) -> DataFrame:
    """With fifty cases a language and turns named by the id: precision to localisation, over resampled cases."""
    k = F.col("doc_id")
    o = _detector(spark, d).select("fault", (k % 50).alias("case_id"), "is_corrupted", "predicted", "score", (k % 7).alias("truth_turn"), F.array(k % 3, k % 5).alias("predicted_turns"))
    i = intervals.detector_intervals(o, ["fault"], seed="9")
    return i.select("fault", "metric", r12("estimate"), r12("low"), r12("high"))


@query
def grounding_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the assignment over cases, with intervals."""
    left, right = _entities(spark, d)
    g = matching.grounding_counts(left, right, matching.assign(_pairs(spark, d), ["case_id"]), ["case_id"])
    return intervals.count_intervals(g.withColumn("field", F.lit("diagnoses")), ["field"], seed="2").select("field", "metric", r12("estimate"), r12("low"), r12("high"))


@query
def granularity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Assigned pairs by how closely they match."""
    return matching.assign(_pairs(spark, d), ["case_id"]).groupBy("granularity").agg(F.count(F.lit(1)).alias("n"))


@query
def fault_injection(spark: SparkSession, d: str) -> DataFrame:
    t = px.turns(spark, d)
    named = [f for f, role, _ in faults.FAULTS if role]
    labels = t.select("dialogue_id").distinct().select("dialogue_id", F.explode(F.array(*map(F.lit, named))).alias("fault"), F.concat(F.lit("case "), F.col("dialogue_id").cast("string")).alias("label"))
    return faults.recovered(faults.inject(t, labels, "11"))


@query
def policy_discriminability(spark: SparkSession, d: str) -> DataFrame:
    """With languages for policies: all words and pairs of the training side, held-out accuracy and AUC."""
    docs = load(spark, d, "documents").select((F.col("doc_id") % 200).alias("case_id"), F.col("lang").alias("policy"), "text")
    return discriminate.discriminate(docs).by_policy.select("policy", "n", "n_correct", r6("accuracy"), r6("auc"), "n_policies")


@query
def score_defects(spark: SparkSession, d: str) -> DataFrame:
    """Scores that break a rule, by rule."""
    e, k = load(spark, d, "events"), F.col("event_id")
    value = F.when(k % 5 != 0, F.col("value") / 50)
    status = F.when(k % 4 == 0, "INCOMPLETE").when(k % 9 == 0, "unknown").otherwise("pass")
    found = e.select(evaluation.score_defect(value, status, F.when(k % 3 == 0, "no claims")).alias("defect"))
    return found.groupBy(F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count(F.lit(1)).alias("n"))


@query
def leakage_events(spark: SparkSession, d: str) -> DataFrame:
    """Leakage events looked up in transcripts and among the reference's paths."""
    t = px.turns(spark, d)
    kind = _references(spark, d).schema["reference"].dataType
    paths = spark.createDataFrame([(role, p, knowledge.permitted(p, STRICT.visible(role))) for role in ("Patient", "Doctor") for p in knowledge.paths(kind)], "role string, path string, permitted boolean")
    k, i = F.col("dialogue_id"), F.col("index")
    path = F.element_at(F.array(F.lit("core.diagnoses"), F.lit(" context.demographics "), F.lit("core.nothing")), ((k + i) % 3 + 1).cast("int"))
    said = F.coalesce(tx.role(F.col("role")), F.lit("Doctor"))
    events = t.select(k, F.when(k % 2 == 0, "Patient").otherwise(said).alias("role"), F.when(i % 4 == 3, i + 1000).otherwise(i).alias("turn_index"), path.alias("field_path"))
    j = evaluation.judged_events(events, t.select("dialogue_id", "index", said.alias("role")), paths)
    return j.groupBy("role", F.coalesce("defect", F.lit("")).alias("defect"), "leak").agg(F.count(F.lit(1)).alias("n"))


@query
def unevidenced_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of references whose evidence doesn't hold in their notes."""
    k = F.col("doc_id")
    notes = load(spark, d, "documents").select(k.alias("case_id"), F.lit("n1").alias("note_id"), F.col("text").alias("note"))
    span = lambda start, text, note="n1": F.struct(F.lit(note).alias("note_id"), F.lit(start).alias("char_start"), (F.lit(start) + F.length(text)).alias("char_end"), text.alias("text"))
    sound, wrong = span(2, F.substring("text", 3, 6)), span(1, F.substring("text", 9, 4))
    entity = lambda *spans: F.struct(F.lit("x").alias("name"), F.array(*spans).alias("evidence"))
    bare = F.struct(F.lit("x").alias("name"), F.array().cast("array<struct<note_id: string, char_start: int, char_end: int, text: string>>").alias("evidence"))
    core = F.struct(F.array(entity(sound), entity(wrong), entity(wrong, sound), bare).alias("diagnoses"), F.array(entity(span(0, F.substring("text", 1, 3), "n2"))).alias("symptoms"))
    refs = load(spark, d, "documents").select(k.alias("case_id"), F.struct(core.alias("core")).alias("reference"), "text")
    u = knowledge.unevidenced(knowledge.evidenced(refs, "case_id", "reference"), notes, "case_id")
    return u.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query
def policy_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The three views of each reference and what was redacted in the patient's."""
    c = knowledge.contexts(_references(spark, d), "reference", STRICT, ("red", "blue", "ring"), unicode=False)
    return c.select("case_id", "policy", F.col("redactions").cast("long").alias("redactions"), F.col("patient.additional.chief_complaint").alias("patient_sees"), F.col("doctor.context.demographics.admission_type").alias("doctor_sees"), F.col("evaluator.additional.chief_complaint").alias("evaluator_sees"))


@query
def retention_by_policy(spark: SparkSession, d: str) -> DataFrame:
    """With sizes of parts for policies: what of the coded entities was extracted, with intervals."""
    left, right = _entities(spark, d)
    policies = spark.createDataFrame([("FULL", 1), ("NO_DIAGNOSIS", 3)], "policy string, keep int")
    some = left.crossJoin(F.broadcast(policies)).where("extracted % keep = 0").select("policy", "case_id", "extracted")
    coded = right.crossJoin(F.broadcast(policies.select("policy"))).select("policy", "case_id", "coded")
    pairs = _pairs(spark, d).join(some, ["case_id", "extracted"]).select("policy", "case_id", "extracted", "coded", "granularity", "score")
    cases = coded.select("policy", "case_id").distinct().withColumn("extractor", F.lit("family-b")).withColumn("generators", F.array(F.lit("family-a")))
    return retention.retention(cases, some, coded, pairs, seed="4").select("policy", "metric", r12("estimate"), r12("low"), r12("high"))


@query
def claims_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Claims and verdicts parsed from fenced JSON responses, aligned and scored."""
    t = px.turns(spark, d)
    patient = t.where(tx.role(F.col("role")) == "Patient")
    item = F.struct(F.col("index").alias("turn_index"), F.lit("Patient").alias("role"), F.when(F.col("index") % 3 == 2, "question").otherwise("patient_fact").alias("type"), F.substring("text", 1, 20).alias("text"))
    said = patient.groupBy("dialogue_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    said = said.select("dialogue_id", F.concat(F.lit("Here:\n```json\n"), F.to_json("c"), F.lit("\n```")).alias("response"), F.size("c").alias("n"))
    claims, _ = evaluation.parsed(said, "response", evaluation.CLAIMS, "dialogue_id", "claim_index")
    verdict = F.expr("transform(sequence(0, n - 1), i -> named_struct('claim_index', i, 'verdict', case (dialogue_id + i) % 4 when 0 then 'unsupported' when 1 then 'unverifiable' else 'supported' end))")
    answers = said.select("dialogue_id", F.to_json(verdict).alias("response"))
    verdicts, _ = evaluation.parsed(answers, "response", evaluation.VERDICTS, "dialogue_id", "_i")
    f = evaluation.faithfulness(claims, verdicts, t, "Patient")
    return f.select("dialogue_id", "claims", "supported", "unsupported", "unverifiable", r6("score"), F.coalesce("incomplete_reason", F.lit("")).alias("incomplete_reason"))


# --- studies ----------------------------------------------------------------


@query
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.col("event_id").alias("attempt_index"), F.col("value").alias("raw"))
    failed = F.array_compact(F.array(*[F.when(v < at.THRESHOLDS[n], n) for n, v in _dimensions().items()]))
    plan = studies.repair_plan(e.select(F.col("attempt_index").alias("case_id"), F.posexplode(failed).alias("position", "dimension")))
    listed = F.array_join(F.transform("actions", lambda a: F.concat(a["dimension"], F.lit(" -> "), F.array_join(a["targets"], "+"))), "; ")
    directives = F.array_join(F.transform("actions", lambda a: a["directive"]), "\n")
    return plan.select("case_id", F.size("actions").cast("long").alias("n_steps"), listed.alias("plan"), F.md5(directives.cast("binary")).alias("directives_md5"), "repair_version")


@query
def attempt_seeds(spark: SparkSession, d: str) -> DataFrame:
    a = px.attempts(spark, d).where("attempt_index >= 1")
    return a.select("attempt_index", studies.attempt_seed(F.lit(20260914), F.col("case_id"), F.concat("policy", F.lit("@"), "variant"), F.col("attempt_index")).alias("seed"))


@query
def judge_legacy(spark: SparkSession, d: str) -> DataFrame:
    t = px.turns(spark, d).withColumn("patient", F.coalesce(tx.role(F.col("role")) == "Patient", F.lit(False)))
    answers = t.where("patient and index > 1").select("dialogue_id", F.when((F.col("dialogue_id") + F.col("index")) % 3 == 0, "no").otherwise("Yes").alias("answer"))
    j = studies.judge_answers(t, answers)
    return j.select("dialogue_id", "patient_turns", "statements", "yes", r6("score"))


@query
def policy_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Every dialogue under every policy and reference mode: six rows are broadcast."""
    grid = spark.createDataFrame([(p, m) for p in ("FULL", "NO_DIAGNOSIS", "NO_DIAGNOSIS_NO_TREATMENT") for m in ("full_ref", "policy_ctx")], "policy string, mode string")
    t = px.turns(spark, d).groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("turns"))
    return t.crossJoin(F.broadcast(grid))


@query
def matrix_missing_cells(spark: SparkSession, d: str) -> DataFrame:
    return studies.missing_cells(px.attempts(spark, d).where("acceptance = 'ACCEPT'"), "case_id", "variant")


@query
def case_coverage(spark: SparkSession, d: str) -> DataFrame:
    return studies.coverage(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id")


@query
def condition_last_wins(spark: SparkSession, d: str) -> DataFrame:
    a = px.attempts(spark, d).where("value is not null")
    return studies.last_wins(a, ["variant", "policy", "case_id"], "attempt_index").select("variant", "policy", "case_id", r6("value"))


@query
def matcher_error_rate(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    k = F.col("p_partkey")
    e = p.select("p_type", F.when(k % 5 != 0, k).alias("expected"), F.when(k % 7 != 0, F.when(k % 11 == 0, k + 1).otherwise(k)).alias("matched"))
    return studies.matcher_errors(e, ["p_type"])


@query
def light_case_reorder(spark: SparkSession, d: str) -> DataFrame:
    """The fifty first documents, those with a licence line before the others."""
    seen = load(spark, d, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("licensed")).alias("light"))
    return studies.reordered(seen, F.col("light"), "doc_id", 50).select("place", "doc_id", "passed")


@query
def dialogue_phases(spark: SparkSession, d: str) -> DataFrame:
    t = px.turns(spark, d).where(tx.role(F.col("role")) == "Doctor")
    turn = F.row_number().over(Window.partitionBy("dialogue_id").orderBy("index"))
    return t.select(turn.alias("turn")).groupBy(studies.phase(F.col("turn")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query
def conversation_checks(spark: SparkSession, d: str) -> DataFrame:
    return studies.conversation_checks(px.turns(spark, d))


@query
def patient_moods(spark: SparkSession, d: str) -> DataFrame:
    t = px.turns(spark, d).where(tx.role(F.col("role")) == "Patient")
    return t.groupBy(studies.mood(F.col("text")).alias("mood")).agg(F.count(F.lit(1)).alias("n"))


@query
def token_totals_by_policy(spark: SparkSession, d: str) -> DataFrame:
    return px.attempts(spark, d).groupBy("policy").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


@query
def reference_entity_totals(spark: SparkSession, d: str) -> DataFrame:
    r = _references(spark, d)
    n = lambda c: F.sum(F.size(c).cast("long"))
    return r.agg(F.count(F.lit(1)).alias("n_references"), n("reference.core.diagnoses").alias("n_diagnoses"), n("reference.context.current_medications").alias("n_medications"))


@query
def diagnosis_term_index(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(knowledge.diagnosis_terms(F.concat_ws(", ", "p_name", "p_type"))), "|").alias("terms"))


@query
def case_split_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select((F.col("doc_id") % 200).alias("case_id"), "lang")
    return discriminate.case_split(docs).groupBy("lang", "test").agg(F.count(F.lit(1)).alias("n"))


# --- corpus -----------------------------------------------------------------


@query
def first_note(spark: SparkSession, d: str) -> DataFrame:
    n = corpus.first_note(px.notes(spark, d))
    return n.select("hadm_id", "row_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def note_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Notes with their patient's and admission's columns."""
    subject = F.when(F.col("hadm_id") % 7 == 0, F.col("subject_id") + 1).otherwise(F.col("subject_id"))
    n = px.admissions(spark, d).select(F.col("hadm_id").alias("row_id"), subject.alias("subject_id"), "hadm_id")
    j = corpus.note_lookup(n, px.patients(spark, d), px.admissions(spark, d))
    return j.select("row_id", "subject_id", "hadm_id", "segment", "admission_type")


@query
def safe_components(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.select("p_partkey", corpus.safe_component(F.concat(F.lit(" ."), "p_name", F.lit("/"), "p_type", F.lit("-"))).alias("component"))


@query
def judge_weighted(spark: SparkSession, d: str) -> DataFrame:
    e, k = load(spark, d, "events"), F.col("event_id")
    raw = {n: F.when(k % (17 + i) != 0, F.col("value") / (70 + 7 * i)) for i, n in enumerate(corpus.JUDGE)}
    score, decision = corpus.judged(raw)
    return e.select("event_id", score.alias("score"), decision.alias("decision"))


@query
def variant_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return corpus.variant_counts(px.attempts(spark, d))


@query
def profile_statistics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("attempt_index")
    r = px.attempts(spark, d).select(F.when(k % 19 != 0, F.col("policy")).alias("profile_type"), (F.col("acceptance") != "REJECT").alias("success"), F.when(k % 3 != 0, F.col("value") >= 0.5).alias("is_realistic"), F.col("value").alias("judge_score"))
    return corpus.profile_statistics(r).select("profile_type", "success", "fail", "realistic", "non_realistic", r6("avg_judge_score"))


@query
def profile_texts(spark: SparkSession, d: str) -> DataFrame:
    """Diagnoses and treatments of references as the older prompts' text."""
    r = _references(spark, d).select("case_id", "reference.core.*")
    treatments = F.transform("treatments", lambda t: F.struct(t["procedure"].alias("procedure"), F.lit("not provided").alias("treatment"), t["medications"].alias("medications")))
    return r.select("case_id", F.md5(corpus.diagnoses_text(F.col("diagnoses")).cast("binary")).alias("diagnoses_md5"), F.md5(corpus.treatments_text(treatments).cast("binary")).alias("treatments_md5"))


# --- records: see the module of that name -------------------------------------

QUERIES |= records.QUERIES
ORACLE_SQL |= records.ORACLE_SQL
