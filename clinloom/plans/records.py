"""Queries over extracts, references by path, quotations, responses and dialogues' progress, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.functions import profiles, responses
from clinloom.operators import attempts, evaluation, knowledge, paths, progress, quotes, variety
from clinloom.plans import proxies as px
from clinloom.plans.oracle import BASE
from clinloom.session import scratch_root
from clinloom.sources import extract, scored
from clinloom.sources.tables import load
from clinloom.streaming.log import AttemptLog

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def extract_scan(spark: SparkSession, d: str) -> DataFrame:
    """Admissions read through the Data Source: two columns, with conditions on two others that never leave the scan."""
    where = [("o_orderstatus", "=", "F"), ("o_orderdate", ">=", "1994-01-01"), ("o_orderpriority", "not in", ["5-LOW", "3-MEDIUM"])]
    orders = extract.read_table(spark, "orders", ["o_custkey", "o_orderpriority"], where, path=d)
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("admissions"), F.count_distinct("o_custkey").alias("subjects"))


TERMS = ("red", "blue", "ring")
DROPPED = ("core.diagnoses[].notes", "core.treatments[].medications[].dosage", "context.demographics.year", "context.current_medications")
REDACTED = ("core.diagnoses[].primary", "additional")


def _references(spark: SparkSession, d: str) -> DataFrame:
    from clinloom.plans.catalogue import _references as made

    return made(spark, d)


@query
def path_values(spark: SparkSession, d: str) -> DataFrame:
    """Per case: values at paths through one and two lists, and at one without."""
    r, c = _references(spark, d), F.col("reference")
    kind = r.schema["reference"].dataType
    joined = lambda p: F.md5(F.array_join(F.array_sort(paths.resolve(c, kind, p)), "|").cast("binary"))
    return r.select("case_id", joined("core.diagnoses[].primary").alias("diagnoses_md5"), joined("core.treatments[].medications[].name").alias("medications_md5"), paths.resolve(c, kind, "context.demographics.year").cast("long").alias("year"))


@query
def path_removals(spark: SparkSession, d: str) -> DataFrame:
    """A row a (case, path): how many values were removed there, with what is left of the diagnoses."""
    r = paths.drop_paths(_references(spark, d), "reference", DROPPED)
    left = F.array_sort(F.transform("reference.core.diagnoses", lambda x: F.to_json(x)))
    return r.select("case_id", F.explode("removed").alias("path", "removed"), F.md5(F.array_join(left, "|").cast("binary")).alias("left_md5"))


@query
def path_redactions(spark: SparkSession, d: str) -> DataFrame:
    """A row a (case, path): how many terms were replaced there, and the diagnoses afterwards."""
    r = paths.redact_paths(_references(spark, d), "reference", REDACTED, TERMS, unicode=False)
    after = F.array_join(F.array_sort(F.transform("reference.core.diagnoses", lambda x: x["primary"])), "|")
    return r.select("case_id", F.explode("redactions").alias("path", "redactions"), F.md5(after.cast("binary")).alias("diagnoses_md5"), F.col("reference.additional.chief_complaint").alias("chief_complaint"))


@query
def quote_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Three quotations of each document: at a wrong place, with other white space, and one that isn't there."""
    n = load(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.lit("n").alias("note_id"), F.coalesce("text", F.lit("")).alias("note"))
    one, two = F.substring("note", 11, 25), F.regexp_replace(F.substring("note", 21, 40), "[ \\t\\r\\n]+", "  \n ")
    spans = n.select("case_id", "note_id", F.posexplode(F.array(one, two, F.concat(F.substring("note", 1, 5), F.lit("#never#")), one)).alias("k", "text"))
    spans = spans.select("case_id", "note_id", F.col("k").cast("string").alias("path"), F.when(F.col("k") == 3, 10).otherwise(3).alias("char_start"), F.when(F.col("k") == 3, F.length("text") + 10).otherwise(9).alias("char_end"), "text")
    return quotes.repair_offsets(spans, n, "case_id").select("case_id", "path", "char_start", "char_end", "status")


_RESPONSES = (
    "'```json\n{\"v\": ' || v || ', \"w\": [1, 2]}\n```'", "'Here is the JSON: {\"v\": ' || v || ', \"w\": [1, 2,], }'", "'{\"v\": ' || v || ', \"w\": 3'", "'see ```\nno json\n``` and ```json\n{\"w\": \"}\", \"v\": ' || v || '}\n``` end'",
    "'\"v\": ' || v || ', \"w\": 2}'", "'no object, ' || v", "'{}'", "'[{\"v\": ' || v || '}]'",
)


@query
def response_objects(spark: SparkSession, d: str) -> DataFrame:
    """Responses in eight shapes, from fenced to broken: the value that is read, how, and why not."""
    e = load(spark, d, "events").selectExpr("event_id", "cast(event_id % 1000 as string) as v", "event_id % 9 as shape")
    text = "case shape " + " ".join(f"when {k} then {x.replace(chr(10), chr(92) + 'n')}" for k, x in enumerate(_RESPONSES)) + " end"
    r = e.select("event_id", F.expr(text).alias("response")).select("event_id", responses.object_of(spark, F.col("response")).alias("r"))
    return r.select("event_id", F.get_json_object("r.json", "$.v").cast("long").alias("v"), "r.how", F.coalesce("r.defect", F.lit("")).alias("defect"))


#: Words that the proxies' texts have, in place of a clinic's.
PROGRESS = progress.Rules(
    full=False, conclusion=("reat", "inst"), reasoning=("the",), confusion=("edan", "haer"), no_more=("rened. ",), inquiries=("and",), doctor_phrases=("^an", "the"), patient_phrases=("^th", "er"), rounds=9, worn=1,
)


@query
def dialogue_progress(spark: SparkSession, d: str) -> DataFrame:
    """Every turn up to its dialogue's end: conclusion, exchanges, streak, worn phrases, and why it ends."""
    p = progress.progress(px.turns(spark, d), PROGRESS)
    return p.select("dialogue_id", F.col("index").cast("long").alias("index"), "concluded", "exchanges", "streak", "worn", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"), "ended")


@query
def log_resume(spark: SparkSession, d: str) -> DataFrame:
    """Attempts appended to a log in two batches that overlap, and the next attempt of every case that is still open."""
    a = px.attempts(spark, d).select("case_id", "attempt_index", "acceptance")
    run = AttemptLog(spark, f"{scratch_root(spark)}/log-{uuid.uuid4().hex}", {"full_hash": "query"}, buckets=16)
    run.append(a.where("attempt_index % 3 < 2"), "1")
    run.append(a.where("attempt_index % 3 > 0"), "2")
    return run.open_cases(a, (F.col("acceptance") == "ACCEPT") & (F.col("attempt_index") % 7 == 0), 90)


@query
def condition_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per variant and policy: attempts, cases, terminal failures, and what a case costs."""
    s = attempts.condition_summary(px.attempts(spark, d), ["variant", "policy"], 3.0, 15.0)
    return s.select("variant", "policy", "attempts", "cases", "accepted_cases", "terminal_failures", "calls", "wall_ms", "acceptance_rate", "attempts_per_case", "estimated_cost", "cost_per_case")


@query
def boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    """1 for a dialogue without a leakage event: here, a turn that names what its role may not know."""
    t = px.turns(spark, d)
    events = t.where(F.contains("text", F.lit("reat")) & (F.col("index") % 2 == 1)).select("dialogue_id")
    return evaluation.boundary(t, events)


@query
def reference_evidence_totals(spark: SparkSession, d: str) -> DataFrame:
    """Of references made from documents: empty cores, entities by kind, and the share that no span supports."""
    n = load(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.coalesce("text", F.lit("")).alias("note"))
    k = F.col("case_id")
    span = lambda a, b: F.struct(F.lit("n").alias("note_id"), F.lit(a).alias("char_start"), F.lit(b).alias("char_end"), F.substring("note", a + 1, 4).alias("text"))
    item = lambda *spans: F.struct(F.array(*spans).alias("evidence"))
    none = F.array(item(span(0, 4))).cast("array<struct<evidence: array<struct<note_id: string, char_start: int, char_end: int, text: string>>>>")
    core = F.struct(F.when(k % 5 == 0, F.slice(none, 1, 0)).otherwise(F.array(item(span(0, 4)), item(span(2, 7)))).alias("symptoms"), F.when(k % 10 == 0, F.slice(none, 1, 0)).otherwise(F.array(item(span(3, 7), span(0, 99)))).alias("diagnoses"))
    refs = n.select("case_id", F.struct(core.alias("core")).alias("reference"))
    t = knowledge.reference_totals(refs, "case_id", "reference", n.select("case_id", F.lit("n").alias("note_id"), "note"))
    return t.select("references", "empty_cores", "entities", "symptoms", "diagnoses", "unevidenced", "unevidenced_share")


_CALLS = (
    "'[]'", "concat('[{\"prompt_tokens\": ', p, ', \"completion_tokens\": ', c, ', \"latency_ms\": 12}]')",
    "concat('[{\"input_tokens\": ', p, ', \"output_tokens\": ', c, ', \"latency_ms\": 5, \"estimated_cost\": 0.25}, {\"prompt_tokens\": 7}]')", "concat('[{\"prompt_tokens\": null, \"input_tokens\": ', p, ', \"latency_ms\": null}]')",
)


@query
def attempt_call_costs(spark: SparkSession, d: str) -> DataFrame:
    """Per event type: what attempts cost by their recorded calls, whose fields have two names, or by what is supplied in their place."""
    e = load(spark, d, "events").selectExpr("event_type", "event_id % 4 as shape", "event_id % 5 = 0 as given", "event_id % 1000 as p", "event_id % 300 as c")
    calls = F.expr("case shape " + " ".join(f"when {k} then {x}" for k, x in enumerate(_CALLS)) + " end")
    cost = attempts.call_costs(calls, F.expr("if(given, concat('{\"calls\": 9, \"prompt_tokens\": ', c, '}'), null)"))
    each = e.select(F.col("event_type").alias("variant"), cost.alias("cost")).select("variant", "cost.*")
    return each.groupBy("variant").agg(F.count(F.lit(1)).alias("attempts"), *[F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens", "wall_ms", "estimated_cost")])


_WHO = '"provenance": {"scorer_id": "s", "model_family": "f", "model_id": "m", "model_digest": "d", "quantisation": "q", "reference_mode": null, "turn_scope": "all", "prompt_version": "1"}'
_SCORED = (
    f"""'"full_reference", "scores": {{"x": {{"value": 0.' || v || ', "status": "pass", {_WHO}}}}}}}'""", f"""'"full_reference", "scores": {{"x": {{"value": 1.' || v || '1, "status": "pass", {_WHO}}}}}}}'""",
    """'"full_reference", "scores": {"x": {"value": 0.' || v || ', "status": "pass"}}}'""", """'"full_reference", "scores": {'""", """'"other", "scores": {}}'""", f"""'"policy_context", "scores": {{"x": {{"value": null, "status": "incomplete", {_WHO}}}}}}}'""",
)


@query
def score_line_defects(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scored dialogues, five of six damaged: how many have which defect, and the mean of the sound scores."""
    e = load(spark, d, "events").selectExpr("event_id", "event_id % 6 as shape", "cast(event_id % 90 + 10 as string) as v")
    rest = F.expr("case shape " + " ".join(f"when {k} then {x}" for k, x in enumerate(_SCORED)) + " end")
    head = F.concat(F.lit('{"dialogue_id": "'), F.col("event_id").cast("string"), F.lit('", "case_id": "c", "policy": "P@1", "reference_mode": '), rest)
    rows = scored.scores(e.select(F.lit("events").alias("file"), head.alias("value")))
    sound = F.avg(F.when(F.col("defect").isNull(), F.col("score.value")))
    return rows.groupBy(F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count(F.lit(1)).alias("n"), F.round(sound, 9).alias("mean_value"))


@query
def legacy_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Patients' views in the older writing, nulls as empty defaults, and their lists as the prompts' text."""
    sex, has = F.when(F.col("doc_id") % 3 != 0, F.lit("F")), F.col("doc_id") % 5 != 0
    person = F.when(F.col("doc_id") % 7 != 0, F.struct((F.col("doc_id") % 90).cast("string").alias("age"), sex.alias("sex")))
    context = F.struct(person.alias("patient_demographics"), F.when(has, F.array("lang", "source")).alias("allergies"))
    core = F.struct(F.array(F.struct(F.col("lang").alias("description"), sex.alias("severity")), F.struct(F.substring("text", 1, 9).alias("description"), sex.alias("severity"))).alias("symptoms"))
    r = load(spark, d, "documents").select("doc_id", F.struct(context.alias("context"), core.alias("core")).alias("r"))
    p = r.select("doc_id", "r", profiles.legacy(F.col("r"), r.schema["r"].dataType, "NO_DIAGNOSIS", "2.0").alias("p"))
    shown = F.md5(profiles.symptoms(F.col("r.core.symptoms"), named=True).cast("binary"))
    return p.select("doc_id", "p.profile_type", profiles.demographics(F.col("r.context.patient_demographics")).alias("demographics"), profiles.allergies(F.col("r.context.allergies")).alias("allergies"), shown.alias("symptoms_md5"),
        F.col("p.Context.Patient_Demographics.Sex").alias("sex"), F.size("p.Context.Allergies").cast("long").alias("n_allergies"), F.col("p.Core.Symptoms")[0]["Severity"].alias("severity"))


SAID = variety.Phrases(("I see", "Right"), ("That's hard",), ("Now",), ("Um...", "Well...", "Uh..."), ("Yes,",), ("Maybe,", "Perhaps,"), weights={"hesitations": (6.0, 3.0, 1.0)})


@query
def turn_variety(spark: SparkSession, d: str) -> DataFrame:
    """What each turn gets said before it, and the habits drawn for it."""
    t = px.turns(spark, d).withColumn("uncertain", F.col("index") % 3 == 1).withColumn("term", F.col("index") % 2 == 1)
    return variety.varied(t, "q", SAID).select("dialogue_id", F.col("index").cast("long").alias("index"), "prefix", F.md5(F.col("response").cast("binary")).alias("response_md5"), "filler", "clarify")


def _draw(slot: str) -> str:
    return f"('0x' || substr(sha256('q|' || dialogue_id || '|' || index || '|{slot}'), 1, 13))::BIGINT"


def _chosen(slot: str, phrases, weights=None) -> str:
    """SQL for a choice: the alias table's places and thresholds as lists."""
    keep, alias = variety.alias_table(weights or [1.0] * len(phrases))
    product, listed = f"({_draw(slot)} * {len(phrases)})", "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in phrases) + "]"
    at = f"(({product} >> 52) + 1)"
    return f"({listed})[CASE WHEN {product} & {variety.WHOLE - 1} < ({keep})[{at}] THEN {at} ELSE ({alias})[{at}] + 1 END]"


def _happens(slot: str, probability: str) -> str:
    return f"{_draw(slot)} < floor(({probability})::DOUBLE * {variety.WHOLE})::BIGINT"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_ITEMS = "i AS (SELECT l_orderkey AS case_id, p_name, p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey)"
_TERM = "'(?i)\\b(?:blue|ring|red)\\b'"
_R = PROGRESS

ORACLE_SQL = {
    "extract_scan": "SELECT o_orderpriority, count(*) AS admissions, count(DISTINCT o_custkey) AS subjects FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= '1994-01-01' AND o_orderpriority NOT IN ('5-LOW', '3-MEDIUM') GROUP BY 1",
    "condition_summary": f"""WITH {BASE}, c AS (SELECT variant, policy, case_id, count(*) AS n, bool_or(acceptance = 'ACCEPT') AS ok, sum(calls) AS calls, sum(prompt_tokens) AS p, sum(completion_tokens) AS q, sum(wall_ms) AS w FROM attempts GROUP BY ALL)
SELECT variant, policy, sum(n)::BIGINT AS attempts, count(*) AS cases, count(*) FILTER (ok) AS accepted_cases, count(*) FILTER (NOT ok) AS terminal_failures, sum(calls)::BIGINT AS calls, sum(w)::BIGINT AS wall_ms, count(*) FILTER (ok) / count(*) AS acceptance_rate, sum(n)::DOUBLE / count(*) AS attempts_per_case,
 (sum(p)::DOUBLE * 3.0::DOUBLE + sum(q)::DOUBLE * 15.0::DOUBLE) / 1e6 AS estimated_cost, (sum(p)::DOUBLE * 3.0::DOUBLE + sum(q)::DOUBLE * 15.0::DOUBLE) / 1e6 / count(*) AS cost_per_case FROM c GROUP BY ALL""",
    "boundary_scores": f"WITH {BASE} SELECT dialogue_id, count(*) FILTER (contains(text, 'reat') AND index % 2 = 1) AS events, (count(*) FILTER (contains(text, 'reat') AND index % 2 = 1) = 0)::INTEGER::DOUBLE AS score FROM turns GROUP BY 1",
    "reference_evidence_totals": """WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents),
c AS (SELECT k, k % 5 <> 0 AS s, k % 10 <> 0 AS g, length(t) >= 4 AS first, length(t) >= 7 AS third FROM d),
n AS (SELECT count(*) AS refs, count(*) FILTER (NOT s AND NOT g) AS empty, 2 * count(*) FILTER (s) AS sy, count(*) FILTER (g) AS di, count(*) FILTER (s AND NOT first) + count(*) FILTER (s) + count(*) FILTER (g AND NOT third) AS bad FROM c)
SELECT refs AS "references", empty AS empty_cores, sy + di AS entities, sy AS symptoms, di AS diagnoses, bad AS unevidenced, bad / (sy + di) AS unevidenced_share FROM n""",
    "attempt_call_costs": """WITH e AS (SELECT event_type AS variant, event_id % 4 AS shape, event_id % 5 = 0 AS given, event_id % 1000 AS p, event_id % 300 AS c FROM events)
SELECT variant, count(*) AS attempts, sum(CASE WHEN given THEN 9 WHEN shape = 0 THEN 0 WHEN shape = 2 THEN 2 ELSE 1 END)::BIGINT AS calls, sum(CASE WHEN given THEN c WHEN shape = 1 THEN p WHEN shape = 2 THEN p + 7 ELSE 0 END)::BIGINT AS prompt_tokens,
 sum(CASE WHEN shape IN (1, 2) THEN c ELSE 0 END)::BIGINT AS completion_tokens, sum(CASE shape WHEN 1 THEN 12 WHEN 2 THEN 5 ELSE 0 END)::BIGINT AS wall_ms, sum(CASE WHEN shape = 2 THEN 0.25::DOUBLE ELSE 0 END) AS estimated_cost FROM e GROUP BY 1""",
    "score_line_defects": """SELECT CASE event_id % 6 WHEN 0 THEN 'sound' WHEN 1 THEN 'bad score ''x'': a value outside 0 to 1' WHEN 2 THEN 'bad score ''x'': fields are missing: provenance' WHEN 3 THEN 'not valid JSON' WHEN 4 THEN 'unknown reference mode'
 ELSE 'bad score ''x'': an incomplete score has no reason' END AS defect, count(*) AS n, round(avg(CASE WHEN event_id % 6 = 0 THEN ('0.' || (event_id % 90 + 10))::DOUBLE END), 9) AS mean_value FROM events GROUP BY 1""",
    "legacy_profiles": """WITH p AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN 'F' END AS sex FROM documents)
SELECT doc_id, 'NO_DIAGNOSIS' AS profile_type, CASE WHEN doc_id % 7 = 0 THEN 'Not specified in profile.' ELSE 'Age: ' || (doc_id % 90) || ', Sex: ' || coalesce(sex, 'N/A') END AS demographics,
 CASE WHEN doc_id % 5 = 0 OR (nullif(lang, '') IS NULL AND nullif(source, '') IS NULL) THEN 'None known or not specified in profile.' ELSE concat_ws(', ', nullif(lang, ''), nullif(source, '')) END AS allergies,
 md5(coalesce(nullif(concat_ws('; ', nullif(lang, ''), nullif(substr(text, 1, 9), '')), ''), 'No specific symptoms listed in profile to discuss.')) AS symptoms_md5,
 CASE WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(sex, '') END AS sex, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS n_allergies, coalesce(sex, '') AS severity FROM p""",
    "turn_variety": f"""WITH {BASE}, t AS (SELECT *, index % 3 = 1 AS u FROM turns),
p AS (SELECT dialogue_id, index, text, concat_ws(' ', CASE WHEN who = 'Patient' AND {_happens("hesitate", "CASE WHEN u THEN 0.7 ELSE 0.4 END")} THEN {_chosen("hesitations", SAID.hesitations, SAID.weights["hesitations"])} END, CASE WHEN who = 'Patient' AND u THEN {_chosen("uncertain", SAID.uncertain)} END,
 CASE WHEN who = 'Doctor' AND NOT {_happens("silent", "0.3")} THEN {_chosen("acknowledgments", SAID.acknowledgments)} || '.' END, CASE WHEN who = 'Doctor' AND u THEN 'That''s hard.' END, CASE WHEN who = 'Doctor' AND index % 4 = 0 THEN 'Now' END) AS prefix,
 coalesce(who = 'Patient', false) AND {_happens("filler", "greatest(0.2::DOUBLE, 0.5::DOUBLE - index * 0.03::DOUBLE)")} AS filler, index % 2 = 1 AND index >= 3 AND {_happens("clarify", "0.3")} AS clarify FROM t)
SELECT dialogue_id, index, prefix, md5(trim(concat_ws(' ', nullif(prefix, ''), coalesce(text, '')), ' ')) AS response_md5, filler, clarify FROM p""",
    "log_resume": f"""WITH {BASE} SELECT case_id, count(*) AS attempts, count(*) + 1 AS next_attempt FROM attempts GROUP BY 1 HAVING count(*) < 90 AND NOT bool_or(acceptance = 'ACCEPT' AND attempt_index % 7 = 0)""",
    "path_values": f"WITH {_ITEMS} SELECT case_id, md5(string_agg(p_name, '|' ORDER BY p_name)) AS diagnoses_md5, md5(string_agg(p_brand, '|' ORDER BY p_brand)) AS medications_md5, any_value(year(o_orderdate)) AS year FROM i JOIN orders ON o_orderkey = case_id GROUP BY 1",
    "path_removals": f"""WITH {_ITEMS}, c AS (SELECT case_id, count(*) AS n, md5(string_agg('{{"primary":"' || p_name || '"}}', '|' ORDER BY '{{"primary":"' || p_name || '"}}')) AS left_md5 FROM i GROUP BY 1)
SELECT case_id, path, CASE WHEN path LIKE 'context%' THEN 1 ELSE n END AS removed, left_md5 FROM c, (VALUES {', '.join(f"('{p}')" for p in DROPPED)}) AS p(path)""",
    "path_redactions": f"""WITH {_ITEMS}, c AS (SELECT case_id, sum(len(regexp_extract_all(p_name, {_TERM})))::BIGINT AS n, md5(string_agg(regexp_replace(p_name, {_TERM}, '[REDACTED]', 'g'), '|' ORDER BY regexp_replace(p_name, {_TERM}, '[REDACTED]', 'g'))) AS diagnoses_md5, 'comes with ' || min(p_name) AS chief FROM i GROUP BY 1)
SELECT case_id, path, CASE WHEN path = 'additional' THEN len(regexp_extract_all(chief, {_TERM})) ELSE n END AS redactions, diagnoses_md5, regexp_replace(chief, {_TERM}, '[REDACTED]', 'g') AS chief_complaint FROM c, (VALUES {', '.join(f"('{p}')" for p in REDACTED)}) AS p(path)""",
    "quote_offsets": r"""WITH n AS (SELECT doc_id AS case_id, coalesce(text, '') AS note FROM documents),
q AS (SELECT case_id, note, unnest([0, 1, 2, 3]) AS k, unnest([substr(note, 11, 25), regexp_replace(substr(note, 21, 40), '[ \t\r\n]+', e'  \n ', 'g'), substr(note, 1, 5) || '#never#', substr(note, 11, 25)]) AS text FROM n),
m AS (SELECT *, CASE WHEN text <> '' AND instr(note, text) > 0 THEN text WHEN regexp_matches(text, '\S') THEN nullif(regexp_extract(note, regexp_replace(regexp_replace(regexp_replace(text, '([!-/:-@\[-`{-~])', '\\\1', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '\\s+', 'g')), '') END AS hit,
 text <> '' AND CASE WHEN k = 3 THEN substr(note, 11, length(text)) ELSE substr(note, 4, 6) END = text AS sound FROM q)
SELECT case_id, k::VARCHAR AS path, CASE WHEN sound THEN CASE WHEN k = 3 THEN 10 ELSE 3 END WHEN hit IS NOT NULL THEN instr(note, hit) - 1 END AS char_start, CASE WHEN sound THEN CASE WHEN k = 3 THEN 10 + length(text) ELSE 9 END WHEN hit IS NOT NULL THEN instr(note, hit) - 1 + length(hit) END AS char_end,
 CASE WHEN sound THEN 'sound' WHEN hit IS NOT NULL THEN 'moved' ELSE 'absent' END AS status FROM m""",
    "response_objects": """SELECT event_id, CASE WHEN event_id % 9 IN (0, 1, 2, 3, 4, 7) THEN event_id % 1000 END AS v,
 CASE event_id % 9 WHEN 0 THEN 'as it is' WHEN 1 THEN 'cleaned' WHEN 2 THEN 'closed' WHEN 3 THEN 'as it is' WHEN 4 THEN 'closed' WHEN 7 THEN 'as it is' ELSE '' END AS how,
 CASE event_id % 9 WHEN 5 THEN 'no JSON object' WHEN 6 THEN 'empty object' WHEN 8 THEN 'empty response' ELSE '' END AS defect FROM events""",
    "dialogue_progress": f"""WITH {BASE}, f AS (SELECT dialogue_id, index, who, lower(coalesce(text, '')) AS low, coalesce(text, '') AS t FROM turns WHERE who IS NOT NULL),
g AS (SELECT *, length(trim(t, e' \\n\\t\\r')) >= 10 AND NOT contains(t, '[ERROR:') AS valid, {_any('low', _R.conclusion)} AND (len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) > {_R.long_words} OR {_any('low', _R.reasoning)}) AS concl,
 {_any('low', _R.inquiries)} AS inq, {_any('low', _R.confusion)} AS conf, {_any('low', _R.no_more)} AS done, substr(low, 1, 100) AS said, who = 'Doctor' AS doc, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY dialogue_id ORDER BY index)),
h AS (SELECT *, count(*) FILTER (doc AND inq) OVER w AS asked, count(*) FILTER (NOT doc) OVER w AS rounds FROM g WINDOW w AS (PARTITION BY dialogue_id ORDER BY index)),
c AS (SELECT *, min(CASE WHEN doc AND concl AND (n >= 6 AND asked >= {_R.questions} OR n >= {_R.long_turns}) THEN n END) OVER (PARTITION BY dialogue_id) AS mark FROM h),
s AS (SELECT *, coalesce(n > mark, false) AS post, sum(CASE WHEN n > mark AND NOT doc THEN CASE WHEN conf THEN 1 ELSE -1 END ELSE 0 END) OVER w AS sm, count(*) FILTER (n > mark AND NOT doc) OVER w AS exchanges,
 list({{'d': doc, 's': said}}) OVER (PARTITION BY dialogue_id ORDER BY index ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS l FROM c WINDOW w AS (PARTITION BY dialogue_id ORDER BY index)),
k AS (SELECT *, sm - least(0, min(sm) OVER w) AS streak, list_filter(l, lambda x: x.d) AS ld, list_filter(l, lambda x: NOT x.d) AS lp FROM s WINDOW w AS (PARTITION BY dialogue_id ORDER BY index)),
e AS (SELECT *, CASE WHEN NOT valid THEN 'invalid' WHEN NOT doc AND len(l) >= 6 AND (coalesce(ld[-1].s = ld[-2].s, false) OR coalesce(lp[-1].s = lp[-2].s, false) OR len(list_filter(ld, lambda x: regexp_matches(x.s, 'what|how|when|where|why|can you|could you'))) >= 3) THEN 'loop'
 WHEN post AND NOT doc AND done THEN 'no more questions' WHEN post AND NOT doc AND conf AND streak >= {_R.streak} THEN 'confused' WHEN post AND doc AND concl THEN 'concluded again' WHEN NOT doc AND rounds >= {_R.rounds} THEN 'rounds' ELSE '' END AS ended FROM k),
z AS (SELECT *, min(CASE WHEN ended <> '' THEN n END) OVER (PARTITION BY dialogue_id) AS last_n,
 CASE WHEN doc THEN regexp_matches(low, '{_R.doctor_phrases[0]}') ELSE regexp_matches(low, '{_R.patient_phrases[0]}') END AS h1, CASE WHEN doc THEN regexp_matches(low, '{_R.doctor_phrases[1]}') ELSE regexp_matches(low, '{_R.patient_phrases[1]}') END AS h2 FROM e),
y AS (SELECT *, count(*) FILTER (h1) OVER w AS c1, count(*) FILTER (h2) OVER w AS c2 FROM z WINDOW w AS (PARTITION BY dialogue_id, doc ORDER BY index))
SELECT dialogue_id, index, coalesce(n >= mark, false) AS concluded, exchanges, streak::BIGINT AS streak, (h1 AND c1 > {_R.worn})::BIGINT + (h2 AND c2 > {_R.worn})::BIGINT AS worn, c1 || ',' || c2 AS counts, ended FROM y WHERE last_n IS NULL OR n <= last_n""",
}
