"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

from statistics import NormalDist

from clinloom.functions import icd9
from clinloom.functions import text as tx
from clinloom.operators import corpus, decomposition, faults, studies
from clinloom.plans.proxies import SQL as BASE

_MASKS = ", ".join(f"bool_or({cond}) AS c{i}" for i, (_, cond) in enumerate(icd9.sql_conditions()))
_AT = {rule.name: i for i, rule in enumerate(icd9.CHARLSON)}
_MILD = {_AT[mild]: _AT[severe] for severe, mild in icd9.SUPERSEDES.items()}
_SCORE = " + ".join(f"CASE WHEN c{i}{f' AND NOT c{_MILD[i]}' if i in _MILD else ''} THEN {r.weight} ELSE 0 END" for i, r in enumerate(icd9.CHARLSON))
_NORMAL = "regexp_replace(upper(code), '[^A-Z0-9]', '', 'g')"
_AGE = "(year(admittime) - year(dob) - CASE WHEN month(admittime) * 100 + day(admittime) < month(dob) * 100 + day(dob) THEN 1 ELSE 0 END)"
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

COHORT = (
    BASE
    + f""",
icu AS (SELECT hadm_id, bool_or(los IS NULL) AS icu_unknown, sum(los) AS los FROM icu_stays GROUP BY 1),
dx AS (SELECT hadm_id, ({_SCORE})::INTEGER AS charlson, high_acuity, n_codes FROM (
  SELECT hadm_id, {_MASKS}, bool_or({icd9.sql_high_acuity()}) AS high_acuity, count(DISTINCT code) AS n_codes
  FROM (SELECT hadm_id, {_NORMAL} AS code FROM diagnoses) GROUP BY 1)),
vent AS (SELECT hadm_id, bool_or({_NORMAL} IN ('9670', '9671', '9672', '9604')) AS ventilated FROM procedures GROUP BY 1),
sizes AS (SELECT hadm_id, sum(length({_STRIP('text')}))::BIGINT AS note_chars FROM notes WHERE lower(trim(category)) = 'discharge summary' GROUP BY 1),
candidates AS (SELECT a.subject_id, a.hadm_id, admittime, dischtime, admission_type, expired, deathtime, {_AGE} AS age, icu.hadm_id IS NOT NULL AS has_icu,
  coalesce(icu_unknown, false) AS icu_unknown, coalesce(los, 0.0) AS icu_days, coalesce(charlson, 0) AS charlson, coalesce(high_acuity, false) AS high_acuity,
  coalesce(n_codes, 0) AS n_codes, coalesce(ventilated, false) AS ventilated, epoch_us(dischtime - admittime) / 86400000000.0 AS stay, coalesce(note_chars, 0) AS note_chars,
  note_chars IS NOT NULL AS noted
  FROM admissions a JOIN patients USING (subject_id) LEFT JOIN icu USING (hadm_id) LEFT JOIN dx USING (hadm_id) LEFT JOIN vent USING (hadm_id)
  LEFT JOIN sizes s ON a.hadm_id % 200 = s.hadm_id),
first AS (SELECT *, [x FOR x IN [CASE WHEN has_icu AND (icu_unknown OR icu_days >= 1) THEN 'E1' END, CASE WHEN expired OR deathtime IS NOT NULL THEN 'E2' END,
  CASE WHEN ventilated THEN 'E3' END, CASE WHEN lower(trim(admission_type)) IN ('newborn', 'neonatal') OR age < 12 THEN 'E4' END, CASE WHEN age >= 90 THEN 'E5' END,
  CASE WHEN high_acuity THEN 'E6' END, CASE WHEN stay > 7 THEN 'E7' END, CASE WHEN charlson > 2 THEN 'E8' END,
  CASE WHEN NOT noted OR note_chars < 500 THEN 'E9' END] IF x IS NOT NULL] AS fired0
  FROM candidates WHERE dischtime >= admittime AND age >= 0 AND subject_id > 0 AND hadm_id > 0),
evaluated AS (SELECT *, CASE WHEN len(fired0) = 0 AND row_number() OVER (PARTITION BY subject_id, len(fired0) = 0 ORDER BY admittime, hadm_id) > 1
  THEN ['E10'] ELSE fired0 END AS fired FROM first)
"""
)
FINAL1 = BASE + """, finals AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY case_id, policy, variant
  ORDER BY acceptance = 'ACCEPT' DESC, CASE WHEN acceptance = 'ACCEPT' THEN attempt_index ELSE -attempt_index END) = 1)"""
FINAL2 = BASE + """, finals AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY case_id, variant ORDER BY attempt_index DESC) = 1)"""
VALUES = BASE + """, vals AS (SELECT variant, policy, case_id, value FROM attempts QUALIFY row_number() OVER (PARTITION BY variant, policy, case_id ORDER BY attempt_index DESC) = 1)"""
_Z = 1.959963984540054
DIMS = ("patient_factuality", "doctor_factuality", "knowledge_boundary", "naturalness", "structural_validity")
_DIM_VALUES = ", ".join(f"CASE WHEN event_id % {11 + i} <> 0 THEN least(1.0, value / {60 + 10 * i}) END AS {n}" for i, n in enumerate(DIMS))
_LIMITS = dict(zip(DIMS, (0.80, 0.80, 1.0, 0.60, 1.0), strict=True))
_SENTINEL = "|".join(tx.SENTINELS)
_QUESTION = "what|how|when|where|why|can you|could you"

PAIRS = """
ents AS (SELECT *, p_partkey // 20 AS case_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '\\bring\\b', 'gear', 'g'), '\\bhot\\b', 'red', 'g'),
  '\\b(small|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS normal FROM part),
l AS (SELECT case_id, p_partkey AS extracted, normal, lpad((p_partkey * 37 % 1000)::VARCHAR, 4, '4') AS code FROM ents WHERE p_size % 2 = 0),
r AS (SELECT case_id, p_partkey AS coded, normal, lpad((p_partkey * 41 % 1000)::VARCHAR, 4, '4') AS code FROM ents WHERE p_size % 2 = 1),
scored AS (SELECT case_id, extracted, coded, l.code AS lc, r.code AS rc, l.normal AS ln, r.normal AS rn,
  CASE WHEN l.normal = '' OR r.normal = '' THEN 0.0 ELSE 2.0 * len(list_intersect(list_distinct(string_split(l.normal, ' ')), list_distinct(string_split(r.normal, ' '))))
    / (len(list_distinct(string_split(l.normal, ' '))) + len(list_distinct(string_split(r.normal, ' ')))) END AS share FROM l JOIN r USING (case_id)),
levels AS (SELECT *, CASE WHEN lc = rc THEN 'exact_code' WHEN ln <> '' AND ln = rn THEN 'exact_description' WHEN substr(lc, 1, 3) = substr(rc, 1, 3) THEN 'category_3digit'
  WHEN share >= 0.6 THEN 'description_overlap' ELSE 'none' END AS granularity FROM scored),
pairs AS (SELECT *, CASE WHEN granularity IN ('none', 'description_overlap') THEN share ELSE 1.0 END AS score,
  CASE granularity WHEN 'exact_code' THEN 4 WHEN 'exact_description' THEN 3 WHEN 'category_3digit' THEN 2 WHEN 'description_overlap' THEN 1 ELSE 0 END AS rk FROM levels)
"""
RATINGS = "r AS (SELECT DISTINCT l_orderkey // 10 AS case_id, l_linenumber % 3 AS rater, l_partkey % 40 AS entity FROM lineitem)"
DETECTOR = """det AS (SELECT d.doc_id, d.lang AS fault, toxic = 1 AS is_corrupted, floor(n_chars / 100.0) / 100 AS score, floor(n_chars / 100.0) / 100 >= 0.2 AS predicted
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
REFS = """items AS (SELECT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
refs AS (SELECT l_orderkey, min(p_name) AS top FROM items GROUP BY 1)"""


def _any(text: str, words) -> str:
    """SQL for whether a text holds one of the words."""
    return " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words)


def _opening() -> str:
    words = "[x FOR x IN regexp_split_to_array(lower(trim(string_split(regexp_replace(text, '\\*\\*.*?\\*\\*', '', 'g'), '.')[1], E' \\t\\n\\r')), '\\s+') IF x <> '']"
    return f"{words}[1:5]"


_VIOLATIONS = (
    BASE
    + f""",
seen AS (SELECT *, {_STRIP('text')} AS own, lag(who) OVER w AS before, lag({_STRIP('text')}) OVER w AS said FROM turns WINDOW w AS (PARTITION BY dialogue_id ORDER BY index)),
tail AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY index DESC) <= 6),
often AS (SELECT DISTINCT dialogue_id FROM (SELECT dialogue_id, s, count(*) AS n FROM tail, (SELECT unnest({list(tx.SYMPTOMS)!r}) AS s) WHERE contains(lower(text), s) GROUP BY ALL) WHERE n >= 3),
found AS (SELECT dialogue_id, CASE WHEN who IS NULL THEN 'role_validity' WHEN who = before THEN 'alternation' END AS "check", index FROM seen
  UNION ALL SELECT dialogue_id, 'empty_turn', index FROM seen WHERE own = ''
  UNION ALL SELECT dialogue_id, 'duplicate_turn', index FROM seen WHERE own <> '' AND own = said
  UNION ALL SELECT dialogue_id, 'error_sentinel', index FROM seen WHERE regexp_matches(text, '(?i){_SENTINEL}')
  UNION ALL SELECT dialogue_id, 'turn_bounds', -1 FROM turns GROUP BY dialogue_id HAVING count(*) < 4 OR count(*) > 40
  UNION ALL SELECT dialogue_id, 'repetition', -1 FROM often),
violations AS (SELECT * FROM found WHERE "check" IS NOT NULL)
"""
)

ORACLE_SQL: dict[str, str] = {
    "cohort_candidates": f"""WITH {COHORT} SELECT hadm_id, subject_id, age::INTEGER AS age, has_icu, icu_unknown, CASE WHEN NOT icu_unknown THEN round(icu_days, 6) END AS icu_days,
  charlson, high_acuity, n_codes, ventilated, round(stay, 6) AS stay, note_chars FROM candidates""",
    "cohort_exclusion_flow": f"""WITH {COHORT}, steps AS (SELECT i AS step, 'E' || i AS code FROM range(1, 11) t(i)),
hits AS (SELECT fired[1] AS code, count(*) AS n FROM evaluated GROUP BY 1), total AS (SELECT count(*) AS t FROM evaluated),
flow AS (SELECT step, code, coalesce(n, 0) AS excluded, t - coalesce(sum(coalesce(n, 0)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entering
  FROM steps LEFT JOIN hits USING (code), total)
SELECT step::INTEGER AS step, code, entering::BIGINT AS entering, excluded::BIGINT AS excluded, (entering - excluded)::BIGINT AS remaining FROM flow""",
    "cohort_audit_status": f"WITH {COHORT} SELECT hadm_id, subject_id, array_to_string(fired, ',') AS fired, CASE WHEN len(fired) = 0 THEN 'eligible' ELSE 'excluded' END AS status FROM evaluated",
    "cohort_hash_sample": f"""WITH {BASE}, k AS (SELECT subject_id, hadm_id, sha256(concat_ws(chr(0), 'cohort-sample-v1', 'snapshot', '20260914', subject_id::VARCHAR, hadm_id::VARCHAR)) AS sample_key FROM admissions)
SELECT row_number() OVER (ORDER BY sample_key, subject_id, hadm_id)::INTEGER AS selection_rank, subject_id, hadm_id, sample_key FROM k ORDER BY sample_key, subject_id, hadm_id LIMIT 100""",
    "cohort_first_admission": f"""WITH {BASE}, r AS (SELECT subject_id, hadm_id, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn, count(*) OVER (PARTITION BY subject_id) AS n_admissions FROM admissions)
SELECT subject_id, hadm_id, n_admissions FROM r WHERE rn = 1""",
    "cohort_malformed": f"""WITH {BASE}, r AS (SELECT CASE WHEN subject_id <= 0 OR hadm_id <= 0 THEN 'identifier' WHEN {_AGE} < 0 THEN 'negative age' WHEN dischtime < admittime THEN 'discharge before admission' END AS reason
  FROM admissions JOIN patients USING (subject_id)) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "cohort_selected_semi": f"""WITH {BASE}, k AS (SELECT hadm_id FROM admissions ORDER BY sha256(concat_ws(chr(0), 'cohort-sample-v1', 'snapshot', '1', subject_id::VARCHAR, hadm_id::VARCHAR)), subject_id, hadm_id LIMIT 500)
SELECT hadm_id, count(*) AS n_rows FROM diagnoses WHERE hadm_id IN (SELECT hadm_id FROM k) GROUP BY 1""",
    "resume_anti": f"WITH {BASE} SELECT hadm_id, subject_id FROM admissions a WHERE NOT EXISTS (SELECT 1 FROM diagnoses d WHERE d.hadm_id = a.hadm_id)",
    "full_outer_case_counts": f"""WITH {BASE}, a AS (SELECT DISTINCT hadm_id FROM icu_stays), b AS (SELECT DISTINCT hadm_id FROM procedures)
SELECT count(*) AS n_union, count(*) FILTER (a.hadm_id IS NOT NULL AND b.hadm_id IS NOT NULL) AS n_both, count(*) FILTER (b.hadm_id IS NULL) AS only_left, count(*) FILTER (a.hadm_id IS NULL) AS only_right
FROM a FULL JOIN b ON a.hadm_id = b.hadm_id""",
    "icu_days_null_poison": f"WITH {BASE} SELECT hadm_id, bool_or(los IS NULL) AS icu_unknown, CASE WHEN NOT bool_or(los IS NULL) THEN round(sum(los), 6) END AS icu_days FROM icu_stays GROUP BY 1",
    "codes_distinct_by_hadm": f"WITH {BASE} SELECT hadm_id, string_agg(DISTINCT {_NORMAL}, ',' ORDER BY {_NORMAL}) AS codes, count(DISTINCT {_NORMAL}) AS n_codes FROM diagnoses GROUP BY 1",
    "charlson_score": f"WITH {COHORT} SELECT hadm_id, charlson FROM dx",
    "high_acuity_flag": f"WITH {BASE}, c AS (SELECT DISTINCT {_NORMAL} AS code FROM diagnoses) SELECT code, {icd9.sql_high_acuity()} AS high_acuity, CASE WHEN code LIKE 'E%' THEN substr(code, 1, 4) ELSE substr(code, 1, 3) END AS category FROM c",
    "demographics_left": f"""WITH {BASE} SELECT hadm_id, coalesce(segment, 'not provided') AS segment, coalesce(strftime(dob, '%Y-%m-%d'), 'not provided') AS dob
FROM admissions LEFT JOIN patients USING (subject_id)""",
    "notes_concat_ordered": f"""WITH {BASE}, n AS (SELECT hadm_id, row_id, chartdate, {_STRIP('text')} AS text FROM notes WHERE lower(trim(category)) = 'discharge summary'),
o AS (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY chartdate IS NOT NULL, chartdate NULLS FIRST, row_id) AS pos FROM n WHERE text <> '')
SELECT hadm_id, first(row_id ORDER BY length(text) DESC, pos) AS longest_row, count(*) AS n_notes, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS text_md5 FROM o GROUP BY 1""",
    "note_top1": f"""WITH {BASE} SELECT hadm_id, row_id, strftime(chartdate, '%Y-%m-%d') AS chartdate FROM notes WHERE lower(category) = 'discharge summary'
QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY chartdate DESC NULLS LAST, row_id DESC) = 1""",
    "attempts_final_first_accepted": f"WITH {FINAL1} SELECT case_id, policy, variant, attempt_index, acceptance, round(value, 6) AS value FROM finals",
    "attempts_final_max_index": f"WITH {FINAL2} SELECT case_id, variant, attempt_index, acceptance, round(value, 6) AS value FROM finals",
    "attempts_summary_grouping_sets": f"""WITH {FINAL1} SELECT coalesce(variant, '*') AS variant, coalesce(policy, '*') AS policy, count(*) AS finals, count(*) FILTER (acceptance = 'ACCEPT') AS n_accepted,
  count(*) FILTER (value IS NULL) AS n_incomplete, round(avg(value), 6) AS mean_value, round(count(*) FILTER (acceptance = 'ACCEPT') / count(*), 6) AS acceptance_rate
FROM finals GROUP BY GROUPING SETS ((), (variant), (policy))""",
    "acceptance_wilson": f"""WITH {FINAL2}, c AS (SELECT variant, count(*) FILTER (acceptance IN ('ACCEPT', 'PASS')) AS k, count(*)::DOUBLE AS n FROM finals GROUP BY 1),
w AS (SELECT *, k / n AS p, 1 + {_Z} * {_Z} / n AS s FROM c)
SELECT variant, k AS n_accepted, n::BIGINT AS n_total, round(p, 6) AS rate, round(greatest(0.0, (p + {_Z} * {_Z} / (2 * n)) / s - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / s), 6) AS low,
  round(least(1.0, (p + {_Z} * {_Z} / (2 * n)) / s + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / s), 6) AS high FROM w""",
    "incomplete_rates": f"WITH {FINAL2} SELECT variant, count(*) FILTER (value IS NULL) AS n_incomplete, count(*) AS n_total, round(count(*) FILTER (value IS NULL) / count(*), 6) AS rate FROM finals GROUP BY 1",
    "cost_by_variant": f"""WITH {BASE} SELECT variant, count(*) AS attempts, sum(calls)::BIGINT AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(wall_ms)::BIGINT AS wall_ms,
  round((sum(prompt_tokens) * 3.0::DOUBLE + sum(completion_tokens) * 15.0::DOUBLE) / 1e6::DOUBLE, 6) AS estimated_cost FROM attempts GROUP BY 1""",
    "score_gate_decide": f"""WITH v AS (SELECT event_id, {_DIM_VALUES} FROM events)
SELECT event_id AS attempt_index, CASE WHEN {' OR '.join(f'coalesce({n} < {t}, false)' for n, t in _LIMITS.items())} THEN 'REJECT' WHEN {' OR '.join(f'{n} IS NULL' for n in DIMS)} THEN 'INCOMPLETE' ELSE 'ACCEPT' END AS decision,
  0.4::DOUBLE * naturalness + 0.3::DOUBLE * knowledge_boundary + 0.3::DOUBLE * patient_factuality AS composite FROM v""",
    "json_scores_explode": """WITH k AS (SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events),
s AS (SELECT 'first' AS dimension, CASE WHEN event_id % 11 <> 0 THEN k / 100 END AS v FROM k UNION ALL SELECT 'second', CASE WHEN event_id % 13 <> 0 THEN 1 - k / 100 END FROM k)
SELECT dimension, count(v) AS measured, count(*) - count(v) AS incomplete, count(*) FILTER (v >= 0.8::DOUBLE) AS passed, count(*) FILTER (v < 0.8::DOUBLE) AS failed, round(avg(v), 6) AS mean_value FROM s GROUP BY 1""",
    "upsert_latest": f"""WITH {BASE}, a AS (SELECT *, 0 AS pri FROM (SELECT * FROM attempts WHERE attempt_index % 2 = 1 QUALIFY row_number() OVER (PARTITION BY case_id, variant ORDER BY attempt_index DESC) = 1)
  UNION ALL SELECT *, 1 FROM (SELECT * FROM attempts WHERE attempt_index % 2 = 0 QUALIFY row_number() OVER (PARTITION BY case_id, variant ORDER BY attempt_index DESC) = 1))
SELECT case_id, variant, attempt_index, round(value, 6) AS value FROM a QUALIFY row_number() OVER (PARTITION BY case_id, variant ORDER BY pri) = 1""",
    "best_scoring_attempt": f"WITH {BASE} SELECT case_id, attempt_index, round(value, 6) AS value FROM attempts WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(value, 6) DESC, attempt_index) = 1",
    "e0_curves": f"WITH {VALUES} SELECT variant, policy, count(value) AS n_cases, count(*) - count(value) AS n_incomplete, round(avg(value), 6) AS mean_value FROM vals GROUP BY ALL",
    "e0_paired": f"""WITH {VALUES}, arms AS (SELECT variant, case_id, max(value) FILTER (policy = 'P0') - max(value) FILTER (policy = 'P2') AS diff FROM vals GROUP BY ALL)
SELECT variant, count(diff) AS n_cases, count(*) - count(diff) AS n_dropped, round(avg(diff), 6) AS mean_difference FROM arms GROUP BY 1""",
    "paired_difference_bootstrap": f"""WITH {VALUES}, arms AS (SELECT variant, case_id, max(value) FILTER (policy = 'P0') - max(value) FILTER (policy = 'P2') AS diff FROM vals GROUP BY ALL),
c AS (SELECT variant, row_number() OVER (PARTITION BY variant ORDER BY md5(case_id::VARCHAR), case_id) - 1 AS ordinal, diff FROM arms WHERE diff IS NOT NULL), s AS (SELECT variant, count(*) AS cases, avg(diff) AS estimate FROM c GROUP BY 1),
slots AS (SELECT variant, b, ('0x' || substr(sha256('7|' || b || '|' || x), 1, 8))::BIGINT % cases AS ordinal, cases, estimate FROM (SELECT *, unnest(range(cases)) AS x FROM s), range(2000) t(b)),
m AS (SELECT variant, b, cases, estimate, avg(diff) AS mean FROM slots JOIN c USING (variant, ordinal) GROUP BY ALL)
SELECT variant, cases, round(estimate, 12) AS estimate, round(quantile_cont(mean, 0.025), 12) AS low, round(quantile_cont(mean, 0.975), 12) AS high FROM m GROUP BY variant, cases, estimate""",
    "sign_flip_exact": f"""WITH {VALUES}, sites AS (SELECT case_id % 12 AS case_id, policy, avg(value) AS value FROM vals GROUP BY ALL),
arms AS (SELECT case_id, max(value) FILTER (policy = 'P0') - max(value) FILTER (policy = 'P2') AS diff FROM sites WHERE policy IN ('P0', 'P2') GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS i, diff FROM arms WHERE diff IS NOT NULL), n AS (SELECT count(*) AS n, abs(sum(diff) / count(*)) AS o FROM c),
f AS (SELECT bits, abs(sum(CASE WHEN (bits >> i) & 1 = 1 THEN -diff ELSE diff END) / (SELECT n FROM n)) AS f FROM range(0, (SELECT 1::BIGINT << n FROM n)) t(bits), c GROUP BY 1)
SELECT n AS n_cases, round(o, 6) AS observed, round(avg(CASE WHEN f + 1e-12 >= o THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM f, n GROUP BY n, o""",
    "holm_bh_adjust": f"""WITH {VALUES}, p AS (SELECT DISTINCT variant || '/' || policy AS label, ('0x' || substr(sha256(variant || '|' || policy), 1, 4))::BIGINT / 65536.0::DOUBLE / 10 AS p_value FROM vals),
r AS (SELECT *, row_number() OVER (ORDER BY p_value, label) AS k, count(*) OVER () AS n FROM p)
SELECT label, round(p_value, 6) AS p_value, round(least(1.0, max((n - k + 1) * p_value) OVER (ORDER BY k)), 6) AS holm, round(least(1.0, min(p_value * n / k) OVER (ORDER BY k DESC)), 6) AS bh FROM r""",
    "structural_violations": f'WITH {_VIOLATIONS} SELECT dialogue_id, "check", index::INTEGER AS turn_index FROM violations',
    "structural_score": f"""WITH {_VIOLATIONS}, v AS (SELECT dialogue_id, count(*) AS n FROM violations GROUP BY 1), t AS (SELECT dialogue_id, count(*) AS turns FROM turns GROUP BY 1)
SELECT dialogue_id, turns, coalesce(n, 0) AS violations, CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM t LEFT JOIN v USING (dialogue_id)""",
    "symptom_repetition_last6": f"""WITH {BASE}, tail AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY index DESC) <= 6)
SELECT dialogue_id, s AS symptom, count(*) AS mentions FROM tail, (SELECT unnest(['the', 'la', 'der', 'que', 'and']) AS s) WHERE contains(lower(text), s) GROUP BY ALL HAVING count(*) >= 3""",
    "opening_repetition": f"""WITH {BASE}, o AS (SELECT dialogue_id, index, role, {_opening()} AS w FROM turns),
p AS (SELECT *, list(list_distinct(w)) OVER (PARTITION BY dialogue_id, role ORDER BY index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS past FROM o),
s AS (SELECT *, len([q FOR q IN coalesce(past, []) IF len(list_distinct(w || q)) > 0 AND len(list_intersect(list_distinct(w), q)) / len(list_distinct(w || q)) > 0.1]) AS alike FROM p)
SELECT dialogue_id, index, greatest(1, len(w))::BIGINT AS n_words, alike::BIGINT AS alike, len(w) > 0 AND alike >= 1 AS repetitive FROM s""",
    "loop_detection": f"""WITH {BASE}, w AS (SELECT dialogue_id, index, list({{'who': who, 'said': lower(substr(text, 1, 100))}}) OVER (PARTITION BY dialogue_id ORDER BY index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS w FROM turns),
m AS (SELECT *, [x.said FOR x IN w IF x.who = 'Doctor'] AS d, [x.said FOR x IN w IF x.who = 'Patient'] AS p FROM w)
SELECT dialogue_id, index, len(w) >= 4 AND (coalesce(len(d) >= 2 AND d[-1] = d[-2], false) OR coalesce(len(p) >= 2 AND p[-1] = p[-2], false) OR len([q FOR q IN d IF regexp_matches(q, '{_QUESTION}')]) >= 3) AS looping FROM m""",
    "dialogue_stats": f"""WITH {BASE} SELECT dialogue_id, count(*) AS turns, sum(len([x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> '']))::BIGINT AS words, count(*) FILTER (who = 'Patient') AS patient_turns,
  count(*) FILTER (who = 'Doctor') AS doctor_turns, count(*) FILTER (who IS NULL) AS other_turns FROM turns GROUP BY 1""",
    "confusion_streak": f"""WITH RECURSIVE {BASE}, o AS (SELECT dialogue_id, row_number() OVER (PARTITION BY dialogue_id ORDER BY index) AS i, length(text) % 3 = 0 AS c FROM turns),
f AS (SELECT dialogue_id, 0::BIGINT AS i, 0 AS now FROM o WHERE i = 1 UNION ALL SELECT o.dialogue_id, o.i, CASE WHEN c THEN now + 1 ELSE greatest(0, now - 1) END FROM f JOIN o ON o.dialogue_id = f.dialogue_id AND o.i = f.i + 1)
SELECT dialogue_id, max(now)::INTEGER AS longest_streak, max(now) >= 2 AS ended FROM f GROUP BY 1""",
    "transcript_render": f"WITH {BASE} SELECT dialogue_id, md5(string_agg('[' || index || '] ' || role || ': ' || text, chr(10) ORDER BY index)) AS transcript_md5 FROM turns GROUP BY 1",
    "redact_terms": """SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(?:license|of the|que|the|und)\\b')) AS n_redacted, md5(regexp_replace(text, '(?i)\\b(?:license|of the|que|the|und)\\b', '[REDACTED]', 'g')) AS text_md5 FROM documents""",
    "light_case_filter": """WITH t AS (SELECT doc_id, [x FOR x IN ['idiot', 'stupid'] IF contains(lower(text), x)] AS h, [x FOR x IN ['license', 'the', 'der'] IF contains(lower(text), x)] AS l FROM documents),
r AS (SELECT doc_id, CASE WHEN len(h) > 0 THEN 'excluded: ' || array_to_string(h, ',') WHEN len(l) > 0 THEN 'included: ' || array_to_string(l, ',') ELSE 'no term' END AS reason FROM t)
SELECT doc_id, reason, reason LIKE 'included%' AS passed FROM r""",
    "evidence_audit": """WITH s AS (SELECT doc_id, text, (doc_id % 50)::INTEGER AS a, (doc_id % 50 + doc_id % 9 * 5)::INTEGER AS b FROM documents),
q AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'elsewhere' ELSE substr(text, a + 1, greatest(0, b - a)) END AS quoted FROM s)
SELECT CASE WHEN text IS NULL THEN 'missing note' WHEN a < 0 OR b <= a OR b > length(text) THEN 'offsets out of range' WHEN substr(text, a + 1, b - a) <> quoted THEN 'text differs' ELSE 'sound' END AS error, count(*) AS n FROM q GROUP BY 1""",
    "scr_mask_policy": f"""WITH {REFS} SELECT o_orderkey AS case_id, o_orderpriority AS admission_type, year(o_orderdate)::INTEGER AS year,
  regexp_replace('comes with ' || top, '(?i)\\b(?:blue|ring|red)\\b', '[REDACTED]', 'g') AS chief_complaint, 1::BIGINT AS n_treatments FROM orders JOIN refs ON o_orderkey = l_orderkey""",
    "leakable_paths": """WITH paths AS (SELECT unnest(['core', 'core.diagnoses', 'core.diagnoses[].primary', 'core.diagnoses[].notes', 'core.treatments', 'core.treatments[].procedure', 'core.treatments[].medications',
  'core.treatments[].medications[].name', 'core.treatments[].medications[].dosage', 'context', 'context.demographics', 'context.demographics.admission_type', 'context.demographics.year', 'context.current_medications',
  'context.current_medications[].name', 'context.current_medications[].dosage', 'additional', 'additional.chief_complaint']) AS path),
allowed AS (SELECT * FROM (VALUES ('Patient', 'core.treatments[].procedure'), ('Patient', 'context.demographics'), ('Patient', 'additional.chief_complaint'), ('Doctor', 'context.demographics')) t(role, a))
SELECT role, path FROM (SELECT DISTINCT role FROM allowed) r, paths WHERE NOT EXISTS (SELECT 1 FROM allowed w WHERE w.role = r.role AND (path = a OR starts_with(path, a || '.') OR starts_with(path, a || '[')
  OR starts_with(a, path || '.') OR starts_with(a, path || '[')))""",
    "matcher_normalise": """WITH a AS (SELECT p_partkey, p_name || ' -- ' || p_type AS t0 FROM part), b AS (SELECT *, lower(t0) AS t1 FROM a), c AS (SELECT *, regexp_replace(t1, '[^\\w\\s]+', ' ', 'g') AS t2 FROM b),
d AS (SELECT *, trim(regexp_replace(t2, '\\s+', ' ', 'g')) AS t3 FROM c), e AS (SELECT *, regexp_replace(regexp_replace(t3, '\\bring\\b', 'gear', 'g'), '\\bhot\\b', 'red', 'g') AS t4 FROM d),
f AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(t4, '\\bsmall\\b', ' ', 'g'), '\\bthe\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS t5 FROM e)
SELECT p_partkey, t5 AS normal, array_to_string([x FOR x IN [CASE WHEN t1 <> t0 THEN 'lowercase' END, CASE WHEN t2 <> t1 THEN 'strip_punctuation' END, CASE WHEN t3 <> t2 THEN 'collapse_whitespace' END,
  CASE WHEN t4 <> t3 THEN 'apply_synonyms' END, CASE WHEN t5 <> t4 THEN 'drop_stopwords' END] IF x IS NOT NULL], ',') AS trace FROM f""",
    "matcher_best": f"WITH {PAIRS} SELECT case_id, extracted, coded, granularity, round(score, 6) AS score FROM pairs QUALIFY row_number() OVER (PARTITION BY case_id, extracted ORDER BY rk DESC, score DESC, coded) = 1",
    "dice_overlap": """WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part)
SELECT a.p_partkey, round(2.0::DOUBLE * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)), 6) AS dice, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 6) AS jaccard FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1""",
    "fleiss_kappa": f"""WITH {RATINGS}, u AS (SELECT case_id, entity, count(*)::DOUBLE AS p FROM r GROUP BY ALL), o AS (SELECT count(*) AS n_units, avg((p * (p - 1) + (3 - p) * (2 - p)) / 6) AS observed, sum(p) / (count(*) * 3) AS rate FROM u),
e AS (SELECT *, rate * rate + (1 - rate) * (1 - rate) AS expected FROM o)
SELECT n_units, round(observed, 6) AS observed, round(expected, 6) AS expected, CASE WHEN 1 - expected > 1e-12 THEN round((observed - expected) / (1 - expected), 6) END AS kappa FROM e""",
    "pairwise_jaccard": f"""WITH {RATINGS}, g AS (SELECT case_id, rater FROM (SELECT DISTINCT case_id FROM r), (SELECT DISTINCT rater FROM r)),
s AS (SELECT case_id, rater, coalesce(list(entity) FILTER (entity IS NOT NULL), []) AS e FROM g LEFT JOIN r USING (case_id, rater) GROUP BY ALL),
j AS (SELECT len(list_distinct(a.e || b.e)) AS u, len(list_intersect(a.e, b.e)) AS i FROM s a JOIN s b ON a.case_id = b.case_id AND a.rater < b.rater)
SELECT count(*) AS n_pairs, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE i / u END), 6) AS mean_jaccard FROM j""",
    "detector_confusion": f"""WITH {DETECTOR}, c AS (SELECT fault, count(*) FILTER (is_corrupted AND predicted) AS tp, count(*) FILTER (NOT is_corrupted AND predicted) AS fp, count(*) FILTER (is_corrupted AND NOT predicted) AS fn,
  count(*) FILTER (NOT is_corrupted AND NOT predicted) AS tn FROM det GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""",
    "detector_auc": f"""WITH {DETECTOR}, n AS (SELECT fault, count(*) FILTER (is_corrupted) AS positives, count(*) FILTER (NOT is_corrupted) AS negatives FROM det GROUP BY 1),
w AS (SELECT a.fault, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)::DOUBLE AS wins FROM det a JOIN det b ON a.fault = b.fault AND a.is_corrupted AND NOT b.is_corrupted GROUP BY 1)
SELECT fault, positives, negatives, CASE WHEN positives * negatives > 0 THEN round(wins / (positives * negatives), 6) END AS auc FROM n LEFT JOIN w USING (fault)""",
    "claims_faithfulness": f"""WITH {BASE}, p AS (SELECT dialogue_id, index, row_number() OVER (PARTITION BY dialogue_id ORDER BY index) - 1 AS i FROM turns WHERE who = 'Patient'),
c AS (SELECT dialogue_id, CASE (dialogue_id + i) % 4 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'unverifiable' ELSE 'supported' END AS v FROM p WHERE index % 3 <> 2),
n AS (SELECT dialogue_id, count(*) AS claims, count(*) FILTER (v = 'supported') AS s, count(*) FILTER (v = 'unsupported') AS u, count(*) FILTER (v = 'unverifiable') AS x FROM c GROUP BY 1)
SELECT dialogue_id, coalesce(claims, 0) AS claims, coalesce(s, 0) AS supported, coalesce(u, 0) AS unsupported, coalesce(x, 0) AS unverifiable, CASE WHEN s + u > 0 THEN round(s / (s + u), 6) END AS score,
  CASE WHEN coalesce(claims, 0) = 0 THEN 'no factual claims' WHEN s + u = 0 THEN 'no verifiable claims' ELSE '' END AS incomplete_reason FROM (SELECT DISTINCT dialogue_id FROM turns) LEFT JOIN n USING (dialogue_id)""",
}

_ACTIONS = "(VALUES " + ", ".join(f"('{d}', '{'+'.join(t)}', '{x}')" for d, t, x in studies.REPAIRS) + ") r(dimension, targets, directive)"
_FAILED = " UNION ALL ".join(f"SELECT event_id AS case_id, {i} AS position, '{n}' AS dimension FROM v WHERE {n} < {t}" for i, (n, t) in enumerate(_LIMITS.items()))

ORACLE_SQL |= {
    "repair_plan": f"""WITH v AS (SELECT event_id, {_DIM_VALUES} FROM events), f AS ({_FAILED})
SELECT case_id, count(*) AS n_steps, string_agg(dimension || ' -> ' || targets, '; ' ORDER BY position) AS plan, md5(string_agg(directive, chr(10) ORDER BY position)) AS directives_md5,
  '{studies.REPAIR_VERSION}' AS repair_version FROM f JOIN {_ACTIONS} USING (dimension) GROUP BY 1""",
    "attempt_seeds": f"""WITH {BASE}, j AS (SELECT attempt_index, '{{"attempt_index":' || attempt_index || ',"base_seed":20260914,"case_id":"' || case_id || '","patient_policy_ref":"' || policy || '@' || variant || '","stream":"generation"}}' AS payload FROM attempts WHERE attempt_index >= 1)
SELECT attempt_index, (('0x' || substr(sha256(payload), 1, 16))::UBIGINT % 2147483648)::BIGINT AS seed FROM j""",
    "judge_legacy": f"""WITH {BASE}, n AS (SELECT dialogue_id, count(*) FILTER (who = 'Patient') AS patient_turns, count(*) FILTER (who = 'Patient' AND index > 1) AS statements,
  count(*) FILTER (who = 'Patient' AND index > 1 AND (dialogue_id + index) % 3 <> 0) AS yes FROM turns GROUP BY 1)
SELECT dialogue_id, patient_turns, statements, yes, round(CASE WHEN patient_turns = 0 THEN 0.0 WHEN statements = 0 THEN 1.0 ELSE yes / statements END, 6)::DOUBLE AS score FROM n""",
    "policy_fanout": f"""WITH {BASE}, t AS (SELECT dialogue_id, count(*) AS turns FROM turns GROUP BY 1)
SELECT dialogue_id, turns, policy, mode FROM t, (SELECT unnest(['FULL', 'NO_DIAGNOSIS', 'NO_DIAGNOSIS_NO_TREATMENT']) AS policy), (SELECT unnest(['full_ref', 'policy_ctx']) AS mode)""",
    "matrix_missing_cells": f"""WITH {BASE}, a AS (SELECT DISTINCT case_id, variant FROM attempts WHERE acceptance = 'ACCEPT')
SELECT c.case_id, v.variant FROM (SELECT DISTINCT case_id FROM a) c, (SELECT DISTINCT variant FROM a) v WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.case_id = c.case_id AND a.variant = v.variant)""",
    "case_coverage": "SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS covered, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing FROM (SELECT DISTINCT doc_id FROM documents)",
    "condition_last_wins": f"WITH {BASE} SELECT variant, policy, case_id, round(value, 6) AS value FROM attempts WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant, policy, case_id ORDER BY attempt_index DESC) = 1",
    "matcher_error_rate": """WITH p AS (SELECT p_type, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS e, CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 1 ELSE p_partkey END END AS m FROM part)
SELECT p_type, count(*) FILTER (e = m) AS tp, count(*) FILTER (m IS NOT NULL AND e IS DISTINCT FROM m) AS fp, count(*) FILTER (e IS NOT NULL AND e IS DISTINCT FROM m) AS fn, count(*) FILTER (e IS NULL AND m IS NULL) AS tn, count(*) AS n_cases FROM p GROUP BY 1""",
    "light_case_reorder": """WITH t AS (SELECT doc_id, contains(lower(text), 'licensed') AS passed FROM documents)
SELECT row_number() OVER (ORDER BY passed DESC, doc_id)::INTEGER AS place, doc_id, passed FROM t ORDER BY passed DESC, doc_id LIMIT 50""",
    "dialogue_phases": f"""WITH {BASE}, t AS (SELECT row_number() OVER (PARTITION BY dialogue_id ORDER BY index) AS n FROM turns WHERE who = 'Doctor')
SELECT CASE WHEN n <= 3 THEN 'opening' WHEN n <= 8 THEN 'exploration' WHEN n <= 11 THEN 'synthesis' ELSE 'conclusion' END AS phase, count(*) AS n FROM t GROUP BY 1""",
    "conversation_checks": f"""WITH {BASE}, t AS (SELECT dialogue_id, length({_STRIP('text')}) >= 10 AND NOT contains(text, '[ERROR:') AS ok, who = 'Doctor' AND ({_any('lower(text)', studies.INQUIRIES)}) AS asked FROM turns),
c AS (SELECT dialogue_id, count(*) AS turns, count(*) FILTER (NOT coalesce(ok, false)) AS invalid, count(*) FILTER (asked) AS inquiries FROM t GROUP BY 1)
SELECT *, turns >= 6 AS substantial, turns >= 6 AND inquiries >= 3 AS covered FROM c""",
    "patient_moods": f"""WITH {BASE}, t AS (SELECT lower(text) AS x FROM turns WHERE who = 'Patient')
SELECT CASE {' '.join('WHEN ' + _any('x', words) + ' THEN ' + repr(name) for name, words in studies.MOODS)} ELSE 'neutral' END AS mood, count(*) AS n FROM t GROUP BY 1""",
    "lenient_candidates": f"""WITH {BASE}, r AS (SELECT *, CASE hadm_id % 6 WHEN 0 THEN ' True' WHEN 1 THEN 'f' WHEN 2 THEN '1' WHEN 3 THEN 'No' WHEN 4 THEN '0' ELSE 'maybe' END AS icu,
  CASE WHEN hadm_id % 89 = 0 THEN 'soon' ELSE strftime(admittime, '%Y-%m-%d') END AS entered FROM admissions)
SELECT hadm_id, subject_id, CASE lower(trim(icu)) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'f' THEN false WHEN 'no' THEN false WHEN '0' THEN false END AS has_icu_stay,
  CASE WHEN entered <> 'soon' THEN entered END AS admitted, CASE WHEN hadm_id % 4 = 0 THEN '' ELSE (hadm_id % 900) || '|' || (subject_id % 900) END AS codes,
  CASE WHEN entered = 'soon' THEN 'admittime' WHEN icu = 'maybe' THEN 'has_icu_stay' ELSE '' END AS reason FROM r""",
    "cohort_selected_audit": f"""WITH {COHORT}, k AS (SELECT hadm_id FROM evaluated WHERE len(fired) = 0 ORDER BY sha256(concat_ws(chr(0), 'cohort-sample-v1', 'snapshot', '20260914', subject_id::VARCHAR, hadm_id::VARCHAR)), subject_id, hadm_id LIMIT 20)
SELECT hadm_id, subject_id, array_to_string(fired, ',') AS fired, CASE WHEN len(fired) > 0 THEN 'excluded' WHEN hadm_id IN (SELECT hadm_id FROM k) THEN 'selected' ELSE 'eligible_not_sampled' END AS status FROM evaluated""",
    "token_totals_by_policy": f"WITH {BASE} SELECT policy, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens FROM attempts GROUP BY 1",
    "reference_entity_totals": "SELECT count(DISTINCT l_orderkey) AS n_references, count(*) AS n_diagnoses, count(*) AS n_medications FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey",
    "diagnosis_term_index": """WITH p AS (SELECT p_partkey, [p_name, p_type] AS parts FROM part),
t AS (SELECT p_partkey, unnest(parts) AS s FROM p), w AS (SELECT p_partkey, s, [x FOR x IN regexp_extract_all(s, '[A-Za-z]+') IF lower(x) NOT IN ('a', 'an', 'and', 'by', 'due', 'for', 'in', 'of', 'on', 'or', 'secondary', 'the', 'to', 'with', 'without')] AS ws FROM t),
f AS (SELECT p_partkey, s AS f FROM t WHERE length(s) >= 4 UNION SELECT p_partkey, upper(array_to_string([substr(x, 1, 1) FOR x IN ws], '')) FROM w WHERE len(ws) >= 2)
SELECT p.p_partkey, coalesce(string_agg(f, '|' ORDER BY f), '') AS terms FROM p LEFT JOIN f ON p.p_partkey = f.p_partkey GROUP BY 1""",
    "case_split_counts": """WITH c AS (SELECT DISTINCT doc_id % 200 AS case_id FROM documents), r AS (SELECT case_id, row_number() OVER (ORDER BY sha256('0|' || case_id), case_id) AS k, count(*) OVER () AS n FROM c)
SELECT lang, k <= greatest(1, least(n - 1, round_even(n * 0.25, 0))) AS test, count(*) AS n FROM documents d JOIN r ON r.case_id = d.doc_id % 200 GROUP BY ALL""",
}

_FAULTS = "(VALUES " + ", ".join(f"('{f}', '{role or ''}')" for f, role, _ in faults.FAULTS) + ") f(fault, of)"
_POWERS = {80: NormalDist().inv_cdf(0.8), 90: NormalDist().inv_cdf(0.9)}
_CASES = {k: f"CASE WHEN sd = 0 THEN 2 ELSE greatest(2, ceil(pow(({_Z} + {z}) * sd / 0.05, 2)))::INTEGER END" for k, z in _POWERS.items()}

ORACLE_SQL |= {
    "fault_injection": f"""WITH {BASE}, seen AS (SELECT *, lag(role) OVER (PARTITION BY dialogue_id ORDER BY index) AS before FROM turns),
fits AS (SELECT dialogue_id, fault, index, sha256('11|' || dialogue_id || '|' || fault || '|' || index) AS draw FROM seen, {_FAULTS}
  WHERE CASE WHEN fault = 'role_order_violation' THEN before IS NOT NULL AND before <> role WHEN fault = 'empty_turn' THEN true ELSE coalesce(who = of, false) END)
SELECT dialogue_id, fault, 1::BIGINT AS n_hits, arg_min(index, draw)::INTEGER AS hit_index, true AS recovered FROM fits GROUP BY 1, 2""",
    "power_derivation": f"""WITH {VALUES}, arms AS (SELECT variant, case_id, max(value) FILTER (policy = 'P0') - max(value) FILTER (policy = 'P1') AS diff FROM vals GROUP BY ALL),
s AS (SELECT variant, count(diff) AS pilot_n, stddev_samp(diff) AS sd FROM arms GROUP BY 1 HAVING stddev_samp(diff) IS NOT NULL),
c AS (SELECT variant, pilot_n, sd, {_CASES[80]} AS complete_80, {_CASES[90]} AS complete_90 FROM s)
SELECT variant, pilot_n, round(sd, 6) AS paired_sd, complete_80, ceil(complete_80 / 0.9::DOUBLE)::INTEGER AS total_80, complete_90, ceil(complete_90 / 0.9::DOUBLE)::INTEGER AS total_90 FROM c""",
}


def _draws(source: str, by: str, resamples: int, seed: str) -> str:
    """CTEs cs, sz, dr: the multiplicities of cases in replicates; replicate -1 has every case once."""
    return f"""cs AS (SELECT {by}, case_id, row_number() OVER (PARTITION BY {by} ORDER BY md5(case_id::VARCHAR), case_id) - 1 AS ordinal FROM (SELECT DISTINCT {by}, case_id FROM {source})),
sz AS (SELECT {by}, count(*) AS cases FROM cs GROUP BY ALL), sl AS (SELECT {by}, b, ('0x' || substr(sha256('{seed}|' || b || '|' || x), 1, 8))::BIGINT % cases AS ordinal FROM (SELECT *, unnest(range(cases)) AS x FROM sz), range({resamples}) t(b)),
dr AS (SELECT {by}, b, case_id, count(*) AS times FROM sl JOIN cs USING ({by}, ordinal) GROUP BY ALL UNION ALL SELECT {by}, -1, case_id, 1 FROM cs)"""


def _interval(value: str) -> str:
    return f"round(max({value}) FILTER (b < 0), 12) AS estimate, round(coalesce(quantile_cont({value}, 0.025) FILTER (b >= 0), max({value}) FILTER (b < 0)), 12) AS low, round(coalesce(quantile_cont({value}, 0.975) FILTER (b >= 0), max({value}) FILTER (b < 0)), 12) AS high"


_METRICS = {"precision": "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END", "recall": "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END", "f1": "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END", "auc": "wins / nullif(pos * neg, 0)", "localisation": "CASE WHEN tp = 0 THEN 0.0 ELSE located / tp END"}
_LONG = " UNION ALL ".join(f"SELECT variant, policy, '{n}' AS metric, case_id, CASE WHEN attempt_index % {11 + i} <> 0 THEN value * {x}::DOUBLE END AS value FROM finals" for i, (n, x) in enumerate(zip(DIMS, (0.9864863, 0.8901573, 0.8107183, 0.7442893, 0.6879113), strict=True)))
_ARMS = " UNION ALL ".join(
    f"SELECT '{section}' AS section, '{key}' AS key, {arm} AS arm, case_id, value FROM cells WHERE dimension = '{d}' AND mode = '{m}' AND policy = '{p}'"
    for section, key, d1, m1, p1, d2, m2, p2 in decomposition.comparisons()
    for arm, d, m, p in ((1, d1, m1, p1), (2, d2, m2, p2))
)
_POLICY = "CASE policy " + " ".join(f"WHEN 'P{i}' THEN '{p}'" for i, p in enumerate(decomposition.POLICIES)) + " END"

ORACLE_SQL |= {
    "detector_intervals": f"""WITH {DETECTOR}, o AS (SELECT *, doc_id % 50 AS case_id, is_corrupted AND predicted AND (doc_id % 7 = doc_id % 3 OR doc_id % 7 = doc_id % 5) AS hit FROM det), {_draws('o', 'fault', 2000, '9')},
w AS (SELECT fault, b, score, sum(times * (is_corrupted AND predicted)::INTEGER) AS tp, sum(times * (NOT is_corrupted AND predicted)::INTEGER) AS fp, sum(times * (is_corrupted AND NOT predicted)::INTEGER) AS fn, sum(times * hit::INTEGER) AS located,
  sum(times * is_corrupted::INTEGER) AS pos, sum(times * (NOT is_corrupted)::INTEGER) AS neg FROM dr JOIN o USING (fault, case_id) GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fault, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w),
r AS (SELECT fault, b, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(located)::DOUBLE AS located, sum(pos)::DOUBLE AS pos, sum(neg)::DOUBLE AS neg, sum(pos * (below + neg / 2))::DOUBLE AS wins FROM c GROUP BY ALL),
m AS ({' UNION ALL '.join(f"SELECT fault, b, '{n}' AS metric, {x} AS v FROM r" for n, x in _METRICS.items())})
SELECT fault, metric, {_interval('v')} FROM m GROUP BY fault, metric""",
    "study_score_rows": f"""WITH {FINAL2}, s AS ({_LONG}), ms AS (SELECT variant, policy, metric, case_id, sum(value) AS total, count(*) AS n FROM s WHERE value IS NOT NULL GROUP BY ALL), {_draws('ms', 'variant, policy, metric', 2000, '3')},
r AS (SELECT variant, policy, metric, b, sum(times * total) / sum(times * n) AS v FROM dr JOIN ms USING (variant, policy, metric, case_id) GROUP BY ALL), i AS (SELECT variant, policy, metric, {_interval('v')} FROM r GROUP BY ALL),
n AS (SELECT variant, policy, metric, count(DISTINCT case_id) FILTER (value IS NOT NULL) AS n_cases, count(value) AS n_scores, count(*) - count(value) AS n_incomplete FROM s GROUP BY ALL)
SELECT variant, policy, metric, estimate, low, high, CASE WHEN n_scores > 0 THEN 'case-clustered percentile bootstrap (B=2000)' ELSE 'all scores INCOMPLETE' END AS method, n_cases, n_scores, n_incomplete FROM n LEFT JOIN i USING (variant, policy, metric)""",
    "trend_comparisons": f"""WITH {BASE}, e AS (SELECT case_id, attempt_index, {_POLICY} AS policy, CASE WHEN attempt_index % 2 = 0 THEN '{decomposition.MODES[0]}' ELSE '{decomposition.MODES[1]}' END AS mode, value FROM attempts),
d AS (SELECT *, '{decomposition.PATIENT}' AS dimension, value AS v FROM e UNION ALL SELECT *, '{decomposition.DOCTOR}', CASE WHEN attempt_index % 7 <> 0 THEN value * 0.9::DOUBLE END FROM e),
cells AS (SELECT dimension, mode, policy, case_id, v AS value FROM d QUALIFY row_number() OVER (PARTITION BY dimension, mode, policy, case_id ORDER BY attempt_index DESC) = 1), arms AS ({_ARMS}),
pairs AS (SELECT section, key, case_id, max(value) FILTER (arm = 1) - max(value) FILTER (arm = 2) AS diff FROM arms GROUP BY ALL), ms AS (SELECT * FROM pairs WHERE diff IS NOT NULL), {_draws('ms', 'section, key', 2000, '5')},
r AS (SELECT section, key, b, sum(times * diff) / sum(times) AS v FROM dr JOIN ms USING (section, key, case_id) GROUP BY ALL), i AS (SELECT section, key, {_interval('v')} FROM r GROUP BY ALL),
n AS (SELECT section, key, count(diff) AS n_cases, count(*) - count(diff) AS n_dropped FROM pairs GROUP BY ALL)
SELECT section, key, n_cases, n_dropped, estimate, low, high, low > 0 OR high < 0 AS excludes_zero FROM n JOIN i USING (section, key) WHERE n_cases > 0""",
}

_REDACTED = "'(?i)\\b(?:blue|ring|red)\\b'"

ORACLE_SQL |= {
    "score_defects": """WITH e AS (SELECT CASE WHEN event_id % 5 <> 0 THEN value / 50 END AS v, CASE WHEN event_id % 4 = 0 THEN 'incomplete' WHEN event_id % 9 = 0 THEN 'unknown' ELSE 'pass' END AS s, event_id % 3 = 0 AS why FROM events)
SELECT CASE WHEN s = 'unknown' THEN 'unknown status' WHEN s = 'incomplete' AND v IS NOT NULL THEN 'an incomplete score carries a value' WHEN s = 'incomplete' AND NOT why THEN 'an incomplete score has no reason'
  WHEN s <> 'incomplete' AND v IS NULL THEN 'a measured score has no value' WHEN s <> 'incomplete' AND NOT (v BETWEEN 0 AND 1) THEN 'a value outside 0 to 1' ELSE 'sound' END AS defect, count(*) AS n FROM e GROUP BY 1""",
    "leakage_events": f"""WITH {BASE}, e AS (SELECT dialogue_id, index, coalesce(who, 'Doctor') AS said, CASE WHEN dialogue_id % 2 = 0 THEN 'Patient' ELSE coalesce(who, 'Doctor') END AS role,
  CASE (dialogue_id + index) % 3 WHEN 0 THEN 'core.diagnoses' WHEN 1 THEN 'context.demographics' ELSE 'core.nothing' END AS path FROM turns),
j AS (SELECT role, CASE WHEN index % 4 = 3 THEN 'no such turn' WHEN said <> role THEN 'role differs' WHEN path = 'core.nothing' THEN 'no such path' ELSE '' END AS defect, path FROM e)
SELECT role, defect, defect = '' AND path = 'core.diagnoses' AS leak, count(*) AS n FROM j GROUP BY ALL""",
    "unevidenced_entities": """WITH n AS (SELECT text, length(substr(text, 3, 6)) AS a, length(substr(text, 9, 4)) AS b FROM documents),
s AS (SELECT a > 0 AND 2 + a <= length(text) AS sound, b > 0 AND 1 + b <= length(text) AND substr(text, 2, b) = substr(text, 9, 4) AS odd FROM n)
SELECT path, count(*) AS n FROM (SELECT 'core.diagnoses[0]' AS path FROM s WHERE NOT coalesce(sound, false) UNION ALL SELECT 'core.diagnoses[1]' FROM s WHERE NOT coalesce(odd, false) UNION ALL SELECT 'core.diagnoses[2]' FROM s WHERE NOT coalesce(odd, false) AND NOT coalesce(sound, false)
  UNION ALL SELECT 'core.diagnoses[3]' FROM s UNION ALL SELECT 'core.symptoms[0]' FROM s) GROUP BY 1""",
    "policy_contexts": f"""WITH {REFS} SELECT o_orderkey AS case_id, 'NO_DIAGNOSIS@2.0' AS policy, len(regexp_extract_all('comes with ' || top, {_REDACTED}))::BIGINT AS redactions,
  regexp_replace('comes with ' || top, {_REDACTED}, '[REDACTED]', 'g') AS patient_sees, o_orderpriority AS doctor_sees, 'comes with ' || top AS evaluator_sees FROM orders JOIN refs ON o_orderkey = l_orderkey""",
}

_JUDGED = " + ".join(f"{w}::DOUBLE * CASE WHEN event_id % {17 + i} <> 0 THEN value / {70 + 7 * i} END" for i, w in enumerate(corpus.JUDGE.values()))

ORACLE_SQL |= {
    "first_note": f"""WITH {BASE} SELECT hadm_id, row_id, md5(text) AS text_md5 FROM notes QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY NOT contains(lower(category), 'discharge summary'), row_id) = 1""",
    "note_lookup": f"""WITH {BASE}, n AS (SELECT hadm_id AS row_id, CASE WHEN hadm_id % 7 = 0 THEN subject_id + 1 ELSE subject_id END AS s FROM admissions)
SELECT n.row_id, p.subject_id, a.hadm_id, segment, admission_type FROM n JOIN patients p ON p.subject_id = s JOIN admissions a ON a.subject_id = s AND a.hadm_id = n.row_id""",
    "safe_components": """WITH n AS (SELECT p_partkey, ' .' || p_name || '/' || p_type || '-' AS t FROM part),
c AS (SELECT *, substr(regexp_replace(regexp_replace(t, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 72) AS s FROM n)
SELECT p_partkey, CASE WHEN s = '' THEN 'case' ELSE s END || '-' || substr(sha256(t), 1, 8) AS component FROM c""",
    "judge_weighted": f"""WITH s AS (SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)) AS score FROM (SELECT event_id, 0.0::DOUBLE + {_JUDGED} AS x FROM events) WHERE x IS NOT NULL)
SELECT e.event_id, score, CASE WHEN score >= {corpus.REALISTIC} THEN 'REALISTIC' WHEN score IS NOT NULL THEN 'UNREALISTIC' END AS decision FROM events e LEFT JOIN s ON s.event_id = e.event_id""",
    "variant_acceptance": f"WITH {BASE} SELECT variant, count(*) FILTER (acceptance LIKE '%ACCEPT') AS accepted, count(*) AS total FROM attempts GROUP BY 1",
    "profile_statistics": f"""WITH {BASE}, r AS (SELECT CASE WHEN attempt_index % 19 <> 0 THEN policy ELSE 'UNKNOWN' END AS profile_type, acceptance <> 'REJECT' AS ok, coalesce(attempt_index % 3 <> 0 AND value >= 0.5, false) AS real, value FROM attempts)
SELECT profile_type, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS fail, count(*) FILTER (ok AND real) AS realistic, count(*) FILTER (ok AND NOT real) AS non_realistic, round(avg(value) FILTER (ok), 6) AS avg_judge_score FROM r GROUP BY 1""",
    "profile_texts": """WITH i AS (SELECT l_orderkey, p_name, p_brand, l_suppkey::VARCHAR AS dose FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey AS case_id, md5(string_agg(p_name || ' (seen with ' || p_brand || ')', '; ' ORDER BY p_name, p_brand)) AS diagnoses_md5, md5('procedure; medications: ' || string_agg(p_brand, ', ' ORDER BY p_brand, dose)) AS treatments_md5 FROM i GROUP BY 1""",
}
