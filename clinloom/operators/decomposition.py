"""Decomposition of a disclosure trend: curves, paired comparisons of cells, gradients, and its report.

A scored row has case_id, dialogue_id, policy, mode, dimension and a nullable value. A cell is a
(dimension, mode, policy); of several dialogues of a case in a cell the last one counts. Which
cells are compared is a small table; cells meet it by broadcast joins, so all comparisons are
one grouped plan, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.operators import intervals

# Dimensions, reference modes, and policies from the loosest to the strictest.
PATIENT, DOCTOR = "patient_factuality", "doctor_factuality"
MODES = ("full_reference", "policy_context")
POLICIES = ("FULL", "NO_DIAGNOSIS", "NO_DIAGNOSIS_NO_TREATMENT")


def comparisons(policies: Sequence[str] = POLICIES, modes: Sequence[str] = MODES) -> list[tuple[str, str, str, str, str, str, str, str]]:
    """(section, key, and dimension, mode, policy of either arm): what is compared, first minus second."""
    full, context = modes
    out = [("reference_scope", f"{d}::{p}", d, context, p, d, full, p) for p in policies for d in (PATIENT, DOCTOR)]
    out += [("turn_scope", f"{p}::{m}", PATIENT, m, p, DOCTOR, m, p) for p in policies for m in modes]
    return out + [("gradient", f"{d}::{m}", d, m, policies[-1], d, m, policies[0]) for d in (PATIENT, DOCTOR) for m in modes]


def cells(scored: DataFrame) -> DataFrame:
    """(dimension, mode, policy, case_id, value): one value a case and cell, that of the last dialogue."""
    by = ["dimension", "mode", "policy", "case_id"]
    return scored.groupBy(*by).agg(F.max_by(F.struct("value"), F.col("dialogue_id"))["value"].alias("value"))


def curves(scored: DataFrame, resamples: int = 2000, seed: str = "0") -> DataFrame:
    """Mean and interval of every cell, and its incomplete cases."""
    return intervals.score_rows(cells(scored), resamples, seed, by=("dimension", "mode", "policy"))


def compared(scored: DataFrame, resamples: int = 2000, seed: str = "0", policies: Sequence[str] = POLICIES, modes: Sequence[str] = MODES) -> DataFrame:
    """(section, key, n_cases, n_dropped, estimate, low, high, excludes_zero) of the comparisons that have cases in both arms.

    A case that only one arm measured is dropped and counted.
    """
    schema = "section string, key string, d1 string, m1 string, p1 string, d2 string, m2 string, p2 string"
    wanted = scored.sparkSession.createDataFrame(comparisons(policies, modes), schema)
    held, on = cells(scored), lambda i: [F.col("dimension") == F.col(f"d{i}"), F.col("mode") == F.col(f"m{i}"), F.col("policy") == F.col(f"p{i}")]
    arms = [held.join(F.broadcast(wanted), on(i)).select("section", "key", "case_id", F.lit(i).alias("arm"), "value") for i in (1, 2)]
    value = lambda i: F.max(F.when(F.col("arm") == i, F.col("value")))
    pairs = arms[0].unionByName(arms[1]).groupBy("section", "key", "case_id").agg(value(1).alias("a"), value(2).alias("b"))
    rows = intervals.score_rows(pairs.select("section", "key", "case_id", (F.col("a") - F.col("b")).alias("value")), resamples, seed, by=("section", "key"))
    shut = (F.col("low") > 0) | (F.col("high") < 0)
    return rows.where("n_cases > 0").select("section", "key", "n_cases", F.col("n_incomplete").alias("n_dropped"), "estimate", "low", "high", shut.alias("excludes_zero"))


def report(scored: DataFrame, resamples: int = 2000, seed: str = "0", policies: Sequence[str] = POLICIES, modes: Sequence[str] = MODES) -> tuple[dict[str, Any], str]:
    """(record, Markdown) of the whole decomposition; the driver gets a few dozen rows."""
    drawn = curves(scored, resamples, seed).collect()
    paired = compared(scored, resamples, seed, policies, modes).collect()
    size = scored.agg(F.count_distinct("case_id").alias("c"), F.count_distinct("dialogue_id").alias("d")).first()
    interval = lambda r: {"estimate": r["estimate"], "low": r["low"], "high": r["high"]}
    record: dict[str, Any] = {"curves": {}, "reference_scope": {}, "turn_scope": {}, "gradient": {}, "incomplete": {}, "n_cases": size["c"], "n_dialogues": size["d"]}
    for r in sorted(drawn, key=lambda r: (r["dimension"], r["mode"], r["policy"])):
        label = f"{r['dimension']}::{r['mode']}"
        if r["n_cases"]:
            record["curves"].setdefault(label, {})[r["policy"]] = interval(r)
        if r["n_incomplete"]:
            record["incomplete"][f"{label}::{r['policy']}"] = r["n_incomplete"]
    for r in sorted(paired, key=lambda r: (r["section"], r["key"])):
        record[r["section"]][r["key"]] = {**interval(r), "n_cases": r["n_cases"], "n_dropped": r["n_dropped"], "excludes_zero": r["excludes_zero"]}
    lines = ["# Decomposition of the trend", "", f"{size['d']} dialogues over {size['c']} cases; intervals are percentiles over resampled cases.", "", "| dimension and mode | " + " | ".join(policies) + " |", "|---" * (len(policies) + 1) + "|"]
    for label, curve in record["curves"].items():
        shown = [f"{c['estimate']:.3f} [{c['low']:.3f}, {c['high']:.3f}]" if (c := curve.get(p)) else "not measured" for p in policies]
        lines.append(f"| {label} | " + " | ".join(shown) + " |")
    for section in ("reference_scope", "turn_scope", "gradient"):
        lines += ["", f"## {section.replace('_', ' ')}", "", "| comparison | difference | cases | dropped | excludes 0 |", "|---" * 5 + "|"]
        lines += [f"| {k} | {x['estimate']:+.3f} [{x['low']:+.3f}, {x['high']:+.3f}] | {x['n_cases']} | {x['n_dropped']} | {'yes' if x['excludes_zero'] else 'no'} |" for k, x in record[section].items()]
    lines += ["", "## incomplete", ""] + ([f"- {k}: {n}" for k, n in record["incomplete"].items()] or ["none"])
    return record, "\n".join([*lines, ""])
