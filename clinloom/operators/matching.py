"""Entity matching: normalisation rules, the granularity ladder, one-to-one assignment.

A matcher is a declared list of rules and tables, compiled into column expressions. Best
candidates come from a grouped maximum; the maximum-cardinality assignment, which has no
relational form, runs per (case, field), whose entities are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.functions import icd9
from clinloom.functions import text as tx
from clinloom.session import ship

RANK = {"exact_code": 4, "generic_equivalent": 3, "exact_description": 3, "category_3digit": 2, "description_overlap": 1, "none": 0}


@dataclass(frozen=True)
class Matcher:
    """Rules in order, tables by name, and the granularities that count."""

    rules: tuple[str, ...]
    granularities: tuple[str, ...]
    tables: Mapping[str, object] = field(default_factory=dict)
    overlap: float = 0.6
    unicode: bool = True

    def _apply(self, rule: str, text: Column) -> Column:
        u = self.unicode
        flag = "(?U)" if u else ""
        table = self.tables.get
        if rule == "lowercase":
            return F.lower(text)
        if rule == "strip_punctuation":
            return F.regexp_replace(text, rf"{flag}[^\w\s]+", " ")
        if rule == "collapse_whitespace":
            return tx.collapse(text, u)
        if rule in ("expand_abbreviations", "apply_synonyms", "brand_to_generic"):
            name = {"expand_abbreviations": "abbreviations", "apply_synonyms": "synonyms"}.get(rule, rule)
            return tx.substitute(text, table(name, {}), u)
        if rule in ("drop_coding_qualifiers", "drop_stopwords", "strip_salt_forms"):
            name = {"drop_coding_qualifiers": "coding_qualifiers", "drop_stopwords": "stopwords"}.get(rule, "salt_forms")
            return tx.remove(text, table(name, ()), u)
        if rule == "strip_dose_and_form":
            units = sorted(table("dose_units", ()), key=len, reverse=True)
            for unit in units:
                text = F.regexp_replace(text, tx.bounded(rf"\d+(?:\.\d+)?\s*{unit}", u), " ")
            text = F.regexp_replace(text, tx.bounded(r"\d+(?:\.\d+)?", u), " ")
            return tx.remove(tx.remove(text, units, u), table("dose_forms", ()), u)
        raise ValueError(f"unknown rule {rule!r}")

    def normalise(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the normal form and the rules that changed it.

        Each rule is a projection of its own: a rule reads the one before once, so the
        expression stays linear in the number of rules.
        """
        keep = df.columns
        out = df.withColumn("_now", F.col(column)).withColumn("_trace", F.array().cast("array<string>"))
        for rule in self.rules:
            out = out.withColumn("_next", self._apply(rule, F.col("_now")))
            fired = F.when(F.col("_next") != F.col("_now"), F.concat("_trace", F.array(F.lit(rule)))).otherwise(F.col("_trace"))
            out = out.select(*keep, F.col("_next").alias("_now"), fired.alias("_trace"))
        return out.select(*keep, tx.strip(F.col("_now"), self.unicode).alias(name), F.col("_trace").alias(f"{name}_trace"))

    def compare(self, left: str, right: str, left_code: str, right_code: str) -> tuple[Column, Column]:
        """(granularity, score) of normal forms ``left``, ``right`` and their codes."""
        a, b = F.col(left), F.col(right)
        bare = lambda c: F.regexp_replace(F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))), r"\.", "")
        ca, cb = bare(left_code), bare(right_code)
        coded, same = (ca != "") & (cb != ""), (a != "") & (a == b)
        brand = F.array_contains(f"{left}_trace", "brand_to_generic") | F.array_contains(f"{right}_trace", "brand_to_generic")
        share = tx.dice(tx.tokens(a), tx.tokens(b))
        tests = {
            "exact_code": coded & (ca == cb),
            "generic_equivalent": same & brand,
            "exact_description": same,
            "category_3digit": coded & (icd9.category(ca) == icd9.category(cb)),
            "description_overlap": share >= self.overlap,
        }
        level = F.lit("none")
        for name in reversed([n for n in tests if n in self.granularities]):
            level = F.when(tests[name], name).otherwise(level)
        weak = share if "description_overlap" in self.granularities else F.lit(0.0)
        return level, F.when(level.isin("none", "description_overlap"), weak).otherwise(F.lit(1.0))


def rank(level: Column) -> Column:
    out = F.lit(0)
    for name, value in RANK.items():
        out = F.when(level == name, value).otherwise(out)
    return out


def best_candidate(pairs: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Per extracted entity its strongest candidate: greatest (rank, score), the first of equals."""
    rest = [c for c in pairs.columns if c not in key]
    order = F.struct(rank(F.col("granularity")), F.col("score"), -F.col(pos))
    best = pairs.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def augment(candidates: dict[int, list[int]]) -> dict[int, int]:
    """A maximum matching, extracted -> coded; the most constrained are placed first."""
    owner: dict[int, int] = {}

    def place(e: int, tried: set[int]) -> bool:
        for c in candidates[e]:
            if c not in tried:
                tried.add(c)
                if c not in owner or place(owner[c], tried):
                    owner[c] = e
                    return True
        return False

    for e in sorted(candidates, key=lambda e: (len(candidates[e]), e)):
        place(e, set())
    return {e: c for c, e in owner.items()}


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (keys, _pairs): the pairs of each row that a maximum matching takes."""
    for batch in batches:
        kept = []
        for pairs in batch.column("_pairs").to_pylist():
            candidates: dict[int, list[int]] = {}
            # pandas' order: greatest rank and score first, unmeasured scores last, then the least coded
            order = sorted(pairs, key=lambda p: (-p["rank"], p["score"] is None or p["score"] != p["score"], -(p["score"] or 0.0), p["coded"]))
            for p in order:
                candidates.setdefault(p["extracted"], []).append(p["coded"])
            got = augment(candidates)
            kept.append([p for p in pairs if got.get(p["extracted"]) == p["coded"]])
        yield batch.set_column(batch.schema.get_field_index("_pairs"), "_pairs", pa.array(kept, batch.column("_pairs").type))


def assign(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Maximum one-to-one assignment per key of matched (extracted, coded, granularity, score) pairs.

    A case's pairs are collected into one row, so that a call of Python has a batch of cases, not one.
    """
    ship(pairs.sparkSession)
    item = F.struct(F.col("extracted").cast("long").alias("extracted"), F.col("coded").cast("long").alias("coded"), "granularity", F.col("score").cast("double").alias("score"), rank(F.col("granularity")).alias("rank"))
    cases = pairs.where("granularity != 'none'").groupBy(*key).agg(F.collect_list(item).alias("_pairs"))
    got = cases.mapInArrow(_assigned, cases.schema).select(*key, F.explode("_pairs").alias("_p"))
    return got.select(*key, *[F.col(f"_p.{c}").alias(c) for c in ("extracted", "coded", "granularity", "score")])


def grounding_counts(extracted: DataFrame, coded: DataFrame, assigned: DataFrame, by: list[str]) -> DataFrame:
    """True and false positives and misses with precision, recall and F1, summed over cases."""
    n = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    out = n(extracted, "n_extracted").join(n(coded, "n_coded"), by, "full_outer").join(n(assigned, "tp"), by, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select(*by, z("tp").alias("tp"), (z("n_extracted") - z("tp")).alias("fp"), (z("n_coded") - z("tp")).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
