"""Statistical operators: paired differences, bootstrap, sign flips, multiplicity, detectors, agreement.

Random choices are made by SHA-256 of seed, replicate and slot, so any engine can repeat
them; ``mersenne_bootstrap`` uses Python's generator where bit parity with it is wanted.
Cases are reduced to sums and counts before anything is replicated.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from hashlib import sha256
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.functions.text import jaccard
from clinloom.session import materialize, ship


def paired(df: DataFrame, arm: str, a: str, b: str) -> DataFrame:
    """(case_id, difference) of cases measured in both arms; null where an arm isn't measured."""
    value = lambda name: F.max(F.when(F.col(arm) == name, F.col("value")))
    both = df.where(F.col(arm).isin(a, b)).groupBy("case_id").agg(value(a).alias("a"), value(b).alias("b"))
    return both.select("case_id", (F.col("a") - F.col("b")).alias("difference"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """Cases used and dropped, and the mean difference."""
    d = F.col("difference")
    return pairs.agg(F.count(d).alias("n_cases"), F.count_if(d.isNull()).alias("n_dropped"), F.avg(d).alias("mean_difference"))


def clusters(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per case: the sum and number of its measured values."""
    measured = df.where("value is not null")
    return measured.groupBy(*by, "case_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


#: Ranges of scores by which a detector's scores are ranked, and hexadecimal digits of the hash ranges of cases.
RANGES, HASH_DIGITS = 64, 2


def matched(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on equal ``by``, where a null equals a null; ``right`` adds its other columns."""
    named = right.select(*[F.col(c).alias(f"_{c}_of") if c in by else F.col(c) for c in right.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in by], F.lit(True))
    return left.join(named, same, how).drop(*[f"_{c}_of" for c in by])


def hash_ranked(df: DataFrame, by: Sequence[str], key: str, name: str, digits: int = HASH_DIGITS, digest: Column | None = None) -> DataFrame:
    """``df`` with the 0-based rank of each row within its group by (digest, key); the digest is the key's MD5.

    A group's rows are ranked inside hash ranges and shifted by the counts of the ranges
    before, of which there are 16^digits a group; more digits serve larger groups.
    """
    hashed = df.withColumn("_hash", F.md5(F.col(key).cast("string").cast("binary")) if digest is None else digest).withColumn("_range", F.substring("_hash", 1, digits))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_range").orderBy("_hash", key)
    ranked = matched(hashed.withColumn("_inner", F.row_number().over(inside) - 1), counts, [*by, "_range"])
    return ranked.withColumn(name, F.col("_before") + F.col("_inner")).drop("_hash", "_range", "_inner", "_before")


def _number(seed: str, replicate: Column, slot: Column) -> Column:
    """The first 32 bits of a hash, which a group of n cases takes modulo n."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), replicate.cast("string"), slot.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


#: Slots that one row stands for until it is in its own task.
SLOTS = 4096
#: At most this many cases are broadcast to the slots.
BROADCAST_CASES = 200_000


def slots(sizes: DataFrame, resamples: int, seed: str) -> DataFrame:
    """(cases, replicate, ordinal): for each distinct size a row for each replicate and each of its slots.

    A slot's hash is the same for every size, so it is made once, not once a group. Blocks of slots are dealt out
    by (replicate, block) before they become rows, to a fixed number of tasks: the blocks are few and small, and
    Spark would else put them, and so all slots, in one. A block carries the distinct sizes that reach it, of which
    there are at most the square root of twice the cases.
    """
    if resamples < 1:
        raise ValueError("resamples must be positive")
    blocks = sizes.select("cases").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cases") - 1) / SLOTS))))
    held = blocks.groupBy("_block").agg(F.collect_set("cases").alias("_sizes")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    dealt = held.repartition(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "replicate", "_block")
    first = F.col("_block") * SLOTS
    numbers = F.transform(F.sequence(first, F.least(F.array_max("_sizes"), first + SLOTS) - 1), lambda slot: _number(seed, F.col("replicate"), slot))
    each = dealt.withColumn("_numbers", numbers).withColumn("cases", F.explode("_sizes"))
    each = each.select("cases", "replicate", F.explode(F.slice("_numbers", F.lit(1), F.least(F.col("cases") - first, F.lit(SLOTS)).cast("int"))).alias("_number"))
    return each.select("cases", "replicate", (F.col("_number") % F.col("cases")).alias("ordinal"))


def resampled(cases: DataFrame, by: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """``cases`` (a row a case of its group) with ``cases``, ``replicate`` and a row for each time that a case is drawn; replicate -1 has every case once.

    Cases are numbered in the order of a hash, range by range, and written once, so that what goes before isn't done
    again for the sizes, and so that they can be counted. Up to ``BROADCAST_CASES`` are broadcast, and sums are then combined
    where the slots are made; more are joined by (size, number). The slots, whose number Spark can't foresee, never are.
    """
    sizes = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"))
    numbered = materialize(matched(hash_ranked(cases, by, "case_id", "ordinal"), sizes, by), "cases")
    few = numbered.count() <= BROADCAST_CASES
    drawn = slots(numbered, resamples, seed).join(F.broadcast(numbered) if few else numbered.hint("merge"), ["cases", "ordinal"])
    return drawn.drop("ordinal").unionByName(numbered.drop("ordinal").withColumn("replicate", F.lit(-1)))


#: Cases of a group that are packed into one row, slots of a task, and hashes of slots that it holds at a time.
PACKED, TASK_SLOTS, HASHES = 1 << 18, 1 << 20, 1 << 24
#: Up to this many packed values are broadcast to the tasks; more are dealt to them.
BROADCAST_VALUES = 4_000_000


def _packed(numbered: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A row for each run of ``PACKED`` cases of a group: its size, the run's first ordinal and the values in order."""
    run = F.floor(F.col("ordinal") / PACKED).alias("_run")
    item = F.struct("ordinal", *[F.col(v).cast("double").alias(v) for v in values])
    held = numbered.groupBy(*by, "cases", run).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return held.select(*by, "cases", (F.col("_run") * PACKED).cast("long").alias("_first"), *[F.col(f"_items.{v}").alias(v) for v in values])


def _hashes(seed: str, replicate: int, first: int, last: int) -> np.ndarray:
    """The first 32 bits of SHA-256 of seed, replicate and slot, for a range of slots; a group of n cases takes them modulo n."""
    head = f"{seed}|{replicate}|".encode()
    return np.frombuffer(b"".join([sha256(head + b"%d" % slot).digest()[:4] for slot in range(first, last)]), ">u4").astype(np.uint32)


def _drawn_sums(seed: str, by: Sequence[str], values: Sequence[str]) -> Callable:
    """For mapInArrow: each packed row meets each task's replicates and slots; the sums of what is drawn of it, a row a replicate."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers = None, {}
        for batch in batches:
            keys = batch.select(by)
            for i, (first, last, low, high, cases, start) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_low", "_high", "_slot", "_end", "cases", "_first")], strict=True)):
                if at != (first, low):
                    at, numbers = (first, low), {}
                held = [batch.column(v)[i].values.to_numpy(zero_copy_only=False) for v in values]
                out = np.empty((len(values), last - first))
                for r in range(first, last):
                    if r not in numbers:
                        numbers[r] = _hashes(seed, r, low, high)
                    ordinal = numbers[r][: max(0, cases - low)] % np.uint32(cases)
                    if cases > len(held[0]):  # of a group in several runs, what falls into this one
                        ordinal = ordinal[(ordinal >= start) & (ordinal < start + len(held[0]))] - np.uint32(start)
                    for k, v in enumerate(held):
                        out[k, r - first] = v.take(ordinal).sum()
                n = last - first
                same = pa.RecordBatch.from_arrays([keys.column(c).take(pa.array([i] * n)) for c in by], names=list(by)) if by else None
                arrays = [*(same.columns if by else []), pa.array([cases] * n, pa.int64()), pa.array(range(first, last), pa.int32()), *[pa.array(x) for x in out]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*by, "cases", "replicate", *values])

    return sums


def resampled_sums(cases: DataFrame, by: Sequence[str], values: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """(by, cases, replicate, values): the sums of ``values`` over the cases that a replicate draws; replicate -1 has every case once.

    ``cases`` has a row a case of its group. Cases are numbered in the order of a hash, range by range, and packed into
    arrays. A task has some replicates and a range of slots, makes their hashes once for all groups, and takes each
    array's values by them: no draw ever is a row, and what is shuffled are arrays and sums. Few arrays are broadcast.
    """
    if resamples < 1:
        raise ValueError("resamples must be positive")
    spark = cases.sparkSession
    sizes = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"))
    numbered = matched(hash_ranked(cases, by, "case_id", "ordinal"), sizes, by)
    packed = materialize(_packed(numbered, by, values), "cases")
    n_values, most = packed.agg(F.coalesce(F.sum(F.size(values[0])), F.lit(0)) * len(values), F.coalesce(F.max("cases"), F.lit(0))).first()
    wide = max(1, min(most, TASK_SLOTS))
    each = max(1, min(HASHES // wide, -(-resamples // (4 * spark.sparkContext.defaultParallelism))))
    parts = spark.range(-(-resamples // each)).select((F.col("id") * each).cast("int").alias("_low"), F.least(F.lit(resamples), (F.col("id") + 1) * each).cast("int").alias("_high"))
    ranges = spark.range(max(1, -(-most // wide))).select((F.col("id") * wide).alias("_slot"), ((F.col("id") + 1) * wide).alias("_end"))
    tasks = parts.crossJoin(F.broadcast(ranges))
    n_tasks = -(-resamples // each) * max(1, -(-most // wide))
    n_parts = max(1, min(n_tasks, 4096))
    reached = F.col("cases") > F.col("_slot")
    if n_values <= BROADCAST_VALUES:
        met = tasks.repartitionByRange(n_parts, "_slot", "_low").join(F.broadcast(packed), reached)
    else:
        met = packed.join(F.broadcast(tasks), reached).repartitionByRange(n_parts, "_slot", "_low").sortWithinPartitions("_slot", "_low")
    ship(spark)
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in cases.select(*by).schema], "cases long", "replicate int", *[f"{v} double" for v in values]])
    drawn = met.mapInArrow(_drawn_sums(seed, list(by), list(values)), kinds)
    once = packed.select(*by, "cases", F.lit(-1).alias("replicate"), *[F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias(v) for v in values])
    return drawn.unionByName(once).groupBy(*by, "cases", "replicate").agg(*[F.sum(v).alias(v) for v in values])


def bootstrap(cases: DataFrame, by: Sequence[str], resamples: int, seed: str, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals of pooled means, whole cases drawn with replacement.

    ``cases`` is the output of ``clusters``. A group with n cases makes n x resamples draws, which are
    summed where they are made (``resampled_sums``).
    """
    means = resampled_sums(cases, by, ["total", "n"], resamples, seed).withColumn("mean", F.col("total") / F.col("n"))
    drawn, tail = F.when(F.col("replicate") >= 0, F.col("mean")), (1 - confidence) / 2
    return means.groupBy(*by, "cases").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("mean"))).alias("estimate"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high")
    )


def _quantile(ordered: list[float], q: float) -> float:
    at = q * (len(ordered) - 1)
    low = int(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)


#: Words of the generator that are made at a time.
WORDS = 1 << 20


def _choices(seed: int, n: int, resamples: int) -> Iterator[np.ndarray]:
    """The n places that ``random.Random(seed).choice`` takes in a sequence of n, again and again.

    Python takes a word's upper bits, as many as n has, and the next word's where they are n or more; numpy's generator makes
    the same words from the same state, an array at a time.
    """
    if n >= 1 << 32:
        raise ValueError("a choice takes one word: fewer than 2^32 cases")
    state = random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    shift, held = 32 - n.bit_length(), np.empty(0, np.int64)
    for _ in range(resamples):
        parts, have = [held], len(held)
        while have < n:
            more = (words.random_raw(min(WORDS, 2 * n + 64)) >> shift).astype(np.int64)
            parts.append(more[more < n])
            have += len(parts[-1])
        held = np.concatenate(parts)
        yield held[:n]
        held = held[n:]


def mersenne_bootstrap(df: DataFrame, by: Sequence[str], resamples: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """The same interval with draws of Python's Mersenne Twister, a group at a time.

    A group's cases are in one task, as are its draws, which follow one another; they are made and summed as arrays.
    ``bootstrap`` has no such bound.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)

    ship(df.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf["value"].notna()]
        groups = {k: g["value"].tolist() for k, g in held.groupby("case_id", sort=True)}
        head = [pdf[c].iloc[0] for c in by]
        if not groups:
            return pd.DataFrame([[*head, 0, None, None, None]], columns=[*by, "cases", "estimate", "low", "high"])
        keys = list(groups)
        totals, counts = np.array([math.fsum(v) for v in groups.values()]), np.array([len(v) for v in groups.values()])
        means = [totals.take(at).sum() / counts.take(at).sum() for at in _choices(seed, len(keys), resamples)]
        means.sort()
        tail = (1 - confidence) / 2
        return pd.DataFrame([[*head, len(keys), held["value"].mean(), _quantile(means, tail), _quantile(means, 1 - tail)]], columns=[*by, "cases", "estimate", "low", "high"])

    return df.groupBy(*by).applyInPandas(one, f"{fields}, cases long, estimate double, low double, high double")


def sign_flip_exact(pairs: DataFrame, most: int = 20) -> DataFrame:
    """The exact two-sided sign-flip p-value of at most ``most`` paired differences.

    The differences, bounded in number, form one array; the 2^n assignments are rows.
    """
    held = pairs.where("difference is not null").agg(F.array_sort(F.collect_list(F.struct("case_id", "difference"))).alias("d"))
    held = held.withColumn("n", F.size("d")).withColumn("checked", F.when(F.col("n") > most, F.raise_error(F.lit("too many pairs for an exact test"))).otherwise(F.lit(True)))
    flips = held.where("n > 0 and checked").withColumn("bits", F.explode(F.expr("sequence(0L, shiftleft(1L, n) - 1)")))
    flipped = F.expr("abs(aggregate(sequence(0, n - 1), 0D, (s, i) -> s + if(getbit(bits, i) = 1, -d[i].difference, d[i].difference)) / n)")
    actual = F.expr("abs(aggregate(d, 0D, (s, x) -> s + x.difference) / n)")
    out = flips.select("n", flipped.alias("f"), actual.alias("o"))
    return out.groupBy("n", "o").agg(F.avg((F.col("f") + 1e-12 >= F.col("o")).cast("double")).alias("p_value")).select(F.col("n").cast("long").alias("n_cases"), F.col("o").alias("observed"), "p_value")


#: Replicates whose signs come from one digest.
SIGN_BITS = 60


def sign_flip(pairs: DataFrame, most: int = 20, resamples: int = 20_000, seed: str = "0") -> DataFrame:
    """The two-sided sign-flip p-value of all paired differences: exact up to ``most`` pairs, else by Monte Carlo.

    A pair's signs in sixty replicates are the bits of one SHA-256 of seed, replicates and
    case; sums are grouped by replicates. The p-value is (extreme + 1) / (resamples + 1).
    """
    held = pairs.where("difference is not null").select(F.col("case_id").cast("string").alias("case_id"), F.col("difference").cast("double").alias("x"))
    if pairs.where("difference is not null").limit(most + 1).count() <= most:
        return sign_flip_exact(pairs, most)
    if resamples < 1:
        raise ValueError("resamples must be positive")
    actual = held.agg(F.count("x").alias("n_cases"), F.abs(F.avg("x")).alias("observed"))
    dealt = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // SIGN_BITS))))
    dealt = dealt.withColumn("bits", F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "part", "case_id"), 256), 1, SIGN_BITS // 4), 16, 10).cast("long"))
    sums = dealt.groupBy("part").agg(*[F.sum(F.expr(f"if(getbit(bits, {i}) = 1, x, -x)")).alias(f"s{i}") for i in range(SIGN_BITS)])
    means = sums.select("part", F.posexplode(F.array(*[f"s{i}" for i in range(SIGN_BITS)])).alias("i", "s")).where(F.col("part") * SIGN_BITS + F.col("i") < resamples)
    extreme = means.crossJoin(F.broadcast(actual)).groupBy("n_cases", "observed").agg(F.count_if(F.abs(F.col("s") / F.col("n_cases")) + 1e-12 >= F.col("observed")).alias("extreme"))
    return extreme.select("n_cases", "observed", ((F.col("extreme") + 1) / (resamples + 1)).alias("p_value"))


def adjusted(p: DataFrame, label: str = "label", family: str | None = None) -> DataFrame:
    """Holm and Benjamini-Hochberg adjustment of (label, p_value), within a family if one is named."""
    w = Window.partitionBy(family) if family else Window.partitionBy(F.lit(1))
    up, n = w.orderBy("p_value", label), F.count(F.lit(1)).over(w)
    ranked = p.withColumn("_rank", F.row_number().over(up)).withColumn("_n", n)
    holm = F.max((F.col("_n") - F.col("_rank") + 1) * F.col("p_value")).over(up.rowsBetween(Window.unboundedPreceding, 0))
    back = w.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    bh = F.min(F.col("p_value") * F.col("_n") / F.col("_rank")).over(back)
    out = ranked.withColumn("holm", F.least(F.lit(1.0), holm)).withColumn("bh", F.least(F.lit(1.0), bh))
    return out.drop("_rank", "_n")


def confusion(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, precision, recall, F1 of a detector; zero where a denominator is."""
    truth, said = F.col("is_corrupted"), F.col("predicted")
    c = df.groupBy(*by).agg(
        F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn")
    )
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    out = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def auc(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the curve with ties at a half, from average ranks; null without both classes.

    Scores are first counted by distinct value, so only distinct scores are ranked, in
    ``RANGES`` ranges a group: no group's scores are in one task. Null scores don't count.
    """
    df = df.where("score is not null")
    truth = F.col("is_corrupted")
    held = df.groupBy(*by, "score").agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    # Ranges of scores: negatives below are those of the ranges before and, inside, of lower scores.
    edges = [i / RANGES for i in range(1, RANGES)]
    cuts = held.groupBy(*by).agg(F.percentile_approx("score", edges, 100 * RANGES).alias("_cuts"))
    held = held.join(F.broadcast(cuts), list(by)) if by else held.crossJoin(F.broadcast(cuts))
    held = held.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*by, "_range").agg(F.sum("neg").alias("_neg"))
    totals = totals.select(*by, "_range", F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_before"))
    below = held.join(F.broadcast(totals), [*by, "_range"]).withColumn("below", F.col("_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    sums = below.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    return sums.withColumn("auc", F.try_divide(F.col("wins"), F.col("positives") * F.col("negatives"))).drop("wins")


def complete_matrix(df: DataFrame, least: int = 2) -> DataFrame:
    """``df`` (case_id, rater), a row an extraction; raises unless each of at least ``least`` raters has each case exactly once.

    Agreement over cases that some raters didn't see would be an agreement of other cases with others.
    """
    pairs = df.groupBy("case_id", "rater").agg(F.count(F.lit(1)).alias("n"))
    raters = [r["rater"] for r in pairs.select("rater").distinct().orderBy("rater").limit(1001).collect()]
    if len(raters) < least or len(raters) > 1000:
        raise ValueError(f"{len(raters)} raters: agreement takes from {least} to 1000")
    if twice := pairs.where("n > 1").orderBy("case_id", "rater").limit(1).collect():
        raise ValueError(f"case {twice[0]['case_id']} has more than one extraction of {twice[0]['rater']}")
    short = pairs.groupBy("case_id").agg(F.collect_set("rater").alias("have")).where(F.size("have") < len(raters)).orderBy("case_id").limit(5).collect()
    if missing := [f"{r['case_id']}/{x}" for r in short for x in raters if x not in r["have"]][:5]:
        raise ValueError(f"raters must have the same cases; missing {', '.join(missing)}")
    return df


def agreement(df: DataFrame, raters: int) -> DataFrame:
    """Fleiss' kappa of (case_id, rater, entity) presence: units are a case's distinct entities."""
    units = df.select("case_id", "rater", "entity").distinct().groupBy("case_id", "entity").agg(F.count(F.lit(1)).alias("p"))
    p, r = F.col("p"), raters
    share = (p * (p - 1) + (r - p) * (r - p - 1)) / (r * (r - 1))
    out = units.agg(F.count(F.lit(1)).alias("n_units"), F.avg(share).alias("observed"), (F.sum("p") / (F.count(F.lit(1)) * r)).alias("rate"))
    out = out.withColumn("expected", F.col("rate") * F.col("rate") + (1 - F.col("rate")) * (1 - F.col("rate")))
    return out.select("n_units", "observed", "expected", F.when(1 - F.col("expected") > 1e-12, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def pairwise_jaccard(df: DataFrame, most: int = 64) -> DataFrame:
    """Mean Jaccard index of the raters' entity sets, over all pairs of raters in all cases.

    Every rater has a set in every case: an empty one where no row names an entity, and two
    empty ones agree. A row with a null entity only says that the rater saw the case. One
    grouping by case; raters, of whom there are few, become columns.
    """
    raters = [r["rater"] for r in df.select("rater").distinct().limit(most + 1).collect()]
    if len(raters) > most:
        raise ValueError(f"more than {most} raters")
    pairs = [jaccard(F.col(f"e{i}"), F.col(f"e{j}"), 1.0) for i in range(len(raters)) for j in range(i + 1, len(raters))]
    if not pairs:
        return df.sparkSession.createDataFrame([(0, None)], "n_pairs long, mean_jaccard double")
    named = df.groupBy("case_id").agg(*[F.collect_set(F.when(F.col("rater") == r, F.col("entity"))).alias(f"e{i}") for i, r in enumerate(sorted(raters))])
    return named.select(F.explode(F.array(*pairs)).alias("j")).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("j").alias("mean_jaccard"))
