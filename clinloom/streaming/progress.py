"""The rows of ``operators.progress`` from a stream, by a processor with state for each dialogue.

Turns are taken in the order of their index, whatever the order in which they arrive: one that comes before its
turn waits in a map, one that was taken already (or has a smaller index) is given back as ``late``. If a gap is not filled
for ``gap_ms``, a timer lets what waits go on without it (give such a query a running trigger: with ``availableNow``
it does not end, as a timer may always fire). State of a dialogue:

* value ``at``: the next index, turns, rounds, inquiries, whether and how the doctor has concluded, exchanges, streak, end;
* lists ``recent`` (for loops) and ``openings`` (the last of each role), bounded by the rules;
* maps ``counts`` (role and phrase) and ``waiting`` (index to what the turn says).

All but ``waiting`` are small whatever a dialogue's length; everything goes ``ttl_ms`` after its last change, if that is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clinloom.operators import progress as batch
from clinloom.operators.dialogue import QUESTIONS
from clinloom.session import ship

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "dialogue_id {id}, index long, who string, concluded boolean, exchanges long, streak long, alike long, repetitive boolean, worn long, counts array<long>, ended string"
COLUMNS = ["dialogue_id", "index", "who", "concluded", "exchanges", "streak", "alike", "repetitive", "worn", "counts", "ended"]
#: ``ended`` of a turn that comes too late.
LATE = "late"
TURN = ("who", "valid", "conclusion", "inquiry", "understands", "confused", "no_more", "said", "opening", "hits")
TURN_SCHEMA = "who string, valid boolean, conclusion boolean, inquiry boolean, understands boolean, confused boolean, no_more boolean, said string, opening string, hits string"


class Dialogues(StatefulProcessor):
    """Takes a dialogue's turns one after the other."""

    def __init__(self, rules: batch.Rules, gap_ms: int | None, ttl_ms: int | None):
        self.rules, self.gap_ms, self.ttl_ms = rules, gap_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, turns long, rounds long, asked long, concluded boolean, exchanges long, streak long, ended string", self.ttl_ms)
        self.recent = handle.getListState("recent", "who string, said string", self.ttl_ms)
        self.openings = handle.getListState("openings", "who string, opening string", self.ttl_ms)
        self.counts = handle.getMapState("counts", "who string, phrase int", "n long", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "index long", TURN_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, next_index = [], self.at.get()[0] if self.at.exists() else 0
        for frame in rows:
            for row in frame.sort_values("index").itertuples(index=False):
                index = int(row[1])  # ``index`` is a method of tuples
                if index < next_index or self.waiting.containsKey((index,)):
                    out.append((key[0], index, row.who, None, None, None, None, None, None, None, LATE))
                else:
                    self.waiting.updateValue((index,), tuple(getattr(row, c) for c in TURN))
        out += self._go(key, next_index)
        self._watch(timerValues)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The gap stays: go on at the least index that waits."""
        held = [k[0] for k in self.waiting.keys()]
        out = self._go(key, min(held)) if held else []
        self._watch(timerValues)
        yield pd.DataFrame(out, columns=COLUMNS)

    def _watch(self, timers) -> None:
        if self.gap_ms is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if next(iter(self.waiting.keys()), None) is not None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.gap_ms)

    def _go(self, key, index: int) -> list[tuple]:
        """Take what waits from ``index`` on, as far as there is no gap."""
        r, out = self.rules, []
        state = list(self.at.get()) if self.at.exists() else [0, 0, 0, 0, False, 0, 0, ""]
        recent, openings = [tuple(x) for x in self.recent.get()], [tuple(x) for x in self.openings.get()]
        while self.waiting.containsKey((index,)):
            turn = dict(zip(TURN, self.waiting.getValue((index,)), strict=True))
            self.waiting.removeKey((index,))
            if not state[7]:
                out.append((key[0], index, *self._take(turn, state, recent, openings)))
            index += 1
        state[0] = max(index, state[0])
        self.at.update(tuple(state))
        self.recent.put(recent[-r.window :]) if recent else None
        self.openings.put(openings) if openings else None
        return out

    def _take(self, turn: dict, state: list, recent: list, openings: list) -> tuple:
        r, who = self.rules, turn["who"]
        doctor = who == "Doctor"
        state[1] += 1
        state[2] += not doctor
        state[3] += doctor and turn["inquiry"]
        recent.append((who, turn["said"]))
        after, ended = state[4], "" if turn["valid"] else batch.INVALID
        if not doctor:
            if not ended and _looping(recent[-r.window :], r.window):
                ended = batch.LOOP
            if after:
                state[5] += 1
                state[6] = state[6] + 1 if turn["confused"] else max(0, state[6] - 1)
                if not ended and r.full:
                    ended = batch.UNDERSTOOD if turn["understands"] and not turn["confused"] else batch.NATURAL if state[5] >= r.exchanges else ""
                elif not ended and turn["no_more"]:
                    ended = batch.NO_QUESTIONS
                if not ended and turn["confused"] and state[6] >= r.streak:
                    ended = batch.CONFUSED
        elif turn["conclusion"]:
            covered = state[1] >= max(r.least_turns, batch.studies.SUBSTANTIAL_TURNS) and state[3] >= r.questions
            if after:
                ended = ended or batch.AGAIN
            elif covered or state[1] >= r.long_turns:
                state[4] = True
        if not doctor and not ended and state[2] >= r.rounds:
            ended = batch.ROUNDS
        own = [o for w, o in openings if w == who]
        alike = sum(_similar(turn["opening"], o) > r.above for o in own[-r.history :]) if turn["opening"] else 0
        openings[:] = [x for x in openings if x[0] != who] + [(who, o) for o in [*own, turn["opening"]][-r.history :]]
        counts, worn = [], 0
        for k, hit in enumerate(turn["hits"]):
            held = self.counts.getValue((who, k))
            n = held[0] if held else 0
            if hit == "1":
                worn += n >= r.worn
                n += 1
                self.counts.updateValue((who, k), (n,))
            counts.append(n)
        state[7] = ended
        return who, state[4], state[5], state[6], alike, alike >= r.alike, worn, counts, ended


def _similar(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


def _looping(recent: list[tuple[str, str]], window: int) -> bool:
    if len(recent) < window:
        return False
    said = {w: [s for v, s in recent if v == w] for w in ("Doctor", "Patient")}
    again = any(len(s) > 1 and s[-1] == s[-2] for s in said.values())
    return again or sum(any(q in s for q in QUESTIONS) for s in said["Doctor"]) >= 3


def use_rocksdb(spark: SparkSession) -> None:
    """State of several kinds needs the store that keeps it in column families."""
    spark.conf.set(STORE, ROCKS)


def dialogue_progress(stream: DataFrame, rules: batch.Rules = batch.Rules(), gap_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The rows of ``operators.progress.progress`` for turns (dialogue_id, index, role, text), as they can be told; and late turns.

    Indices of a dialogue are whole numbers from 0 over patient's and doctor's turns; ``gap_ms`` bounds how long a missing one is waited for.
    """
    from pyspark.sql import functions as F

    ship(stream.sparkSession)
    told = batch.features(stream, rules).withColumn("index", F.col("index").cast("long"))
    told = told.withColumn("hits", F.array_join(F.transform("hits", lambda h: F.when(h, "1").otherwise("0")), ""))
    schema = OUTPUT.format(id=stream.schema["dialogue_id"].dataType.simpleString())
    return told.groupBy("dialogue_id").transformWithStateInPandas(Dialogues(rules, gap_ms, ttl_ms), schema, "Append", "None" if gap_ms is None else "ProcessingTime")
