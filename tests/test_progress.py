"""Dialogue progress: by windows, by a plain loop, and from a stream that is stopped and resumed."""

import json
import random
import re
import shutil
import time

import pytest
from pyspark.sql import functions as F

from clinloom.operators import progress as pg
from clinloom.plans import proxies as px
from clinloom.streaming import progress as sp

RULES = dict(
    conclusion=("we end", "so far"), reasoning=("plan",), understanding=("yes",), confusion=("huh",), no_more=("done",), inquiries=("ask",), doctor_phrases=("^so", "plan$", "a.k"), patient_phrases=("^well", "huh"),
    questions=1, long_words=9, rounds=12, worn=1,
)
WORDS = ["we end", "so far", "plan", "yes", "huh", "done", "ask", "well well", "what", "pain here", "it is a long way to go", "...", "**bold** so"]


def made(seed, dialogues=60):
    deal = random.Random(seed)
    rows = []
    for d in range(dialogues):
        for k in range(deal.randint(0, 28)):
            role = ["doctor", "Patient "][k % 2] if deal.random() < 0.95 else deal.choice(["user", "assistant"])
            text = " ".join(deal.choices(WORDS, k=deal.randint(2, 5))) + f" {deal.randint(0, 30)}"
            rows.append((d, k, role, deal.choice([text, text, text, "[ERROR: none]", None]) if deal.random() < 0.05 else text))
    return rows


def plain(rows, r):
    out = []
    for d in sorted({x[0] for x in rows}):
        turns, concluded, exchanges, streak, ended = [], False, 0, 0, ""
        openings, counts = {"Doctor": [], "Patient": []}, {"Doctor": [0] * len(r.doctor_phrases), "Patient": [0] * len(r.patient_phrases)}
        for _, index, role, text in sorted(x for x in rows if x[0] == d):
            who, text = {"doctor": "Doctor", "assistant": "Doctor"}.get(role.strip().lower(), "Patient"), text or ""
            low = text.lower()
            turns.append((who, low))
            has = lambda words, low=low: any(w in low for w in words)
            after = concluded
            if len(text.strip()) < 10 or "[ERROR:" in text:
                ended = pg.INVALID
            said = {w: [t[:100] for v, t in turns[-r.window :] if v == w] for w in ("Doctor", "Patient")}
            loop = len(turns) >= r.window and (any(len(s) > 1 and s[-1] == s[-2] for s in said.values()) or sum(any(q in t for q in ("what", "how", "when", "where", "why", "can you", "could you")) for t in said["Doctor"]) >= 3)
            if who == "Patient":
                ended = ended or (pg.LOOP if loop else "")
                if after:
                    exchanges += 1
                    streak = streak + 1 if has(r.confusion) else max(0, streak - 1)
                    if r.full:
                        ended = ended or (pg.UNDERSTOOD if has(r.understanding) and not has(r.confusion) else pg.NATURAL if exchanges >= r.exchanges else "")
                    elif has(r.no_more):
                        ended = ended or pg.NO_QUESTIONS
                    if has(r.confusion) and streak >= r.streak:
                        ended = ended or pg.CONFUSED
                if sum(w == "Patient" for w, _ in turns) >= r.rounds:
                    ended = ended or pg.ROUNDS
            elif has(r.conclusion) and (len(text.split()) > r.long_words or has(r.reasoning)):
                asked = sum(w == "Doctor" and any(q in t for q in r.inquiries) for w, t in turns)
                if after:
                    ended = ended or pg.AGAIN
                elif len(turns) >= 6 and asked >= r.questions or len(turns) >= r.long_turns:
                    concluded = True
            opening = " ".join(re.sub(r"\*\*.*?\*\*", "", text).split(".")[0].lower().split()[:5])
            a = set(opening.split())
            alike = sum(len(a & set(o.split())) / len(a | set(o.split())) > r.above for o in openings[who][-r.history :] if o) if a else 0
            openings[who].append(opening)
            worn = 0
            for k, p in enumerate(r.doctor_phrases if who == "Doctor" else r.patient_phrases):
                if re.search(p, low):
                    worn += counts[who][k] >= r.worn
                    counts[who][k] += 1
            out.append((d, index, who, concluded, exchanges, streak, alike, alike >= r.alike, worn, tuple(counts[who]), ended))
            if ended:
                break
    return sorted(out)


def got(rows):
    return sorted((*[r[c] for c in sp.COLUMNS[:9]], tuple(r["counts"]), r["ended"]) for r in rows)


@pytest.mark.parametrize("full", [True, False])
def test_windows_equal_loop(spark, full):
    rules = pg.Rules(full=full, **RULES)
    rows = made(1) + [(1000, 0, "doctor", None)]
    df = spark.createDataFrame(rows + [(5, 99, "nurse", "not a turn")], "dialogue_id long, index long, role string, text string").repartition(3)
    found = got(pg.progress(df, rules).collect())
    assert found == plain(rows, rules)
    reasons = {x[-1] for x in found}
    assert len(reasons) >= 6, reasons
    assert pg.progress(df.where("false"), rules).count() == 0


def test_fixed_words_on_a_dialogue(spark):
    """With the engine's own words: a conclusion, confusion, understanding."""
    said = ["Please describe the pain.", "It is in my back.", "On a scale up to ten, please?", "About a seven or so.", "Is it worse if you sit?", "Yes, it does get worse.", "Based on what you've told me, this is likely a strain.", "What does that mean for me?", "You should rest and it will pass.", "Okay, that makes sense to me."]
    df = spark.createDataFrame([(1, k, "doctor" if k % 2 == 0 else "patient", t) for k, t in enumerate(said)], "dialogue_id long, index long, role string, text string")
    rows = sorted(pg.progress(df).collect(), key=lambda r: r["index"])
    assert [r["concluded"] for r in rows] == [False] * 6 + [True] * 4
    assert [(r["exchanges"], r["streak"]) for r in rows[6:]] == [(0, 0), (1, 1), (1, 1), (2, 0)] and rows[-1]["ended"] == pg.UNDERSTOOD


def run(spark, source, folder, sink, rules, **more):
    """All that is there, once; rows of a batch are kept by its number, so a batch that runs again replaces them."""
    stream = spark.readStream.schema("dialogue_id long, index long, role string, text string").option("maxFilesPerTrigger", 1).json(str(source))
    out = sp.dialogue_progress(stream, rules, **more)

    def keep(batch, number):
        sink[number] = batch.collect()

    out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(folder)).trigger(availableNow=True).start().awaitTermination(300)


def put(folder, name, rows):
    text = "\n".join(json.dumps(dict(zip(("dialogue_id", "index", "role", "text"), r, strict=True))) for r in rows)
    (folder / "new").write_text(text)
    shutil.move(folder / "new", folder / f"{name}.json")


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(sp.STORE)
    sp.use_rocksdb(spark)
    yield
    spark.conf.set(sp.STORE, before)


def test_stream_equals_windows(spark, rocks, tmp_path):
    """Turns arrive in any order, over several runs from one checkpoint, some twice."""
    rules = pg.Rules(full=False, **RULES)
    rows = made(2, 9)
    shuffled = random.Random(3).sample(rows, len(rows))
    source, sink = tmp_path / "in", {}
    source.mkdir()
    third = len(rows) // 3
    put(source, "a", shuffled[:third])
    run(spark, source, tmp_path / "ck", sink, rules)
    first = len(sink)
    put(source, "b", shuffled[third : 2 * third])
    put(source, "c", shuffled[2 * third :] + shuffled[:10])
    run(spark, source, tmp_path / "ck", sink, rules)
    run(spark, source, tmp_path / "ck", sink, rules)  # nothing new
    found = [r for rows in sink.values() for r in rows]
    assert len(sink) > first and got([r for r in found if r["ended"] != sp.LATE]) == plain(rows, rules)
    assert len([r for r in found if r["ended"] == sp.LATE]) == 10


def test_gap_ends_by_timer(spark, rocks, tmp_path):
    """A turn that never comes is waited for, then left out; if it comes after all, it is late."""
    rules = pg.Rules(full=True, **RULES)
    source, sink = tmp_path / "in", {}
    source.mkdir()
    turn = lambda k: (1, k, "doctor" if k % 2 == 0 else "patient", f"pain here it is {k}")
    put(source, "a", [turn(0), turn(2), turn(3)])
    stream = spark.readStream.schema("dialogue_id long, index long, role string, text string").json(str(source))
    query = sp.dialogue_progress(stream, rules, gap_ms=3000).writeStream.outputMode("append").foreachBatch(lambda b, n: sink.update({n: b.collect()}))
    query = query.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()

    def until(wanted):
        end = time.time() + 90
        while time.time() < end:
            rows = sorted((r["index"], r["ended"]) for batch in list(sink.values()) for r in batch)
            if rows == wanted:
                return True
            time.sleep(0.3)
        return rows

    try:
        assert until([(0, "")]) is True or until([(0, ""), (2, ""), (3, "")]) is True
        assert until([(0, ""), (2, ""), (3, "")]) is True
        put(source, "b", [turn(1), turn(4)])
        assert until([(0, ""), (1, sp.LATE), (2, ""), (3, ""), (4, "")]) is True
    finally:
        query.stop()


def test_real_turns(spark, sf_dir):
    turns = px.turns(spark, sf_dir)
    assert pg.progress(turns).select("dialogue_id").distinct().count() == turns.where(F.lower("role").isin("user", "assistant")).select("dialogue_id").distinct().count()
