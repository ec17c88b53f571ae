"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from clinloom.operators import cohort
from clinloom.sources import sinks, tables
from clinloom.streaming import attempts as stream


def test_csv_extract(spark, tmp_path):
    (tmp_path / "NOTEEVENTS.csv").write_text('ROW_ID,SUBJECT_ID,HADM_ID,CHARTDATE,CATEGORY,TEXT,EXTRA\n1,2,3,2020-01-02,"Discharge summary","line one\nline ""two""",x\n4,5,,,Nursing,plain,y\n')
    df = tables.read_extract(spark, str(tmp_path), "NOTEEVENTS")
    assert df.columns == ["ROW_ID", "SUBJECT_ID", "HADM_ID", "CHARTDATE", "CATEGORY", "TEXT"]
    rows = df.orderBy("ROW_ID").collect()
    assert rows[0]["TEXT"] == 'line one\nline "two"' and rows[1]["HADM_ID"] is None and str(rows[0]["CHARTDATE"]) == "2020-01-02"
    with pytest.raises(FileNotFoundError):
        tables.read_extract(spark, str(tmp_path), "ICUSTAYS")
    a = tables.snapshot_hash(str(tmp_path), ["NOTEEVENTS"])
    (tmp_path / "NOTEEVENTS.csv").write_text("changed")
    assert a.startswith("sha256:") and a != tables.snapshot_hash(str(tmp_path), ["NOTEEVENTS"])


def test_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"case_id": "a", "n": 1}\n\n  \n{"case_id": "b", "n": 2}\n')
    assert [tuple(r) for r in tables.read_lines(spark, str(good), "case_id string, n int").orderBy("n").collect()] == [("a", 1), ("b", 2)]
    assert tables.read_lines(spark, str(good), "case_id string, n int", line_number=True).columns == ["line", "case_id", "n"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"case_id": "a"}\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        tables.read_lines(spark, str(bad), "case_id string, n int").collect()


def test_cache_by_stamp(spark, tmp_path):
    one = tables.cached(spark, spark.range(3).toDF("x"), str(tmp_path), "t", "s1")
    again = tables.cached(spark, spark.range(9).toDF("x"), str(tmp_path), "t", "s1")
    other = tables.cached(spark, spark.range(9).toDF("x"), str(tmp_path), "t", "s2")
    assert (one.count(), again.count(), other.count()) == (3, 3, 9)


def test_write_once_and_log(tmp_path):
    path = str(tmp_path / "run.json")
    sinks.write_once(path, {"b": 1, "a": 2})
    with pytest.raises(FileExistsError):
        sinks.write_once(path, {})
    log = str(tmp_path / "log.jsonl")
    assert sinks.append_lines(log, [{"id": 1}, {"id": 2}], "id") == 2
    with pytest.raises(ValueError, match="already"):
        sinks.append_lines(log, [{"id": 2}], "id")
    assert sinks.content_hash({"a": 1, "b": 2}) == sinks.content_hash({"b": 2, "a": 1})


def test_tables_do_not_depend_on_order(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5, None), ("a", 0.25, 1)], "k string, v double, n int")
    one = sinks.write_tables(str(tmp_path / "1"), {"t": df}, {"x": 1})
    two = sinks.write_tables(str(tmp_path / "2"), {"t": df.orderBy(F.desc("k"))}, {"x": 1})
    assert one == two and (tmp_path / "1" / "t.csv").read_text() == "k,v,n\na,0.250000,1\nb,0.500000,\n"
    assert "circle" in sinks.bar_svg(["a<b"], [0.5], [0.4], [0.6]) and "circle" not in sinks.bar_svg(["a"], [None], [None], [None])


def test_manifests(spark):
    df = spark.range(50).selectExpr("id % 9 as subject_id", "id as hadm_id")
    picked = cohort.hash_sample(df, 5, "s", "1")
    flow = cohort.exclusion_flow(df.withColumn("fired", F.array().cast("array<string>")))
    private, public = sinks.manifests(picked, flow, {"v": 1}, b"secret")
    assert sinks.verify_manifest(private) and sinks.verify_manifest(public) and not sinks.verify_manifest(private | {"selected": []})
    assert "subject_id" not in json.dumps(public) and len(set(public["cases"])) == 5


def test_markdown(spark, tmp_path):
    ref = {"diagnoses": [{"primary": "Fieber é", "notes": "n"}], "allergies": ["x"]}
    text = sinks.to_markdown(ref)
    assert sinks.from_markdown(text) == ref
    (tmp_path / "a.md").write_text(text, encoding="utf-8")
    (tmp_path / "b.md").write_text("# nothing\n")
    rows = sinks.read_markdown(spark, str(tmp_path), "diagnoses array<struct<primary: string, notes: string>>, allergies array<string>").orderBy("file").collect()
    assert rows[0]["reference"]["diagnoses"][0]["primary"] == "Fieber é" and rows[1]["reference"] is None
    assert sinks.entry_line("- Aspirin | dose: 5 mg | bad") == {"name": "Aspirin", "dose": "5 mg"}
    with pytest.raises(ValueError):
        sinks.from_markdown("x")


def test_append_stream(spark, tmp_path):
    source, log, ck = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ck")
    source.mkdir()
    record = lambda i: json.dumps({"attempt_id": f"a{i}", "case_id": "c", "variant": "v", "policy": "p", "attempt_index": i, "ts": "2024-01-01T00:00:00Z", "value": 0.5, "acceptance": "ACCEPT"})
    (source / "1.json").write_text("\n".join(map(record, [1, 2, 2])))
    s = stream.read_stream(spark, str(source), stream.ATTEMPT)
    stream.append_stream(s, log, ck).awaitTermination(120)
    (source / "2.json").write_text("\n".join(map(record, [2, 3])))
    stream.append_stream(s, log, ck).awaitTermination(120)
    assert sorted(r["attempt_id"] for r in spark.read.parquet(log).collect()) == ["a1", "a2", "a3"]
    assert stream.append_once(spark.read.parquet(log), log) == 0


def test_windowed_rates_of_a_batch(spark):
    df = spark.createDataFrame([("v", "ACCEPT", 0.5, "2024-01-01 00:10:00"), ("v", "REJECT", None, "2024-01-01 00:50:00"), ("v", "PASS", 1.0, "2024-01-01 01:00:00")], "variant string, acceptance string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r["attempts"], r["accepted"], r["measured"], r["mean_value"]) for r in stream.windowed_rates(df).collect())
    assert got == [(1, 1, 1, 1.0), (2, 1, 1, 0.5)]


def test_dialogue_state(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    turn = lambda i, t: json.dumps({"dialogue_id": "d", "index": i, "role": "user", "text": t, "ts": "2024-01-01T00:00:00Z"})
    (source / "1.json").write_text("\n".join(turn(i, t) for i, t in enumerate(["I am confused", "fine", "I am confused", "I am confused"])))
    out = stream.dialogue_state(stream.read_stream(spark, str(source), stream.TURN), "confused", limit=3)
    rows = []

    def once():
        sink = out.writeStream.outputMode("update").foreachBatch(lambda batch, _: rows.extend(tuple(r)[1:] for r in batch.collect()))
        sink.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)

    once()
    (source / "2.json").write_text(turn(4, "still confused"))
    once()
    assert rows == [(4, 2, 2, False), (5, 3, 0, True)]
