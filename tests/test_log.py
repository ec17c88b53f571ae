"""The resumable log: killed between data and marker, delivered twice, resumed under another identity; and locks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinloom.sources import locks
from clinloom.streaming import log

SHAPE = locks.run_shape(("full", "single"), ("reference", "note"))
MODEL = {"id": "m", "digest": "sha256:" + "a" * 64, "family": "f", "quantisation": "q4"}
CONFIG = {"name": "n", "variant": "full", "patient_policy_id": "FULL@2.0", "doctor_guidance_id": "g", "reference_mode": "note", "seed": 1, "max_turns": 30, "max_attempts": 3, "thresholds": {"x": 0.7}, "models": {"doctor": MODEL}, "prompt_versions": {"doctor": "1"}}
IDENTITY = locks.run_identity(locks.run_config(CONFIG, SHAPE), "c0ffee")


def frame(spark, rows):
    return spark.createDataFrame(rows, "case_id string, attempt_index long, acceptance string, note string")


def keys(df):
    return sorted((r["case_id"], r["attempt_index"]) for r in df.collect())


def rows(a, b, k=1, acceptance="REJECT"):
    return [(f"case-{i}", k, acceptance, "x" * 50) for i in range(a, b)]


def test_append_and_resume(spark, tmp_path):
    own = log.AttemptLog(spark, str(tmp_path / "log"), IDENTITY, buckets=8)
    assert own.read() is None and own.open_cases(frame(spark, rows(0, 3)), F.lit(True), 3).count() == 3
    assert own.append(frame(spark, rows(0, 40) + rows(0, 3)), "b1") == 40
    assert own.append(frame(spark, rows(0, 40)), "b1") == 0  # delivered again
    assert own.append(frame(spark, rows(30, 60)), "b2") == 20
    assert own.append(frame(spark, rows(0, 60)), "b3") == 0 and len(own.commits()) == 2
    again = log.AttemptLog(spark, str(tmp_path / "log"), IDENTITY, buckets=8)
    assert again.append(frame(spark, rows(0, 10, 2, "ACCEPT") + rows(10, 20, 2) + rows(10, 15, 3)), "b4") == 25
    assert keys(again.read()) == sorted([(f"case-{i}", 1) for i in range(60)] + [(f"case-{i}", 2) for i in range(20)] + [(f"case-{i}", 3) for i in range(10, 15)])
    left = again.open_cases(frame(spark, rows(0, 70)), F.col("acceptance") == "ACCEPT", 3)
    wanted = {f"case-{i}": (0, 1) if i >= 60 else (1, 2) if i >= 20 else (2, 3) for i in range(15, 70)}
    assert {r["case_id"]: (r["attempts"], r["next_attempt"]) for r in left.collect()} == wanted


def test_only_files_that_may_have_a_case_are_read(spark, tmp_path):
    own = log.AttemptLog(spark, str(tmp_path / "log"), IDENTITY, buckets=8)
    for k in range(6):
        own.append(frame(spark, rows(100 * k, 100 * k + 40)), f"b{k}")
    own.open_cases(frame(spark, rows(205, 206)), F.lit(False), 3)
    assert 1 <= len(own.touched) <= 3 < 48 and own.commits()[2]["folder"] in {a for a, _ in own.touched}
    assert own.append(frame(spark, rows(9000, 9001)), "new") == 1 and len(own.touched) <= 2


@pytest.mark.parametrize("dies_in", ["_commit", "_filters"])
def test_killed_before_the_marker(spark, tmp_path, monkeypatch, dies_in):
    """Data without a marker isn't there; the same batch goes in later, whole and once."""
    own = log.AttemptLog(spark, str(tmp_path / "log"), IDENTITY, buckets=4)
    own.append(frame(spark, rows(0, 10)), "b1")

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(log.AttemptLog, dies_in, die)
        with pytest.raises(KeyboardInterrupt):
            own.append(frame(spark, rows(5, 30)), "b2")
    resumed = log.AttemptLog(spark, str(tmp_path / "log"), IDENTITY, buckets=4)
    assert keys(resumed.read()) == sorted((f"case-{i}", 1) for i in range(10))
    assert resumed.append(frame(spark, rows(5, 30)), "b2") == 20
    assert keys(resumed.read()) == sorted((f"case-{i}", 1) for i in range(30))
    assert resumed.vacuum() and not resumed.vacuum() and resumed.read().count() == 30


def test_another_identity_is_refused(spark, tmp_path):
    log.AttemptLog(spark, str(tmp_path / "log"), IDENTITY)
    other = locks.run_identity(locks.run_config(CONFIG | {"seed": 2}, SHAPE), "c0ffee")
    with pytest.raises(locks.LockError, match="config_hash .*full_hash"):
        log.AttemptLog(spark, str(tmp_path / "log"), other)
    with pytest.raises(locks.LockError, match="buckets"):
        log.AttemptLog(spark, str(tmp_path / "log"), IDENTITY, buckets=3)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put = lambda name, some: (source / f"{name}.json").write_text("\n".join(json.dumps({"case_id": c, "attempt_index": k, "acceptance": a}) for c, k, a, _ in some))
    own = log.AttemptLog(spark, str(tmp_path / "log"), IDENTITY, buckets=4)
    stream = spark.readStream.schema("case_id string, attempt_index long, acceptance string").option("maxFilesPerTrigger", 1).json(str(source))
    put("1", rows(0, 9))
    put("2", rows(5, 12))
    own.append_stream(stream, str(tmp_path / "ck")).awaitTermination(200)
    put("3", rows(10, 14))
    own.append_stream(stream, str(tmp_path / "ck")).awaitTermination(200)
    assert keys(own.read()) == sorted((f"case-{i}", 1) for i in range(14))


def test_filters_lose_nothing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 5000):
        held = rng.integers(-(1 << 63), 1 << 63, n)
        packed = log.filter_of(held)
        assert log.may_have(packed, held).all()
        other = rng.integers(-(1 << 63), 1 << 63, 20_000)
        assert log.may_have(packed, other).mean() < 0.02


def test_run_config():
    sound = locks.run_config(CONFIG | {"config_hash": "not trusted"}, SHAPE)
    assert (sound["patient_policy_id"], sound["patient_policy_version"]) == ("FULL", "2.0") and sound["models"]["doctor"]["prompt_cost_per_million"] == 0.0
    bad = {
        "unknown fields: sead": {"sead": 1}, "variant must be one of": {"variant": "x"}, "seed must be a whole number": {"seed": True}, "max_turns must be at least 1": {"max_turns": 0}, "thresholds must not be empty": {"thresholds": {}},
        "thresholds 'y' must be a number from 0 to 1": {"thresholds": {"y": 1.5}}, "models 'doctor' object: missing fields: family": {"models": {"doctor": {k: v for k, v in MODEL.items() if k != "family"}}}, "name must be text": {"name": " "},
        "frozen_at must be an ISO time": {"frozen_at": "2024-01-01T00:00:00"}, "is not that of": {"patient_policy_version": "1.0"}, "prompt_versions 'd' must be text": {"prompt_versions": {"d": ""}},
    }
    for message, change in bad.items():
        with pytest.raises(locks.LockError, match=message):
            locks.run_config(CONFIG | change, SHAPE)
    with pytest.raises(locks.LockError, match="missing fields: models, name"):
        locks.run_config({k: v for k, v in CONFIG.items() if k not in ("name", "models")}, SHAPE)


def test_confirmatory_runs_are_pinned():
    pinned = {"frozen_at": "2024-01-01T00:00:00Z", "input_manifest_hash": "sha256:" + "0" * 64}
    locks.require_confirmatory(locks.run_config(CONFIG | pinned, SHAPE))
    with pytest.raises(locks.LockError, match="frozen_at.*input_manifest_hash"):
        locks.require_confirmatory(locks.run_config(CONFIG, SHAPE))
    loose = CONFIG | pinned | {"patient_policy_id": "FULL", "models": {"doctor": MODEL | {"digest": "latest"}}}
    with pytest.raises(locks.LockError, match="policy version.*not pinned for doctor"):
        locks.require_confirmatory(locks.run_config(loose, SHAPE))


def test_locked_folder(tmp_path):
    shape = {"matcher_id": locks.Field(locks.text), "version": locks.Field(locks.text), "frozen_at": locks.Field(locks.moment), "rules": locks.Field(locks.anything, [])}
    name = lambda d: f"{d['matcher_id']}@{d['version']}"
    read = lambda: locks.read_locked(str(tmp_path), shape, name, "matcher")
    put = lambda file, **more: (tmp_path / file).write_text(json.dumps({"matcher_id": "m", "version": "1", "frozen_at": "2024-01-01T00:00:00Z"} | more))
    put("a.json")
    assert read()["m@1"]["rules"] == []
    locks.write_lock(str(tmp_path), name)
    put("b.json", version="2")
    with pytest.raises(locks.LockError, match="m@2 is not in the lock"):
        read()
    locks.write_lock(str(tmp_path), name)
    assert set(read()) == {"m@1", "m@2"}
    put("a.json", rules=["relaxed"])
    for _ in range(2):
        with pytest.raises(locks.LockError, match="m@1 changed"):
            read()
        locks.write_lock(str(tmp_path), name)  # a version is never recorded anew
    put("a.json", version="2")
    with pytest.raises(locks.LockError, match="twice"):
        read()
    (tmp_path / "a.json").unlink()
    with pytest.raises(locks.LockError, match="m@1 is in the lock but not"):
        read()
    (tmp_path / "a.json").write_text("{")
    with pytest.raises(locks.LockError, match="not JSON"):
        read()
    with pytest.raises(locks.LockError, match="no folder"):
        locks.read_locked(str(tmp_path / "none"), shape, name, "matcher")


def test_frozen_before_the_run():
    locks.ensure_frozen_before("2024-01-01T00:00:00Z", "2024-01-01T00:00:01+00:00", "matcher m@1")
    for started in ("2024-01-01T00:00:00Z", "2024-01-01T01:00:00+02:00"):
        with pytest.raises(locks.LockError, match="not before"):
            locks.ensure_frozen_before("2024-01-01T00:00:00Z", started, "matcher m@1")
