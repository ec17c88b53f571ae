import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clinloom.llm import queries
from clinloom.llm import transport_stream as ts


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_round_trip(data):
    p = ts.demux(ts.mux(data))
    assert p.payload == data and not p.continuity_errors and not p.damaged_units
    assert p.pts == [i * ts.TICKS for i in range(len(p.pts))] and len(p.random_access) == -(-len(p.pts) // ts.GROUP)
    assert p.streams == {ts.ES_PID: ts.STREAM_TYPE_PRIVATE}


@pytest.mark.parametrize("n", [0, 1, 161, 162, 163, 345, 346, 347, ts.UNIT - 1, ts.UNIT, ts.UNIT + 1, 40 * ts.UNIT])
def test_edges_of_packets(n):
    stream = ts.mux(bytes(i % 251 for i in range(n)))
    assert len(stream) % ts.PACKET == 0 and stream[:: ts.PACKET] == b"\x47" * (len(stream) // ts.PACKET)
    assert len(ts.demux(stream).payload) == n


def packets(stream):
    return [stream[i : i + ts.PACKET] for i in range(0, len(stream), ts.PACKET)]


def test_faults_are_seen():
    data = bytes(range(256)) * 60
    p = packets(ts.mux(data))
    lost = ts.demux(b"".join(p[:8] + p[9:]))
    assert lost.continuity_errors == 1 and lost.damaged_units == 1
    again = ts.demux(b"".join(p[:8] + [p[7]] + p[8:]))
    assert again.payload == data and again.repeated == 1 and not again.continuity_errors
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    assert ts.demux(b"".join([null, *p])).payload == data
    for bad in (b"", b"x" * 188, p[0][:100], b"".join(p[2:5]), b"".join([p[0][:20] + b"\x99" + p[0][21:], *p[1:8]])[: 188 * 8].replace(p[0][5:21], b"\0" * 16)):
        with pytest.raises(ts.StreamError):
            ts.demux(bad)


def test_access_points_begin_units():
    stream = ts.mux(b"z" * (20 * ts.UNIT))
    program = ts.demux(stream)
    for at in program.random_access:
        assert stream[at] == 0x47 and stream[at + 1] & 0x40
    assert len(program.random_access) == 3


def test_section_crc_of_a_known_table():
    assert ts.section_crc(bytes.fromhex("00b00d0001c100000001e1001ce2d2b7")[:12]) == int.from_bytes(ts._section(0, 1, bytes.fromhex("0001e100"))[-4:], "big")
    assert ts.section_crc(ts._section(0, 1, bytes.fromhex("0001e100"))) == 0


def test_columns(odd, empty):
    out = ts.with_program(ts.with_media(odd)).select("doc_id", "text", "program", "key").collect()
    assert len(out) == odd.count()
    for r in out:
        payload = ts.framed(r["text"])
        assert len(payload) % ts.FRAME == 0 and len(payload) > 0 and payload.rstrip(b" ") == (r["text"] or "").encode().rstrip(b" ")
        p = r["program"]
        assert (p["payload_bytes"], p["payload_sha256"], p["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert ts.with_program(ts.with_media(empty)).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op1_transport_stream(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        stream = ts.mux(ts.framed(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["media_bytes"], r["media_sha256"]) == (len(texts[r["doc_id"]].encode()), len(stream), hashlib.sha256(stream).hexdigest())
        assert r["payload_sha256"] == hashlib.sha256(ts.framed(texts[r["doc_id"]])).hexdigest() and "errors=0" in r["feature"]
