"""op1's stored streams against an independent reader: packet by packet, bit by bit, from the format's own definition."""

import hashlib
import zlib

from clinloom.llm import queries
from clinloom.llm import transport_stream as ts


def crc_of(data):
    """CRC-32/MPEG-2 by its definition, a bit at a time."""
    crc = 0xFFFFFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = crc >> 31 ^ byte >> bit & 1
            crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return crc


def sections(packet_payload):
    table = packet_payload[1 + packet_payload[0] :]
    length = (table[1] & 0x0F) << 8 | table[2]
    body = table[: 3 + length]
    assert crc_of(body) == 0
    return body


def read(stream):
    """(payload, timestamps, access points, packets) of a stream; asserts what the format demands."""
    assert stream and len(stream) % 188 == 0
    pmt_pid, es_pid, counters, unit, units, points, clocks = None, None, {}, None, [], [], []
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80
        start, pid, control, counter = p[1] & 0x40, (p[1] & 0x1F) << 8 | p[2], p[3] >> 4 & 3, p[3] & 15
        assert p[3] >> 6 == 0
        body = p[4:]
        if control & 2:
            length = body[0]
            if length:
                flags = body[1]
                if flags & 0x40:
                    points.append(at)
                if flags & 0x10:
                    base = int.from_bytes(body[2:8], "big")
                    clocks.append((base >> 15, base & 511))
                used = 1 + (6 if flags & 0x10 else 0)
                assert set(body[1 + used : 1 + length]) <= {0xFF}
            body = body[1 + length :]
        if control & 1:
            assert counters.get(pid, (counter - 1) & 15) == (counter - 1) & 15
            counters[pid] = counter
        if pid == 0:
            s = sections(body)
            assert s[0] == 0 and s[8:10] == b"\0\1"
            pmt_pid = (s[10] & 0x1F) << 8 | s[11]
        elif pid == pmt_pid:
            s = sections(body)
            assert s[0] == 2
            skip = (s[10] & 15) << 8 | s[11]
            assert s[12 + skip] == 6
            es_pid = (s[13 + skip] & 0x1F) << 8 | s[14 + skip]
        else:
            assert pid == es_pid
            if start:
                unit = bytearray()
                units.append(unit)
            unit += body
    payload, stamps = b"", []
    for u in units:
        assert u[:4] == b"\0\0\1\xbd" and int.from_bytes(u[4:6], "big") == len(u) - 6 and u[7] >> 6 == 2 and u[8] == 5
        assert u[9] >> 4 == 2 and u[9] & 1 and u[11] & 1 and u[13] & 1
        stamps.append((u[9] >> 1 & 7) << 30 | u[10] << 22 | u[11] >> 1 << 15 | u[12] << 7 | u[13] >> 1)
        payload += u[14:]
    assert clocks == [(x, 0) for x in stamps]
    return payload, stamps, points, len(stream) // 188


def test_query_equals_the_reader(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    media = {r["doc_id"]: (r["text"], r["media"]) for r in ts.with_media(docs).collect()}
    for r in queries.op1_transport_stream(spark, sf_dir).collect():
        text, stream = media[r["doc_id"]]
        payload, stamps, points, packets = read(bytes(stream))
        data = (text or "").encode()
        want = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert payload == want and (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(want), zlib.crc32(want[-16:]))
        assert (r["payload_sha256"], r["media_bytes"], r["media_sha256"]) == (hashlib.sha256(want).hexdigest(), len(stream), hashlib.sha256(stream).hexdigest())
        mean = f"{round(sum(want) / len(want), 6):,.3f}"
        assert r["feature"] == f"packets={packets};pes={len(stamps)};last_pts={stamps[-1]};access={len(points)};errors=0;mean={mean}"
        assert stamps == [i * 3600 for i in range(len(stamps))] and len(points) == -(-len(stamps) // ts.GROUP)


def test_odd_texts(odd):
    for r in ts.with_media(odd).select("text", "media").collect():
        payload = read(bytes(r["media"]))[0]
        data = (r["text"] or "").encode()
        assert payload[: len(data)] == data and len(payload) % 192 == 0 and not payload[len(data) :].strip(b" ")
