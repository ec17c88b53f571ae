"""Media columns: MPEG transport streams in a binary column.

``mux`` wraps a payload of 8-bit samples in a single-program transport stream (ISO/IEC
13818-1): 188-byte packets; program association and program map tables with their CRC,
repeated at every random-access point; one private elementary stream of PES packets, each
with a presentation timestamp; clock reference and random-access indicator in the
adaptation field; continuity counters; stuffing in the last packet of a PES packet.

``demux`` trusts nothing: it checks sync bytes and table CRCs, follows the program
association table to the program map and from there to the elementary stream, counts
continuity errors (repeated packets are dropped, not counted), reassembles the PES packets
and returns payload, timestamps and the byte offsets of random-access points.

Both work on whole columns through Arrow batches without a shuffle; a document's stream is
built and parsed by numpy slices, not byte by byte. Batches are bounded in bytes by Spark.

Defined cases: a null text counts as empty; the payload is padded with spaces to a
positive multiple of ``FRAME``; equal texts give equal streams; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.session import ship

#: Fixed values of the transport stream format.
PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
STREAM_TYPE_PRIVATE, STREAM_ID_PRIVATE = 0x06, 0xBD
#: Choices of this writer.
FRAME = 192
UNIT = 16 * FRAME  # payload bytes of one PES packet
GROUP = 8  # a random-access point every so many PES packets
TICKS = 3600  # 90 kHz ticks between PES packets (25 a second)
PMT_PID, ES_PID, PROGRAM = 0x0100, 0x0101, 1


class StreamError(ValueError):
    """The bytes are not a transport stream that can be read back."""


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        table = np.where(table & 0x80000000, (table << 1) ^ np.uint32(0x04C11DB7), table << 1).astype(np.uint32)
    return table


_CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    """CRC-32 of MPEG-2 sections: most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    data = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(data.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(0, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE_PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _pts_bytes(pts: np.ndarray) -> np.ndarray:
    out = np.empty((len(pts), 5), np.uint8)
    out[:, 0] = 0x21 | (pts >> 30 & 7) << 1
    out[:, 1] = pts >> 22 & 0xFF
    out[:, 2] = (pts >> 15 & 0x7F) << 1 | 1
    out[:, 3] = pts >> 7 & 0xFF
    out[:, 4] = (pts & 0x7F) << 1 | 1
    return out


def _units(payload: np.ndarray, first: int) -> np.ndarray:
    """Packets (unit, packet, byte) of PES packets that all carry ``payload.shape[1]`` bytes; counters unset."""
    n, size = payload.shape
    index = first + np.arange(n, dtype=np.int64)
    pes = np.empty((n, 14 + size), np.uint8)
    pes[:, :4] = (0, 0, 1, STREAM_ID_PRIVATE)
    pes[:, 4], pes[:, 5] = (size + 8) >> 8, (size + 8) & 0xFF
    pes[:, 6:9] = (0x84, 0x80, 5)
    pts = index * TICKS & 0x1FFFFFFFF
    pes[:, 9:14] = _pts_bytes(pts)
    pes[:, 14:] = payload
    head, room = 8, 176  # adaptation field with flags and clock reference
    total = pes.shape[1]
    packets = 1 if total <= room else 1 + -(-(total - room) // 184)
    out = np.full((n, packets, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x10
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] = 0x30
    short = max(0, room - total)
    out[:, 0, 4] = head - 1 + short
    out[:, 0, 5] = 0x10 | np.where(index % GROUP == 0, 0x40, 0)
    out[:, 0, 6], out[:, 0, 7], out[:, 0, 8], out[:, 0, 9] = pts >> 25 & 0xFF, pts >> 17 & 0xFF, pts >> 9 & 0xFF, pts >> 1 & 0xFF
    out[:, 0, 10], out[:, 0, 11] = (pts & 1) << 7 | 0x7E, 0
    out[:, 0, 4 + head + short :] = pes[:, : room - short]
    if packets > 1:
        full = packets - 2
        out[:, 1 : 1 + full, 4:] = pes[:, room : room + 184 * full].reshape(n, full, 184)
        tail = total - room - 184 * full
        stuff = 184 - tail
        if stuff:
            out[:, -1, 3] |= 0x20
            out[:, -1, 4] = stuff - 1
            if stuff > 1:
                out[:, -1, 5] = 0
        out[:, -1, 4 + stuff :] = pes[:, room + 184 * full :]
    return out


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload (any length; it is carried as it is)."""
    data = np.frombuffer(payload, np.uint8)
    n, rest = divmod(len(data), UNIT)
    parts = []
    if n:
        parts.append(_units(data[: n * UNIT].reshape(n, UNIT), 0))
    if rest or not n:
        parts.append(_units(data[n * UNIT :].reshape(1, rest), n))
    es = np.concatenate([p.reshape(-1, PACKET) for p in parts])
    es[:, 3] |= (np.arange(len(es)) & 15).astype(np.uint8)
    points = np.flatnonzero((es[:, 3] & 0x20 > 0) & (es[:, 1] & 0x40 > 0) & (es[:, 5] & 0x40 > 0))
    tables = np.empty((len(points), 2, PACKET), np.uint8)
    tables[:, 0], tables[:, 1] = _PAT, _PMT
    tables[:, :, 3] |= (np.arange(len(points)) & 15).astype(np.uint8)[:, None]
    return np.insert(es, np.repeat(points, 2), tables.reshape(-1, PACKET), axis=0).tobytes()


@dataclass
class Program:
    """What was read back from a stream."""

    payload: bytes
    packets: int
    pts: list[int]
    random_access: list[int]  # byte offsets of the packets that begin there
    continuity_errors: int = 0
    repeated: int = 0
    damaged_units: int = 0
    streams: dict[int, int] = field(default_factory=dict)  # pid -> stream type


def _sections(ts: np.ndarray, pid: np.ndarray, want: int) -> list[bytes]:
    """The distinct sound sections that begin in packets of one pid."""
    out = []
    for row in {bytes(r[4:]) for r in ts[(pid == want) & (ts[:, 1] & 0x40 > 0)]}:
        start = 1 + row[0]
        end = start + 3 + ((row[start + 1] & 15) << 8 | row[start + 2]) if start + 3 <= len(row) else len(row) + 1
        if end <= len(row) and section_crc(row[start:end]) == 0:
            out.append(row[start:end])
    return sorted(out)


def demux(stream: bytes) -> Program:
    """Parse a transport stream; raises StreamError where no program can be read."""
    if not stream or len(stream) % PACKET:
        raise StreamError("not a whole number of packets")
    ts = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (ts[:, 0] != SYNC).any():
        raise StreamError("lost sync")
    pid = (ts[:, 1].astype(np.int32) & 0x1F) << 8 | ts[:, 2]
    maps = [int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for s in _sections(ts, pid, 0) if s[0] == 0 for i in range(8, len(s) - 4, 4) if s[i : i + 2] != b"\0\0"]
    if not maps:
        raise StreamError("no program association")
    streams: dict[int, int] = {}
    for s in _sections(ts, pid, maps[0]):
        if s[0] == 2:
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i < len(s) - 4:
                streams[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    if not streams:
        raise StreamError("no program map")
    at = np.flatnonzero((pid == min(streams)) & (ts[:, 3] & 0x10 > 0))
    if not len(at):
        raise StreamError("no elementary stream")
    own = ts[at]
    counter = (own[:, 3] & 15).astype(np.int8)
    step = np.diff(counter) & 15
    same = np.concatenate([[False], (step == 0) & (own[1:] == own[:-1]).all(axis=1)])
    jump = np.concatenate([[False], step != 1]) & ~same
    own, at, jump = own[~same], at[~same], jump[~same]
    adapted = own[:, 3] & 0x20 > 0
    skip = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    if (skip > PACKET).any():
        raise StreamError("adaptation field too long")
    starts = np.flatnonzero(own[:, 1] & 0x40)
    if not len(starts):
        raise StreamError("no PES packet")
    carried = np.arange(PACKET) >= skip[:, None]
    carried[: starts[0]] = False
    es = own[carried]
    before = np.concatenate([[0], np.cumsum(carried.sum(axis=1))])
    begin, end = before[starts], before[np.append(starts[1:], len(own))]
    keep = np.ones(len(es), np.int8)
    sound = end - begin >= 14
    begin_ok = begin[sound]
    head = es[begin_ok[:, None] + np.arange(14)].astype(np.int64)
    good = (head[:, :3] == (0, 0, 1)).all(axis=1) & (head[:, 7] & 0x80 > 0)
    declared = head[:, 4] << 8 | head[:, 5]
    damaged = int((~sound).sum() + (~good).sum() + (declared[good] + 6 != (end - begin)[sound][good]).sum())
    drop = np.zeros(len(es) + 1, np.int32)
    np.add.at(drop, begin_ok[good], 1)
    np.add.at(drop, np.minimum(begin_ok[good] + 9 + head[good, 8], len(es)), -1)
    keep = np.cumsum(drop[:-1]) == 0
    h = head[good]
    pts = (h[:, 9] >> 1 & 7) << 30 | h[:, 10] << 22 | (h[:, 11] >> 1) << 15 | h[:, 12] << 7 | h[:, 13] >> 1
    points = at[adapted[: len(at)] & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)] * PACKET
    return Program(es[keep].tobytes(), len(ts), pts.tolist(), points.tolist(), int(jump.sum()), int(same.sum()), damaged, streams)


def framed(text: str | None) -> bytes:
    """UTF-8 of the text, padded with spaces to a positive multiple of FRAME bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(FRAME, -(-len(data) // FRAME) * FRAME), b" ")


@F.pandas_udf(T.BinaryType())
def muxed(text: pd.Series) -> pd.Series:
    """Column of streams for a column of texts."""
    return pd.Series([mux(framed(x if isinstance(x, str) else None)) for x in text], dtype=object)


_LONGS = T.ArrayType(T.LongType())
PROGRAM_TYPE = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("packets", T.LongType()),
        T.StructField("pts", _LONGS),
        T.StructField("random_access", _LONGS),
        T.StructField("continuity_errors", T.LongType()),
        T.StructField("damaged_units", T.LongType()),
        T.StructField("mean_sample", T.DoubleType()),
    ]
)


@F.pandas_udf(PROGRAM_TYPE)
def described(media: pd.Series) -> pd.DataFrame:
    """What each stored stream holds, read back from its bytes."""
    rows = []
    for stream in media:
        p = demux(stream)
        rows.append(
            (len(p.payload), hashlib.sha256(p.payload).hexdigest(), zlib.crc32(p.payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), p.packets, p.pts, p.random_access, p.continuity_errors, p.damaged_units, round(float(np.frombuffer(p.payload, np.uint8).mean()) if p.payload else 0.0, 6))
        )
    return pd.DataFrame(rows, columns=PROGRAM_TYPE.names)


@F.pandas_udf(T.BinaryType())
def payload_of(media: pd.Series) -> pd.Series:
    """The payload of each stored stream."""
    return pd.Series([demux(x).payload for x in media], dtype=object)


def with_media(df: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """``df`` with a column of transport streams."""
    ship(df.sparkSession)
    return df.withColumn(name, muxed(F.col(text)))


def with_program(df: DataFrame, media: str = "media", name: str = "program") -> DataFrame:
    """``df`` with a struct column of what each stream holds."""
    ship(df.sparkSession)
    return df.withColumn(name, described(F.col(media)))


def feature(program: Column) -> Column:
    """A short text of a stream's shape: packets, PES packets, last timestamp, access points, errors, mean sample."""
    p = program
    return F.concat_ws(
        ";",
        F.concat(F.lit("packets="), p["packets"]),
        F.concat(F.lit("pes="), F.size(p["pts"])),
        F.concat(F.lit("last_pts="), F.element_at(p["pts"], -1)),
        F.concat(F.lit("access="), F.size(p["random_access"])),
        F.concat(F.lit("errors="), p["continuity_errors"] + p["damaged_units"]),
        F.concat(F.lit("mean="), F.format_number(p["mean_sample"], 3)),
    )
