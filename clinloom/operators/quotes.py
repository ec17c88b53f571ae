"""Evidence offsets repaired: where in its note each quotation really stands.

A span says where its quotation is; models miscount. A quotation that isn't there is looked for, first as it is, then with any
white space between its words, as notes are wrapped where a model writes a space. What the note doesn't have stays
unfound: every word must be there, in order, with nothing else between.

All quotations of a note go into one Aho–Corasick automaton, which passes once over the note and once over the
note with its runs of white space collapsed; an array leads from the collapsed text back to offsets of the note.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clinloom.session import ship

_RUN = re.compile(r"\s+")
SOUND, MOVED, ABSENT, NO_NOTE = "sound", "moved", "absent", "no note"


def collapsed(note: str) -> tuple[str, np.ndarray]:
    """The note with each run of white space as one space, and each of its characters' offset in the note."""
    parts, places, at = [], [], 0
    for m in _RUN.finditer(note):
        parts += [note[at : m.start()], " "]
        places.append(np.arange(at, m.start() + 1))
        at = m.end()
    parts.append(note[at:])
    places.append(np.arange(at, len(note)))
    return "".join(parts), np.concatenate(places)


def _first(text: str, patterns: set[str]) -> dict[str, int]:
    """The first place of each pattern in a text, in one pass."""
    out: dict[str, int] = {}
    if not patterns:
        return out
    automaton = ahocorasick.Automaton()
    for p in patterns:
        automaton.add_word(p, p)
    automaton.make_automaton()
    for end, p in automaton.iter(text):
        if p not in out:
            out[p] = end - len(p) + 1
            if len(out) == len(patterns):
                break
    return out


def locate_all(note: str, quoted: Sequence[str]) -> dict[str, tuple[int, int]]:
    """(start, end) of each quotation that the note has."""
    exact = _first(note, {q for q in quoted if q})
    out = {q: (a, a + len(q)) for q, a in exact.items()}
    loose = {q: " ".join(q.split()) for q in quoted if q not in out and q.split()}
    if loose:
        flat, place = collapsed(note)
        there = _first(flat, set(loose.values()))
        for q, words in loose.items():
            if words in there:
                a = there[words]
                out[q] = int(place[a]), int(place[a + len(words) - 1]) + 1
    return out


def repair_offsets(spans: DataFrame, notes: DataFrame, case: str, path: str = "path") -> DataFrame:
    """(case, path, note_id, char_start, char_end, text, status) of every span (case, path, note_id, char_start, char_end, text).

    ``status``: sound (left as it was), moved (now where the quotation first stands), absent (offsets null) or no
    note. ``notes`` has (case, note_id, note), each once. A note's spans are brought to it as one row.
    """
    ship(spans.sparkSession)
    item = F.struct(F.col(path).alias("path"), F.col("char_start").cast("long").alias("start"), F.col("char_end").cast("long").alias("end"), "text")
    grouped = spans.groupBy(case, "note_id").agg(F.collect_list(item).alias("spans"))
    joined = grouped.join(notes.select(case, "note_id", "note"), [case, "note_id"], "left").select(case, "note_id", "note", "spans")
    schema = T.StructType([joined.schema[case], joined.schema["note_id"], T.StructField("path", spans.schema[path].dataType), T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType()), T.StructField("text", T.StringType()), T.StructField("status", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, note_id, note, items in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                place = locate_all(note, [s["text"] or "" for s in items]) if note is not None else {}
                rows = []
                for s in items:
                    a, b, text = s["start"], s["end"], s["text"] or ""
                    if note is None:
                        a, b, status = None, None, NO_NOTE
                    elif text and a is not None and b is not None and 0 <= a < b and note[a:b] == text:
                        status = SOUND
                    else:
                        (a, b), status = (place[text], MOVED) if text in place else ((None, None), ABSENT)
                    rows.append((key, note_id, s["path"], a, b, s["text"], status))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return joined.mapInArrow(run, schema).withColumnRenamed("path", path)
