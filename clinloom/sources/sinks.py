"""Small outputs of the driver: write-once JSON, manifests, tables, and the Markdown codec.

These take frames that are small by construction (tables of a study); rows are sorted, so
files are the same byte for byte whatever the order of the input.
"""

from __future__ import annotations

import csv
import hashlib
import hmac
import io
import json
import os
import re
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of a study has at most this many rows; more is refused rather than collected.
MOST_ROWS = 100_000


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces, the form that is hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def content_hash(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def write_once(path: str, value: Any) -> None:
    """Write a JSON document that must not exist yet."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n")
        f.flush()
        os.fsync(f.fileno())


def append_lines(path: str, records: Iterable[Mapping[str, Any]], key: str) -> int:
    """Append records to a JSON lines log; an id that is there already raises."""
    target, seen = Path(path), set()
    if target.exists():
        with open(target, encoding="utf-8") as f:
            seen = {json.loads(line)[key] for line in f if line.strip()}
    n = 0
    with open(target, "a", encoding="utf-8") as f:
        for record in records:
            if record[key] in seen:
                raise ValueError(f"{key} {record[key]!r} is in the log already")
            seen.add(record[key])
            f.write(canonical(record) + "\n")
            n += 1
        f.flush()
        os.fsync(f.fileno())
    return n


def _rows(df: DataFrame) -> list[tuple]:
    got = df.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: not a table for the driver")
    return sorted((tuple(r) for r in got), key=lambda r: tuple((x is not None, str(x)) for x in r))


def csv_text(df: DataFrame) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows([["" if v is None else f"{v:.6f}" if isinstance(v, float) else v for v in r] for r in _rows(df)])
    return out.getvalue()


def bar_svg(labels: list[str], values: list[float | None], lows: list[float | None], highs: list[float | None]) -> str:
    """Horizontal points with intervals on [0, 1]; what isn't measured has no mark."""
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="640" height="{24 * len(labels) + 16}">']
    for i, (label, v, lo, hi) in enumerate(zip(labels, values, lows, highs, strict=True)):
        y = 24 * i + 20
        safe = label.replace("&", "&amp;").replace("<", "&lt;")
        parts.append(f'<text x="4" y="{y + 4}" font-size="12">{safe}</text>')
        if v is not None and lo is not None and hi is not None:
            parts.append(f'<line x1="{220 + 400 * lo:.2f}" x2="{220 + 400 * hi:.2f}" y1="{y}" y2="{y}" stroke="black"/><circle cx="{220 + 400 * v:.2f}" cy="{y}" r="3"/>')
    return "\n".join([*parts, "</svg>\n"])


def write_tables(folder: str, tables: Mapping[str, DataFrame], summary: Mapping[str, Any]) -> dict[str, str]:
    """CSV files, ``summary.json`` and a manifest of SHA-256 hashes, which is returned."""
    os.makedirs(folder, exist_ok=True)
    texts = {f"{name}.csv": csv_text(df) for name, df in sorted(tables.items())} | {"summary.json": json.dumps(summary, sort_keys=True, indent=2) + "\n"}
    hashes = {}
    for name, text in texts.items():
        Path(folder, name).write_text(text, encoding="utf-8")
        hashes[name] = hashlib.sha256(text.encode()).hexdigest()
    Path(folder, "manifest.json").write_text(json.dumps(hashes, sort_keys=True, indent=2) + "\n", encoding="utf-8")
    return hashes


def pseudonym(secret: bytes, *parts: Any) -> str:
    """24 hex digits of a keyed hash, for identifiers that must not be published."""
    return hmac.new(secret, "\0".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()[:24]


def manifests(selected: DataFrame, flow: DataFrame, criteria: Mapping[str, Any], secret: bytes) -> tuple[dict, dict]:
    """(private, public) manifests of a sample: the public one has pseudonyms and a commitment, no raw id."""
    rows = [r.asDict() for r in selected.select("selection_rank", "subject_id", "hadm_id").orderBy("selection_rank").collect()]
    steps = [r.asDict() for r in flow.orderBy("step").collect()]
    private = {"criteria": dict(criteria), "criteria_hash": content_hash(criteria), "flow": steps, "selected": rows, "cohort_hash": content_hash([[r["subject_id"], r["hadm_id"]] for r in rows])}
    private["manifest_hash"] = content_hash(private)
    public = {"criteria_hash": private["criteria_hash"], "flow": steps, "cases": [pseudonym(secret, r["subject_id"], r["hadm_id"]) for r in rows], "commitment": hmac.new(secret, private["manifest_hash"].encode(), hashlib.sha256).hexdigest()}
    public["manifest_hash"] = content_hash(public)
    return private, public


def verify_manifest(manifest: Mapping[str, Any]) -> bool:
    body = {k: v for k, v in manifest.items() if k != "manifest_hash"}
    return content_hash(body) == manifest.get("manifest_hash")


FENCE = re.compile(r"```json reference\n(.*?)\n```", re.S)


def to_markdown(reference: Mapping[str, Any], title: str = "Reference") -> str:
    """Readable text with the whole reference in a JSON block, which is what is read back."""
    lines = [f"# {title}", ""]
    for section, value in reference.items():
        lines += [f"## {section}", ""]
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, Mapping):
                head, *rest = [f"{k}: {v}" for k, v in item.items() if not isinstance(v, (list, dict))] or [""]
                lines.append("- " + " | ".join([head, *rest]))
            else:
                lines.append(f"- {item}")
        lines.append("")
    return "\n".join([*lines, "```json reference", json.dumps(reference, sort_keys=True, ensure_ascii=False), "```", ""])


def from_markdown(text: str) -> dict[str, Any]:
    if not (block := FENCE.search(text)):
        raise ValueError("no reference block")
    return json.loads(block[1])


def read_markdown(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """References out of Markdown files; files without a sound block have a null reference."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    block = F.regexp_extract("value", r"(?s)```json reference\n(.*?)\n```", 1)
    return raw.select("file", F.from_json(F.when(block != "", block), schema).alias("reference"))


def entry_line(line: str) -> dict[str, str]:
    """A line ``name | key: value | ...`` as a mapping; the first part is the name."""
    head, *rest = [p.strip() for p in line.lstrip("- ").split("|")]
    out = {"name": head}
    for part in rest:
        key, sep, value = part.partition(":")
        if sep:
            out[key.strip().lower()] = value.strip()
    return out
