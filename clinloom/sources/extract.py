"""A clinical extract behind an interface: one Spark Data Source, several places that tables can be in.

``clinloom_extract`` reads a table of a *place*: a folder of Parquet tables, or a warehouse reached by a
client. Columns are declared before anything is read, so only those asked for are; conditions are given to the
scan, which drops rows before they reach Spark; a byte cap refuses a scan that would read more.
What a place gives must be identified: ``identity`` says which snapshot a table is, under a scheme
of each place's own, so two places never compare equal by accident.

A place is named by ``place``: ``parquet`` with a ``path``, or ``module:function`` of a function that takes the
options and returns a client. A client has ``describe(table)``, with the keys rows, modified and schema (DDL), and
``query(sql, max_bytes)``, an iterator of Arrow record batches. It is made anew in each task, so it is never shipped.

Conditions are named, as ``where`` of ``read_table``, and not taken from the plan: Spark 4.1 keeps a Python
reader with the filters that were pushed into it for the relation's next use, so that a union of two filters of
one DataFrame gives one of them twice. Filters of the plan stay with Spark, and are right on top of ``where``.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from importlib import import_module
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as api
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from clinloom.session import ship

NAME = "clinloom_extract"
#: Bytes of a file that one task reads, and footers that are read at a time for a byte cap.
SPLIT, FOOTERS = 64 << 20, 32
#: Conditions: comparisons, and those on text with their functions in SQL and Arrow.
COMPARE = ("=", "!=", "<", "<=", ">", ">=")
MATCH: dict[str, tuple[str, Callable]] = {"starts with": ("starts_with", pc.starts_with), "ends with": ("ends_with", pc.ends_with), "contains": ("contains", pc.match_substring)}
LISTS, NULLS = ("in", "not in"), ("is null", "is not null")


class Client(Protocol):
    """What a warehouse must be able to do."""

    def describe(self, table: str) -> Mapping[str, Any]: ...

    def query(self, sql: str, max_bytes: int | None) -> Iterator[pa.RecordBatch]: ...


class ExtractError(RuntimeError):
    """A table can't be read, or not within its cap, or not identified."""


@dataclass(frozen=True)
class Term:
    """One condition of a conjunction. A null meets none but ``is null``, as in SQL; NaN is above all numbers, as in Spark."""

    column: str
    kind: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.kind not in (*COMPARE, *MATCH, *LISTS, *NULLS):
            raise ExtractError(f"no condition is called {self.kind!r}")
        values = self.value if self.kind in LISTS else (self.value,)
        if self.kind not in NULLS and any(v is None or v != v for v in values):
            raise ExtractError(f"a condition on {self.column} compares with no value")

    def sql(self) -> str:
        name = _quoted(self.column)
        if self.kind in COMPARE:
            return f"{name} {self.kind.replace('!=', '<>')} {literal(self.value)}"
        if self.kind in LISTS:
            return f"{name} {self.kind.upper()} ({', '.join(map(literal, self.value))})" if self.value else ("FALSE" if self.kind == "in" else f"{name} IS NOT NULL")
        if self.kind in MATCH:
            return f"{MATCH[self.kind][0]}({name}, {literal(self.value)})"
        return f"{name} {self.kind.upper()}"

    def arrow(self, kind: pa.DataType) -> pc.Expression:
        """The same for a column of an Arrow type."""
        column = ds.field(self.column)
        if self.kind in NULLS:
            return column.is_null() if self.kind == "is null" else column.is_valid()
        if self.kind in MATCH:
            return MATCH[self.kind][1](column, self.value)
        if self.kind in LISTS:
            found = column.isin(pa.array([_scalar(v, kind).as_py() for v in self.value], kind))
            return (found if self.kind == "in" else ~found) & column.is_valid()
        value = _scalar(self.value, kind)
        found = {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[self.kind]
        return found | pc.is_nan(column) if pa.types.is_floating(kind) and self.kind[0] == ">" else found


def _scalar(value: Any, kind: pa.DataType) -> pa.Scalar:
    """A value of a condition as one of the column's type; dates and times are given as ISO text, in UTC where the column has a zone."""
    if pa.types.is_timestamp(kind) and kind.tz:
        return pc.cast(pc.assume_timezone(_scalar(value, pa.timestamp(kind.unit)), "UTC"), kind)
    return pc.cast(pa.scalar(value.isoformat() if hasattr(value, "isoformat") else value), kind)


def terms_of(where: Iterable[Sequence], schema: T.StructType) -> list[Term]:
    """Conditions (column, kind, value) as terms, each held against its column's type."""
    out, arrow = [], to_arrow_schema(schema)
    for column, kind, *value in where:
        term = Term(column, kind.lower(), *(tuple(v) if isinstance(v, (list, tuple)) else v for v in value))
        if column not in schema.names:
            raise ExtractError(f"a condition is on {column}, which the table hasn't")
        held = arrow.field(column).type
        if pa.types.is_nested(held) or term.kind in MATCH and not pa.types.is_string(held):
            raise ExtractError(f"{term.kind!r} isn't for {column}, a {held}")
        try:
            term.arrow(held)
        except pa.ArrowInvalid as bad:
            raise ExtractError(f"{column} is compared with what is no {held}: {bad}") from bad
        out.append(term)
    return out


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(value: Any) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if hasattr(value, "isoformat"):
        kind = "TIMESTAMP" if hasattr(value, "hour") else "DATE"
        return f"{kind} '{value.isoformat(sep=' ') if kind == 'TIMESTAMP' else value.isoformat()}'"
    return str(value)


def select(table: str, columns: Sequence[str], terms: Iterable[Term] = (), extra: str = "") -> str:
    """The SQL that a place is asked: exactly the columns, and the predicates that narrow them."""
    where = " AND ".join([t.sql() for t in terms] + ([extra] if extra else []))
    name = ".".join(_quoted(part) for part in table.split("."))
    return f"SELECT {', '.join(map(_quoted, columns)) or 'NULL'} FROM {name}" + (f" WHERE {where}" if where else "")


@dataclass
class Split(api.InputPartition):
    """What one task reads: a range of a file, or one of the warehouse's shards."""

    at: str
    first: int = 0
    last: int = 0
    more: dict[str, Any] = field(default_factory=dict)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as Arrow reaches it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def list_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the files below a path, or of the file that it is, in order of names; hidden ones aside."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise ExtractError(f"{path} does not exist")
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "_.")


class ParquetPlace:
    """A folder of Parquet tables, each a file or a folder ``<table>.parquet``."""

    def __init__(self, options: Mapping[str, str]):
        if not options.get("path"):
            raise ExtractError("a Parquet place needs a path")
        self.path, self.split = options["path"].rstrip("/"), int(options.get("split", SPLIT))

    def files(self, table: str) -> list[tuple[str, int]]:
        found = list_files(f"{self.path}/{table}.parquet", ".parquet")
        if not found:
            raise ExtractError(f"{self.path}/{table}.parquet holds no Parquet file")
        return found

    def schema(self, table: str) -> T.StructType:
        system, _ = file_system(self.path)
        return from_arrow_schema(pq.read_schema(self.files(table)[0][0], filesystem=system), prefer_timestamp_ntz=True)

    def identity(self, table: str) -> str:
        """Names and sizes don't tell contents apart: that takes ``snapshot.tree_hash``."""
        raise ExtractError("a folder is identified by the bytes of its files: see clinloom.sources.snapshot")

    def scanned(self, table: str, columns: set[str]) -> int:
        """Bytes of the columns, from the footers."""
        system, _ = file_system(self.path)

        def of(path: str) -> int:
            meta, total = pq.read_metadata(path, filesystem=system), 0
            for g in range(meta.num_row_groups):
                chunks = (meta.row_group(g).column(c) for c in range(meta.num_columns))
                total += sum(c.total_compressed_size for c in chunks if c.path_in_schema.split(".")[0] in columns)
            return total

        with ThreadPoolExecutor(FOOTERS) as pool:
            return sum(pool.map(of, [path for path, _ in self.files(table)]))

    def splits(self, table: str, columns: Sequence[str], terms: Sequence[Term], cap: int | None) -> list[Split]:
        if cap is not None and (n := self.scanned(table, {*columns, *(t.column for t in terms)})) > cap:
            raise ExtractError(f"{select(table, columns, terms)} would read {n} bytes of {table}; the cap is {cap}")
        return [Split(path, a, min(a + self.split, size)) for path, size in self.files(table) for a in range(0, max(size, 1), self.split)]

    def read(self, split: Split, table: str, schema: T.StructType, terms: Sequence[Term], cap: int | None) -> Iterator[pa.RecordBatch]:
        """The row groups whose middle lies in the split; statistics rule out groups, the filter rows."""
        system, _ = file_system(self.path)
        fragment = ds.ParquetFileFormat().make_fragment(split.at, system)
        file, own = fragment.metadata, []
        for g in range(file.num_row_groups):
            group = file.row_group(g)
            start = min(group.column(c).dictionary_page_offset or group.column(c).data_page_offset for c in range(group.num_columns))
            if split.first <= start + sum(group.column(c).total_compressed_size for c in range(group.num_columns)) // 2 < split.last:
                own.append(g)
        if not own:
            return
        part, wanted = fragment.subset(row_group_ids=own), to_arrow_schema(schema)
        # Columns of another type than declared (or absent) are cast (or null) after the file's own filter.
        held = fragment.physical_schema
        condition = None
        for t in terms:
            if t.column not in held.names:
                if t.kind != "is null":
                    return
                continue
            here = t.arrow(held.field(t.column).type)
            condition = here if condition is None else condition & here
        for batch in part.scanner(columns=[c for c in schema.names if c in held.names], filter=condition).to_batches():
            if batch.num_rows:
                columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted) if columns else batch


class WarehousePlace:
    """Tables behind a client that answers SQL. ``shard_by`` names a whole-number column by which ``shards`` tasks share a scan."""

    def __init__(self, options: Mapping[str, str]):
        module, _, name = options["place"].partition(":")
        self.options = dict(options)
        self.client: Client = getattr(import_module(module), name)(self.options)
        self.shards, self.key = int(options.get("shards", 1)), options.get("shard_by")
        if self.shards > 1 and not self.key:
            raise ExtractError("a scan in shards needs shard_by")

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(self.client.describe(table)["schema"])

    def identity(self, table: str) -> str:
        known = self.client.describe(table)
        if known.get("rows") is None or known.get("modified") is None:
            raise ExtractError(f"{table} has no row count or no time of change, so its snapshot can't be identified")
        return f"{table}\n{int(known['rows'])}\n{known['modified']}\n"

    def splits(self, table: str, columns: Sequence[str], terms: Sequence[Term], cap: int | None) -> list[Split]:
        return [Split(table, k, self.shards) for k in range(self.shards)]

    def read(self, split: Split, table: str, schema: T.StructType, terms: Sequence[Term], cap: int | None) -> Iterator[pa.RecordBatch]:
        shard = f"coalesce(abs({_quoted(self.key)}), 0) % {split.last} = {split.first}" if split.last > 1 else ""
        wanted = to_arrow_schema(schema)
        for batch in self.client.query(select(table, schema.names, terms, shard), cap):
            if batch.num_rows:
                columns = [batch.column(k).cast(f.type) for k, f in enumerate(wanted)]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted) if columns else batch


def place_of(options: Mapping[str, str]) -> ParquetPlace | WarehousePlace:
    kind = options.get("place", "parquet")
    if kind != "parquet" and ":" not in kind:
        raise ExtractError(f"{kind!r} is neither parquet nor module:function")
    return ParquetPlace(options) if kind == "parquet" else WarehousePlace(options)


def _table(options: Mapping[str, str]) -> str:
    if not options.get("table"):
        raise ExtractError("the option table is required")
    return options["table"]


class ExtractSource(api.DataSource):
    """Options: place, table, path, where (JSON), max_bytes, split; shards and shard_by of a warehouse; all others go to the client."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return place_of(self.options).schema(_table(self.options))

    def reader(self, schema: T.StructType) -> ExtractReader:
        return ExtractReader(dict(self.options), schema)


class ExtractReader(api.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.columns, self.table = options, schema, _table(options)
        self.cap = int(options["max_bytes"]) if options.get("max_bytes") else None
        self.terms = [Term(c, k, tuple(v) if isinstance(v, list) else v) for c, k, v in json.loads(options.get("where", "[]"))]

    def sql(self) -> str:
        return select(self.table, self.columns.names, self.terms)

    def partitions(self) -> Sequence[api.InputPartition]:
        return place_of(self.options).splits(self.table, self.columns.names, self.terms, self.cap)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from place_of(self.options).read(partition, self.table, self.columns, self.terms, self.cap)


def read_table(spark: SparkSession, table: str, columns: Sequence[str] | None = None, where: Iterable[Sequence] = (), **options: object) -> DataFrame:
    """The rows of a table that meet all of ``where``, with just ``columns`` (all, if None). Options are those of ``ExtractSource``.

    Conditions are (column, kind, value), with the kinds of ``COMPARE``, ``MATCH``, ``LISTS`` and ``NULLS``; they may
    be on columns that aren't asked for. Dates and times are ISO text or Python's.
    """
    ship(spark)
    spark.dataSource.register(ExtractSource)
    given = {k: str(v) for k, v in options.items() if v is not None} | {"table": table}
    whole = place_of(given).schema(table)
    if columns is not None and (gone := [c for c in columns if c not in whole.names]):
        raise ExtractError(f"{table} has no column {', '.join(gone)}")
    terms = terms_of(where, whole)
    given["where"] = json.dumps([[t.column, t.kind, t.value] for t in terms], default=lambda v: v.isoformat())
    schema = whole if columns is None else T.StructType([whole[c] for c in columns])
    return spark.read.format(NAME).schema(schema).options(**given).load()


def warehouse_snapshot(tables: Sequence[str], **options: object) -> str:
    """A digest of the identity, row count and time of change of the tables, in this order, under the warehouse's own scheme."""
    place = place_of({k: str(v) for k, v in options.items()})
    return "warehouse-sha256:" + hashlib.sha256("".join(place.identity(t) for t in tables).encode()).hexdigest()
