"""Paths into nested columns, compiled to expressions: values, removals and redactions, each counted by path.

A path is dotted, with ``[]`` after a list field, as ``knowledge.paths`` gives them: ``core.diagnoses[].primary``. It is
checked against the column's type once, and becomes nested ``transform``, ``withField``, ``dropFields`` and ``flatten``; no row
is looked at by Python. A null is a value that isn't there: it is neither found, nor counted, nor redacted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinloom.functions import text as tx

MARK = "[REDACTED]"
Steps = Sequence[tuple[str, bool]]


def steps(path: str) -> Steps:
    """(name, whether a list is gone through) of each part; a list at the end is taken as a whole."""
    parts = path.split(".")
    if not all(p.removesuffix("[]") for p in parts):
        raise ValueError(f"{path!r} is no path")
    out = [(p.removesuffix("[]"), p.endswith("[]")) for p in parts]
    return [*out[:-1], (out[-1][0], False)]


def type_at(kind: T.DataType, path: str) -> T.DataType:
    """The type of the values at a path; raises if the type has no such path."""
    for name, listed in steps(path):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            raise ValueError(f"there is no {path!r}: {name!r} is not a field")
        kind = kind[name].dataType
        if listed:
            if not isinstance(kind, T.ArrayType):
                raise ValueError(f"there is no {path!r}: {name!r} is not a list")
            kind = kind.elementType
        elif isinstance(kind, T.ArrayType) and name != steps(path)[-1][0]:
            raise ValueError(f"there is no {path!r}: {name!r} is a list")
    return kind


def _found(value: Column, way: Steps, leaf: T.DataType) -> Column:
    (name, listed), rest = way[0], way[1:]
    if not rest:
        return F.array_compact(F.array(value[name]))
    if not listed:
        return _found(value[name], rest, leaf)
    return F.coalesce(F.flatten(F.transform(value[name], lambda x: _found(x, rest, leaf))), F.array().cast(T.ArrayType(leaf)))


def found(value: Column, kind: T.DataType, path: str) -> Column:
    """All values at a path, in order, as an array; empty where it reaches nothing."""
    leaf = type_at(kind, path)
    return F.coalesce(_found(value, steps(path), leaf), F.array().cast(T.ArrayType(leaf)))


def resolve(value: Column, kind: T.DataType, path: str) -> Column:
    """The value at a path, or the array of values of a path through a list; null where it reaches nothing."""
    all_of = found(value, kind, path)
    return F.when(F.size(all_of) > 0, all_of) if "[]" in path.rsplit(".", 1)[0] else F.get(all_of, F.lit(0))


def _changed(value: Column, way: Steps, change: Callable[[Column, str], Column]) -> Column:
    """``value`` with ``change(container, name)`` made in every struct that the path's last field is in."""
    (name, listed), rest = way[0], way[1:]
    if not rest:
        return change(value, name)
    inner = F.transform(value[name], lambda x: _changed(x, rest, change)) if listed else _changed(value[name], rest, change)
    return value.withField(name, inner)


def drop(value: Column, kind: T.DataType, path: str) -> tuple[Column, Column]:
    """(``value`` without the field at a path, how many values were removed). A struct's only field can't be dropped."""
    parent, _, name = path.rpartition(".")
    holder = type_at(kind, parent) if parent else kind
    if isinstance(holder, T.ArrayType):
        holder = holder.elementType
    type_at(kind, path)
    if len(holder.fields) == 1:
        raise ValueError(f"{path!r} is all that its container has: drop the container")
    return _changed(value, steps(path), lambda v, field: v.dropFields(field)), F.size(found(value, kind, path)).cast("long")


def without_type(kind: T.DataType, path: str) -> T.DataType:
    """The type of what ``drop`` leaves."""
    (name, listed), rest = steps(path)[0], path.split(".")[1:]
    fields = []
    for f in kind.fields:
        if f.name != name:
            fields.append(f)
        elif rest:
            inner = f.dataType.elementType if listed else f.dataType
            left = without_type(inner, ".".join(rest))
            fields.append(T.StructField(name, T.ArrayType(left, f.dataType.containsNull) if listed else left, f.nullable))
    return T.StructType(fields)


def drop_paths(df: DataFrame, column: str, paths: Iterable[str], counts: str = "removed") -> DataFrame:
    """``df`` with every path removed from a struct column, and a map of how many values each had."""
    value, kind, made = F.col(column), df.schema[column].dataType, []
    for path in sorted(set(paths), key=lambda p: (-p.count("."), p)):  # inner ones first, so that each is counted
        value, n = drop(value, kind, path)
        kind = without_type(kind, path)
        made += [F.lit(path), n]
    return df.select("*", F.create_map(*made).alias(counts)).withColumn(column, value) if made else df.withColumn(counts, F.create_map().cast("map<string, long>"))


def _strings(value: Column, kind: T.DataType, each: Callable[[Column], Column]) -> Column:
    """``value`` with every text in it changed."""
    if isinstance(kind, T.StringType):
        return each(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _strings(x, kind.elementType, each)) if _has_text(kind) else value
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            if _has_text(f.dataType):
                value = value.withField(f.name, _strings(value[f.name], f.dataType, each))
    return value


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    return isinstance(kind, T.StringType) or isinstance(kind, T.StructType) and any(_has_text(f.dataType) for f in kind.fields)


def _hits(value: Column, kind: T.DataType, pattern: str) -> Column:
    """How often a pattern matches in all texts of a value."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.regexp_count(value, F.lit(pattern)), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType) and _has_text(kind):
        return F.coalesce(F.aggregate(F.transform(value, lambda x: _hits(x, kind.elementType, pattern)), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    out = F.lit(0).cast("long")
    for f in kind.fields if isinstance(kind, T.StructType) else ():
        if _has_text(f.dataType):
            out = out + _hits(value[f.name], f.dataType, pattern)
    return out


def hits(value: Column, kind: T.DataType, path: str, pattern: str) -> Column:
    """How often a pattern matches in all texts at or below a path."""
    return _hits(found(value, kind, path), T.ArrayType(type_at(kind, path)), pattern)


def redact_paths(df: DataFrame, column: str, paths: Iterable[str], terms: Iterable[str], counts: str = "redactions", unicode: bool = True) -> DataFrame:
    """``df`` with whole terms replaced in all texts at or below the paths, and a map of how many each path had.

    Paths must not lie inside each other, as a term would count twice.
    """
    paths = sorted(set(paths))
    if inside := [(a, b) for a in paths for b in paths if a != b and b.startswith((f"{a}.", f"{a}["))]:
        raise ValueError(f"{inside[0][1]!r} lies inside {inside[0][0]!r}")
    pattern = tx.word_pattern(terms, unicode)
    value, kind, made = F.col(column), df.schema[column].dataType, []
    for path in paths:
        leaf = type_at(kind, path)
        made += [F.lit(path), hits(F.col(column), kind, path, pattern) if pattern else F.lit(0).cast("long")]
        if pattern and _has_text(leaf):
            value = _changed(value, steps(path), lambda v, name, leaf=leaf: v.withField(name, _strings(v[name], leaf, lambda s: F.regexp_replace(s, pattern, MARK))))
    mapped = F.create_map(*made) if made else F.create_map().cast("map<string, long>")
    return df.select("*", mapped.alias(counts)).withColumn(column, value)
