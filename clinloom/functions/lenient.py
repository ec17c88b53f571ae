"""Lenient reading of text columns: what can't be read is null, for the caller to report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinloom.functions.text import strip

# Words that stand for true and false.
TRUE, FALSE = ("true", "t", "1", "yes"), ("false", "f", "0", "no")


def as_text(value: Column) -> Column:
    return strip(value.cast("string"))


def as_bool(value: Column) -> Column:
    """True or false from a boolean, 0 or 1, or a word in any case; null for anything else."""
    word = F.lower(as_text(value))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def as_long(value: Column) -> Column:
    return as_text(value).try_cast("long")


def as_double(value: Column) -> Column:
    return as_text(value).try_cast("double")


def as_timestamp(value: Column) -> Column:
    """An ISO 8601 date or time; null where it isn't one."""
    return as_text(value).try_cast("timestamp")


def as_codes(value: Column) -> Column:
    """Codes from text such as ``{4280,"41401"}`` or ``4280, 41401``; null means none."""
    items = F.filter(F.transform(F.split(F.regexp_replace(as_text(value), r"^[{}]+|[{}]+$", ""), ","), lambda x: strip(x)), lambda x: x != "")
    return F.coalesce(F.transform(items, lambda x: F.regexp_replace(x, '^"+|"+$', "")), F.array().cast("array<string>"))
