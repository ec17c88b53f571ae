"""References as the older prompts take them: lists as text, absent fields as empty defaults, names in the older writing.

All are column expressions over the types of their columns, so a plan keeps only what it shows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the prompts say where a profile has nothing.
UNSPECIFIED = "Not specified in profile."
NO_ALLERGIES = "None known or not specified in profile."
NO_SYMPTOMS = "No specific symptoms listed in profile to discuss."


def listed(items: Column, sep: str, absent: str) -> Column:
    """The items that aren't null or empty, joined; ``absent`` where there are none."""
    kept = F.filter(items, lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(F.coalesce(F.size(kept) > 0, F.lit(False)), F.array_join(kept, sep)).otherwise(F.lit(absent))


def medications(items: Column, named: bool = False) -> Column:
    """Names joined by commas; ``named`` where items are structs with a name."""
    return listed(F.transform(items, lambda m: m["name"]) if named else items, ", ", UNSPECIFIED)


def allergies(items: Column) -> Column:
    return listed(items, ", ", NO_ALLERGIES)


def symptoms(items: Column, named: bool = False) -> Column:
    """Descriptions joined by semicolons; ``named`` where items are structs with a description."""
    return listed(F.transform(items, lambda s: s["description"]) if named else items, "; ", NO_SYMPTOMS)


def demographics(d: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    return F.when(d.isNotNull(), F.concat(F.lit("Age: "), text(d["age"]), F.lit(", Sex: "), text(d["sex"]))).otherwise(F.lit(UNSPECIFIED))


def _absent(kind: T.DataType) -> Column:
    """The empty default of a type: no items, an empty text, a null of any other."""
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit("" if isinstance(kind, T.StringType) else None).cast(kind)


def pascal(name: str) -> str:
    return "_".join(part[:1].upper() + part[1:] for part in name.split("_"))


def filled(value: Column, kind: T.DataType, rename: Mapping[str, str] | None = None, older: bool = False) -> Column:
    """``value`` with a null, at any depth, as its type's empty default; with ``older`` under the older names (``rename``, else words with capitals)."""
    if isinstance(kind, T.StructType):
        name = lambda f: (rename or {}).get(f, pascal(f)) if older else f
        return F.struct(*[filled(value[f.name], f.dataType, rename, older).alias(name(f.name)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        items = value if not isinstance(kind.elementType, (T.StructType, T.ArrayType)) else F.transform(value, lambda x: filled(x, kind.elementType, rename, older))
        return F.coalesce(items, F.array())
    return F.coalesce(value, _absent(kind))


def legacy(visible: Column, kind: T.StructType, policy_id: str, version: str, rename: Mapping[str, str] | None = None) -> Column:
    """A patient's view in the older writing: masked and absent fields are empty defaults, never missing; with its policy."""
    older = filled(visible, kind, rename, older=True)
    names = [(rename or {}).get(f.name, pascal(f.name)) for f in kind.fields]
    return F.struct(*[older[n].alias(n) for n in names], F.lit(policy_id).alias("profile_type"), F.lit(version).alias("policy_version"))
