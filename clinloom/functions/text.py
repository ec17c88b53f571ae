"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a failure report looks like in a turn.
SENTINELS = (
    r"\[\s*ERROR\b",
    r"\berror generating\b",
    r"\bunable to generate\b",
    r"\bfailed to generate\b",
    r"\bno response (?:was )?(?:generated|received)\b",
    r"\b(?:api|provider|model) (?:error|failure|unavailable)\b",
)
# Symptoms whose repetition is watched.
SYMPTOMS = ("pain", "headache", "fever", "cough", "nausea", "dizziness", "fatigue", "weakness", "shortness of breath", "chest pain")
ROLES = {"patient": "Patient", "user": "Patient", "doctor": "Doctor", "physician": "Doctor", "assistant": "Doctor"}


def strip(text: Column, unicode: bool = True) -> Column:
    """Without white space at either end; of all Unicode by default."""
    flag = "(?U)" if unicode else ""
    return F.regexp_replace(text, rf"{flag}^\s+|\s+$", "")


def role(name: Column) -> Column:
    """Patient or Doctor; null for any other role, which the caller must report or reject."""
    key = F.lower(strip(name))
    out = F.lit(None).cast("string")
    for given, canonical in ROLES.items():
        out = F.when(key == given, F.lit(canonical)).otherwise(out)
    return out


def has_sentinel(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(SENTINELS))


def opening(text: Column) -> Column:
    """The first five words of the first sentence, bold passages removed, in lower case."""
    plain = F.regexp_replace(text, r"\*\*.*?\*\*", "")
    first = strip(F.split(plain, r"\.")[0])
    words = F.filter(F.split(F.lower(first), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, 5), " ")


def tokens(text: Column) -> Column:
    """Distinct words between white space."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2 * both / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """|a and b| / |a or b|; ``empty`` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def bounded(pattern: str, unicode: bool = True) -> str:
    """A pattern that only matches whole words, of Unicode or of ASCII letters, digits and underscores."""
    return rf"(?U)\b{pattern}\b" if unicode else rf"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def word_pattern(terms: Iterable[str], unicode: bool = True) -> str | None:
    """One pattern of whole terms in any case, the longest first; None without terms."""
    ordered = sorted({t for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    if not ordered:
        return None
    return "(?i)" + bounded("(?:" + "|".join(re.escape(t) for t in ordered) + ")", unicode)


def redact(text: Column, terms: Iterable[str], mark: str = "[REDACTED]", unicode: bool = True) -> tuple[Column, Column]:
    """(text with every term replaced, number of replacements)."""
    pattern = word_pattern(terms, unicode)
    if pattern is None:
        return text, F.lit(0)
    return F.regexp_replace(text, pattern, mark), F.regexp_count(text, F.lit(pattern))


def substitute(text: Column, table: Mapping[str, str], unicode: bool = True) -> Column:
    """Whole phrases replaced one after another, the longest first."""
    for phrase in sorted(table, key=len, reverse=True):
        text = F.regexp_replace(text, bounded(re.escape(phrase), unicode), table[phrase].replace("$", r"\$"))
    return text


def collapse(text: Column, unicode: bool = True) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+" if unicode else r"\s+", " "), unicode)


def remove(text: Column, phrases: Iterable[str], unicode: bool = True) -> Column:
    """Whole phrases removed, the longest first, and white space collapsed."""
    return collapse(substitute(text, dict.fromkeys(phrases, " "), unicode), unicode)
