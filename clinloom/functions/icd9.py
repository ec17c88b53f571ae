"""ICD-9 code functions as column expressions: normal form, categories, acuity, Charlson."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A condition's codes: prefixes, three-digit ranges and four-digit ranges."""

    name: str
    weight: int
    prefixes: tuple[str, ...]
    categories: tuple[tuple[int, int], ...] = ()
    four: tuple[tuple[int, int], ...] = ()


# Conditions, weights and codes of the ICD-9 Charlson index.
CHARLSON = (
    Rule("myocardial_infarction", 1, ("410", "412")),
    Rule("congestive_heart_failure", 1, ("39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493", "428"), four=((4254, 4259),)),
    Rule("peripheral_vascular_disease", 1, ("0930", "4373", "440", "441", "4431", "4432", "4438", "4439", "4471", "5571", "5579", "V434")),
    Rule("cerebrovascular_disease", 1, ("36234",), categories=((430, 438),)),
    Rule("dementia", 1, ("290", "2941", "3312")),
    Rule("chronic_pulmonary_disease", 1, ("4168", "4169", "5064", "5081", "5088"), categories=((490, 505),)),
    Rule("rheumatic_disease", 1, ("4465", "7140", "7141", "7142", "7148", "725"), four=((7100, 7104),)),
    Rule("peptic_ulcer_disease", 1, (), categories=((531, 534),)),
    Rule("mild_liver_disease", 1, ("07022", "07023", "07032", "07033", "07044", "07054", "0706", "0709", "570", "571", "5733", "5734", "5738", "5739", "V427")),
    Rule("diabetes_without_complication", 1, ("2500", "2501", "2502", "2503", "2508", "2509")),
    Rule("diabetes_with_complication", 2, ("2504", "2505", "2506", "2507")),
    Rule("hemiplegia_or_paraplegia", 2, ("3341", "342", "343", "3440", "3441", "3442", "3443", "3444", "3445", "3446", "3449")),
    Rule("renal_disease", 2, ("40301", "40311", "40391", "40402", "40403", "40412", "40413", "40492", "40493", "582", "585", "586", "5880", "V420", "V451", "V56"), four=((5830, 5837),)),
    Rule("malignancy", 2, ("2386",), categories=((140, 172), (174, 195), (200, 208))),
    Rule("moderate_or_severe_liver_disease", 3, ("4560", "4561", "4562"), four=((5722, 5728),)),
    Rule("metastatic_solid_tumour", 6, (), categories=((196, 199),)),
    Rule("aids_hiv", 6, ("042", "043", "044")),
)
#: The severe form of a condition supersedes the mild one.
SUPERSEDES = {
    "diabetes_with_complication": "diabetes_without_complication",
    "moderate_or_severe_liver_disease": "mild_liver_disease",
    "metastatic_solid_tumour": "malignancy",
}
# Codes of acute illness and of mechanical ventilation.
ACUTE_PREFIXES, ACUTE_CODES = ("038", "410", "7855"), ("99591", "99592", "78552", "4275", "51881", "51884")
ACUTE_CATEGORIES = ((140, 239), (430, 438))
VENTILATION = ("9670", "9671", "9672", "9604")


def normalise(code: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")


def category(code: Column) -> Column:
    """The category of a normalised code: four characters for E codes, else three."""
    return F.when(F.startswith(code, F.lit("E")), F.substring(code, 1, 4)).otherwise(F.substring(code, 1, 3))


def _beginnings(prefixes: tuple[str, ...], categories: tuple[tuple[int, int], ...], four: tuple[tuple[int, int], ...] = ()) -> list[str]:
    """All beginnings of codes that prefixes, three-digit and four-digit ranges stand for."""
    threes = [f"{n:03d}" for low, high in categories for n in range(low, high + 1)]
    return [*prefixes, *threes, *[f"{n:04d}" for low, high in four for n in range(low, high + 1)]]


def _looked_up(code: Column, masks: dict[str, int]) -> Column:
    """OR of the masks of a code's beginnings: one literal map and one lookup for each length of a beginning."""
    out = F.lit(0)
    for size in sorted({len(k) for k in masks}):
        held = F.create_map(*[F.lit(x) for k, v in masks.items() if len(k) == size for x in (k, v)])
        out = out.bitwiseOR(F.coalesce(F.try_element_at(held, F.substring(code, 1, size)), F.lit(0)))
    return out


def charlson_mask(code: Column) -> Column:
    """The conditions of one normalised code, a bit for each rule; OR over the codes of an admission."""
    masks: dict[str, int] = {}
    for i, rule in enumerate(CHARLSON):
        for k in _beginnings(rule.prefixes, rule.categories, rule.four):
            masks[k] = masks.get(k, 0) | 1 << i
    return _looked_up(code, masks)


def charlson_score(mask: Column) -> Column:
    """The weighted score of a mask, superseded conditions left out."""
    at = {rule.name: 1 << i for i, rule in enumerate(CHARLSON)}
    by_mild = {mild: severe for severe, mild in SUPERSEDES.items()}
    total = F.lit(0)
    for rule in CHARLSON:
        own = mask.bitwiseAND(at[rule.name]) != 0
        if rule.name in by_mild:
            own = own & (mask.bitwiseAND(at[by_mild[rule.name]]) == 0)
        total = total + F.when(own, rule.weight).otherwise(0)
    return total


def is_high_acuity(code: Column) -> Column:
    return (_looked_up(code, dict.fromkeys(_beginnings(ACUTE_PREFIXES, ACUTE_CATEGORIES), 1)) != 0) | code.isin(*ACUTE_CODES)


def _sql_meets(prefixes: tuple[str, ...], categories=(), four=(), exact: tuple[str, ...] = (), code: str = "code") -> str:
    parts = [f"regexp_matches({code}, '^({'|'.join(prefixes)})')"] if prefixes else []
    parts += [f"coalesce(try_cast(substr({code}, 1, 3) AS INTEGER) BETWEEN {a} AND {b}, false)" for a, b in categories]
    parts += [f"(length({code}) >= 4 AND coalesce(try_cast(substr({code}, 1, 4) AS INTEGER) BETWEEN {a} AND {b}, false))" for a, b in four]
    parts += [f"{code} IN ({', '.join(repr(x) for x in exact)})"] if exact else []
    return "(" + " OR ".join(parts) + ")"


def sql_conditions(code: str = "code") -> list[tuple[Rule, str]]:
    """SQL for each rule's condition, for the oracle."""
    return [(r, _sql_meets(r.prefixes, r.categories, r.four, code=code)) for r in CHARLSON]


def sql_high_acuity(code: str = "code") -> str:
    return _sql_meets(ACUTE_PREFIXES, ACUTE_CATEGORIES, exact=ACUTE_CODES, code=code)
