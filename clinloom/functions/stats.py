"""Statistical functions: closed forms as columns, design formulas on the driver."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from datetime import UTC, datetime
from statistics import NormalDist, stdev

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard normal quantiles of the supported confidences.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """(estimate, low, high) of the Wilson score interval, clipped to [0, 1]; null without trials."""
    if confidence not in Z:
        raise ValueError(f"confidence must be one of {sorted(Z)}")
    z = Z[confidence]
    n = F.when(trials > 0, trials.cast("double"))
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low = F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - spread))
    return p, low, F.when(n.isNotNull(), F.least(F.lit(1.0), centre + spread))


def required_pairs(sd: float, smallest: float, power: float, alpha: float = 0.05, incomplete: float = 0.0) -> tuple[int, int]:
    """(complete, total) cases for a paired normal test, the total inflated for incomplete ones."""
    if smallest <= 0 or not 0 < alpha < 1 or not 0 <= incomplete < 1:
        raise ValueError("smallest, alpha or incomplete out of range")
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    complete = 2 if sd == 0 else max(2, math.ceil((z * sd / smallest) ** 2))
    return complete, math.ceil(complete / (1 - incomplete))


def required(sd: Column, smallest: float, power: float, alpha: float = 0.05, incomplete: float = 0.0) -> tuple[Column, Column]:
    """``required_pairs`` of a column of spreads."""
    required_pairs(0.0, smallest, power, alpha, incomplete)
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    complete = F.when(sd == 0, 2).otherwise(F.greatest(F.lit(2), F.ceil(F.pow(z * sd / smallest, 2)))).cast("int")
    return complete, F.ceil(complete / (1 - incomplete)).cast("int")


def achieved_power(sd: float, smallest: float, planned: int, alpha: float = 0.05, incomplete: float = 0.0) -> float:
    complete = max(2, math.floor(planned * (1 - incomplete)))
    if sd == 0:
        return 1.0
    shift, edge = smallest * math.sqrt(complete) / sd, NormalDist().inv_cdf(1 - alpha / 2)
    return 1 - NormalDist().cdf(edge - shift) + NormalDist().cdf(-edge - shift)


def power_plan(pilot: Sequence[float], smallest: float, alpha: float = 0.05, incomplete: float = 0.0) -> dict[str, float]:
    """Sample sizes for 80 % and 90 % power from a pilot's paired differences."""
    if len(pilot) < 2:
        raise ValueError("at least two paired differences are needed")
    sd = stdev(pilot)
    out: dict[str, float] = {"pilot_n": len(pilot), "paired_sd": sd}
    for percent in (80, 90):
        out[f"complete_{percent}"], out[f"total_{percent}"] = required_pairs(sd, smallest, percent / 100, alpha, incomplete)
    return out


def assert_powered(sd: float, smallest: float, planned: int, alpha: float = 0.05, incomplete: float = 0.0, target: float = 0.8) -> float:
    """The power of a planned cohort; raises below the target."""
    if planned < 2:
        raise ValueError("a planned cohort has at least two cases")
    power = achieved_power(sd, smallest, planned, alpha, incomplete)
    if power < target:
        raise ValueError(f"a cohort of {planned} has power {power:.3f}, below {target:.3f}")
    return power


def power_record(pilot: Sequence[float], smallest: float, planned: int, frozen_at: datetime, alpha: float = 0.05, incomplete: float = 0.0) -> str:
    """Markdown that states, before a confirmatory run, what its size rests on; the pilot is named by its hash."""
    if frozen_at.tzinfo is None:
        raise ValueError("frozen_at needs a zone")
    if not all(map(math.isfinite, pilot)):
        raise ValueError("pilot differences must be finite")
    plan = power_plan(pilot, smallest, alpha, incomplete)
    digest = hashlib.sha256(json.dumps([float(v) for v in pilot], separators=(",", ":")).encode()).hexdigest()
    facts = {
        "Frozen before the run": frozen_at.astimezone(UTC).isoformat().replace("+00:00", "Z"), "Pilot pairs": plan["pilot_n"], "Pilot SHA-256": digest, "Paired standard deviation": f"{plan['paired_sd']:.8g}",
        "Smallest difference worth finding": f"{smallest:.8g}", "Two-sided alpha": f"{alpha:.6g}", "Allowance for incomplete cases": f"{incomplete:.3%}", "Cases for 80 % power": plan["total_80"], "Cases for 90 % power": plan["total_90"],
        "Planned cases": planned, "Power of the planned cases": f"{achieved_power(plan['paired_sd'], smallest, planned, alpha, incomplete):.3%}", "Method": "normal approximation of a two-sided paired test of means",
    }
    return "\n".join(["# Power of the confirmatory cohort", "", *[f"- {k}: {v}" for k, v in facts.items()], "", "Another pilot, difference, alpha, allowance or size is another run configuration.", ""])
