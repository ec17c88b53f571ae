"""Documents that may not change behind a study's back: closed-world shapes, hash locks, freeze dates, run identity.

A shape says all fields a document may have; anything else is refused, as a misspelt field would silently be a default.
A document's hash is that of its canonical JSON. A folder of documents has a lock with the hash of each version: one whose body
changed without a new version is refused, and so is one that the lock doesn't have. A run is named by four hashes of
what it is made from and a fifth of those; resuming under others is refused, with the names of those that differ.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from clinloom.sources.sinks import content_hash

Check = Callable[[Any], str | None]
MISSING = object()
PINNED = re.compile(r"sha256:[0-9a-fA-F]{64}")
LOCK = "_hashes.json"


class LockError(ValueError):
    """A document, a lock or a run isn't what it has to be."""


@dataclass(frozen=True)
class Field:
    """What a field must be, and its value where the document has none."""

    check: Check
    default: Any = MISSING


def text(value: Any) -> str | None:
    return None if isinstance(value, str) and value.strip() else "must be text that isn't blank"


def whole(least: int | None = None) -> Check:
    def check(value: Any) -> str | None:
        if isinstance(value, bool) or not isinstance(value, int):
            return "must be a whole number"
        return f"must be at least {least}" if least is not None and value < least else None

    return check


def number(low: float, high: float = float("inf")) -> Check:
    def check(value: Any) -> str | None:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
            return f"must be a number from {low:g} to {high:g}"
        return None

    return check


def one_of(*values: str) -> Check:
    return lambda value: None if value in values else f"must be one of {', '.join(values)}"


def moment(value: Any) -> str | None:
    try:
        parsed_moment(value)
    except (TypeError, ValueError):
        return "must be an ISO time with a zone"
    return None


def optional(check: Check) -> Check:
    return lambda value: None if value is None else check(value)


def mapping(check: Check, empty: bool = False) -> Check:
    """An object whose values all pass."""

    def over(value: Any) -> str | None:
        if not isinstance(value, Mapping):
            return "must be an object"
        if not value and not empty:
            return "must not be empty"
        for key, item in value.items():
            if not str(key).strip():
                return "has a blank name"
            if problem := check(item):
                return f"{key!r} {problem}"
        return None

    return over


def shaped(shape: Mapping[str, Field]) -> Check:
    """An object of a shape."""

    def check(value: Any) -> str | None:
        try:
            closed(value, shape, "object")
        except LockError as bad:
            return str(bad)
        return None

    return check


def anything(value: Any) -> str | None:
    return None


def parsed_moment(value: str) -> datetime:
    """A time in UTC; one without a zone is refused, as it isn't a moment."""
    out = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if out.tzinfo is None:
        raise ValueError(f"{value!r} has no zone")
    return out.astimezone(UTC)


def closed(value: Any, shape: Mapping[str, Field], what: str) -> dict[str, Any]:
    """The document with its defaults; raises on unknown, missing and unsound fields, all named."""
    if not isinstance(value, Mapping):
        raise LockError(f"a {what} must be an object")
    problems = []
    if unknown := sorted(set(value) - set(shape)):
        problems.append(f"unknown fields: {', '.join(unknown)}")
    if missing := sorted(k for k, f in shape.items() if k not in value and f.default is MISSING):
        problems.append(f"missing fields: {', '.join(missing)}")
    out = {k: value.get(k, f.default) for k, f in shape.items() if k in value or f.default is not MISSING}
    problems += [f"{k} {p}" for k, v in out.items() if k in value and (p := shape[k].check(v))]
    if problems:
        raise LockError(f"{what}: {'; '.join(problems)}")
    return out


MODEL = {"id": Field(text), "digest": Field(text), "family": Field(text), "quantisation": Field(text), "provider_class": Field(text, "LocalOpenAICompatibleProvider"), "prompt_cost_per_million": Field(number(0), 0.0), "completion_cost_per_million": Field(number(0), 0.0)}


def run_shape(variants: tuple[str, ...], modes: tuple[str, ...]) -> dict[str, Field]:
    """The shape of a run's configuration, for an engine's variants and reference modes."""
    return {
        "schema_version": Field(text, "1.0"), "name": Field(text), "variant": Field(one_of(*variants)), "patient_policy_id": Field(text), "patient_policy_version": Field(optional(text), None), "doctor_guidance_id": Field(text),
        "reference_mode": Field(one_of(*modes)), "seed": Field(whole()), "max_turns": Field(whole(1)), "max_attempts": Field(whole(1)), "thresholds": Field(mapping(number(0, 1))), "models": Field(mapping(shaped(MODEL))),
        "prompt_versions": Field(mapping(text)), "frozen_at": Field(optional(moment), None), "input_manifest_hash": Field(text, "UNSPECIFIED"), "batch_config": Field(mapping(anything, True), {}), "metadata": Field(mapping(anything, True), {}),
    }


def run_config(value: Mapping[str, Any], shape: Mapping[str, Field]) -> dict[str, Any]:
    """A sound configuration. Hashes that a manifest states are left out, never trusted; ``id@version`` names a policy's version too."""
    given = {k: v for k, v in value.items() if k not in ("config_hash", "prompt_set_hash")}
    policy, _, version = str(given.get("patient_policy_id", "")).partition("@")
    if version:
        if given.get("patient_policy_version") not in (None, version):
            raise LockError(f"run configuration: policy version {given['patient_policy_version']!r} is not that of {given['patient_policy_id']!r}")
        given |= {"patient_policy_id": policy, "patient_policy_version": version}
    out = closed(given, shape, "run configuration")
    out["models"] = {role: closed(m, MODEL, f"model of {role}") for role, m in sorted(out["models"].items())}
    return out


def require_confirmatory(config: Mapping[str, Any]) -> None:
    """Raise unless everything that a confirmatory run depends on is pinned: freeze time, policy version, inputs, models."""
    problems = []
    if config["frozen_at"] is None:
        problems.append("frozen_at is required")
    if config["patient_policy_version"] is None:
        problems.append("an explicit policy version is required")
    if not PINNED.fullmatch(config["input_manifest_hash"]):
        problems.append("input_manifest_hash must be sha256: and 64 digits")
    if loose := sorted(role for role, m in config["models"].items() if not PINNED.fullmatch(m["digest"])):
        problems.append(f"models are not pinned for {', '.join(loose)}")
    if problems:
        raise LockError(f"not confirmatory: {'; '.join(problems)}")


IDENTITY = ("config_hash", "input_manifest_hash", "prompt_set_hash", "git_commit", "full_hash")


def run_identity(config: Mapping[str, Any], commit: str) -> dict[str, str]:
    """The five hashes of a run."""
    parts = {"config_hash": content_hash(dict(config)), "input_manifest_hash": config["input_manifest_hash"], "prompt_set_hash": content_hash(dict(config["prompt_versions"])), "git_commit": commit}
    return parts | {"full_hash": content_hash(parts)}


def assert_identity(stated: Mapping[str, Any], wanted: Mapping[str, str], what: str = "run") -> None:
    """Raise with every hash that differs."""
    if differ := [f"{k} is {stated.get(k)!r}, not {v!r}" for k, v in wanted.items() if stated.get(k) != v]:
        raise LockError(f"{what} has another identity: {'; '.join(differ)}")


def ensure_frozen_before(frozen_at: str, started: str, what: str) -> None:
    """What judges a run must be older than the run: else it could have been relaxed after its results."""
    if parsed_moment(frozen_at) >= parsed_moment(started):
        raise LockError(f"{what} was frozen at {frozen_at}, which is not before the run began at {started}: give it a new version and run again")


def read_locked(folder: str, shape: Mapping[str, Field], key: Callable[[Mapping[str, Any]], str], what: str) -> dict[str, dict[str, Any]]:
    """The documents of a folder by key, each of the shape and with the hash that the folder's lock has for it."""
    root = Path(folder)
    if not root.is_dir():
        raise LockError(f"there is no folder {folder}")
    lock = json.loads((root / LOCK).read_text(encoding="utf-8")) if (root / LOCK).exists() else None
    out: dict[str, dict[str, Any]] = {}
    for path in sorted(root.glob("*.json")):
        if path.name == LOCK:
            continue
        try:
            value = json.loads(path.read_text(encoding="utf-8"))
        except ValueError as bad:
            raise LockError(f"{path.name} is not JSON: {bad}") from bad
        document = closed(value, shape, f"{what} {path.name}")
        name = key(document)
        if name in out:
            raise LockError(f"{what} {name} is there twice")
        if lock is not None and lock.get(name) != (own := content_hash(value)):
            raise LockError(f"{what} {name} is not in the lock" if name not in lock else f"{what} {name} changed ({own[:12]}, locked {lock[name][:12]}): give it a new version")
        out[name] = document
    if lock is not None and (gone := sorted(set(lock) - set(out))):
        raise LockError(f"{what} {gone[0]} is in the lock but not in the folder")
    return out


def write_lock(folder: str, key: Callable[[Mapping[str, Any]], str]) -> dict[str, str]:
    """Record the hash of each document that the lock hasn't yet; a version that it has is never recorded anew."""
    root = Path(folder)
    old = json.loads((root / LOCK).read_text(encoding="utf-8")) if (root / LOCK).exists() else {}
    documents = [json.loads(p.read_text(encoding="utf-8")) for p in sorted(root.glob("*.json")) if p.name != LOCK]
    new = {key(v): content_hash(v) for v in documents}
    (root / LOCK).write_text(json.dumps(new | old, sort_keys=True, indent=2) + "\n", encoding="utf-8")
    return new | old
