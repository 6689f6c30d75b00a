"""Stored matchers: cards beside the models, a promotion pointer behind a deploy gate, resolution of the active one."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from kinweave.sources.files import listing, modified, put_text

POINTER = "active.json"
CARD = ".card.json"


class DeployRefused(RuntimeError):
    """A model is worse than the active one by more than the margin."""


def _read(spark: SparkSession, path: str) -> dict | None:
    """The JSON object of a small file; None if it is missing or no object."""
    folder, name = path.rsplit("/", 1)
    if name not in listing(spark, folder):
        return None
    try:
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (json.JSONDecodeError, TypeError):
        return None
    return found if isinstance(found, dict) else None


def write_card(spark: SparkSession, folder: str, model: str, precision: float, recall: float, **more: Any) -> None:
    """The held-out precision and recall of automatic merges, beside the model of that name."""
    put_text(spark, f"{folder}/{model}{CARD}", json.dumps({"model": model, "precision": precision, "recall": recall, **more}, indent=1))


def models(spark: SparkSession, folder: str) -> list[str]:
    """Names of the models that have a card, the last written last, ties by name."""
    found = [n.removesuffix(CARD) for n in listing(spark, folder) if n.endswith(CARD)]
    return sorted(found, key=lambda m: (modified(spark, f"{folder}/{m}{CARD}"), m))


def pointed(spark: SparkSession, folder: str) -> str | None:
    """The model the pointer names, if it is there."""
    name = (_read(spark, f"{folder}/{POINTER}") or {}).get("model")
    return name if name in models(spark, folder) else None


def active_model(spark: SparkSession, folder: str, override: str | None = None) -> str | None:
    """The model to serve: the override (None if it does not exist), else the promoted one, else the newest, else None."""
    if override is not None:
        return override if override in models(spark, folder) else None
    return pointed(spark, folder) or next(reversed(models(spark, folder)), None)


def passes_gate(new: dict, active: dict | None, margin: float = 0.0) -> bool:
    """Precision and recall are each no worse than the active model's by more than the margin; the first model passes."""
    return active is None or all(new.get(k, 0.0) >= active.get(k, 0.0) - margin for k in ("precision", "recall"))


def promote(spark: SparkSession, folder: str, model: str, margin: float = 0.0, force: bool = False) -> bool:
    """Point at the model if it passes the gate against the promoted one, or by force; returns whether it passed."""
    before = pointed(spark, folder)
    ok = passes_gate(_read(spark, f"{folder}/{model}{CARD}") or {}, _read(spark, f"{folder}/{before}{CARD}") if before else None, margin)
    if not ok and not force:
        raise DeployRefused(f"{model} is worse than {before}")
    put_text(spark, f"{folder}/{POINTER}", json.dumps({"model": model, "forced": force and not ok}))
    return ok


_LOADED: dict[tuple[str, int], Any] = {}


def load_cached(spark: SparkSession, path: str, load: Callable[[str], Any]) -> Any:
    """What ``load`` makes of a path, kept until the path is written again."""
    key = (path, modified(spark, path))
    if key not in _LOADED:
        for old in [k for k in _LOADED if k[0] == path]:
            del _LOADED[old]
        _LOADED[key] = load(path)
    return _LOADED[key]


def save_thresholds(spark: SparkSession, folder: str, **values: float) -> dict[str, float]:
    """Overrides of thresholds, each between 0 and 1, added to those stored; returns all."""
    if any(not 0 <= v <= 1 for v in values.values()):
        raise ValueError("a threshold lies between 0 and 1")
    merged = thresholds(spark, folder) | values
    put_text(spark, f"{folder}/thresholds.json", json.dumps(merged))
    return merged


def thresholds(spark: SparkSession, folder: str, **defaults: float) -> dict[str, float]:
    """The defaults with the stored overrides over them."""
    return defaults | {k: float(v) for k, v in (_read(spark, f"{folder}/thresholds.json") or {}).items()}
