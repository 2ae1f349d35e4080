"""Settings of a run: typed, checked as a whole, from JSON or a profile of a matrix."""

from __future__ import annotations

import dataclasses
import difflib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Settings:
    """What a run needs to know. Bounds are in BOUNDS, choices in CHOICES."""

    mode: str = "synthetic"
    preset: str = "snv_sg_mc"
    window: int = 25
    poly: int = 2
    deriv: int = 1
    folds: int = 5
    most_components: int = 10
    alpha: float = 0.05
    seed: int = 42
    wn_min: float | None = None
    wn_max: float | None = None
    range_low: float | None = None
    range_high: float | None = None
    labels_seen: str = "blind"


BOUNDS = {"window": (3, 501), "poly": (0, 9), "deriv": (0, 4), "folds": (2, 50), "most_components": (1, 100), "alpha": (1e-6, 0.5)}
CHOICES = {"mode": ("synthetic", "csv", "spectra", "images"), "labels_seen": ("blind", "control")}


def check(values: dict) -> tuple[Settings, list[str]]:
    """(settings, errors). Every error is found before any is reported; unknown names come with a near one."""
    errors, good = [], {}
    fields = {f.name: f for f in dataclasses.fields(Settings)}
    for k, v in values.items():
        if k not in fields:
            near = difflib.get_close_matches(k, fields, 1)
            errors.append(f"unknown setting {k!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
            continue
        kind = str(fields[k].type).split(" |")[0]
        if v is None and "None" in str(fields[k].type):
            good[k] = None
        elif kind == "str" and isinstance(v, str) or kind == "int" and isinstance(v, int) and not isinstance(v, bool):
            good[k] = v
        elif kind == "float" and isinstance(v, int | float) and not isinstance(v, bool):
            good[k] = float(v)
        else:
            errors.append(f"{k}: {v!r} is no {kind}")
            continue
        if k in BOUNDS and not BOUNDS[k][0] <= good[k] <= BOUNDS[k][1]:
            errors.append(f"{k}: {v!r} is not within {BOUNDS[k][0]} to {BOUNDS[k][1]}")
        if k in CHOICES and good[k] not in CHOICES[k]:
            errors.append(f"{k}: {v!r} is none of {', '.join(CHOICES[k])}")
    s = Settings(**good)
    if s.window % 2 == 0:
        errors.append("window: must be odd")
    if s.poly >= s.window or s.deriv > s.poly:
        errors.append("poly must be under window, deriv at most poly")
    for a, b in (("wn_min", "wn_max"), ("range_low", "range_high")):
        lo, hi = getattr(s, a), getattr(s, b)
        if lo is not None and hi is not None and lo >= hi:
            errors.append(f"{a} must be under {b}")
    return s, errors


def _text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).select("value").first()
    if row is None:
        raise ValueError(f"{path} is empty")
    return row[0]


def load(spark: SparkSession, path: str) -> Settings:
    s, errors = check(json.loads(_text(spark, path)))
    if errors:
        raise ValueError("; ".join(errors))
    return s


def save(spark: SparkSession, settings: Settings, path: str) -> None:
    spark.createDataFrame([(json.dumps(dataclasses.asdict(settings), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def apply_profile(settings: Settings, profiles: dict[str, dict], name: str) -> Settings:
    """settings with the values of a named profile where they still have their defaults; an unknown name is
    an error before anything is read."""
    if name not in profiles:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(sorted(profiles))}")
    wanted, errors = check(profiles[name])
    if errors:
        raise ValueError("; ".join(errors))
    default = Settings()
    free = {k: getattr(wanted, k) for k in profiles[name] if getattr(settings, k) == getattr(default, k)}
    return dataclasses.replace(settings, **free)


def fingerprint(spark: SparkSession, settings: Settings) -> str:
    """SHA-256 of the settings: the name of a run's output."""
    return spark.range(1).select(F.sha2(F.lit(json.dumps(dataclasses.asdict(settings), sort_keys=True)), 256)).first()[0]
