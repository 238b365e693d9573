"""Factors as declared data: a registry, parameter grids, digests, output names, and decision cores."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FactorSpec:
    """What a factor is; ``plan`` names the function that makes (ts, factor, value) rows from a tape."""

    name: str
    plan: str
    params: dict[str, Any] = field(default_factory=dict)
    version: str = "1"
    family: str = ""
    comments: str = ""

    def __post_init__(self) -> None:
        if not self.name.startswith("Monitor"):
            raise ValueError("a factor's name starts with 'Monitor'")

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


PLANS: dict[str, Callable[..., DataFrame]] = {}


def factor_plan(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers ``plan(tape, spec)`` under a name."""

    def add(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in PLANS:
            raise ValueError(f"plan {name} is registered already")
        PLANS[name] = plan
        return plan

    return add


@dataclass
class FactorSet:
    """Specs by name; saved as JSON, with a digest over all."""

    specs: dict[str, FactorSpec] = field(default_factory=dict)

    def add(self, spec: FactorSpec) -> None:
        self.specs[spec.name] = spec

    @property
    def digest(self) -> str:
        return hashlib.sha256("".join(f"{n}:{s.digest}" for n, s in sorted(self.specs.items())).encode()).hexdigest()

    def dump(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps([asdict(s) for s in self.specs.values()], indent=1))

    @classmethod
    def load(cls, path: str | Path) -> FactorSet:
        return cls({s["name"]: FactorSpec(**s) for s in json.loads(Path(path).read_text())})

    def collect(self, tape: DataFrame, only: list[str] | None = None) -> DataFrame:
        """(ts, factor, value) of all factors, their names projected."""
        frames = [output_names(PLANS[s.plan](tape, s), s.name) for s in self.specs.values() if only is None or s.name in only]
        if not frames:
            raise ValueError("no factor is chosen")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def factor_name(monitor: str, key: Column | None = None) -> Column:
    """``Monitor.X`` gives ``X``, with a key ``X.key``."""
    base = F.lit(monitor.removeprefix("Monitor.").removeprefix("Monitor"))
    return F.when(F.coalesce(key, F.lit("")) == "", base).otherwise(F.concat_ws(".", base, key)) if key is not None else base


def output_names(rows: DataFrame, monitor: str) -> DataFrame:
    """(ts, factor, value) from ready rows (ts, key, value[, ready])."""
    kept = rows.where("ready") if "ready" in rows.columns else rows
    return kept.select("ts", factor_name(monitor, F.col("key")).alias("factor"), "value")


def param_grid(ranges: dict[str, list[Any]], static: dict[str, Any] | None = None, name: str | None = None) -> Iterator[dict[str, Any]]:
    """Every combination, the first parameter varying fastest; static values win; ``name`` numbers them."""
    keys = list(ranges)
    combos = itertools.product(*(ranges[k] for k in reversed(keys)))
    for i, values in enumerate(combos):
        out = dict(zip(keys, reversed(values), strict=True)) | (static or {})
        yield out | ({"name": f"Monitor.Grid.{name}.{i}"} if name else {})


class DecisionCore:
    """Turns predictions into a signal of -1, 0 or 1 and a volume; subclasses plug in models."""

    def predict(self, factors: DataFrame) -> DataFrame:
        raise NotImplementedError

    def signal(self, position: Column) -> Column:
        raise NotImplementedError

    def trade_volume(self, position: Column) -> Column:
        raise NotImplementedError

    def calibrate(self, factors: DataFrame) -> dict[str, Any]:
        return {}

    def dump(self, path: str | Path, state: dict[str, Any]) -> None:
        Path(path).write_text(json.dumps(state))

    @staticmethod
    def load(folder: str | Path, pattern: str = "*.json") -> dict[str, Any]:
        """The newest saved state by file name."""
        files = sorted(Path(folder).glob(pattern))
        if not files:
            raise FileNotFoundError(f"no {pattern} in {folder}")
        return json.loads(files[-1].read_text())


class DummyCore(DecisionCore):
    """Never trades."""

    def predict(self, factors: DataFrame) -> DataFrame:
        return factors.withColumn("prediction", F.lit(None).cast("double"))

    def signal(self, position: Column) -> Column:
        return F.lit(0)

    def trade_volume(self, position: Column) -> Column:
        return F.lit(1.0)
