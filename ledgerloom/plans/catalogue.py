"""Approved operations by name, and plans of them run in dependency order."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Step:
    """One operation of a plan. ``keep`` filters the result by equality; ``needs`` maps columns to columns of
    earlier steps whose values restrict it (a semi-join, never a list on the driver)."""

    name: str
    operation: str
    keep: dict[str, object] = field(default_factory=dict)
    needs: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass
class Result:
    name: str
    data: DataFrame | None
    error: str | None
    planned_ms: float


def run_plan(spark: SparkSession, sf: str, steps: list[Step], operations: dict[str, Callable[[SparkSession, str], DataFrame]], most_steps: int = 10) -> list[Result]:
    """Composes the steps lazily. An unknown operation or a failed need fails its step alone; a cycle fails all."""
    if len(steps) > most_steps:
        raise ValueError(f"a plan has at most {most_steps} steps")
    by_name = {s.name: s for s in steps}
    try:
        order = list(TopologicalSorter({s.name: {n for n, _ in s.needs.values()} for s in steps}).static_order())
    except CycleError as e:
        return [Result(s.name, None, f"cycle: {e.args[1]}", 0.0) for s in steps]
    done: dict[str, Result] = {}
    for name in order:
        began = time.time()
        step = by_name.get(name)
        try:
            if step is None or step.operation not in operations:
                raise KeyError(f"no such operation: {step.operation if step else name}")
            df = operations[step.operation](spark, sf)
            for column, value in step.keep.items():
                df = df.filter(F.col(column) == F.lit(value))
            for column, (other, source) in step.needs.items():
                if done[other].data is None:
                    raise RuntimeError(f"{other} failed")
                df = df.join(done[other].data.select(F.col(source).alias(column)).distinct(), column, "left_semi")
            done[name] = Result(name, df, None, (time.time() - began) * 1000)
        except Exception as e:  # noqa: BLE001 - a step's failure is its result
            done[name] = Result(name, None, str(e), (time.time() - began) * 1000)
    return [done[s.name] for s in steps]
