"""User inference stages: registry, order, and an error envelope for each row.

A stage gets a pandas batch with the frame's columns and the results of the stages that it
requires, and returns one dict per row. It runs inside Arrow batches on the executors; what it
loads (a model) is made once per worker by ``setup``. A column stage is an expression and stays
in the JVM. What a stage requires but isn't there (unknown or disabled) is missing to it: None
in each row of a batch, or no entry in ``seen``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from graphlib import TopologicalSorter
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proctrace.operators import detections


@dataclass
class Stage:
    name: str
    fields: str
    infer: Callable[[pd.DataFrame, object], list[dict]]
    requires: list[str] = field(default_factory=list)
    enabled: bool = True
    setup: Callable[[], object] | None = None

    def schema(self) -> T.StructType:
        extra = T.StructType.fromDDL(self.fields)
        return T.StructType([T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()), *extra.fields])


@dataclass
class ColumnStage:
    """fields: from the required stages' struct columns by name to the stage's own fields.

    error: null where the row succeeds; the fields of a failed row are null. Expressions that can
    raise on bad values should be the try_ forms.
    """

    name: str
    fields: Callable[[dict[str, Column]], dict[str, Column]]
    requires: list[str] = field(default_factory=list)
    enabled: bool = True
    error: Callable[[dict[str, Column]], Column] | None = None

    def column(self, seen: dict[str, Column]) -> Column:
        error = self.error(seen) if self.error else F.lit(None).cast("string")
        own = [F.when(error.isNull(), c).alias(n) for n, c in self.fields(seen).items()]
        return F.struct(error.isNull().alias("success"), error.alias("error"), *own)


def bubble_stage(circles: str = "circles") -> ColumnStage:
    """Count and rounded circles of a column of (x, y, radius) arrays; a null column fails."""
    found = detections.bubbles(F.col(circles))
    return ColumnStage("bubble_detection", lambda _: {n: found[n] for n in ("bubble_count", "detected", "circles")}, error=lambda _: F.when(F.col(circles).isNull(), "no circles"))


def cleanliness_stage() -> ColumnStage:
    """Score and grade from the bubbles; frames without a count have none."""

    def fields(seen: dict[str, Column]) -> dict[str, Column]:
        n = seen["bubble_detection"]["bubble_count"] if "bubble_detection" in seen else F.lit(None).cast("int")
        score, grade = detections.cleanliness(n, F.lit(True))
        return {"score": score, "grade": grade, "bubble_count": F.coalesce(n, F.lit(0))}

    return ColumnStage("cleanliness", fields, requires=["detection", "bubble_detection"])


class Registry:
    """Stages by name, in the order of registration."""

    def __init__(self) -> None:
        self._stages: dict[str, Stage | ColumnStage] = {}

    def register(self, stage: Stage | ColumnStage) -> None:
        self._stages[stage.name] = stage

    def unregister(self, name: str) -> bool:
        return self._stages.pop(name, None) is not None

    def enable(self, name: str, on: bool = True) -> bool:
        if name in self._stages:
            self._stages[name].enabled = on
        return name in self._stages

    def enabled(self) -> list[Stage | ColumnStage]:
        return [s for s in self._stages.values() if s.enabled]

    def ordered(self) -> list[Stage | ColumnStage]:
        """Stages after what they require; otherwise by registration, independent ones first."""
        stages = {s.name: s for s in self.enabled()}
        sorter = TopologicalSorter({n: [r for r in s.requires if r in stages] for n, s in stages.items()})
        sorter.prepare()
        out: list[Stage | ColumnStage] = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=list(stages).index)
            out += [stages[n] for n in ready]
            sorter.done(*ready)
        return out

    def run(self, frames: DataFrame) -> DataFrame:
        """Adds a struct column for each enabled stage; a row whose stage fails has success false and the error."""
        seen: list[str] = []
        for columnar, group in groupby(self.ordered(), key=lambda s: isinstance(s, ColumnStage)):
            if not columnar:
                stages = list(group)
                frames = _in_batches(frames, stages)
                seen += [s.name for s in stages]
                continue
            for s in group:
                frames = frames.withColumn(s.name, s.column({r: F.col(r) for r in s.requires if r in seen}))
                seen.append(s.name)
        return frames


def _in_batches(frames: DataFrame, stages: list[Stage]) -> DataFrame:
    """Consecutive batch stages in one pass."""
    names = {s.name: s.schema().names for s in stages}
    schema = T.StructType([*frames.schema.fields, *[T.StructField(s.name, s.schema()) for s in stages]])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = {s.name: s.setup() if s.setup else None for s in stages}
        for batch in batches:
            for s in stages:
                missing = {r: None for r in s.requires if r not in batch}
                batch[s.name] = _guarded(s, names[s.name], batch.assign(**missing), loaded[s.name])
            yield batch

    return frames.mapInPandas(work, schema)


def _envelope(names: list[str], row: dict) -> dict:
    return {n: row.get(n) for n in names} | {"success": row.get("success", True), "error": row.get("error")}


def _guarded(stage: Stage, names: list[str], batch: pd.DataFrame, model: object) -> list[dict]:
    """The whole batch at once; row by row if that fails, so that one row's failure is its own."""
    try:
        return [_envelope(names, r) for r in stage.infer(batch, model)]
    except Exception:  # noqa: BLE001  the row's own error follows
        out = []
        for i in range(len(batch)):
            try:
                out.append(_envelope(names, stage.infer(batch.iloc[i : i + 1], model)[0]))
            except Exception as e:  # noqa: BLE001
                out.append(_envelope(names, {"success": False, "error": str(e)}))
        return out
