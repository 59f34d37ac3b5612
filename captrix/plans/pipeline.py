"""Declarative edits: a JSON list of operations becomes one logical plan."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from captrix.operators import edit

#: Operations, their parameters, and the edit that each is.
OPERATIONS = {
    "Sort": ((), edit.sort),
    "Shift": (("offset_ms",), edit.shift),
    "MergeAdjacent": (("max_gap_ms",), edit.merge_adjacent),
    "SplitLong": (("max_chars",), edit.split_long),
    "TransformFps": (("in_fps", "out_fps"), edit.transform_framerate),
    "RemoveOverlaps": ((), edit.remove_overlaps),
    "EnforceMinDuration": (("min_ms",), edit.enforce_min_duration),
    "EnforceMaxDuration": (("max_ms",), edit.enforce_max_duration),
    "AutoExtendCps": (("max_cps",), edit.auto_extend_for_cps),
    "FilterEmpty": ((), edit.filter_empty),
    "RemoveDuplicates": ((), edit.remove_duplicates),
}


@dataclass
class Pipeline:
    """Operations as dictionaries with ``op`` and parameters, applied from left to right."""

    operations: list[dict] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        spec = json.loads(text)
        operations = spec.get("operations", [])
        for o in operations:
            if o.get("op") not in OPERATIONS:
                raise ValueError(f"unknown operation: {o.get('op')}")
            missing = [p for p in OPERATIONS[o["op"]][0] if p not in o]
            if missing:
                raise ValueError(f"{o['op']}: missing {', '.join(missing)}")
        return cls(operations)

    def to_json(self) -> str:
        return json.dumps({"operations": self.operations}, indent=2)

    def add(self, op: str, **parameters) -> Pipeline:
        return Pipeline([*self.operations, {"op": op, **parameters}])

    def apply(self, cues: DataFrame) -> DataFrame:
        def one(df: DataFrame, o: dict) -> DataFrame:
            names, step = OPERATIONS[o["op"]]
            return step(df, *[o[n] for n in names])

        return functools.reduce(one, self.operations, cues)


class Builder:
    """The edits as a chain of calls on a cues table."""

    def __init__(self, cues: DataFrame):
        self.cues = cues

    def _then(self, step, *args) -> Builder:
        return Builder(step(self.cues, *args))

    def sort(self) -> Builder:
        return self._then(edit.sort)

    def shift(self, offset_ms: int) -> Builder:
        return self._then(edit.shift, offset_ms)

    def merge_adjacent(self, max_gap_ms: int) -> Builder:
        return self._then(edit.merge_adjacent, max_gap_ms)

    def split_long(self, max_chars: int) -> Builder:
        return self._then(edit.split_long, max_chars)

    def transform_fps(self, in_fps: float, out_fps: float) -> Builder:
        return self._then(edit.transform_framerate, in_fps, out_fps)

    def remove_overlaps(self) -> Builder:
        return self._then(edit.remove_overlaps)

    def enforce_min_duration(self, min_ms: int) -> Builder:
        return self._then(edit.enforce_min_duration, min_ms)

    def enforce_max_duration(self, max_ms: int) -> Builder:
        return self._then(edit.enforce_max_duration, max_ms)

    def auto_extend_cps(self, max_cps: float) -> Builder:
        return self._then(edit.auto_extend_for_cps, max_cps)

    def map(self, **columns: Column) -> Builder:
        return Builder(edit.map_cues(self.cues, **columns))

    def filter(self, condition: Column) -> Builder:
        return self._then(edit.filter_cues, condition)

    def remove_duplicates(self) -> Builder:
        return self._then(edit.remove_duplicates)

    def build(self) -> DataFrame:
        return self.cues
