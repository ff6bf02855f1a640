"""Seconds and samples that tasks spend, told to the driver as tasks end."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.accumulators import AccumulatorParam


class _Sums(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for k, v in b.items():
            a[k] = a.get(k, 0) + v
        return a


class Clock:
    """Sums by stage over all tasks: seconds of Python work, for each part (chunk) of a clip, and samples seen. A task that is run again counts again."""

    def __init__(self, context: SparkContext) -> None:
        self._sums = context.accumulator({}, _Sums())

    def add(self, stage: str, seconds: float, part: int = 0) -> None:
        self._sums.add({(part, stage): seconds})

    def count(self, samples: int) -> None:
        self._sums.add({"samples": samples})

    @property
    def parts(self) -> list[dict[str, float]]:
        """Of each part, seconds by stage."""
        out: dict[int, dict[str, float]] = {}
        for key, v in dict(self._sums.value).items():
            if isinstance(key, tuple):
                out.setdefault(key[0], {})[key[1]] = float(v)
        return [out[k] for k in sorted(out)]

    @property
    def samples(self) -> int:
        return int(self._sums.value.get("samples", 0))
