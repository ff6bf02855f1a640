"""Features, change scores and segments of ranges of samples, all in the pass that reads the samples."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textframes.functions import arrays
from textframes.operators.features import shaped
from textframes.operators.segments import CHANGE
from textframes.operators.timing import Clock
from textframes.sources.shared import few

#: Pixels that are compared together.
PIXELS = 1 << 24
TYPES = {"clip_id": "string", "chunk": "int"}


class RangeScan:
    """Planes, sharpness and scores of samples that come in order, batch after batch; only the last plane is kept."""

    def __init__(self, keys: tuple[str, ...], gamma: float) -> None:
        self.keys, self.gamma, self.last = keys, gamma, None

    def planes(self, batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
        """The plane of each row, and its sharpness: rows of one size and format are computed together."""
        kinds = [*zip(*(batch.column(c).to_pylist() for c in ("w", "h", "fmt", "color_range")), strict=True)]
        data = batch.column("data").to_pylist()
        planes: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(kinds)
        sharp = np.zeros(len(kinds))
        for kind in dict.fromkeys(kinds):
            at = [i for i, x in enumerate(kinds) if x == kind]
            w, h, fmt, color_range = kind
            g = arrays.luma(shaped([data[i] for i in at], w, h, fmt), fmt, color_range, self.gamma)
            sharp[at] = arrays.sharpness(g)
            for i, x in zip(at, g, strict=True):
                planes[i] = x
        return planes, sharp

    def scores(self, batch: pa.RecordBatch, planes: list[np.ndarray]) -> tuple[list[tuple], np.ndarray]:
        """(keys, part, at) of each row, and its score: -1 without a sample right before it."""
        names = [*zip(*(batch.column(c).to_pylist() for c in (*self.keys, "part", "at")), strict=True)]
        threshold = batch.column("threshold").to_pylist()
        before = [self.last, *zip(names, planes, strict=True)][: len(names)]
        score = np.full(len(names), -1, np.int64)
        alike: dict[tuple, list[int]] = {}
        for i, (x, name, plane) in enumerate(zip(before, names, planes, strict=True)):
            if x is not None and x[0][:-1] == name[:-1] and x[0][-1] == name[-1] - 1:
                if x[1].shape == plane.shape:
                    alike.setdefault((plane.shape, threshold[i]), []).append(i)
                else:
                    score[i] = 9  # another size is a change of everything
        for ((h, w), t), rows in alike.items():
            step = max(1, PIXELS // max(1, h * w))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                bits = [np.stack(x) > t for x in ([planes[i] for i in part], [before[i][1] for i in part])]
                score[part] = arrays.cluster(bits[0] != bits[1])
        if names:
            self.last = (names[-1], planes[-1])
        return names, score


def _needed(ranges: DataFrame, thresholds: DataFrame, keys: tuple[str, ...], ordered: bool) -> DataFrame:
    """Rows with their clip's threshold, in order. The sort comes last: below a join Spark would leave it out."""
    measured = few(thresholds)
    joined = ranges.join(measured, list(keys))
    if not ordered or measured is thresholds:
        joined = joined.repartition("clip_id", "part").sortWithinPartitions("clip_id", "part", "at")
    return joined.select(*keys, "fi", "at", "part", "own", "w", "h", "fmt", "color_range", "threshold", "data")


def change_scores(ranges: DataFrame, thresholds: DataFrame, keys: tuple[str, ...] = ("clip_id",), gamma: float = 0.0, ordered: bool = False) -> DataFrame:
    """keys, fi, k, score: the largest 3 x 3 cluster of pixels whose bit (luma > threshold) differs from the sample before.

    The first sample of a key has no score. ranges: samples with part and own, each range with the last sample of the one
    before, which isn't its own. ordered: whether a range lies in one partition, in order; else rows are shuffled by range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = RangeScan(keys, gamma)
        for batch in batches:
            _, score = scan.scores(batch, scan.planes(batch)[0])
            out = [*(batch.column(c) for c in keys), batch.column("fi"), batch.column("at"), pa.array(score.astype(np.int32), mask=score < 0)]
            yield pa.RecordBatch.from_arrays(out, [*keys, "fi", "k", "score"]).filter(batch.column("own"))

    return _needed(ranges, thresholds, keys, ordered).mapInArrow(run, ", ".join(f"{c} {TYPES[c]}" for c in keys) + ", fi bigint, k bigint, score int")


def range_segments(ranges: DataFrame, thresholds: DataFrame, change: float = CHANGE, keys: tuple[str, ...] = ("clip_id",), gamma: float = 0.0,
                   keep_frames: bool = True, keep_planes: bool = True, clock: Clock | None = None, ordered: bool = False) -> DataFrame:
    """keys, part, seg, changes, start, end, n, best, frames: the segments of each range of samples, in the pass that reads them.

    seg counts the changes in the range up to the segment, changes are those of the whole range.
    best: sharp and -fi of the sharpest sample, the first of equals, with its plane (h, w, luma; null unless keep_planes).
    So a plane leaves the task for each segment of a range, not for each sample. ranges, ordered: as in change_scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = RangeScan(keys, gamma)
        name: tuple | None = None
        held: list[list] = []  # segments of the range: start, end, n, sharp, fi, plane, frames
        changes = 0

        def out() -> pa.RecordBatch:
            n, first = len(held), changes - len(held) + 1
            start, end, count, sharp, fi, plane, frames = zip(*held, strict=True)
            columns = [pa.array([x] * n, pa.int32() if c == "chunk" else pa.string()) for c, x in zip(keys, name, strict=False)]
            columns += [pa.array([name[-1]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([changes] * n, pa.int64())]
            shape = [pa.array([p.shape[k] if keep_planes else None for p in plane], pa.int32()) for k in range(2)]
            luma = pa.array([p.tobytes() if keep_planes else None for p in plane], pa.binary())
            best = pa.StructArray.from_arrays([pa.array(sharp, pa.float64()), pa.array([-x for x in fi], pa.int64()), *shape, luma], ["sharp", "at", "h", "w", "luma"])
            columns += [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(count, pa.int64()), best, pa.array(frames, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, [*keys, "part", "seg", "changes", "start", "end", "n", "best", "frames"])

        for batch in batches:
            began = time.perf_counter()
            planes, sharps = scan.planes(batch)
            read = time.perf_counter()
            names, score = scan.scores(batch, planes)
            own, fis = batch.column("own").to_pylist(), batch.column("fi").to_pylist()
            for i, (s, fi, sharp) in enumerate(zip(score.tolist(), fis, sharps.tolist(), strict=True)):
                if not own[i]:
                    continue
                if name != names[i][:-1]:
                    if held:
                        yield out()
                    name, held, changes = names[i][:-1], [], 0
                if s >= change:
                    changes += 1
                if not held or s >= change:
                    held.append([fi, fi, 0, -1.0, fi, planes[i], []])
                last = held[-1]
                last[1], last[2] = fi, last[2] + 1
                if sharp > last[3]:
                    last[3], last[4], last[5] = sharp, fi, planes[i]
                if keep_frames:
                    last[6].append(fi)
            if clock:
                chunk = batch.column("chunk")[0].as_py() if "chunk" in keys and names else 0
                clock.add("decode", read - began, chunk)
                clock.add("segment", time.perf_counter() - read, chunk)
                clock.count(sum(own))
        if held:
            yield out()

    schema = ", ".join(f"{c} {TYPES[c]}" for c in keys)
    schema += ", part bigint, seg bigint, changes bigint, start bigint, end bigint, n bigint, best struct<sharp: double, at: bigint, h: int, w: int, luma: binary>, frames array<bigint>"
    return _needed(ranges, thresholds, keys, ordered).mapInArrow(run, schema)
