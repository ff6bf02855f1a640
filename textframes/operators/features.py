"""What segmentation needs of each frame: luma, sharpness and its own threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textframes.functions import arrays

FEATURES = "clip_id string, fi bigint, k bigint, w int, h int, sharp double, otsu int, luma binary"
#: Samples that set a clip's threshold.
CALIBRATION = 50


def shaped(data: list[bytes], w: int, h: int, fmt: str) -> np.ndarray:
    """Frames of one size as an array: (n, h, w, channels), or (n, rows, w) for packed 4:2:0."""
    flat = np.frombuffer(b"".join(data), np.uint8)
    if fmt == "nv12":
        return flat.reshape(len(data), -1, w)
    return flat.reshape(len(data), h, w, 3 if fmt == "rgb" else 1)


def frame_features(frames: DataFrame, gamma: float = 0.0, more: str = "") -> DataFrame:
    """One row for each frame (clip_id, fi, k, w, h, fmt, color_range, data): one pass, fused with the scan.

    Frames of the same size in a batch are computed together. A frame without data is left out.
    more: an int column that is carried.
    """
    carried = [more] if more else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [*zip(*(batch.column(c).to_pylist() for c in ("w", "h", "fmt", "color_range")), strict=True)]
            for kind in dict.fromkeys(kinds):
                at = pa.array([k for k, x in enumerate(kinds) if x == kind])
                part = batch.take(at)
                w, h, fmt, color_range = kind
                g = arrays.luma(shaped(part.column("data").to_pylist(), w, h, fmt), fmt, color_range, gamma)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("clip_id"), part.column("fi"), part.column("k"), pa.array(np.full(len(g), g.shape[2], np.int32)), pa.array(np.full(len(g), g.shape[1], np.int32)),
                        pa.array(arrays.sharpness(g)), pa.array(arrays.otsu(arrays.histograms(g)).astype(np.int32)), pa.array([x.tobytes() for x in g], pa.binary()), *(part.column(c) for c in carried),
                    ],
                    ["clip_id", "fi", "k", "w", "h", "sharp", "otsu", "luma", *carried],
                )

    columns = ("clip_id", "fi", "k", "w", "h", "fmt", "color_range", "data", *carried)
    return frames.where("data is not null").select(*columns).mapInArrow(run, FEATURES + "".join(f", {c} int" for c in carried))


def median_thresholds(features: DataFrame, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """keys, threshold: the median of the samples' own thresholds, cut to an int."""
    return features.groupBy(*keys).agg(F.floor(F.percentile("otsu", F.lit(0.5))).cast("int").alias("threshold"))


def clip_thresholds(features: DataFrame, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """keys, threshold: the median of the first CALIBRATION samples' own thresholds, cut to an int."""
    return median_thresholds(features.where(F.col("k") < CALIBRATION), keys)


def clip_thresholds_strided(features: DataFrame) -> DataFrame:
    """clip_id, threshold from samples spread over the whole clip: every max(1, n / CALIBRATION)-th, CALIBRATION at most."""
    sizes = features.groupBy("clip_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / CALIBRATION)).alias("step"))
    some = features.select("clip_id", "k", "otsu").join(sizes, "clip_id").where((F.col("k") % F.col("step") == 0) & (F.col("k") < F.col("step") * CALIBRATION))
    return some.groupBy("clip_id").agg(F.floor(F.percentile("otsu", F.lit(0.5))).cast("int").alias("threshold"))


def histogram(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, g, n: occurrences of each level."""
    return pixels.groupBy(*keys, "g").agg(F.count("*").alias("n"))


def otsu(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, threshold of each histogram (keys, g, n) in DataFrame operations: the first level that best parts it."""
    whole, below = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    n, mass = F.col("n").cast("double"), F.col("n").cast("double") * F.col("g")
    sums = counts.select(*keys, "g", F.sum(n).over(below).alias("b"), F.sum(n).over(whole).alias("all"), F.sum(mass).over(below).alias("mb"), F.sum(mass).over(whole).alias("m"))
    above, apart = F.col("all") - F.col("b"), F.col("mb") / F.col("b") - (F.col("m") - F.col("mb")) / (F.col("all") - F.col("b"))
    spread = F.when(F.col("b") < F.col("all"), F.col("b") * above * apart * apart).otherwise(-1.0)
    best = sums.groupBy(*keys).agg(F.max(F.struct(spread.alias("spread"), (-F.col("g")).alias("at"))).alias("x"))
    return best.select(*keys, F.when(F.col("x.spread") > 0, -F.col("x.at")).otherwise(arrays.FLAT).cast("int").alias("threshold"))


def pooled_thresholds(features: DataFrame) -> DataFrame:
    """clip_id, threshold of the first CALIBRATION samples' pixels taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in batch.column("luma").to_pylist()]) if batch.num_rows else np.zeros((0, 256), int)
            row, g = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column("clip_id").take(pa.array(row)), pa.array(g.astype(np.int32)), pa.array(counts[row, g].astype(np.int64))], ["clip_id", "g", "n"])

    first = features.where(F.col("k") < CALIBRATION).select("clip_id", "luma").mapInArrow(run, "clip_id string, g int, n bigint")
    return otsu(first.groupBy("clip_id", "g").agg(F.sum("n").alias("n")), "clip_id")
