"""Frames as rows, and clips made of other tables.

frames: clip_id string, fi bigint, w int, h int, fmt string (rgb, gray or nv12), color_range tinyint
(0 limited, 1 full), data binary (row-major bytes; w x h x channels, or packed 4:2:0 rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textframes.operators.ordered import running_total

FRAMES = "clip_id string, fi bigint, w int, h int, fmt string, color_range tinyint, data binary"
#: Samples dealt by ranges: k counts samples, own is false for the last sample of the range before.
HALO = FRAMES + ", k bigint, part bigint, own boolean"
#: Samples of a range.
RANGE = 1024


def bytes_of(values: Column) -> Column:
    """An array of ints 0..255 as binary."""
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def clip_of_vectors(vectors: DataFrame, side: int = 8) -> DataFrame:
    """A gray clip: vector v is shown for v % 4 + 1 frames; g = 255 value + 128, cut to a byte.

    From the second frame on of every third vector the square 2..4 is inverted.
    """
    rows = vectors.select(F.col("vec_id").alias("v"), "embedding")
    first = running_total(rows, [], "v", F.col("v") % 4 + 1, "after")
    shown = first.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("v") % 4).cast("int"))))
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 255 + 128).cast("int")))
    inside = lambda p: (F.floor(p / side).between(2, 4)) & ((p % side).between(2, 4))
    flip = (F.col("v") % 3 == 0) & (F.col("j") >= 1)
    pixels = F.transform("embedding", lambda x, p: F.when(flip & inside(p), 255 - level(x)).otherwise(level(x)))
    fi = F.col("after") - (F.col("v") % 4 + 1) + F.col("j")
    return shown.select(
        F.lit("clip").alias("clip_id"), fi.cast("bigint").alias("fi"), F.lit(side).alias("w"), F.lit(side).alias("h"), F.lit("gray").alias("fmt"),
        F.lit(1).cast("tinyint").alias("color_range"), bytes_of(pixels).alias("data"),
    )


def pixels(frames: DataFrame) -> DataFrame:
    """clip_id, fi, y, x, g: one row for each byte of one-channel frames."""
    values = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda p: F.conv(F.hex(F.expr("data").substr(p, F.lit(1))), 16, 10).cast("int"))
    flat = frames.select("clip_id", "fi", "w", F.posexplode(values).alias("p", "g"))
    return flat.select("clip_id", "fi", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), "g")


def crop(frames: DataFrame, roi: tuple[int, int, int, int]) -> DataFrame:
    """The closed box x1, y1, x2, y2 of rgb or gray frames; frames of that size already stay."""
    x1, y1, x2, y2 = roi
    w, h = x2 - x1 + 1, y2 - y1 + 1
    channels = F.when(F.col("fmt") == "rgb", 3).otherwise(1)
    row = lambda y: F.expr("data").substr(((y * F.col("w") + x1) * channels + 1).cast("int"), (F.lit(w) * channels).cast("int"))
    cut = F.aggregate(F.sequence(F.lit(y1), F.lit(y2)), F.lit(b""), lambda out, y: F.concat(out, row(y)))
    whole = (F.col("w") == w) & (F.col("h") == h)
    named = frames.withColumn("_data", F.when(whole, F.col("data")).otherwise(cut)).drop("data", "w", "h")
    return named.withColumns({"data": F.col("_data"), "w": F.lit(w), "h": F.lit(h)}).drop("_data")


def sample(frames: DataFrame, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    """Frames start, start + stride, ... before end (None or 0: all), with their ordinal k; a plain filter on fi."""
    stride = max(1, int(stride))
    kept = frames.where(F.col("fi") >= start)
    if end:
        kept = kept.where(F.col("fi") < end)
    return kept.where((F.col("fi") - start) % stride == 0).withColumn("k", F.expr(f"(fi - {start}L) div {stride}"))


def with_halo(samples: DataFrame) -> DataFrame:
    """Samples with the range of k that they are in (part); the last of a range also goes to the next one, as not its own."""
    part = F.floor(F.col("k") / RANGE)
    own, next_ = F.struct(part.alias("part"), F.lit(True).alias("own")), F.struct((part + 1).alias("part"), F.lit(False).alias("own"))
    twice = F.when(F.col("k") % RANGE == RANGE - 1, F.array(own, next_)).otherwise(F.array(own))
    return samples.withColumn("_to", F.explode(twice)).select(*samples.columns, "_to.part", "_to.own")


def charset(spark, path: str) -> DataFrame:
    """idx, ch: the blank, the lines of a text file in order, a space."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n").alias("lines"))
    table = F.concat(F.array(F.lit("")), F.col("lines"), F.array(F.lit(" ")))
    return lines.select(F.posexplode(table).alias("idx", "ch"))
