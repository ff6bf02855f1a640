"""The pixel functions as Spark columns over single values; each agrees with its numpy form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textframes.functions.arrays import GRAY_WEIGHTS, INPUT_HEIGHT


def gray(r: Column, g: Column, b: Column) -> Column:
    parts = [c.cast("double") * w for c, w in zip((r, g, b), GRAY_WEIGHTS, strict=True)]
    return F.floor(parts[0] + parts[1] + parts[2]).cast("int")


def expand_range(y: Column, color_range: int = 0) -> Column:
    if color_range == 1:
        return y
    wide = F.floor((y.cast("double") - 16) * 255 / 219 + 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(255), wide.cast("int")))


def curve(g: Column, gamma: float) -> Column:
    return g if gamma <= 0 else F.floor(F.pow(g.cast("double") / 255, F.lit(float(gamma))) * 255).cast("int")


def duration_text(seconds: Column) -> Column:
    """H:MM:SS or M:SS; halves round to even."""
    total = F.bround(F.greatest(F.lit(0.0), seconds.cast("double")), 0).cast("bigint")
    hours, minutes, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two(minutes), two(s))).otherwise(F.concat_ws(":", minutes.cast("string"), two(s)))


def rate(average: Column, nominal: Column) -> Column:
    """Frames a second: the average if positive, else the nominal, else 30."""
    positive = lambda c: F.when(c > 0, c.cast("double"))
    return F.coalesce(positive(average), positive(nominal), F.lit(30.0))


def stride(n: Column) -> Column:
    return F.greatest(F.lit(1), n.cast("int"))


def most_changed(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Pixels that may change between similar crops: a hundredth of the closed box, 32 at least."""
    return F.greatest(F.lit(32), F.floor((x2 - x1 + 1) * (y2 - y1 + 1) * F.lit(0.01)).cast("int"))


def batch_width(widest: Column, floor: int = 224) -> Column:
    """Input width for a widest width-to-height ratio."""
    return F.floor(F.greatest(F.lit(floor / INPUT_HEIGHT), widest) * INPUT_HEIGHT).cast("int")


def input_width(w: Column, h: Column, aspect: float = 0.0) -> Column:
    """Width of a crop at the recogniser's height; aspect > 0 fixes it."""
    if aspect > 0:
        return F.lit(max(1, round(INPUT_HEIGHT * aspect)))
    return F.greatest(F.lit(1), F.floor(w * INPUT_HEIGHT / h)).cast("int")
