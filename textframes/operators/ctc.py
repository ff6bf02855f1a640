"""Decoding of recogniser outputs in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ctc_steps(outputs: DataFrame, key: str = "seg", p: str = "p") -> DataFrame:
    """key, steps: of each output (array of steps, each an array by class) the kept steps, in order.

    A step's class is its likeliest, the first of equals; a step with the class of the one before,
    and then the blank 0, is dropped.
    """
    best = F.transform(F.col(p), lambda step: F.struct((F.array_position(step, F.array_max(step)) - 1).cast("int").alias("cls"), F.array_max(step).cast("double").alias("score")))
    pairs = outputs.select(key, best.alias("best"))
    kept = F.expr("""
      filter(transform(best, (x, i) -> struct(i AS step, x.cls AS cls, x.score AS score,
                                              i = 0 OR element_at(best, greatest(i, 1)).cls <> x.cls AS changed)),
             x -> x.changed AND x.cls <> 0)""")
    return pairs.select(key, kept.alias("steps"))


def ctc_decode(outputs: DataFrame, charset: DataFrame, key: str = "seg", p: str = "p") -> DataFrame:
    """key, text (null if empty), confidence, steps: characters of the kept steps and their mean score.

    Scores are taken as integers of 1e-5 and their mean is rounded half up, so that engines agree.
    charset (idx, ch) is a small dimension: one aggregated row of it is joined to all outputs.
    """
    table = charset.agg(F.map_from_entries(F.collect_list(F.struct("idx", "ch"))).alias("chars"))
    steps = ctc_steps(outputs, key, p).crossJoin(F.broadcast(table))
    n = F.size("steps")
    units = F.aggregate("steps", F.lit(0).cast("bigint"), lambda a, x: a + F.round(x["score"] * 100000).cast("bigint"))
    confidence = F.when(n > 0, F.floor((2 * units + n) / (2.0 * n)) / 100000).otherwise(0.0)
    text = F.array_join(F.transform("steps", lambda x: F.coalesce(F.element_at("chars", x["cls"]), F.lit(""))), "")
    return steps.select(key, F.nullif(text, F.lit("")).alias("text"), confidence.alias("confidence"), n.cast("bigint").alias("steps"))
