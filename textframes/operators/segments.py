"""Change scores between neighbouring samples, segments, and the merge of similar neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textframes.functions import arrays
from textframes.operators.ordered import running_total
from textframes.sources.shared import few, saved

#: Changed pixels in a 3 x 3 square from which a segment ends.
CHANGE = 5.0
#: Mean difference up to which neighbouring segments are similar.
SIMILAR = 3.0
#: Segments that are folded in a row; rounds after which ranges get longer, and how many times.
MERGE_RANGE, ROUNDS, LONGER = 8192, 6, 16


def joined_segments(ranges: DataFrame, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """keys, seg (from 0), start, end, n, rep_frame, h, w, luma, frames: segments of ranges, joined over their borders, with their representative's plane.

    A range's segments are numbered on from the changes of the ranges before it: a sum over ranges, not frames.
    """
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.select(*keys, "part", "changes").distinct()
    sums = sums.select(*keys, "part", F.coalesce(F.sum("changes").over(before), F.lit(0)).alias("_before"))
    rows = ranges.join(sums, [*keys, "part"]).withColumn("seg", F.col("seg") + F.col("_before"))
    best = F.max("best")
    out = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), (-best["at"]).alias("rep_frame"), *(best[c].alias(c) for c in ("h", "w", "luma"))]
    return rows.groupBy(*keys, "seg").agg(*out, F.array_sort(F.flatten(F.collect_list("frames"))).alias("frames"))


def segment_ids(scores: DataFrame, change: float = CHANGE, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """scores with seg, from 0: a new segment starts where the score reaches change."""
    return running_total(scores, list(keys), "k", F.when(F.col("score") >= change, 1).otherwise(0), "seg")


def segments(frames: DataFrame, keep_frames: bool = True, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """keys, seg, start, end, n, rep_frame (the sharpest, the first of equals), frames (fi, in order) of rows with seg and sharp."""
    best = F.max(F.struct("sharp", (-F.col("fi")).alias("at")))
    out = [F.min("fi").alias("start"), F.max("fi").alias("end"), F.count("*").alias("n"), (-best["at"]).alias("rep_frame")]
    if keep_frames:
        out.append(F.array_sort(F.collect_list("fi")).alias("frames"))
    return frames.groupBy(*keys, "seg").agg(*out)


def chunk_bounds(n: int, chunks: int = 4, least: int = 16) -> list[tuple[int, int]]:
    """Ordinals from, to of the chunks that a clip of n samples is cut to; end excluded."""
    count = min(n, max(2, min(chunks or 4, max(2, n // least))))
    return [(i * n // count, (i + 1) * n // count) for i in range(count)]


def with_chunks(features: DataFrame, chunks: int = 4, least: int = 16, totals: DataFrame | None = None) -> DataFrame:
    """features with chunk, and k counted in it: chunk_bounds in each clip. totals (clip_id, n): samples of each clip, if known."""
    total = totals if totals is not None else features.groupBy("clip_id").agg(F.count("*").alias("n"))
    count = F.least(F.col("n"), F.greatest(F.lit(2), F.least(F.lit(chunks or 4), F.greatest(F.lit(2), F.floor(F.col("n") / least)))))
    # k is in chunk i if i n div c <= k < (i + 1) n div c, so i = (k c + c - 1) div n
    rows = features.join(total, "clip_id").withColumn("_c", count)
    rows = rows.withColumn("chunk", F.expr("(k * _c + _c - 1) div n").cast("int")).withColumn("k", F.col("k") - F.expr("chunk * n div _c"))
    return rows.drop("_c", "n")


def hybrid_ranges(samples: DataFrame, calibration: int, ratio: float) -> DataFrame:
    """clip_id, fi, k, side: 0 calibration, 1 front, 2 back; front and back meet at max(calibration, n ratio)."""
    total = samples.groupBy("clip_id").agg(F.count("*").alias("n"))
    split = F.least(F.col("n"), F.greatest(F.lit(calibration), F.floor(F.col("n") * F.lit(float(ratio)))))
    side = F.when(F.col("k") < F.least(F.lit(calibration), split), 0).when(F.col("k") < split, 1).otherwise(2)
    return samples.join(total, "clip_id").select("clip_id", "fi", "k", side.alias("side"))


class AnchorFold:
    """Folds a range of representatives that come in order: each is folded into the anchor if it is similar, else is the next anchor."""

    def __init__(self, mode: str, most_mean: float, most_changed: int) -> None:
        self.rule = (mode, most_mean, most_changed)

    def run(self, batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        mode, most_mean, most_changed = self.rule
        name, anchor, anchor_seg = None, None, -1
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            first = []
            for i in range(batch.num_rows):
                own = tuple(columns[c][i] for c in (*keys, "part"))
                g = np.frombuffer(columns["luma"][i], np.uint8).reshape(columns["h"][i], columns["w"][i])
                if name != own or not arrays.similar(anchor, g, mode, columns["threshold"][i], most_mean, most_changed):
                    name, anchor, anchor_seg = own, g, columns["seg"][i]
                first.append(anchor_seg)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "part", "seg")), pa.array(first, pa.int64())], [*keys, "part", "seg", "first_seg"])


def merged_ids(segs: DataFrame, thresholds: DataFrame, mode: str = "binary", most_mean: float = SIMILAR, most_changed: int = 32,
               keys: tuple[str, ...] = ("clip_id",), paths: list[str] | None = None, rounds: list[int] | None = None) -> DataFrame:
    """keys, seg, first_seg: the segment that each one is folded into. segs: with the planes (h, w, luma) of their representatives.

    In order, a segment whose representative is similar to that of the last one kept is folded into
    it; the one kept stays the anchor.

    Segments are folded by ranges, each as if its first segment were kept: that is the range's own result. To
    an anchor that comes in a range does one of three things. If its first segment isn't similar to it, the own result
    holds, whatever the anchor. Else the range is folded again with it, and either passes it through,
    or ends with an anchor of its own. What comes into a range is the end of the last range before it
    that doesn't pass through: a window over one row for each range. So where one picture goes on over many ranges,
    all of them get its anchor in the round after they are known to pass. Rounds go on until no
    range gets another anchor; each folds only the ranges that do, and keeps the results of the others. Where
    ROUNDS rounds don't settle it, which takes anchors that each end some ranges later, ranges get LONGER
    times longer: the number of rounds grows with the logarithm of a clip's segments.

    paths: gets what is written to the shared folder. rounds: gets the number of ranges that each round folds again.
    """
    reps = segs.select(*keys, "seg", "h", "w", "luma").join(few(thresholds), list(keys))
    most = segs.agg(F.max("seg")).head()[0] or 0
    size, done = MERGE_RANGE, None
    if size <= most:
        reps = saved(reps, "merge-reps", paths)  # several passes read it
    while done is None:
        done = _folded_by_ranges(reps, AnchorFold(mode, most_mean, most_changed), keys, size, size > most, [] if paths is None else paths, [] if rounds is None else rounds)
        size *= LONGER
    return done


def _folded_by_ranges(reps: DataFrame, fold: AnchorFold, keys: tuple[str, ...], size: int, whole: bool, paths: list[str], rounds: list[int]) -> DataFrame | None:
    """merged_ids by ranges of `size` segments, or None if that isn't settled after ROUNDS rounds and a clip has more than one."""
    types, order = {"clip_id": "string", "chunk": "int"}, [*keys, "part"]
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", part bigint, seg bigint, first_seg bigint"
    rows = reps.withColumn("part", F.floor(F.col("seg") / size))

    def folded(some: DataFrame) -> DataFrame:
        dealt = some.repartition(*order).sortWithinPartitions(*order, "seg")
        return dealt.mapInArrow(lambda batches: fold.run(batches, keys), schema)

    def with_anchor(some: DataFrame, ids: DataFrame) -> DataFrame:
        """Rows of some ranges, each range after the anchor that comes in (ids: keys, part, comes)."""
        anchors = reps.join(few(ids.select(*keys, "part", F.col("comes").alias("seg"))), [*keys, "seg"])
        return some.unionByName(anchors.select(*some.columns))

    def ends(some: DataFrame) -> DataFrame:
        return some.groupBy(*order).agg(F.max_by("first_seg", "seg").alias("end"))

    if whole:
        return folded(rows).drop("part")
    own = saved(folded(rows), "merge-own", paths)
    # of each range: its own end, and by which round's fold (0: its own) it ends how
    state = saved(ends(own).select(*order, F.col("end").alias("own"), "end", F.lit(None).cast("bigint").alias("comes"), F.lit(False).alias("passes"), F.lit(0).alias("round")), "merge-state", paths)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    refolded: list[DataFrame] = []
    for number in range(1, ROUNDS + 1):
        now = F.last(F.when(~F.col("passes"), F.col("end")), ignorenulls=True).over(before)
        state = state.withColumn("_now", now)
        changed = state.where(~F.col("_now").eqNullSafe(F.col("comes")) & F.col("_now").isNotNull()).select(*order, F.col("_now").alias("comes"))
        changed = saved(changed, "merge-changed", paths)
        rounds.append(changed.count())
        if not rounds[-1]:
            chosen = state.select(*order, "round")
            every = own.withColumn("round", F.lit(0))
            for k, some in enumerate(refolded, 1):
                every = every.unionByName(some.withColumn("round", F.lit(k)))
            return every.join(few(chosen), [*order, "round"]).select(*keys, "seg", "first_seg")
        # of these, which begin with a segment that is similar to what comes
        heads = rows.where(F.col("seg") % size == 0).join(few(changed.select(*order)), order).select(*rows.columns)
        near = folded(with_anchor(heads, changed)).where(F.floor(F.col("seg") / size) == F.col("part")).where("first_seg <> seg")
        near = saved(near.select(*order, F.col("first_seg").alias("comes")), "merge-near", paths)
        again = rows.join(few(near.select(*order)), order).select(*rows.columns)
        again = saved(folded(with_anchor(again, near)).where(F.floor(F.col("seg") / size) == F.col("part")), "merge-folded", paths)
        refolded.append(again)
        result = near.join(ends(again), order).select(*order, F.col("end").alias("_end"), (F.col("end") == F.col("comes")).alias("_passes"))
        both = state.join(few(changed.select(*order, F.col("comes").alias("_comes"))), order, "left").join(few(result), order, "left")
        hit, touched = F.col("_end").isNotNull(), F.col("_comes").isNotNull()
        state = both.select(
            *order, "own", F.when(hit, F.col("_end")).when(touched, F.col("own")).otherwise(F.col("end")).alias("end"), F.coalesce("_comes", "comes").alias("comes"),
            F.when(touched, F.coalesce("_passes", F.lit(False))).otherwise(F.col("passes")).alias("passes"), F.when(hit, number).when(touched, 0).otherwise(F.col("round")).alias("round"),
        )
        state = saved(state, "merge-state", paths)
    return None


def merge(segs: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Segments folded by merged_ids: seg and rep_frame of the first, frames of all."""
    joined = segs.join(ids, [*keys, "seg"])
    head = F.min(F.struct("seg", "rep_frame"))
    out = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), head["rep_frame"].alias("rep_frame")]
    if "frames" in segs.columns:
        out.append(F.array_sort(F.flatten(F.collect_list("frames"))).alias("frames"))
    return joined.groupBy(*keys, F.col("first_seg")).agg(*out).withColumnRenamed("first_seg", "seg")
