"""Mixing of sources to target weights by Pfair scheduling, in DataFrame functions only (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textframes.llm.shared import saved, small

#: Rows of a source that are ranked together; a source has as many such parts as it needs.
PART_ROWS = 4096
#: Slots that are scheduled in a row, before they join the slots so far.
RUN_SLOTS = 256

#: One frame: at each slot, of the sources with a released block, the one with the earliest deadline
#: (then the first source) gives its next block. c: blocks of each source in the frame, p: their sum.
EARLIEST_DEADLINE_FIRST = f"""
aggregate(
  sequence(0L, (p - 1) div {RUN_SLOTS}),
  named_struct('done', transform(c, x -> 0L), 'runs', cast(array() AS ARRAY<ARRAY<STRUCT<t: BIGINT, s: INT, j: BIGINT>>>)),
  (state, run) -> transform(array(aggregate(
      sequence(run * {RUN_SLOTS}, least(p, (run + 1) * {RUN_SLOTS}) - 1),
      named_struct('done', state.done, 'slots', cast(array() AS ARRAY<STRUCT<t: BIGINT, s: INT, j: BIGINT>>)),
      (own, t) -> transform(array(array_min(filter(
          transform(c, (n, i) -> named_struct('deadline', if(own.done[i] < n, -floor(-(own.done[i] + 1) * p / n), NULL),
                                              'ready', own.done[i] < n AND floor(own.done[i] * p / n) <= t, 'i', i)),
          x -> x.ready)).i),
        k -> named_struct(
          'done', transform(own.done, (d, i) -> if(i = k, d + 1, d)),
          'slots', concat(own.slots, array(named_struct('t', t, 's', k, 'j', own.done[k])))))[0])),
    own -> named_struct('done', own.done, 'runs', concat(state.runs, array(own.slots))))[0],
  state -> flatten(state.runs))
"""


def with_temperature(counts: DataFrame, alpha: float, total: int) -> DataFrame:
    """source, rows, weight: integers near total x rows^alpha / sum of rows^alpha, 1 at least."""
    power = F.pow(F.col("rows").cast("double"), F.lit(float(alpha)))
    every = Window.partitionBy()
    share = counts.withColumn("power", power).withColumn("all", F.sum("power").over(every))
    return share.select("source", "rows", F.greatest(F.lit(1), F.round(F.col("power") * total / F.col("all"))).cast("bigint").alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = 16, alpha: float = 0.5, total: int = 100) -> DataFrame:
    """docs with slot, block and place: the order in which sources are mixed. Every row stays.

    weights: source and weight (positive integers); sources that it doesn't name get 1. Without it,
    weights follow the sources' sizes to the power alpha. A frame's schedule is made in one row, in time
    that grows with the sum of the weights times the number of sources. Each source's rows, in the order of md5(doc_id), are cut
    into blocks. Time is cut into frames. In a frame each source has as many blocks as its weight,
    or what it has left. Block j of c in a frame of p slots is released at floor(j p / c) and due at
    ceil((j + 1) p / c); earliest deadline first meets all of them, so that at any slot a source is
    less than one block away from its share of the frame. When a source ends, the others go on with
    their weights.

    slot: number of the block in the mix, from 0; block: its number in the source; place: the row's
    place in the block. A null source counts as a source named by the empty string. Rows of one
    doc_id (null too) are in any order among themselves. Columns of docs with the new names are
    replaced. A source's rows are ranked in parts of about PART_ROWS by hash range.
    """
    docs = docs.drop("slot", "block", "place")
    names = docs.withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    names = names.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    counts = names.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighted = with_temperature(counts, alpha, total)
    else:
        given = weights.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("weight").cast("bigint").alias("weight"))
        weighted = counts.join(given, "source", "left").select("source", "rows", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("bigint").alias("weight"))
    blocks_of = weighted.withColumn("n", F.ceil(F.col("rows") / block)).withColumn("frames", F.floor(F.col("n") / F.col("weight")))
    sources = saved(blocks_of.select("source", "rows", "weight", "n", "frames"), "mixing-sources")

    # one row: the sources, and the frames from which the blocks a frame holds differ
    plan = sources.agg(
        F.sort_array(F.collect_list(F.struct("source", "weight", "n", "frames"))).alias("sources"),
        F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), F.collect_list("frames"), F.collect_list(F.col("frames") + 1)))).alias("starts"),
    ).where(F.size("sources") > 0)
    phase = plan.select("sources", "starts", F.posexplode("starts").alias("phase", "start"))
    phase = phase.withColumn("c", F.expr("transform(sources, s -> if(start < s.frames, s.weight, if(start = s.frames, s.n - s.frames * s.weight, 0L)))"))
    phase = phase.withColumn("p", F.expr("aggregate(c, 0L, (a, x) -> a + x)")).where("p > 0")
    phase = phase.withColumn("times", F.expr("starts[phase + 1] - start"))
    phase = phase.withColumn("base", F.sum(F.col("p") * F.col("times")).over(Window.partitionBy().orderBy("start").rowsBetween(Window.unboundedPreceding, -1)))
    slots = phase.select("start", "p", F.coalesce("base", F.lit(0)).alias("base"), "sources", F.explode(F.expr(EARLIEST_DEADLINE_FIRST)).alias("x"))
    slots = slots.select(F.col("sources")[F.col("x.s")]["source"].alias("_source"), "start", F.col("x.j").alias("j"), "p", "base", F.col("x.t").alias("t"))
    slots = saved(slots, "mixing-slots")

    # a row's number in its source: its number in its part, and the rows of the parts before
    known = sources.select(F.col("source").alias("_source"), "weight", "frames", F.ceil(F.col("rows") / PART_ROWS).alias("parts"))
    starts = plan.select("starts")
    number = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint")
    part = F.floor(number * F.col("parts") / F.lit(1 << 32)).cast("bigint")
    dealt = names.join(small(known), "_source").withColumn("_part", part)
    sizes = dealt.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_source", "_part").orderBy("_hash", "doc_id")
    ranked = dealt.withColumn("_row", F.row_number().over(within) - 1).join(offsets, ["_source", "_part"])
    rank = F.col("_row") + F.col("_offset")
    ranked = ranked.withColumn("block", F.floor(rank / block)).withColumn("place", (rank % block).cast("int"))
    frame = F.least(F.floor(F.col("block") / F.col("weight")), F.col("frames"))
    ranked = ranked.withColumn("_frame", frame).withColumn("j", F.col("block") - F.col("_frame") * F.col("weight"))
    ranked = ranked.crossJoin(F.broadcast(starts)).withColumn("start", F.expr("array_max(filter(starts, s -> s <= _frame))"))
    out = ranked.join(slots, ["_source", "start", "j"])
    slot = F.col("base") + (F.col("_frame") - F.col("start")) * F.col("p") + F.col("t")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], slot.alias("slot"), "block", "place")
