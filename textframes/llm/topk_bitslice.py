"""Exact top-k inner products over a bit-sliced index (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textframes.llm.shared import saved, small

#: Rows of an index block, and queries that are taken through a block together.
BLOCK, QUERIES = 16_384, 128
#: Low bits that the slices leave out; rows near the boundary are scored with all bits.
DROPPED = 3
#: Components from here on could overflow a score of 64 bits; their vectors stand in blocks of their own.
LARGEST = 1 << 26


def quantise(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x and floor(scale x) of each vector, shorter ones filled with 0; whether it takes part, and whether it is large."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    good = ~pc.is_null(column).to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(x)]] = False
    raw = np.zeros((len(lengths), int(lengths.max(initial=0))))
    raw[row, place] = np.where(np.isfinite(x), x, 0.0)
    value = floor(raw, scale)
    large = (np.abs(value) >= LARGEST).any(axis=1)
    return raw, np.where(large[:, None], 0, value).astype(np.int64), good, large


def floor(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as float64, infinite where it is beyond."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as Python integers."""
    out = [int(v) if np.isfinite(v) else int(w) * scale for v, w in zip(floor(x, scale).ravel().tolist(), x.ravel().tolist(), strict=True)]
    return np.array([*out, None], object)[:-1].reshape(x.shape)


class SliceIndex:
    """A block of vectors: each component, counted from its lowest value, as bitmaps by binary digit."""

    def __init__(self, values: np.ndarray) -> None:
        n, dims = values.shape
        self.n, self.values = n, values
        self.base = values.min(axis=0) if n else np.zeros(dims, np.int64)
        rest = values - self.base
        self.bits = [int(m).bit_length() for m in (rest.max(axis=0) if n else self.base)]
        words = -(-n // 64)
        packed = np.zeros((n + 63) // 64 * 64, np.uint8)
        self.slices: list[list[np.ndarray]] = []
        for d in range(dims):
            own = []
            for b in range(DROPPED, self.bits[d]):
                packed[:n] = rest[:, d] >> b & 1
                own.append(np.packbits(packed, bitorder="little").view(np.uint64).copy())
            self.slices.append(own)
        packed[:n] = 1
        packed[n:] = 0
        self.all = np.packbits(packed, bitorder="little").view(np.uint64).copy()
        assert len(self.all) == words

    def sum_slices(self, weights: np.ndarray) -> list[np.ndarray]:
        """Digits of each row's sum of |weight| x (kept digits), by carry-save addition of bitmaps.

        For a negative weight a component counts from its highest value down: its slices are inverted.
        """
        columns: list[list[np.ndarray]] = [[] for _ in range(64)]
        for d, w in enumerate(weights.tolist()):
            slices = self.slices[d]
            if w < 0:
                slices = [x ^ self.all for x in slices]
            w, k = abs(w), 0
            while w:
                if w & 1:
                    for b, x in enumerate(slices):
                        columns[k + b].append(x)
                w, k = w >> 1, k + 1
        out = []
        for k, column in enumerate(columns):
            while len(column) >= 3:
                a, b, c = column.pop(), column.pop(), column.pop()
                ab = a ^ b
                column.append(ab ^ c)
                columns[k + 1].append((a & b) | (ab & c))
            if len(column) == 2:
                a, b = column
                columns[k + 1].append(a & b)
                column[:] = [a ^ b]
            out.append(column[0] if column else np.zeros_like(self.all))
        while out and not out[-1].any():
            out.pop()
        return out

    def top(self, weights: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best: all that are, and few others."""
        digits, allowed = self.sum_slices(weights), self.all
        sure, open_, kth = np.zeros_like(allowed), allowed, 0
        for b in range(len(digits) - 1, -1, -1):
            both = sure | (open_ & digits[b])
            if int(np.bitwise_count(both).sum()) >= k:
                open_ = open_ & digits[b]
                kth |= 1 << b
            else:
                sure, open_ = both, open_ & ~digits[b]
        # what the dropped digits can add: rows from this sum on may still reach the k-th
        slack = int(sum(abs(w) * ((1 << min(DROPPED, bits)) - 1) for w, bits in zip(weights.tolist(), self.bits, strict=True)))
        least = kth - -(-slack >> DROPPED)
        if least <= 0:
            chosen = allowed
        else:
            above, equal = np.zeros_like(allowed), allowed
            for b in range(max(len(digits), least.bit_length()) - 1, -1, -1):
                digit = digits[b] if b < len(digits) else np.zeros_like(allowed)
                if least >> b & 1:
                    equal = equal & digit
                else:
                    above, equal = above | (equal & digit), equal & ~digit
            chosen = above | equal
        return np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little")[: self.n])


def search(index: SliceIndex, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows, best first, ties to the smaller id."""
    dims = min(len(query), index.values.shape[1])
    weights = np.zeros(index.values.shape[1], np.int64)
    weights[:dims] = query[:dims]
    rows = index.top(weights, k)
    score = index.values[rows] @ weights
    best = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][best], score[best]


def search_large(x: np.ndarray, scale: int, ids: np.ndarray, query: np.ndarray, query_scale: int, k: int) -> tuple[np.ndarray, list[int]]:
    """As search, for components of any size: float64 leaves few rows, which Python integers score."""
    dims = min(len(query), x.shape[1])
    x, query = x[:, :dims], query[:dims]
    with np.errstate(over="ignore", invalid="ignore"):
        values, weights = floor(x, scale), floor(query, query_scale)
        about, off = values @ weights, np.abs(values) @ np.abs(weights) * (dims + 2) * 2.0**-51
        least, most = about - off, about + off
    rows = np.arange(len(ids))
    if len(rows) > k:
        least = np.where(np.isfinite(least), least, -np.inf)[rows]
        rows = rows[~(most[rows] < np.partition(least, len(rows) - k)[len(rows) - k])]
    score = (whole(x[rows], scale) * whole(query, query_scale)).sum(axis=1).tolist() if dims else [0] * len(rows)
    best = sorted(range(len(rows)), key=lambda r: (-score[r], ids[rows[r]]))[:k]
    return ids[rows[best]], [int(score[r]) for r in best]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query.

    Queries are the rows whose vec_id is divisible by `every`, each searched against all other rows
    (rows that repeat its vec_id among them). Score: inner product of floor(scale x), as integers;
    ties to the smaller vec_id. Vectors that are null or hold a null or non-finite component take no
    part, nor do rows without a vec_id; a shorter vector is filled with 0. Other columns are not read.
    Components may have any finite size; only a score among the k best that a bigint can't hold is an
    error.

    Index blocks and blocks of queries, each of bounded size, are written to the shared folder and
    paired; each pair gives k + 1 rows for a query at most. A query finds itself, too: of its best
    rows, one with its own vec_id and its product with itself is left out at the end. Queries are
    broadcast where they are measured to be small; else Spark pairs partitions.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, BLOCK, scale)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, QUERIES, scale)

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    schema = "ids binary, data binary, large boolean"
    index = saved(rows.mapInArrow(build, schema), "slice-index")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = asked.mapInArrow(gather, schema).withColumn("query_block", F.monotonically_increasing_id())
    queries = saved(queries.select(F.col("ids").alias("query_ids"), F.col("data").alias("query_data"), F.col("large").alias("query_large"), "query_block"), "slice-queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                ids, data, large, query_ids, query_data, query_large, query_block = (batch.column(c)[at].as_py() for c in range(7))
                ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64)
                asks = np.frombuffer(query_data, np.float64 if query_large else np.int32).reshape(len(query_ids), -1)
                if large or query_large:
                    x = np.frombuffer(data, np.float64 if large else np.int32).astype(np.float64).reshape(len(ids), -1)
                    scales = scale if large else 1, scale if query_large else 1
                    found = [search_large(x, scales[0], ids, q, scales[1], k + 1) for q in asks.astype(np.float64)]
                else:
                    if last is None or not np.array_equal(last, ids):
                        last, block = ids, SliceIndex(np.frombuffer(data, np.int32).astype(np.int64).reshape(len(ids), -1))
                    found = [search(block, ids, q, k + 1) for q in asks.astype(np.int64)]
                sizes = [len(x) for x, _ in found]
                square = [sum(x * x for x in own) for own in (whole(asks, scale) if query_large else asks).tolist()]
                score = [s for _, part in found for s in (part if isinstance(part, list) else part.tolist())]
                own = np.repeat(np.array([*square, None], object)[:-1], sizes).tolist()
                over = [(s >= 1 << 63) - (s < -1 << 63) for s in score]  # such scores need no order among themselves
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([x for x, _ in found])),
                        pa.array([0 if o else s for s, o in zip(score, over, strict=True)], pa.int64()), pa.array(over, pa.int32()),
                        pa.array(np.full(len(score), query_block)), pa.array(np.repeat(np.arange(len(sizes)), sizes)),
                        pa.array([s == x for s, x in zip(score, own, strict=True)], pa.bool_()),
                    ],
                    ["query_id", "vec_id", "score", "over", "query_block", "query_at", "square"],
                )

    # the query set against all rows, in blocks
    pairs = index.crossJoin(small(queries))
    scored = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, over int, query_block bigint, query_at bigint, square boolean")
    query = ["query_block", "query_at"]
    own = F.col("square") & (F.col("vec_id") == F.col("query_id"))
    order = Window.partitionBy(*query).orderBy(F.desc("over"), F.desc("score"), "vec_id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    # the query itself: the first row that it can be
    best = best.withColumn("self", F.min(F.when(own, F.col("rank"))).over(Window.partitionBy(*query)))
    best = best.where("self is null or rank <> self").withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("self"), 1).otherwise(0)).where(F.col("rank") <= k)
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score of the k best is too large for a bigint")).cast("bigint"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def _cut(batches: Iterator[pa.RecordBatch], most: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Blocks of quantised vectors, and of large ones as they are; a task's batches are joined until a block is full."""
    held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

    def block(ids: np.ndarray, values: np.ndarray, large: bool) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        data = values[order] if large else values[order].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([ids[order].tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([large])], ["ids", "data", "large"])

    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        width = max(v.shape[1] for _, v in parts)
        return np.concatenate([i for i, _ in parts]), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in parts])

    for batch in batches:
        raw, values, good, large = quantise(batch.column("embedding"), scale)
        all_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for kind, use, data in ((False, good & ~large, values), (True, good & large, raw)):
            if use.any():
                held[kind].append((all_ids[use], data[use]))
            if sum(len(i) for i, _ in held[kind]) >= most:
                ids, data = joined(held[kind])
                full = len(ids) // most * most
                for at in range(0, full, most):
                    yield block(ids[at : at + most], data[at : at + most], kind)
                held[kind] = [(ids[full:], data[full:])] if full < len(ids) else []
    for kind, parts in held.items():
        if parts:
            yield block(*joined(parts), kind)
