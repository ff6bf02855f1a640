"""How often each of many 64-bit hashes occurs in the whole corpus, told to those who ask, by two shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Hashes that a task holds before it asks for them.
FLUSH = 500_000
#: Rows that share one question at most: their places are sent as 16-bit numbers.
FLUSH_ROWS = 60_000
#: Columns of a question: hashes of one part of the hash space (32 bits each), who asks, and how often each occurs there.
ASK = "flush bigint, part int, hashes binary, who binary, n binary"
_U = np.uint64
_NAMES = ["flush", "part", "hashes", "who", "n"]


def parts_bits(df: DataFrame) -> int:
    """Bits of a hash by which questions are dealt: several parts for each shuffle partition, so each fits a task."""
    return max(4, (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())


def batch(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


class Question:
    """Distinct hashes of one flush with their number of occurrences there, in order."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes)
        sorted_ = hashes[self.order]
        self.starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
        self.value = sorted_[self.starts]
        self.n = np.diff(np.r_[self.starts, len(sorted_)])

    def spread(self, of_value: np.ndarray) -> np.ndarray:
        """A number of each distinct hash, for each hash that was given."""
        out = np.empty(len(self.order), of_value.dtype)
        out[self.order] = np.repeat(of_value, self.n)
        return out

    def rows(self, flush: int, bits: int, who: np.ndarray, counted: bool) -> tuple[list, ...]:
        """Columns of ASK. who: a number for each distinct hash that comes back with the answer."""
        part = (self.value >> _U(64 - bits)).astype(np.int64)
        short = (self.value >> _U(32 - bits)).astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        ends = [*starts[1:].tolist(), len(part)]
        n = np.minimum(self.n, 0xFFFFFFFF).astype(np.uint32)
        cut = [*zip(starts.tolist(), ends, strict=True)] if len(part) else []
        return (
            [flush] * len(cut), part[starts].tolist(), [short[a:b].tobytes() for a, b in cut],
            [who[a:b].tobytes() for a, b in cut], [n[a:b].tobytes() if counted else b"" for a, b in cut],
        )


def answer(batches: Iterator[pa.RecordBatch], who: type) -> Iterator[pa.RecordBatch]:
    """Questions, sorted by part, to answers: of each, those who asked for what occurs more than once, and how often.

    Rows of negative parts are somebody's luggage and pass. Hashes of a part are told apart by 32 more bits.
    """
    held: list[tuple] = []

    def settle() -> pa.RecordBatch:
        asked = [np.frombuffer(x[2], np.uint32) for x in held]
        all_ = np.concatenate(asked)
        n = np.concatenate([np.frombuffer(x[4], np.uint32) if x[4] else np.ones(len(a), np.uint32) for x, a in zip(held, asked, strict=True)]).astype(np.int64)
        order = np.argsort(all_)
        sorted_ = all_[order]
        starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        sums = np.add.reduceat(n[order], starts)
        total = np.empty(len(all_), np.int64)
        total[order] = np.repeat(sums, np.diff(np.r_[starts, len(all_)]))
        out, at = [], 0
        for x, a in zip(held, asked, strict=True):
            own = np.minimum(total[at : at + len(a)], 0xFFFFFFFF).astype(np.uint32)
            at += len(a)
            more = own > 1
            if more.any():
                out.append((x[0], x[1], None, np.frombuffer(x[3], who)[more].tobytes(), own[more].tobytes()))
        flush, part, none, back, counts = zip(*out, strict=True) if out else ((),) * 5
        return batch([pa.array(flush, pa.int64()), pa.array(part, pa.int32()), pa.array(none, pa.binary()), pa.array(back, pa.binary()), pa.array(counts, pa.binary())], _NAMES)

    for rows in batches:
        parts = rows.column("part").to_numpy(zero_copy_only=False)
        luggage = parts < 0
        if luggage.any():
            yield rows.filter(pa.array(luggage))
        asked = rows.filter(pa.array(~luggage))
        done = []
        for row in zip(*(asked.column(c).to_pylist() for c in _NAMES), strict=True):
            if held and held[0][1] != row[1]:
                done.append(settle())
                held.clear()
            held.append(row)
        for x in done:
            yield _padded(x, rows.schema)
    if held:
        yield _padded(settle(), rows.schema)


def _padded(answers: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """With nulls for the columns of the luggage."""
    return batch([answers.column(f.name) if f.name in _NAMES else pa.nulls(answers.num_rows, f.type) for f in schema], schema.names)


def census(questions: DataFrame, who: type, done: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """questions: rows of ASK, and rows of a negative part with more columns, one for each flush: its luggage.

    done gets each flush's luggage and then its answers, one after the other. A hash goes to the
    task of its part once from each flush, however many rows hold it; nothing is collected.
    """
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema.fields)
    dealt = questions.repartition("part").sortWithinPartitions("part")
    answered = dealt.mapInArrow(lambda batches: answer(batches, who), shape)
    return answered.repartition("flush").sortWithinPartitions("flush", "part").mapInArrow(done, schema)


def flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.RecordBatch]]]:
    """Each luggage row with the batches of its answers (from rows sorted by flush and part)."""
    luggage, answers = None, []
    for rows in batches:
        parts, at = rows.column("part").to_numpy(zero_copy_only=False), 0
        for k in [*np.flatnonzero(parts < 0).tolist(), rows.num_rows]:
            if k > at:
                answers.append(rows.slice(at, k - at).select(["who", "n"]))
            if k < rows.num_rows:
                if luggage is not None:
                    yield luggage, answers
                luggage, answers, at = rows.slice(k, 1), [], k + 1
    if luggage is not None:
        yield luggage, answers


def flush_number(task: int, k: int) -> int:
    return task << 32 | k


def luggage_part(flush: int) -> int:
    """Negative, and different from flush to flush, so that luggage is dealt evenly."""
    return -1 - (flush * 0x9E3779B1 >> 7) % (1 << 30)
