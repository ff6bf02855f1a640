"""Exact duplicates through an extendible-hash index on shared files (operator 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm.shared import ASCII_LOWER, blocks, saved

#: Hash bits that the directory may use at most: a million entries.
MAX_DEPTH = 20
#: A bucket with more bytes than this is split, as long as its keys differ.
BUCKET_BYTES = 256 << 10


def normalise(text: str) -> bytes:
    return text.encode("utf-8").translate(ASCII_LOWER)


@dataclass
class Directory:
    """Extendible hashing: 2^depth entries, several of which may name one bucket."""

    depth: int
    bucket: np.ndarray  # of each entry

    @classmethod
    def build(cls, load: np.ndarray, capacity: int) -> Directory:
        """load: bytes by hash prefix. Starts with one bucket; overfull ones split, which doubles the
        directory whenever a bucket has only one entry, until buckets fit or prefixes end."""
        most = int(len(load)).bit_length() - 1
        sums = np.r_[0, np.cumsum(load, dtype=np.int64)]
        depth, bucket, local = 0, np.zeros(1, np.int64), [0]
        todo = [0]
        while todo:
            b = todo.pop()
            entries = np.flatnonzero(bucket == b)
            width = 1 << (most - depth)
            size = sums[(int(entries[-1]) + 1) * width] - sums[int(entries[0]) * width]
            if size <= capacity or local[b] == most:
                continue
            if local[b] == depth:
                bucket = np.repeat(bucket, 2)
                depth += 1
                entries = np.flatnonzero(bucket == b)
            new = len(local)
            local[b] += 1
            local.append(local[b])
            bucket[entries[len(entries) // 2 :]] = new
            todo += [b, new]
        first = np.unique(bucket, return_index=True)[1]
        return cls(depth, np.argsort(np.argsort(first))[bucket])  # numbered in the order of their keys

    def owners(self, load: np.ndarray, n: int) -> np.ndarray:
        """The owner, 0 to n - 1, of each bucket: ranges of keys with about as many bytes each."""
        of_bucket = np.bincount(self.bucket, weights=load.reshape(len(self.bucket), -1).sum(axis=1)).astype(np.int64)
        before = np.cumsum(of_bucket) - of_bucket
        return np.minimum(n - 1, before * n // max(1, int(of_bucket.sum())))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        if self.depth == 0:
            return np.zeros(len(hashes), np.int64)
        return self.bucket[(hashes >> np.uint64(64 - self.depth)).astype(np.int64)]


def _hashes(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))


def prefix_load(docs: DataFrame, bits: int) -> np.ndarray:
    """Bytes of text by the first bits of their hash: 2^bits numbers at the driver, whatever the input.

    Each task sums its own texts first, each distinct text of a block once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, texts in blocks(batch, "text"):
                distinct = [*{*map(normalise, texts)}]
                at = (_hashes(distinct) >> np.uint64(64 - bits)).astype(np.int64)
                np.add.at(load, at, np.fromiter(map(len, distinct), np.int64, len(distinct)))
        at = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(load[at])], ["prefix", "bytes"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "prefix bigint, bytes bigint")
    out = np.zeros(1 << bits, np.int64)
    for prefix, size in parts.groupBy("prefix").agg(F.sum("bytes")).collect():
        out[prefix] = size
    return out


def depth_for(docs: DataFrame, bucket_bytes: int) -> int:
    """Hash bits with which buckets of that size hold all texts, and one more; MAX_DEPTH at most."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).head()[0] or 0
    return max(8, min(MAX_DEPTH, (total // bucket_bytes).bit_length() + 1))


def exact_groups(docs: DataFrame, bits: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts one
    row with the largest doc_id stays (a null id is below any other). One row out for each row in; other columns are not read; an empty table gives none.

    bits: hash bits that the directory may use (at most MAX_DEPTH; None: as many as the texts' bytes
    need); buckets grow beyond bucket_bytes
    only when these are used up. Texts are folded in each task first: the owner of a text gets its
    bytes once from each task, and one short row from each block, however many copies there are.
    """
    bits = depth_for(docs, bucket_bytes) if bits is None else bits
    if not 1 <= bits <= MAX_DEPTH:
        raise ValueError(f"bits must be 1 to {MAX_DEPTH}")
    spark = docs.sparkSession
    load, tasks = prefix_load(docs, bits), int(spark.conf.get("spark.sql.shuffle.partitions"))
    built = Directory.build(load, bucket_bytes)
    directory = spark.sparkContext.broadcast((built, built.owners(load, tasks)))  # 2^bits entries at most
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, (tree, owner) = TaskContext.get().partitionId() << 36, directory.value
        sent: dict[bytes, int] = {}  # digest of each text that this task has sent
        rows = 0
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                groups: dict[bytes, list] = {}
                for text, doc_id in zip(texts, part.column("doc_id").to_pylist(), strict=True):
                    groups.setdefault(normalise(text), []).append(doc_id)
                keys = [*groups]
                digests = [hashlib.sha256(k) for k in keys]
                first = [d.digest() not in sent for d in digests]
                local = [task | sent.setdefault(d.digest(), len(sent)) for d in digests]
                hashes = _hashes(keys)
                ids = part.schema.field("doc_id").type
                best = [max((i for i in x if i is not None), default=None) for x in groups.values()]
                for x, top in zip(groups.values(), best, strict=True):  # the row that may stay comes first
                    k = x.index(top)
                    x[0], x[k] = x[k], x[0]
                page = [task | rows + k for k in range(len(keys))]
                rows += len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(page, pa.int64()),
                        pa.array(local, pa.int64()),
                        pa.array(owner[tree.lookup(hashes)].astype(np.int32)),
                        pa.array(hashes.view(np.int64)),
                        pa.array([k if new else None for k, new in zip(keys, first, strict=True)], pa.binary()),
                        pa.array([d.hexdigest() for d in digests]),
                        pa.array(best, ids),
                        pa.array([*map(len, groups.values())], pa.int64()),
                        pa.array([*groups.values()], pa.list_(ids)),
                    ],
                    ["page", "local", "owner", "hash", "data", "text_sha256", "best", "n", "ids"],
                )

    folded = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        fold,
        f"page bigint, local bigint, owner int, hash bigint, data binary, text_sha256 string, best {kind}, n bigint, ids array<{kind}>",
    )
    pages = saved(folded, "exact-index")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, key, ids = Chain(), None, None
        for batch in batches:
            out, ids = [], batch.column("best").type
            for hash_, page, local, data, best, n in zip(*(batch.column(c).to_pylist() for c in ("hash", "page", "local", "data", "best", "n")), strict=True):
                if hash_ != key:
                    out += chain.rows()
                    chain, key = Chain(), hash_
                chain.add(page, local, data, best, n)
            yield _resolved(out, ids)
        if ids is not None:
            yield _resolved(chain.rows(), ids)

    # an owner has a range of keys; its rows come sorted by hash, texts before the short rows that refer to them
    entries = pages.select("owner", "hash", "page", "local", "data", "best", "n")
    owned = entries.repartitionById(tasks, "owner").sortWithinPartitions("hash", "local", F.col("data").isNull(), "page")
    resolved = owned.select("hash", "page", "local", "data", "best", "n").mapInArrow(own, f"local bigint, keep_id {kind}, keep_page bigint, group_size bigint")
    members = pages.select("page", "local", "text_sha256", F.posexplode("ids").alias("pos", "doc_id"))
    kept = (F.col("page") == F.col("keep_page")) & (F.col("pos") == 0)
    return members.join(resolved, "local").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


class Chain:
    """The texts of one hash value, told apart by their bytes."""

    def __init__(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.of_local: dict[int, int] = {}
        self.best: list = []
        self.page: list[int] = []  # of the row that holds the best
        self.n: list[int] = []

    def add(self, page: int, local: int, data: bytes | None, best, n: int) -> None:
        if data is not None:
            k = self.of_local[local] = self.slot.setdefault(data, len(self.slot))
            if k == len(self.best):
                self.best.append(best)
                self.page.append(page)
                self.n.append(0)
        k = self.of_local[local]
        self.n[k] += n
        if best is not None and (self.best[k] is None or best > self.best[k]):
            self.best[k], self.page[k] = best, page

    def rows(self) -> list[tuple]:
        return [(local, self.best[k], self.page[k], self.n[k]) for local, k in self.of_local.items()]


def _resolved(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    local, keep, page, n = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(local, pa.int64()), pa.array(keep, ids), pa.array(page, pa.int64()), pa.array(n, pa.int64())],
        ["local", "keep_id", "keep_page", "group_size"],
    )
