"""Similarity join of shingle sets by count vectors (operator 5)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm import census
from textframes.llm.components import components
from textframes.llm.shared import dropped, mix, saved, slices, small
from textframes.llm.words import WordCutter

#: Groups that elements are hashed to: the coordinates of a point.
GROUPS = 64
#: Sets with a key in common that are compared as points in one task; more are parted by further keys, so many times at most.
RUN_ROWS, PARTINGS = 1024, 3
#: Crowds that the sets of a crowd are in, on average: from so many further keys in common on, it is a family of near copies.
FAMILY = 3
#: Sets, and elements, of a chunk of a cluster.
CHUNK_ROWS, CHUNK_ELEMENTS = 256, 1 << 20
#: Growth of set sizes from band to band of a cluster.
BAND = 1.25
#: Sets of each band, on average, that every chunk of a cluster is compared with, so that its parts meet.
PIVOTS = 16
_U = np.uint64


class Shingles:
    """Shingle sets of a column of texts, as sorted 64-bit hashes."""

    def __init__(self, width: int) -> None:
        self.width, self.cutter = width, WordCutter(fold=True)
        self.factor = np.random.default_rng(31).integers(1, 1 << 64, width, dtype=_U) | _U(1)

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All sets in a row (sorted and distinct in each text), the text of each element, and the sets' sizes."""
        flat, n = self.cutter.hashes(texts)
        width, ends = self.width, np.cumsum(n)
        value = np.zeros(len(flat), _U)
        for k in range(width):
            value[: len(flat) - k] += flat[k:] * self.factor[k]
        value = mix(value)
        last = np.repeat(ends, n)  # of each word, the end of its text
        keep = np.arange(len(flat)) + width <= last
        for x in np.flatnonzero((n > 0) & (n < width)).tolist():  # the whole sequence as one shingle
            at, total = int(ends[x] - n[x]), np.array([0x9E37], _U)
            for k in range(int(n[x])):
                total = mix(flat[at + k : at + k + 1] + total)
            value[at], keep[at] = total[0], True
        owner = np.repeat(np.arange(len(n)), n)[keep]
        value = value[keep]
        size = np.bincount(owner, minlength=len(n))
        at = 0
        for k in size.tolist():
            value[at : at + k].sort()
            at += k
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        owner = owner[first]
        return value[first], owner, np.bincount(owner, minlength=len(n))


def signatures(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two 64-bit sums of each set: with its size they name it."""
    out, some = np.zeros((2, len(n)), np.int64), np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    for k in range(2):
        if len(starts):
            out[k, some] = np.add.reduceat(mix(value ^ mix(np.array([k + 11], _U))), starts).view(np.int64)
    return out


def prefix(value: np.ndarray, often: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Of a set's elements, which of the rarest it may share with any set that it links with.

    Linked sets share t of the elements of either at least, so they share one of the n - ceil(t n) + 1
    that come first in any common order; here by number of sets, then by hash. One that no other set
    has can't be it.
    """
    num, den = threshold.numerator, threshold.denominator
    first = np.lexsort((value, often))[: len(value) + num * len(value) // -den + 1]
    return value[first[often[first] > 1]]


class CountTree:
    """R-tree over count vectors: a set's elements are hashed to groups, the counts are a point.

    An overlap is at most the sum over groups of the smaller count; in a node, of the smaller of the
    query's count and the largest count below the node.
    """

    LEAF = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, threshold: Fraction) -> None:
        self.t = threshold
        self.order = np.lexsort((*points.T[:2], sizes))  # packed by size, then by the first counts
        self.points, self.sizes = points[self.order], sizes[self.order]
        starts = np.arange(0, len(sizes), self.LEAF)
        self.levels = [(np.maximum.reduceat(self.points, starts), self.sizes[starts], np.maximum.reduceat(self.sizes, starts))]
        while len(self.levels[-1][1]) > self.LEAF:
            high, small, large = self.levels[-1]
            starts = np.arange(0, len(small), self.LEAF)
            self.levels.append((np.maximum.reduceat(high, starts), small[starts], np.maximum.reduceat(large, starts)))

    def _may(self, q: np.ndarray, n: int, high: np.ndarray, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        num, den = self.t.numerator, self.t.denominator
        bound = np.minimum(high, q).sum(axis=1)
        # overlap >= t (n + m - overlap), for the smallest m
        return ((num + den) * bound >= num * (n + small)) & (large * den >= num * n) & (small * num <= den * n)

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Positions of points whose bound allows a link."""
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, small, large = (x[nodes] for x in self.levels[depth])
            nodes = nodes[self._may(q, n, high, small, large)]
            below = len(self.levels[depth - 1][1]) if depth else len(self.sizes)
            nodes = (nodes[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
            nodes = nodes[nodes < below]
        return self.order[nodes[self._may(q, n, self.points[nodes], self.sizes[nodes], self.sizes[nodes])]]


def count_vectors(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Elements of each of n sets in each of GROUPS groups."""
    group = (mix(values ^ _U(0xD1342543DE82EF95)) % _U(GROUPS)).astype(np.int64)
    return np.bincount(owner * GROUPS + group, minlength=n * GROUPS).reshape(n, GROUPS)


class Forest:
    """Union-find over positions; join tells whether it connected something."""

    def __init__(self, n: int) -> None:
        self.parent = [*range(n)]

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def may_link(points: np.ndarray, sizes: np.ndarray, threshold: Fraction, known: list[int | None] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose counts allow a link; known: equal marks are connected already."""
    tree, forest, out = CountTree(points, sizes, threshold), Forest(len(points)), []
    first: dict[int, int] = {}
    for x, mark in enumerate(known or []):
        if mark is not None:
            forest.join(first.setdefault(mark, x), x)
    if known and None not in known and len(first) == 1:
        return out
    for x in range(len(points)):
        out += [(x, y) for y in tree.search(points[x], int(sizes[x])).tolist() if forest.join(x, y)]
    return out


class Searched:
    """Sets with a tree of their points; others are searched in it and verified whole."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction) -> None:
        self.sets, self.threshold = sets, threshold
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.tree = CountTree(count_vectors(np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes), len(sets)), self.sizes, threshold)

    def links(self, others: list[np.ndarray], forest: Forest) -> list[tuple[int, int]]:
        """A spanning forest of the links; forest: over these sets, then the others, and what is known to be connected."""
        sizes = np.fromiter(map(len, others), np.int64, len(others))
        points = count_vectors(np.concatenate(others), np.repeat(np.arange(len(others)), sizes), len(others))
        num, den, out = self.threshold.numerator, self.threshold.denominator, []
        for k, own in enumerate(others):
            x = len(self.sets) + k
            for y in self.tree.search(points[k], int(sizes[k])).tolist():
                if forest.root(x) != forest.root(y):
                    other = self.sets[y]
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    if (num + den) * int((own[at] == other).sum()) >= num * (len(own) + len(other)):
                        forest.join(x, y)
                        out.append((x, y))
        return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of the same first columns, which come one after the other."""
    held: list[tuple] = []
    for rows in batches:
        for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _pairs(make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> Callable:
    """The pairs that make yields, as batches of a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make(batches)
        while part := [*itertools.islice(found, 4096)]:
            a, b = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def similar_groups(docs: DataFrame, width: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """doc_id, n_shingles, component_id, group_id and text_hash of each row.

    Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set holds the distinct shingles of `width`
    words, of a shorter text the whole sequence as one, of a null or wordless text nothing. Two
    documents link when intersection >= threshold x union; component_id is the smallest doc_id that
    links reach. Empty sets link with nothing. A row without a doc_id takes the component of equal
    sets, but doesn't lead or bridge. Rows that share a doc_id but not the set are judged apart,
    each by its own set: group_id (null for an empty set) tells groups apart, and with doc_id the hash
    of the text tells rows apart. Other columns are not read. Elements are 64-bit hashes.

    Sets that are equal become one class. A class can link only if the threshold's share of its
    elements occurs elsewhere (_signed), which a census of all elements tells. Those that are left
    emit their rarest elements as keys (prefix); where a key is common, further keys part its sets
    (block_keys). Classes with a key in common are compared as points
    of an R-tree (CountTree); pairs whose counts allow a link make clusters, outside of which nothing
    links, and clusters are searched by such trees and verified on whole sets (_links). Only spanning
    forests leave a task.
    """
    signed = saved(_signed(docs, width, threshold), "jaccard-signed")
    classes = signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("row.doc_id").alias("rep"), F.max("alive").alias("alive"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    sets = _sets(docs, classes.where("alive and rep is not null"), width)
    keyed = _keyed(sets, threshold)
    cluster = _clusters(keyed, sets, threshold)
    placed = sets.withColumn("band", F.floor(F.log(BAND, F.col("n"))).cast("int"))
    placed = saved(placed.join(small(cluster), "cid"), "jaccard-placed")
    dropped(sets, keyed, cluster)
    links = _links(placed, threshold)
    comp = components(links, "jaccard-components")
    dropped(placed, links)
    linked = comp.withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid")
    linked = linked.join(linked.groupBy("component").agg(F.min("rep").alias("least")), "component").select("cid", "least", "component")
    named = classes.join(linked, "cid", "left").select("n", "s1", "s2", F.coalesce("least", "rep").alias("_least"), F.coalesce("component", "cid").alias("group_id"))
    return signed.join(named, ["n", "s1", "s2"], "left").select(
        "row.doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "row.doc_id").alias("component_id"), "group_id", "row.text_hash"
    )


def _signed(docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """row (doc_id, text_hash), n, s1, s2 (the set's name) of each row, and alive: whether enough of its elements occur elsewhere to link."""
    kind = f"struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, text_hash: bigint>"
    bits = census.parts_bits(docs)
    names = ["flush", "part", "hashes", "who", "n", "ids", "sizes", "s1", "s2", "local"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, task, k = Shingles(width), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        elements = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            value, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            ids = pa.concat_arrays([x[2] for x in held])
            s1, s2 = signatures(value, sizes)
            q = census.Question(value)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            local = np.bincount(owner[q.spread(q.n) > 1], minlength=len(sizes))
            who = np.where(q.n > 1, census.FLUSH_ROWS, owner[q.order[q.starts]]).astype(np.uint16) if len(value) else np.zeros(0, np.uint16)
            name = census.flush_number(task, k)
            columns = q.rows(name, bits, who, False)
            flushes, parts, hashes, whos, ns = ([*x, y] for x, y in zip(columns, (name, census.luggage_part(name), None, None, None), strict=True))
            more = len(flushes) - 1
            lists = pa.ListArray.from_arrays(pa.array([0] * (more + 1) + [len(ids)], pa.int32()), ids)
            luggage = [pa.array([None] * more + [x.astype(np.int64).tobytes()], pa.binary()) for x in (sizes, s1, s2, local)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flushes, pa.int64()), pa.array(parts, pa.int32()), *(pa.array(x, pa.binary()) for x in (hashes, whos, ns)), lists, *luggage], names
            )
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                value, _, n = shingles.sets(part.column("text"))
                if held and (elements + len(value) > census.FLUSH or rows + len(n) > census.FLUSH_ROWS):
                    yield from flush()
                    elements, rows, k = 0, 0, k + 1
                held.append((value, n, part.column("row")))
                elements, rows = elements + len(value), rows + len(n)
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for luggage, answers in census.flushes(batches):
            sizes, s1, s2, local = (np.frombuffer(luggage.column(c)[0].as_py(), np.int64) for c in ("sizes", "s1", "s2", "local"))
            found = local.copy()
            for rows in answers:
                who = np.frombuffer(b"".join(rows.column("who").to_pylist()), np.uint16)
                found += np.bincount(who[who < census.FLUSH_ROWS], minlength=len(sizes))
            alive = found * threshold.denominator >= threshold.numerator * sizes
            yield pa.RecordBatch.from_arrays([luggage.column("ids").flatten(), *map(pa.array, (sizes, s1, s2, alive & (sizes > 0)))], ["row", "n", "s1", "s2", "alive"])

    schema = f"{census.ASK}, ids array<{kind}>, sizes binary, s1 binary, s2 binary, local binary"
    text = F.col("text").cast("string")
    asked = docs.select(F.struct("doc_id", F.xxhash64(text).alias("text_hash")).alias("row"), text.alias("text")).mapInArrow(ask, schema)
    return census.census(asked, np.uint16, settle, f"row {kind}, n bigint, s1 bigint, s2 bigint, alive boolean")


def _sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """cid, n, data (the elements) of each class, once, from a row that its rep names; written."""
    reps = small(classes.select(F.col("rep").alias("doc_id"), "cid", F.col("n").alias("size"), "s1", "s2"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(reps, "doc_id").select("cid", "size", "s1", "s2", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            for part in slices(batch, "text"):
                value, _, n = shingles.sets(part.column("text"))
                own = np.stack([n, *signatures(value, n)])
                same = (own == np.stack([part.column(c).to_numpy() for c in ("size", "s1", "s2")])).all(axis=0)
                ends = np.cumsum(n)
                data = [value[b - k : b].tobytes() for b, k in zip(ends[same].tolist(), n[same].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("cid").filter(pa.array(same)), pa.array(n[same]), pa.array(data, pa.binary())], ["cid", "n", "data"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            cid = batch.column("cid").to_numpy(zero_copy_only=False)
            new = np.r_[True, cid[1:] != cid[:-1]] if len(cid) else np.zeros(0, bool)
            if len(cid):
                new[0], last = cid[0] != last, cid[-1]
            yield batch.filter(pa.array(new))

    found = texts.mapInArrow(cut, "cid bigint, n bigint, data binary")
    return saved(found.repartition("cid").sortWithinPartitions("cid").mapInArrow(once, "cid bigint, n bigint, data binary"), "jaccard-sets")


def _keyed(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """cid, n, point and keys of the classes that can still link; written."""
    bits = census.parts_bits(sets)
    names = ["flush", "part", "hashes", "who", "n", "cids", "sizes", "data"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, bytes]] = []
        elements = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cids, sizes, data = zip(*held, strict=True)
            joined = b"".join(data)
            q, name = census.Question(np.frombuffer(joined, _U)), census.flush_number(task, k)
            columns = q.rows(name, bits, np.arange(len(q.value), dtype=np.uint32), True)
            flushes, parts, hashes, whos, ns = ([*x, y] for x, y in zip(columns, (name, census.luggage_part(name), None, None, None), strict=True))
            more = len(flushes) - 1
            luggage = [pa.array([None] * more + [x], pa.binary()) for x in (np.array(cids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), joined)]
            yield pa.RecordBatch.from_arrays([pa.array(flushes, pa.int64()), pa.array(parts, pa.int32()), *(pa.array(x, pa.binary()) for x in (hashes, whos, ns)), *luggage], names)
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "data")), strict=True):
                if held and elements + row[1] > census.FLUSH:
                    yield from flush()
                    elements, k = 0, k + 1
                held.append(row)
                elements += row[1]
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for luggage, answers in census.flushes(batches):
            cids, sizes = (np.frombuffer(luggage.column(c)[0].as_py(), np.int64) for c in ("cids", "sizes"))
            value = np.frombuffer(luggage.column("data")[0].as_py(), _U)
            q = census.Question(value)
            often = np.ones(len(q.value), np.int64)
            for rows in answers:
                who, n = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32) for c in ("who", "n"))
                often[who] = n
            often = q.spread(often)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            found = np.bincount(owner[often > 1], minlength=len(sizes))
            ends = np.cumsum(sizes)
            some = np.flatnonzero(found * threshold.denominator >= threshold.numerator * sizes)
            for at in range(0, len(some), 1024):
                part = some[at : at + 1024]
                cut = [slice(b - k, b) for b, k in zip(ends[part].tolist(), sizes[part].tolist(), strict=True)]
                keys = [prefix(value[s], often[s], threshold) for s in cut]
                points = count_vectors(np.concatenate([value[s] for s in cut]), np.repeat(np.arange(len(part)), sizes[part]), len(part)).astype(np.uint32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([*map(len, keys)])], pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(cids[part]), pa.array(sizes[part]), pa.array([p.tobytes() for p in points], pa.binary()), lists], ["cid", "n", "point", "keys"])

    asked = sets.mapInArrow(ask, f"{census.ASK}, cids binary, sizes binary, data binary")
    return saved(census.census(asked, np.uint32, settle, "cid bigint, n bigint, point binary, keys array<bigint>"), "jaccard-keyed")


def size_bands(largest: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Edges of bands of set sizes, and each band's number of blocks.

    A set links only with sets of its own band and the two beside it. Linked sets of which the smaller is in a band differ in fewer
    elements than the band has blocks.
    """
    num, den = threshold.numerator, threshold.denominator
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * den // num)))
    blocks = [(e - 1) * (den - num) // num + 1 for e in edges[1:]]
    return np.array(edges, np.int64), np.array(blocks, np.int64)


def block_keys(values: np.ndarray, sizes: np.ndarray, threshold: Fraction, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets by whole blocks of their elements, and whose they are: linked sets have one in common.

    Elements are dealt to as many blocks by hash as linked sets can differ in elements, and one more: so
    one block, perhaps an empty one, is the same in both. A set is cut by the blocks of its own band, and of the one
    below, in which a smaller partner may be.
    """
    edges, blocks = size_bands(int(sizes.max(initial=1)), threshold)
    band = np.searchsorted(edges, sizes, "right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place, content = mix(values ^ mix(np.array([seed + 101], _U))), mix(values ^ mix(np.array([seed + 211], _U)))
    keys, owners = [], []
    for down in range(2):
        own = np.flatnonzero((band >= down) & (sizes > 0))
        label = band[own] - down
        n = blocks[label]
        first = np.full(len(sizes), -1, np.int64)
        first[own] = np.cumsum(n) - n
        some = first[owner] >= 0
        each = blocks[np.maximum(0, band[owner[some]] - down)]
        at = first[owner[some]] + (place[some] % each.astype(_U)).astype(np.int64)
        sums = np.zeros(int(n.sum()), _U)
        np.add.at(sums, at, content[some])
        which = np.arange(len(sums)) - np.repeat(np.cumsum(n) - n, n)
        name = mix(which.astype(_U) + (np.repeat(label, n).astype(_U) << _U(32)) + _U((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        keys.append(mix(sums ^ name))
        owners.append(np.repeat(own, n))
    return np.concatenate(keys), np.concatenate(owners)


def _parted(sets: DataFrame, crowd: DataFrame, threshold: Fraction, seed: int) -> DataFrame:
    """cid, key: block keys of the sets of a crowd (cid, parent), each with every parent that it has there."""
    lists = small(saved(crowd.groupBy("cid").agg(F.collect_list("parent").alias("parents")), "jaccard-crowd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values, sizes = np.frombuffer(b"".join(part.column("data").to_pylist()), _U), part.column("n").to_numpy()
                key, owner = block_keys(values, sizes, threshold, seed)
                cids = part.column("cid").to_numpy()[owner]
                parents = part.column("parents").to_pylist()
                times = np.fromiter(map(len, parents), np.int64, len(parents))
                wide = np.repeat(np.arange(len(key)), times[owner])
                begin = np.cumsum(times) - times
                nth = np.arange(len(wide)) - np.repeat(np.cumsum(times[owner]) - times[owner], times[owner])
                parent = np.array([x for p in parents for x in p], np.int64).view(_U)[begin[owner[wide]] + nth]
                out = mix(key[wide] ^ mix(parent + _U(7)))
                yield pa.RecordBatch.from_arrays([pa.array(cids[wide]), pa.array(out.view(np.int64))], ["cid", "key"])

    return sets.select("cid", "n", "data").join(lists, "cid").mapInArrow(run, "cid bigint, key bigint")


def _clusters(keyed: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """cid, cluster: classes connected by pairs with a key in common whose counts allow a link; written.

    Sets with a key in common are compared as points of an R-tree in one task, if they are RUN_ROWS at
    most. A larger crowd is parted by keys of which linked sets share one, too (block_keys), then those that are still large by
    other blocks, within their crowd. Where sets are in many crowds at once they are a family of near copies, which share most
    blocks: such a family is one cluster, as most of its sets are one component anyway.
    """
    flat, near, family = keyed.select("cid", F.explode("keys").alias("key")), [], None
    mark = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"m{k}") for k in range(2)]
    written: list[DataFrame] = []

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in _groups(batches, 1):
            cids = [x[1] for x in rows]
            points = np.frombuffer(b"".join([x[3] for x in rows]), np.uint32).astype(np.int64).reshape(-1, GROUPS)
            for x, y in may_link(points, np.array([x[2] for x in rows]), threshold, [x[4] for x in rows]):
                yield cids[x], cids[y]

    for level in range(PARTINGS + 1):
        # keys with the same classes are one run
        runs = flat.groupBy("key").agg(F.count("*").alias("run"), F.min("cid").alias("hub"), *mark).where("run > 1")
        runs = saved(runs.groupBy("run", "m0", "m1").agg(F.min(F.struct("key", "hub")).alias("x")).select("run", "x.key", "x.hub"), "jaccard-runs")
        written.append(runs)
        held = flat.join(runs, "key")
        crowd = None
        if not runs.where(F.col("run") > RUN_ROWS).isEmpty():
            crowd = saved(held.where(F.col("run") > RUN_ROWS).select("cid", "key", "hub"), "jaccard-crowds")
            written.append(crowd)
            if level == 0:
                crowd = crowd.select("cid").distinct().withColumn("parent", F.lit(0).cast("bigint"))
            else:
                mine = crowd.groupBy("cid").agg(F.count("*").alias("_m"))
                alike = crowd.join(mine, "cid").groupBy("key").agg(F.avg("_m").alias("_m"))
                alike = saved(alike.select("key", (F.lit(level == PARTINGS) | (F.col("_m") > FAMILY)).alias("family")), "jaccard-alike")
                both = crowd.join(small(alike), "key")
                more = both.where("family").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
                family = saved(more if family is None else family.union(more), "jaccard-family")
                crowd = saved(both.where("not family").select("cid", F.col("key").alias("parent")), "jaccard-parents")
                written += [alike, family, crowd]
        few = held.where(F.col("run") <= RUN_ROWS).select("key", "cid").join(keyed.select("cid", "n", "point"), "cid")
        if family is None:
            few = few.withColumn("known", F.lit(None).cast("bigint"))
        else:  # what a family holds needn't be connected again
            few = few.join(small(saved(family.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("known")), "jaccard-known")), "cid", "left")
        few = few.select("key", "cid", "n", "point", "known").repartition("key").sortWithinPartitions("key", "cid")
        near.append(saved(few.mapInArrow(_pairs(compare), "a bigint, b bigint").distinct(), "jaccard-near"))
        written.append(near[-1])
        if crowd is None or crowd.isEmpty():
            break
        flat = saved(_parted(sets, crowd, threshold, level + 1), "jaccard-parted")
        written.append(flat)
    families = [] if family is None else [family]
    every = near[0]
    for more in [*near[1:], *families]:
        every = every.union(more)
    found = components(every.distinct(), "jaccard-clusters").select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    dropped(*written)
    return found


def _links(placed: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b: links that connect what is connected; written. placed: cid, n, data, cluster, band.

    A cluster that fits a chunk is searched there. A larger one is cut into chunks of each band of
    sizes. Each chunk is searched alone and with the cluster's pivots. Most of a large group of near
    copies is then one component, whose members needn't be compared any more; all other sets visit
    every chunk of the bands that they can link with. So no pair is left out but those that are
    connected already.
    """
    size = [F.count("*").alias("rows"), F.sum("n").alias("elements")]
    one = placed.groupBy("cluster").agg(*size).select("cluster", ((F.col("rows") <= CHUNK_ROWS) & (F.col("elements") <= CHUNK_ELEMENTS)).alias("one"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("rows") / CHUNK_ROWS), F.ceil(F.col("elements") / CHUNK_ELEMENTS)).cast("int")
    one = saved(one, "jaccard-sizes")
    parted = placed.select("cid", "n", "band", "cluster").join(small(one.where("not one")), "cluster")
    bands = saved(parted.groupBy("cluster", "band").agg(*size).select("cluster", "band", "rows", chunks.alias("chunks")), "jaccard-bands")
    row = ["cluster", "band", "home", "visits", "cid", "data", "known"]
    whole = placed.join(small(one.where("one")), "cluster").select("cluster", F.lit(-1).alias("band"), F.lit(0).alias("home"), F.lit(False).alias("visits"), "cid", "data", F.lit(None).cast("bigint").alias("known"))
    dealt = placed.join(small(bands), ["cluster", "band"])
    at_home = dealt.withColumns({"home": F.pmod(F.xxhash64("cid"), "chunks").cast("int"), "visits": F.lit(False)}).drop("rows", "chunks")
    reach = int(math.log(1 / threshold) / math.log(BAND) + 1e-9) + 1

    def visiting(rows: DataFrame) -> DataFrame:
        to = bands.select("cluster", F.col("band").alias("to"), "chunks")
        met = rows.join(small(to), "cluster").where(F.abs(F.col("band") - F.col("to")) <= reach)
        met = met.withColumn("home", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("visits", F.lit(True))
        return met.drop("band", "chunks").withColumnRenamed("to", "band")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, residents, visitors = None, [], []
        searched = None

        def met() -> Iterator[tuple]:
            nonlocal searched
            rows = [*residents, *visitors]
            if searched is None:
                searched = Searched([np.frombuffer(x[5], _U) for x in residents], threshold)
                others = rows  # residents among themselves, too
            else:
                others = visitors
            forest = Forest(len(residents) + len(others))
            known: dict[int, int] = {}
            named = [*residents, *others]
            for i, x in enumerate(named):  # one set, or what is connected already
                for mark in (x[4], x[6]):
                    if mark is not None and (j := known.setdefault(mark, i)) != i:
                        forest.join(i, j)
            for x, y in searched.links([np.frombuffer(x[5], _U) for x in others], forest):
                yield named[x][4], named[y][4]
            visitors.clear()

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x[:3] != key:
                    if residents and (visitors or searched is None):
                        yield from met()
                    key, searched = x[:3], None
                    residents, visitors = [], []
                if x[3]:
                    visitors.append(x)
                    if len(visitors) >= CHUNK_ROWS and residents:
                        yield from met()
                else:
                    residents.append(x)
        if residents and (visitors or searched is None):
            yield from met()

    def searched(rows: DataFrame) -> DataFrame:
        groups = rows.select(*row).repartition("cluster", "band", "home").sortWithinPartitions("cluster", "band", "home", "visits", "cid")
        return groups.mapInArrow(_pairs(search), "a bigint, b bigint")

    if bands.isEmpty():
        out = saved(searched(whole), "jaccard-links")
        dropped(bands, one)
        return out
    unknown = F.lit(None).cast("bigint").alias("known")
    place = F.shiftrightunsigned(F.xxhash64("cid", F.lit(1)), 11) / F.lit(float(1 << 53))
    pivots = visiting(placed.drop("n").join(small(bands.drop("chunks")), ["cluster", "band"]).where(place * F.col("rows") < PIVOTS).drop("rows"))
    alone = whole.union(at_home.withColumn("known", unknown).select(*row)).union(pivots.withColumn("known", unknown).select(*row))
    first = saved(searched(alone), "jaccard-links")

    label = components(first, "jaccard-parts").select(F.col("node").alias("cid"), "component")
    label = parted.select("cid", "cluster").join(label, "cid", "left").select("cid", "cluster", F.coalesce("component", "cid").alias("known"))
    label = saved(label, "jaccard-labels")
    largest = label.groupBy("cluster", "known").count().groupBy("cluster").agg(F.max(F.struct("count", "known"))["known"].alias("largest"))
    rest = saved(label.join(largest, "cluster").where("known <> largest").select("cid", "known"), "jaccard-rest")
    guests = visiting(placed.drop("n").join(small(rest), "cid"))
    second = searched(at_home.join(small(label.select("cid", "known")), "cid").select(*row).union(guests.select(*row)))
    out = saved(first.union(second), "jaccard-links")
    dropped(bands, one, first, label, rest)
    return out
