"""Removal of repeated passages with suffix automata of reference shards (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm.shared import BitFilter, blocks, dropped, mix, saved, slices, small
from textframes.llm.suffix_automaton import SuffixAutomaton
from textframes.llm.words import WordCutter

#: Words of a k-gram; a window is represented by one of its k-grams.
GRAM = 8
#: k-grams that are known as common; only the order of preference depends on them.
COMMON = 100_000
#: Words in an automaton.
SHARD_WORDS = 100_000
_U = np.uint64


class Passages:
    """Words of blocks of texts as hashes, and the k-gram that represents each window."""

    def __init__(self, window: int, common: np.ndarray) -> None:
        self.window, self.gram, self.common = window, min(GRAM, window), common
        self.cutter = WordCutter(fold=False)
        self.factor = np.random.default_rng(37).integers(1, 1 << 64, self.gram, dtype=_U) | _U(1)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in a row, and the number of words of each text."""
        return self.cutter.hashes(texts)

    def grams(self, flat: np.ndarray) -> np.ndarray:
        """Hash of the k-gram at each word (those that cross texts are never looked at)."""
        out = np.zeros(max(0, len(flat) - self.gram + 1), _U)
        for k in range(self.gram):
            out += flat[k : k + len(out)] * self.factor[k]
        return mix(out)

    def anchors(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with the same anchor: first window, windows in the run, anchor's place, its hash.

        A window's anchor is its smallest k-gram, common ones last, the first of equal ones: equal
        windows have equal anchors at the same place.
        """
        grams = self.grams(flat)
        span = self.window - self.gram + 1  # k-grams in a window
        if len(grams) < span:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, _U)
        rank = mix(grams) >> _U(1)  # not the hash itself: smallest hashes would crowd a filter by their first bits
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
            rank |= (self.common[at] == grams).astype(_U) << _U(63)
        value, place, width = rank, np.arange(len(rank)), 1
        while width < span:
            step = min(width, span - width)
            right = value[step:] < value[: len(value) - step]
            place = np.where(right, place[step:], place[: len(place) - step])
            value, width = rank[place], width + step
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)[: len(place)]
        start = np.flatnonzero(np.arange(len(place)) + self.window <= ends[owner])
        if not len(start):
            return start, start, start, np.zeros(0, _U)
        at = place[start]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(start) != 1)])
        return start[first], np.diff(np.r_[first, len(start)]), at[first], grams[at[first]]


def _common_grams(texts: DataFrame, window: int) -> np.ndarray:
    """k-grams that stand out in some block of rows, those with most occurrences first; COMMON at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(window, np.zeros(0, _U))
        for batch in batches:
            for part in slices(batch, "text"):
                gram, count = np.unique(passages.grams(passages.words(part.column("text"))[0]), return_counts=True)
                many = count >= 6
                yield pa.RecordBatch.from_arrays([pa.array(gram[many].view(np.int64)), pa.array(count[many])], ["gram", "n"])

    found = texts.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "gram").limit(COMMON).select("gram").toArrow()
    return np.sort(top.column("gram").to_numpy().view(_U))


def _repeated_filter(texts: DataFrame, window: int, common) -> BitFilter:
    """The anchors that occur more than once, and some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(window, common.value)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, n = passages.words(part.column("text"))
                anchor, count = np.unique(passages.anchors(flat, n)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(count)], ["anchor", "n"])

    counted = texts.select("text").mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = saved(counted.where("n > 1").select("anchor"), "passage-anchors")
    return BitFilter(repeated, "anchor", 64)


def shard_repeats(contexts: list[tuple[int, np.ndarray, int]], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """contexts: name, word hashes, occurrences. For each, the runs of windows that occur more than once.

    A generalised suffix automaton holds each context once; a state's occurrences are those of the
    contexts that pass through it and of the states that link to it. Streamed through the automaton,
    a context has at each word a longest match; the state that stands for its last `window` words
    tells how often these occur. Runs: from, to (windows, end excluded).
    """
    if len(contexts) == 1:
        name, words, n = contexts[0]
        return [(name, [(0, len(words) - window + 1)] if n > 1 else [])]
    alphabet: dict[int, int] = {}
    coded = [[alphabet.setdefault(w, len(alphabet)) for w in words.tolist()] for _, words, _ in contexts]
    sam = SuffixAutomaton(max(1, len(alphabet).bit_length()))
    passed: dict[int, int] = {}
    for symbols, (_, _, n) in zip(coded, contexts, strict=True):
        for state in sam.add(symbols):
            passed[state] = passed.get(state, 0) + n
    occurs = [0] * len(sam.length)
    for state, n in passed.items():
        occurs[state] = n
    for state in reversed(sam.by_length()):
        occurs[sam.link[state]] += occurs[state]
    out, go, length, link, bits = [], sam.go, sam.length, sam.link, sam.bits
    for symbols, (name, _, _) in zip(coded, contexts, strict=True):
        state, matched, runs = 0, 0, []
        for place, x in enumerate(symbols):
            while (to := go.get(state << bits | x)) is None:
                state = link[state]
                matched = length[state]
            state, matched = to, matched + 1
            while length[link[state]] >= window:  # keep the match at the window's length
                state = link[state]
                matched = length[state]
            if matched >= window and occurs[state] > 1:
                start = place - window + 1
                if runs and runs[-1][1] == start:
                    runs[-1] = (runs[-1][0], start + 1)
                else:
                    runs.append((start, start + 1))
        out.append((name, runs))
    return out


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space) of each row.

    Words are `[^\\x20\\x09-\\x0D]+`. Removed is each word covered by a window of `window` words that
    also starts anywhere else in the table, the same document included; windows are judged on the
    input. A null or wordless text has no words; a text shorter than a window keeps all; a null id
    stays null; each row counts, also one that is repeated. Other columns are not read. Words are
    compared by 64-bit hashes.

    Each window is represented by one k-gram, its anchor. Windows whose anchor occurs once can't be
    repeated. The rest are cut from their documents as contexts (all windows of one anchor in one
    place), equal contexts are counted and folded, and contexts of one anchor meet in one shard,
    whose suffix automaton judges their windows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.withColumns({"k1": F.xxhash64("text"), "k2": F.hash("text")})
    common = spark.sparkContext.broadcast(_common_grams(texts, window))
    known = spark.sparkContext.broadcast(_repeated_filter(texts, window, common))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(window, common.value)
        sent: set[int] = set()  # contexts whose words this task has sent
        for batch in batches:
            for part in slices(batch, "text"):
                flat, n = passages.words(part.column("text"))
                start, size, _, anchor = passages.anchors(flat, n)
                some = np.flatnonzero(known.value.holds(anchor))
                data = [flat[s : s + k + window - 1].tobytes() for s, k in zip(start[some].tolist(), size[some].tolist(), strict=True)]
                name = np.fromiter(map(xxhash.xxh3_64_intdigest, data), _U, len(data)).view(np.int64)
                row = np.searchsorted(np.cumsum(n), start[some], "right")
                first = [not (x in sent or sent.add(x)) for x in name.tolist()]
                if len(sent) > 500_000:
                    sent.clear()
                local = start[some] - (np.cumsum(n) - n)[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k1").take(pa.array(row)), part.column("k2").take(pa.array(row)), pa.array(local),
                        pa.array(anchor[some].view(np.int64)), pa.array(name), pa.array([d if f else None for d, f in zip(data, first, strict=True)], pa.binary()),
                    ],
                    ["k1", "k2", "start", "anchor", "context", "data"],
                )

    places = saved(texts.select("text", "k1", "k2").mapInArrow(cut, "k1 bigint, k2 int, start bigint, anchor bigint, context bigint, data binary"), "passage-places")
    counted = places.groupBy("anchor", "context").agg(F.count("*").alias("n"))
    bodies = places.where("data is not null").select("anchor", "context", "data").dropDuplicates(["anchor", "context"])
    contexts = counted.join(bodies, ["anchor", "context"]).select("anchor", "context", "n", "data")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, np.ndarray, int]] = []  # of anchors that have several contexts
        group: list[tuple[int, np.ndarray, int]] = []
        words, key = 0, None

        def judged(contexts: list[tuple[int, np.ndarray, int]]) -> list[tuple[int, int, int]]:
            return [(name, a, b) for name, runs in shard_repeats(contexts, window) for a, b in runs] if contexts else []

        def batch_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            name, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["context", "a", "b"])

        for batch in batches:
            out = []
            for anchor, name, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != key:
                    if len(group) == 1:  # nothing else has this anchor: the number of occurrences decides
                        out += judged(group)
                    else:
                        shard += group
                        words += sum(len(w) for _, w, _ in group)
                    group, key = [], anchor
                    if words >= SHARD_WORDS:
                        out += judged(shard)
                        shard, words = [], 0
                group.append((name, np.frombuffer(data, _U), n))
            yield batch_of(out)
        yield batch_of((judged(group) if len(group) == 1 else judged(shard + group)) + (judged(shard) if len(group) == 1 else []))

    shards = contexts.repartition("anchor").sortWithinPartitions("anchor", "context")
    repeats = saved(shards.mapInArrow(judge, "context bigint, a bigint, b bigint"), "passage-repeats")
    spans = places.select("k1", "k2", "start", "context").join(repeats, "context")
    spans = spans.select("k1", "k2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") - 1 + window).alias("b")).distinct()
    listed = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("spans"):
                a, b = (own.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                out.append(np.stack([a[first], b[np.r_[first[1:] - 1, len(a) - 1]]], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out, pa.binary())], ["k1", "k2", "spans"])

    merged = saved(listed.mapInArrow(join_up, "k1 bigint, k2 int, spans binary"), "passage-spans")
    dropped(places, repeats)
    chosen = small(merged)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in blocks(batch, "text"):
                n, removed, kept = [], [], []
                for text, spans in zip(rows, part.column("spans").to_pylist(), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space only
                    n.append(len(words))
                    if spans:
                        left, at = [], 0
                        for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                            left += words[at:a]
                            at = b
                        words = left + words[at:]
                    removed.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                digest = [hashlib.sha256(k).hexdigest() for k in kept]
                kept = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), kept],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = texts.join(chosen, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
