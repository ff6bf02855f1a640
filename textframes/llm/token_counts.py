"""Token counts by rank-synchronous merging of ragged arrays (operator 1)."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm.byte_bpe import ByteVocabulary, pretokens, vocabulary
from textframes.llm.shared import blocks

NO_RANK = np.int64(1 << 40)


class RankMerger:
    """Merges many byte strings at once: each round applies every sequence's pair of lowest rank.

    All occurrences of that pair in a sequence are applied in one round, from the left and without
    overlap. That equals one merge at a time: a pair made of a new symbol never ranks below the
    merge that made the symbol.
    """

    SLOTS = 1 << 20
    #: Longer byte strings go alone: rounds that look at the places of one rank only.
    LONG = 2048

    def __init__(self, vocab: ByteVocabulary) -> None:
        self.vocab = vocab
        self.keys = np.full(self.SLOTS, -1, np.int64)
        self.ranks = np.full(self.SLOTS, NO_RANK, np.int64)
        pairs: dict[int, int] = {}
        for rank, key in enumerate((vocab.left * vocab.size + vocab.right).tolist()):
            pairs[key] = rank  # of a repeated pair the last rank counts
        waiting, ranks = np.array([*pairs], np.int64), np.array([*pairs.values()], np.int64)
        slot = self._slot(waiting)
        self.probes = 0
        while len(waiting):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = waiting[put], ranks[put]
            rest = np.ones(len(waiting), bool)
            rest[put] = False
            waiting, ranks, slot = waiting[rest], ranks[rest], (slot[rest] + 1) & (self.SLOTS - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank_of(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NO_RANK)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot_open = slot[open_] = (slot[open_] + 1) & (self.SLOTS - 1)
            found = self.keys[slot_open]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot_open[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and each word's number of tokens."""
        if long := [k for k, w in enumerate(words) if len(w) > self.LONG]:
            short = [k for k, w in enumerate(words) if len(w) <= self.LONG]
            flat, n = self.encode([words[k] for k in short])
            parts, counts = dict(zip(short, np.split(flat, np.cumsum(n)[:-1]), strict=True)) if short else {}, np.zeros(len(words), np.int64)
            parts |= {k: self.encode_long(words[k]) for k in long}
            counts[[*parts]] = [*map(len, parts.values())]
            return np.concatenate([parts[k] for k in range(len(words))]), counts
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        counts = np.zeros(len(words), np.int64)
        done_owner, done_symbols = [], []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            rank[pair] = self.rank_of(symbols[pair] * self.vocab.size + symbols[pair + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            ended = lowest == NO_RANK
            if ended.any():
                done_owner.append(owner[ended])
                done_symbols.append(symbols[ended])
                symbols, owner, rank, lowest = (x[~ended] for x in (symbols, owner, rank, lowest))
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == lowest)
            run = np.r_[True, np.diff(at) != 1]  # overlapping hits: a pair of equal symbols
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            symbols[at] = self.vocab.product[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_owner:
            return np.zeros(0, np.int64), counts
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        np.add.at(counts, owner, 1)
        return symbols[order], counts


    def encode_long(self, word: bytes) -> np.ndarray:
        """The same rounds over one string: places wait by rank, and a round touches those of the lowest rank and their neighbours."""
        n, size = len(word), self.vocab.size
        symbol = np.append(self.vocab.byte_id[np.frombuffer(word, np.uint8)], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, NO_RANK)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[after[places] < n]
            found = self.rank_of(symbol[places] * size + symbol[after[places]])
            rank[places] = found
            places, found = places[found < NO_RANK], found[found < NO_RANK]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else []
            for r, own in zip(found[starts].tolist() if len(found) else [], np.split(places, starts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(own)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            run = np.r_[True, after[at[:-1]] != at[1:]]  # overlapping hits: a pair of equal symbols
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            gone = after[at]
            symbol[at] = self.vocab.product[r]
            rank[gone], rank[at] = NO_RANK, NO_RANK
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            wait(np.unique(np.concatenate([at, left[left >= 0]])))
        kept, k = [], 0
        steps = after.tolist()
        while k < n:
            kept.append(k)
            k = steps[k]
        return symbol[kept]


class UnitCounter:
    """Tokens of each unit, remembered up to a bound."""

    LIMIT = 400_000

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.merger = RankMerger(self.vocab)
        self.known: dict[str, int] = {}

    def _learn(self, units: list[str]) -> None:
        for special in self.vocab.special:
            self.known[special] = 1
        cut = [pretokens(u) for u in units]
        flat = [p.encode() for ps in cut for p in ps]
        counts = self.merger.encode(flat)[1] if flat else np.zeros(0, np.int64)
        ends = np.cumsum([0, *map(len, cut)])
        sums = np.r_[0, np.cumsum(counts)]
        self.known.update(zip(units, (sums[ends[1:]] - sums[ends[:-1]]).tolist(), strict=True))

    def counts(self, texts: list[str]) -> np.ndarray:
        cut = [self.vocab.units(t) for t in texts]
        flat = [u for us in cut for u in us]
        if len(self.known) > self.LIMIT:
            self.known.clear()
        new = set(flat).difference(self.known, self.vocab.special)
        self._learn([*new])
        each = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sums, ends = np.r_[0, np.cumsum(each)], np.cumsum([0, *map(len, cut)])
        return sums[ends[1:]] - sums[ends[:-1]]


@functools.lru_cache(maxsize=2)
def unit_counter(path: str) -> UnitCounter:
    return UnitCounter(path)


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row's whole text.

    A null or empty text has no bytes and no tokens; a null id stays null; equal rows are counted
    each; other columns of docs are not read. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = unit_counter(vocab_path)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                n = counter.counts(texts)
                n_bytes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
