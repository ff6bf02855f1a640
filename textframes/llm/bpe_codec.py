"""Exact BPE encoding by dynamic programming over prefixes, and decoding (operator 3)."""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm.byte_bpe import ByteVocabulary, pretokens, vocabulary
from textframes.llm.shared import blocks
from textframes.llm.suffix_automaton import SuffixAutomaton
from textframes.llm.token_counts import NO_RANK, RankMerger


class TokenAutomaton(SuffixAutomaton):
    """Suffix automaton of a vocabulary, with the token that a state's longest string is, if any.

    A string that is a whole token starts at a token's first byte, so no longer string shares its
    state: it is the longest of its state, and a state stands for one token at most.
    """

    def __init__(self, strings: dict[bytes, int]) -> None:
        super().__init__(8)
        token = {self.add(string)[-1]: i for string, i in strings.items()}
        self.token = [token.get(s, -1) for s in range(len(self.length))]
        #: The nearest state up the suffix links, itself excluded, that is a token.
        self.above = [0] * len(self.length)
        for s in self.by_length():
            up = self.link[s]
            self.above[s] = up if self.token[up] >= 0 else self.above[up]


class IntTable:
    """A hash table of non-negative integers in arrays, filled once; absent keys give -1."""

    def __init__(self, items: dict[int, int]) -> None:
        self.bits = max(4, (4 * len(items)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        keys, values = np.array([*items], np.int64), np.array([*items.values()], np.int64)
        slot, self.probes = self.slot(keys), 0
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        slot = self.slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], -1)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = open_[found == key[open_]]
            out[hit] = self.values[slot[hit]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        return out


class PrefixCoder:
    """Encodes pre-tokens: for each prefix it stores the one token that ends the prefix's encoding.

    The token is the one whose bytes end the prefix (the suffix automaton names the candidates)
    and which fits behind the last token of the prefix that it leaves over. encode_many advances
    many pre-tokens byte by byte together; long ones go alone, byte by byte in plain Python.
    """

    MEMO_BITS = 20
    #: Longer pre-tokens are encoded alone, so that few long ones don't hold up many short ones.
    TOGETHER = 48

    def __init__(self, vocab: ByteVocabulary) -> None:
        self.vocab = vocab
        n = vocab.size
        self.merger = RankMerger(vocab)
        self.made_at = np.full(n, -1, np.int64)  # rank of the merge that makes a token; -1: a byte
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.made_at[vocab.product] = np.arange(len(vocab.product))
        self.left[vocab.product], self.right[vocab.product] = vocab.left, vocab.right
        ids = sorted({*vocab.byte_id.tolist(), *vocab.product.tolist()})
        # a token that its own bytes aren't encoded to never occurs
        counts = self.merger.encode([vocab.token_bytes[i] for i in ids])[1]
        kept = [i for i, c in zip(ids, counts.tolist(), strict=True) if c == 1]
        sam = TokenAutomaton({vocab.token_bytes[i]: i for i in kept})
        self.edges = IntTable(sam.go)
        self.length, self.link = np.array(sam.length), np.array(sam.link)
        self.token, self.above = np.array(sam.token), np.array(sam.above)
        self.memo_key = np.full(1 << self.MEMO_BITS, -1, np.int64)
        self.memo = np.zeros(1 << self.MEMO_BITS, bool)
        self.alone: _Alone | None = None

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of each a and b are encoded to just these two tokens.

        Walks back in time from the finished tokens: at each moment the symbols that meet at the
        border are known, and no merge across the border may come before the merge that really
        took one of them away. At equal rank the left place goes first.
        """
        out, n = np.ones(len(a), bool), self.vocab.size
        until_a = until_b = np.full(len(a), np.int64(1 << 60))
        at = np.arange(len(a))
        while len(at):
            across = self.merger.rank_of(a * n + b)
            wrong = (across < NO_RANK) & (across < until_a) & (across <= until_b)
            out[at[wrong]] = False
            ra, rb = self.made_at[a], self.made_at[b]
            go = ~wrong & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb, until_a, until_b = (x[go] for x in (at, a, b, ra, rb, until_a, until_b))
            later = ra > rb
            until_a, a = np.where(later, ra, until_a), np.where(later, self.right[a], a)
            until_b, b = np.where(later, until_b, rb), np.where(later, b, self.left[b])
        return out

    def fits_known(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits with a memory of fixed size."""
        key = a * self.vocab.size + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.MEMO_BITS)).astype(np.int64)
        new = np.flatnonzero(self.memo_key[slot] != key)
        out = self.memo[slot]
        if len(new):
            out[new] = self.fits(a[new], b[new])
            self.memo_key[slot[new]], self.memo[slot[new]] = key[new], out[new]
        return out

    def encode(self, word: bytes) -> list[int]:
        return self.encode_many([word])[0]

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        if (long := [k for k, w in enumerate(words) if len(w) > self.TOGETHER]):
            rest = [k for k, w in enumerate(words) if len(w) <= self.TOGETHER]
            out: list[list[int]] = [[]] * len(words)
            self.alone = self.alone or _Alone(self)
            for k in long:
                out[k] = self.alone.encode(words[k])
            for k, ids in zip(rest, self.encode_many([words[k] for k in rest]), strict=True):
                out[k] = ids
            return out
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        last, back = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        state, matched = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # words longer than k
        for k, n in enumerate(active.tolist()):
            b = data[starts[:n] + k]
            to = self.edges.get(state[:n] << 8 | b)
            while len(miss := np.flatnonzero(to < 0)):
                state[miss] = self.link[state[miss]]
                matched[miss] = self.length[state[miss]]
                to[miss] = self.edges.get(state[miss] << 8 | b[miss])
            state[:n] = to
            matched[:n] += 1
            at = np.where((self.token[to] >= 0) & (self.length[to] == matched[:n]), to, self.above[to])
            open_ = np.arange(n)
            while len(open_):
                begin = k + 1 - self.length[at[open_]]
                open_, begin = open_[begin > 0], begin[begin > 0]
                good = self.fits_known(last[starts[open_] + begin - 1], self.token[at[open_]])
                open_ = open_[~good]
                at[open_] = self.above[at[open_]]
            last[starts[:n] + k], back[starts[:n] + k] = self.token[at], k + 1 - self.length[at]
        out, end = [[] for _ in words], sizes.copy()
        live = np.flatnonzero(end > 0)
        while len(live):
            place = starts[live] + end[live] - 1
            for k, t in zip(order[live].tolist(), last[place].tolist(), strict=True):
                out[k].append(t)
            end[live] = back[place]
            live = live[end[live] > 0]
        for ids in out:
            ids.reverse()
        return out


class _Alone:
    """The same coder over plain integers: a byte costs about a microsecond in a word of any length."""

    LIMIT = 100_000

    def __init__(self, coder: PrefixCoder) -> None:
        self.n = coder.vocab.size
        self.rank = {k: r for r, k in enumerate((coder.vocab.left * self.n + coder.vocab.right).tolist())}
        compact = lambda x: array("i", x.astype(np.int32).tobytes())
        self.made_at, self.left, self.right = map(compact, (coder.made_at, coder.left, coder.right))
        self.length, self.link, self.token, self.above = map(compact, (coder.length, coder.link, coder.token, coder.above))
        self.keys, self.values = array("q", coder.edges.keys.tobytes()), compact(coder.edges.values)
        self.shift, self.mask = 64 - coder.edges.bits, (1 << coder.edges.bits) - 1
        self.known: dict[int, bool] = {}

    def go(self, key: int) -> int:
        """As IntTable.get."""
        keys, mask = self.keys, self.mask
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> self.shift
        while (found := keys[slot]) != key:
            if found < 0:
                return -1
            slot = (slot + 1) & mask
        return self.values[slot]

    def fits(self, a: int, b: int) -> bool:
        """As PrefixCoder.fits."""
        never = 1 << 60
        until_a = until_b = never
        while True:
            across = self.rank.get(a * self.n + b, never)
            if across < until_a and across <= until_b:
                return False
            ra, rb = self.made_at[a], self.made_at[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until_a, a = ra, self.right[a]
            else:
                until_b, b = rb, self.left[b]

    def encode(self, word: bytes) -> list[int]:
        go, link, length, token, above, known, n = self.go, self.link, self.length, self.token, self.above, self.known, self.n
        last, back = [0] * len(word), [0] * len(word)
        state = matched = 0
        for k, b in enumerate(word):
            while (to := go(state << 8 | b)) < 0:
                state = link[state]
                matched = length[state]
            state, matched = to, matched + 1
            at = state if token[state] >= 0 and length[state] == matched else above[state]
            while (begin := k + 1 - length[at]) > 0:
                key = last[begin - 1] * n + token[at]
                good = known.get(key)
                if good is None:
                    if len(known) >= self.LIMIT:
                        known.clear()
                    good = known[key] = self.fits(last[begin - 1], token[at])
                if good:
                    break
                at = above[at]
            last[k], back[k] = token[at], begin
        out, end = [], len(word)
        while end:
            out.append(last[end - 1])
            end = back[end - 1]
        return out[::-1]


class Codec:
    """Encodes and decodes whole texts; units that were met before are remembered up to a bound."""

    LIMIT = 300_000

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.coder = PrefixCoder(self.vocab)
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.known_ids: dict[str, bytes] = {}

    def encode_units(self, units: list[str]) -> list[list[int]]:
        parts = [[] if u in self.vocab.special else pretokens(u) for u in units]
        coded = iter(self.coder.encode_many([p.encode() for ps in parts for p in ps]))
        return [
            [self.vocab.special[u]] if u in self.vocab.special else [i for _ in ps for i in next(coded)]
            for u, ps in zip(units, parts, strict=True)
        ]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_units(self.vocab.units(text or "")) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocab.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def id_arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        cut = [self.vocab.units(t) for t in texts]
        if len(self.known_ids) > self.LIMIT:
            self.known_ids.clear()
        known = self.known_ids
        new = [*{u for us in cut for u in us}.difference(known)]
        for unit, ids in zip(new, self.encode_units(new), strict=True):
            known[unit] = np.array(ids, np.int32).tobytes()
        joined = [b"".join([known[u] for u in units]) for units in cut]
        return np.frombuffer(b"".join(joined), np.int32), np.fromiter(map(len, joined), np.int64, len(joined)) // 4

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, and the hashes of the ids and of the decoded text."""
        cut = [self.vocab.units(t) for t in texts]
        if len(self.known) > self.LIMIT:
            self.known.clear()
        known, token_bytes = self.known, self.vocab.token_bytes
        new = [*{u for us in cut for u in us}.difference(known)]
        for unit, ids in zip(new, self.encode_units(new), strict=True):
            known[unit] = (",".join(map(str, ids)), len(ids), b"".join([token_bytes[i] for i in ids]))
        out = []
        for units in cut:
            found = [known[u] for u in units]
            ids_text = ",".join([x[0] for x in found])
            decoded = b"".join([x[2] for x in found]).decode("utf-8", "replace")
            out.append((sum([x[1] for x in found]), hashlib.sha256(ids_text.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocab_path: str, ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs with a column of the tokens of each whole text (array of int). A null text has none.

    A column of that name is replaced. keep_text: whether the text comes back, too. One pass without a
    shuffle.
    """
    others = [f for f in docs.schema.fields if f.name != ids]
    kept = [f for f in others if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocab_path)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                flat, counts = coder.id_arrays(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat))
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), lists], [*names, ids])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[F.col(f"`{f.name}`") for f in others]).mapInArrow(run, f"{schema}, `{ids}` array<int>")


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text.

    A null or empty text gives no ids and the hash of the empty string; a null id stays null; equal
    rows are coded each; other columns of docs are not read. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocab_path)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                n, ids, decoded = zip(*coder.digests(texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
