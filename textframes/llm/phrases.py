"""Phrases whose words occur together more often than apart, per language (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textframes.llm.shared import ASCII_LOWER, BitFilter, dropped, mix, saved, slices, small
from textframes.llm.words import WordCutter, utf8

_U = np.uint64
#: Bytes between words, and those of them that end a piece: no phrase goes over these.
BETWEEN, STOPS = np.zeros(256, bool), np.zeros(256, bool)
STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN[[0x20, 0x09]] = True
BETWEEN |= STOPS
#: Substrings of these lengths are counted in one pass; a pass leaves out what holds a rare substring of the pass before.
LEVELS = ((1, 1), (2, 2), (3, None))
#: Parts at least that a language's phrases are ranked in before the last ranking, and phrases of a part about.
PARTS, PART_ROWS = 64, 1_000_000


class PieceCutter(WordCutter):
    """Words, with A-Z lower-cased, and where a sequence of words begins: at a text's or a piece's first word."""

    def __init__(self) -> None:
        super().__init__(fold=True)

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = ~BETWEEN[data]
        breaks = np.zeros(len(data) + 1, bool)
        breaks[offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | breaks[1:-1]
        end[:-1] &= ~inside[1:] | breaks[1:-1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, offsets))

    def heads(self, data: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a word is the first of its sequence."""
        piece = np.cumsum(STOPS[data])[starts] if len(starts) else starts
        out = np.ones(len(starts), bool)
        out[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
        return out


def longer(suffix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a substring from that of its suffix without the first word, and the first word."""
    return mix(suffix * _U(0x9E3779B97F4A7C15) + word)


class SuffixStates:
    """States of the generalised suffix automaton of sequences of words, for substrings of `shortest` to `deepest` words.

    A state stands for substrings that end at the same places; they are suffixes of its longest one.
    States are found from short to long: the places where a substring ends are parted by the word before it.
    Where that parts nothing, the longer substring is in its suffix's state; else it is a state of its own,
    whose suffix link is the suffix's state. So there are no transitions: only lengths, links and numbers of end places.
    """

    def __init__(self, words: np.ndarray, room: np.ndarray, marks: np.ndarray, shortest: int, deepest: int) -> None:
        """words: of all sequences in a row. room: words up to each that a substring ending there may have. A state keeps the least mark of its places."""
        self.keys = [words[:0], words]
        for k in range(2, shortest):
            self.keys.append(self._level(k))
        none = np.zeros(0, np.int64)
        first, last, count, link, end, mark = none, none, none, none, none, marks[:0]
        state_at, n_at = np.full(len(words), -1, np.int64), np.full(len(words), -1, np.int64)
        for k in range(shortest, deepest + 1):
            if k > 1:
                self.keys.append(self._level(k))
            at = np.flatnonzero(room >= k)
            if not len(at):
                break
            order = np.argsort(self.keys[k][at], kind="stable")
            key = self.keys[k][at[order]]
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(new) - 1
            n = np.diff(np.r_[np.flatnonzero(new), len(key)])
            where = at[order[new]]  # a place where it ends
            least = np.minimum.reduceat(marks[at[order]], np.flatnonzero(new))
            suffix = state_at[where]
            own = (suffix < 0) | (n_at[where] != n)
            state = np.where(own, len(first) + np.cumsum(own) - 1, suffix)
            last[suffix[~own]] = k
            first, last = np.r_[first, np.full(own.sum(), k)], np.r_[last, np.full(own.sum(), k)]
            count, link, end, mark = np.r_[count, n[own]], np.r_[link, suffix[own]], np.r_[end, where[own]], np.r_[mark, least[own]]
            state_at[at[order]], n_at[at[order]] = state[group], n[group]
        self.first, self.last, self.count, self.link, self.end, self.mark = first, last, count, link, end, mark

    def _level(self, k: int) -> np.ndarray:
        out = np.zeros(len(self.keys[1]), _U)
        out[k - 1 :] = longer(self.keys[k - 1][k - 1 :], self.keys[1][: len(out) - k + 1])
        return out

    def substrings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, number of end places and least mark of every substring: a state's are those of each of its lengths."""
        wide = self.last - self.first + 1
        state = np.repeat(np.arange(len(wide)), wide)
        length = self.first[state] + np.arange(len(state)) - np.repeat(np.cumsum(wide) - wide, wide)
        key = np.zeros(len(state), _U)
        for k in range(int(length.max(initial=0)) + 1):
            at = length == k
            key[at] = self.keys[k][self.end[state[at]]] if k else 0
        return key, self.count[state], self.mark[state]


def state_of(lang: np.ndarray) -> np.ndarray:
    """Key of a language's empty phrase, which occurs at every word."""
    return mix(lang ^ _U(0xD6E8FEB86659FD93))


class Frequent:
    """Keys of substrings that are frequent, and a few others: two filters over different bits of a key."""

    def __init__(self, found: DataFrame) -> None:
        turned = F.shiftleft("key", 32).bitwiseOR(F.shiftrightunsigned("key", 32))
        self.filters = [BitFilter(found.select("key"), "key", 64), BitFilter(found.select(turned.alias("key")), "key", 64)]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return self.filters[0].holds(keys) & self.filters[1].holds(keys << _U(32) | keys >> _U(32))


def _sequences(part: pa.RecordBatch, cutter: PieceCutter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice (keys that hold the language), how many of its sequence come up to each, text of each; bytes, first bytes, ends."""
    column = part.column("text")
    data, offsets = utf8(column)
    starts, ends, n = cutter.bounds(data, offsets)
    h, _ = cutter.hashes(column)
    doc = np.repeat(np.arange(len(n)), n)
    lang = part.column("_lang").to_numpy(zero_copy_only=False).view(_U)
    words = mix(h ^ mix(lang[doc])) if len(h) else h
    at = np.arange(len(words))
    room = at - np.maximum.accumulate(np.where(cutter.heads(data, starts, doc), at, 0)) + 1 if len(at) else at
    return words, room, doc, data, starts, ends


def _allowed(words: np.ndarray, room: np.ndarray, length: int, frequent: Frequent) -> np.ndarray:
    """Room that is left if no substring of `length` words that isn't frequent may lie inside."""
    key = words
    for k in range(2, length + 1):
        grown = np.zeros(len(words), _U)
        grown[k - 1 :] = longer(key[k - 1 :], words[: len(words) - k + 1])
        key = grown
    good = (room >= length) & frequent.holds(key)
    at = np.arange(len(words))
    bad = np.maximum.accumulate(np.where(good, -1, at)) if len(at) else at
    return np.minimum(room, length - 1 + at - bad)


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    text = F.col("text").cast("string")
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("_lang"), text.alias("text"), F.hash(lang, text).alias("_at")).where("text is not null")


def counts(texts: DataFrame, shortest: int, deepest: int, frequent: Frequent | None) -> DataFrame:
    """key, n, at: how often each substring of shortest to deepest words occurs, and the least hash of a text that it occurs in.

    Substrings that hold a rare one of shortest - 1 words are left out. Each slice of texts is a shard with an
    automaton of its own; numbers of shards are summed, first in each task. With shortest 1, a language's empty
    phrase has the number of its words.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent) if frequent else None
    cutters: list[PieceCutter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cutters:
            cutters.append(PieceCutter())
        for batch in batches:
            for part in slices(batch, "text"):
                words, room, doc, *_ = _sequences(part, cutters[0])
                marks = part.column("_at").to_numpy(zero_copy_only=False)[doc]
                if shared:
                    room = _allowed(words, room, shortest - 1, shared.value)
                    keep = np.flatnonzero(room >= shortest)  # with the words that lead up to these
                    near = np.zeros(len(words) + 1, np.int64)
                    np.add.at(near, keep - shortest + 1, 1)
                    np.add.at(near, keep + 1, -1)
                    inside = np.cumsum(near[:-1]) > 0
                    words, room, marks = words[inside], room[inside], marks[inside]
                key, n, at = SuffixStates(words, room, marks, shortest, deepest).substrings()
                if shortest == 1:
                    lang, first, of, times = np.unique(part.column("_lang").to_numpy(zero_copy_only=False).view(_U)[doc], return_index=True, return_inverse=True, return_counts=True)
                    least = np.full(len(lang), np.iinfo(np.int32).max, np.int32)
                    np.minimum.at(least, of, marks)
                    key, n, at = np.r_[key, state_of(lang)], np.r_[n, times], np.r_[at, least]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(at.astype(np.int32))], ["key", "n", "at"])

    return texts.select("_lang", "text", "_at").mapInArrow(run, "key bigint, n bigint, at int").groupBy("key").agg(F.sum("n").alias("n"), F.min("at").alias("at"))


def named(texts: DataFrame, wanted: DataFrame, deepest: int) -> DataFrame:
    """key, lang, phrase, m, link, stem, heads, tails of each wanted phrase (key, at), perhaps several times, and perhaps of others.

    link: key without the first word, the suffix link's way; stem: without the last. heads and tails: keys of
    its first 1, 2, ... words and of the rest. Only the texts with the hashes `at` are looked at, equal ones once: the least hashes
    of all, so that few texts name all phrases.
    """
    lists = wanted.groupBy("at").agg(F.collect_list("key").alias("keys"))  # of one text's phrases
    lists = small(saved(lists, "phrases-lists"))
    owners = texts.join(lists.select(F.col("at").alias("_at")), "_at", "left_semi").dropDuplicates(["_at", "lang", "text"])
    rows = owners.join(lists.withColumnRenamed("at", "_at"), "_at").select("lang", "_lang", "text", "keys")
    cutters: list[PieceCutter] = []
    names = ["key", "lang", "phrase", "m", "link", "stem", "heads", "tails"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    signed = lambda x: np.array(x, _U).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cutters:
            cutters.append(PieceCutter())
        for batch in batches:
            for part in slices(batch, "text"):
                words, room, doc, data, starts, ends = _sequences(part, cutters[0])
                wanted_here = np.unique(part.column("keys").flatten().to_numpy(zero_copy_only=False)).view(_U)
                langs, small_text = part.column("lang").to_pylist(), data.tobytes().translate(ASCII_LOWER)
                keys, out = [words[:0], words], []
                lang = part.column("_lang").to_numpy(zero_copy_only=False).view(_U)
                for k, at in zip(*np.unique(lang[doc], return_index=True), strict=True):
                    out.append((signed(state_of(np.array([k], _U)))[0], langs[doc[at]], "", 0, None, None, [], []))
                for k in range(1, deepest + 1):
                    if k > 1:
                        grown = np.zeros(len(words), _U)
                        grown[k - 1 :] = longer(keys[-1][k - 1 :], words[: len(words) - k + 1])
                        keys.append(grown)
                    at = np.flatnonzero(room >= k)
                    at = at[np.isin(keys[k][at], wanted_here)]
                    found, first = np.unique(keys[k][at], return_index=True)
                    for key, i in zip(found.view(np.int64).tolist(), at[first].tolist(), strict=True):
                        s = i - k + 1
                        phrase = b" ".join(small_text[starts[j] : ends[j]] for j in range(s, i + 1)).decode("utf-8", "replace")
                        heads, tails = signed([keys[c][s + c - 1] for c in range(1, k)]), signed([keys[k - c][i] for c in range(1, k)])
                        out.append((key, langs[doc[i]], phrase, k, tails[0] if k > 1 else None, heads[-1] if k > 1 else None, heads, tails))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, "key bigint, lang string, phrase string, m int, link bigint, stem bigint, heads array<bigint>, tails array<bigint>")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """1000 a n / (l r), cut down, in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", whole(a) * whole(n) * 1000, whole(left) * whole(right))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to `longest` words with the highest scores.

    docs has text and lang (null: `und`); other columns are not looked at. Words are what lies between
    spaces, tabs and `.,;:!?` or line ends, A-Z lower-cased; phrases don't go over the latter. a is how often the phrase
    occurs in its language, overlaps included, n all its words; of all cuts in two, with counts l and r, that with the lowest
    score floor(1000 a n / (l r)) counts, ties to the shortest first part. Phrases with a >= least are
    candidates; one that lies inside a longer one with share % of its occurrences is left out. Ties go to
    the larger a, then to the phrase in UTF-8 order.

    A null or empty text has no words; equal rows and rows of one id all count; without a frequent
    phrase there are no rows.

    Counts are those of generalised suffix automata of shards, summed. Only substrings whose own
    parts are frequent are counted on: single words, then pairs, then the rest in one pass. A phrase that is
    no longest one of its state in the automaton of everything has the count of a phrase one word longer in
    front, which its suffix link leads back from; the mirrored case is found by the first words. Phrases
    are compared by 64-bit hashes.
    """
    texts = _texts(docs)
    found: list[DataFrame] = []
    frequent = None
    for shortest, deepest in LEVELS:
        if shortest > longest:
            break
        level = counts(texts, shortest, min(deepest or longest, longest), frequent).where(F.col("n") >= least)
        found.append(saved(level, "phrases-counts"))
        frequent = Frequent(found[-1])  # the driver gets two filters of 32 MB at most
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = saved(every, "phrases-all")
    dropped(*found)
    of_key = small(every.select("key", "n"))
    rows = named(texts, every, longest).join(of_key, "key")
    one = F.min(F.struct("lang", "phrase", "m", "link", "stem", "heads", "tails", F.col("n").alias("a"))).alias("x")
    rows = saved(rows.groupBy("key").agg(one).select("key", "x.*"), "phrases-named")
    long = rows.where("m >= 2")
    count = lambda side: of_key.select(F.col("key").alias(f"_{side}"), F.col("n").alias(side))
    cuts = long.select("key", "lang", "phrase", "m", "a", F.posexplode(F.arrays_zip("heads", "tails")).alias("k", "cut"))
    cuts = cuts.select("key", "lang", "phrase", "m", "a", "k", F.col("cut.heads").alias("_l"), F.col("cut.tails").alias("_r"))
    totals = small(rows.where("m = 0").select("lang", F.col("a").alias("n")))
    cuts = cuts.join(count("l"), "_l").join(count("r"), "_r").join(totals, "lang")
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "lang", "phrase", "a", "n")).alias("x")).select("key", "x.*")
    inside = long.where("m >= 3").select(F.explode(F.array("link", "stem")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("_longer"))
    whole = scored.join(inside, "key", "left").where(F.coalesce(F.col("_longer"), F.lit(0)) * 100 < F.col("a") * share)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(max(PARTS, rows.count() // PART_ROWS)))
    first = whole.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))  # of top rows of each part at most
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
