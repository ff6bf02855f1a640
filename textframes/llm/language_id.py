"""Language identification by nearest centroid over TF-IDF character n-grams (operator 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm.shared import blocks, fold, lowest, mix



#: Words: letters, and numerals that are no digits (fractions, circled digits); add() takes the latter out.
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Texts whose dense vectors are held together.
DENSE_ROWS = 128
#: A text belongs to no language if its cosine to the nearest centroid exceeds what hash collisions
#: alone give by less than a floor, which depends on its length. The floor is what texts of random letters reach: their mean and
#: DEVIATIONS standard deviations; or, if that is less, what the share QUANTILE of texts of the languages stays below, which the model
#: has not seen (cross-fitted in FOLDS parts).
DEVIATIONS, QUANTILE, FOLDS = 3.0, 0.01, 2
#: Words of the texts that floors are measured on, and random texts of each length.
LENGTHS, RANDOM_TEXTS = tuple(1 << k for k in range(10)), 128


class GramTable:
    """Distinct lower-case words and the hashed n-grams (1 to 3 letters, with word borders) of each."""

    def __init__(self, size: int, limit: int = 300_000) -> None:
        self.size, self.limit = size, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.grams, self.offsets, self.used = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64), 0
        self.lettered = np.zeros(0, bool)

    def add(self, words: list[str]) -> None:
        """Hashes the n-grams of new words in one go."""
        if not words:
            return
        for w in words:
            self.index[w] = len(self.index)
        words = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]
        self.lettered = np.r_[self.lettered, np.fromiter(map(bool, words), bool, len(words))]
        text = "\n" + "\n".join(words) + "\n"  # a word's border is the line end on either side
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        border = code == 10
        owner = np.cumsum(border)  # of each border: the word that follows it
        two = code[:-1] * np.uint64(0x110000) + code[1:]
        three = two[:-1] * np.uint64(0x110000) + code[2:]
        owners, values = [], []
        inside = np.flatnonzero(~border)
        owners.append(owner[inside])
        values.append(code[inside])
        p = np.flatnonzero(~(border[:-1] & border[1:]))
        owners.append(np.where(border[p + 1], owner[p], owner[p + 1]))
        values.append(two[p] + np.uint64(1 << 62))
        p = np.flatnonzero(~border[1:-1])
        owners.append(owner[p + 1])
        values.append(three[p] + np.uint64(1 << 63))
        owners, values = np.concatenate(owners), np.concatenate(values)
        grams = (mix(values) % np.uint64(self.size)).astype(np.int32)
        order = np.argsort(owners, kind="stable")
        counts = np.bincount(owners - 1, minlength=len(words))[: len(words)]
        if self.used + len(grams) > len(self.grams):
            self.grams = np.r_[self.grams, np.zeros(max(len(self.grams), len(grams)), np.int32)]
        self.grams[self.used : self.used + len(grams)] = grams[order]
        self.used += len(grams)
        self.offsets = np.r_[self.offsets, self.offsets[-1] + np.cumsum(counts)]

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Term frequencies (texts x size) and the number of words with a letter of each text."""
        cut = [LETTERS.findall(t.lower()) for t in texts]
        if len(self.index) > self.limit:
            self.clear()
        self.add([*{w for ws in cut for w in ws}.difference(self.index)])
        n_words = np.fromiter(map(len, cut), np.int64, len(cut))
        ids = np.fromiter((i for ws in cut for i in map(self.index.__getitem__, ws)), np.int64, int(n_words.sum()))
        lettered = np.bincount(np.repeat(np.arange(len(cut)), n_words)[self.lettered[ids]], minlength=len(cut))
        pair, n = np.unique(np.repeat(np.arange(len(cut)), n_words) * (1 << 32) + ids, return_counts=True)
        doc, word = pair >> 32, pair & 0xFFFFFFFF
        sizes = self.offsets[word + 1] - self.offsets[word]
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.offsets[word], sizes)
        flat = np.repeat(doc, sizes) * self.size + self.grams[place]
        tf = np.bincount(flat, weights=np.repeat(n, sizes).astype(np.float64), minlength=len(cut) * self.size)
        return tf.reshape(len(cut), self.size).astype(np.float32), lettered


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    """Centroids by language, and how far above chance a text must be to belong to one."""

    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    marks: np.ndarray  # lengths, in doublings of distinct n-grams
    floor: np.ndarray  # at each of these; in between in proportion

    @property
    def size(self) -> int:
        return len(self.idf)

    def weigh(self, tf: np.ndarray) -> np.ndarray:
        return unit_rows(np.log1p(tf) * self.idf)

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, cosine, and whether it is too far from that centroid."""
        best, value, margin = self.measure(tf)
        return best, value, margin < np.interp(doublings(tf), self.marks, self.floor)

    def measure(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, cosine, and how far that is above chance."""
        cosine = self.weigh(tf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        value = cosine[np.arange(len(tf)), best]
        return best, value, value - self.chance(tf, best)

    def chance(self, tf: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Expected cosine to centroid `best` of n-grams that are strange to it: of the same counts in any slots."""
        w = np.log1p(tf)
        norm = np.sqrt((w * w).sum(axis=1) * (self.idf**2).mean())
        return w.mean(axis=1) * (self.centroids @ self.idf)[best] / np.maximum(norm, 1e-12)


def doublings(tf: np.ndarray) -> np.ndarray:
    """A text's length: how often one distinct n-gram is doubled."""
    return np.log2(np.maximum(1, (tf > 0).sum(axis=1)))


def fit(texts: list[str], langs: list[str], size: int = 4096, clusters: int = 3, seed: int = 7) -> LanguageModel:
    """Spherical k-means in each language, and floors. Without texts the model has no centroid and rejects all."""
    model = _centroids(texts, langs, size, clusters, seed)
    if model.languages:
        model.marks, model.floor = _floors(model, texts, langs, clusters, seed)
    return model


def _centroids(texts: list[str], langs: list[str], size: int, clusters: int, seed: int) -> LanguageModel:
    grams = GramTable(size)
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.ones(size, np.float32), np.zeros((0, size), np.float32), np.zeros(1), np.zeros(1))
    rows: dict[str, list[str]] = {name: [] for name in names}
    for text, lang in zip(texts, langs, strict=True):
        rows[lang].append(text)

    def blocks_of(own: list[str]) -> Iterator[np.ndarray]:  # dense vectors of one language are held at most
        return (grams.vectors(own[k : k + 256])[0] for k in range(0, len(own), 256))

    found = sum((tf > 0).sum(axis=0) for tf in blocks_of(texts))
    idf = (np.log((1 + len(texts)) / (1 + found)) + 1).astype(np.float32)
    rng = np.random.default_rng(seed)
    labels, centres = [], []
    for name in names:
        own = unit_rows(np.log1p(np.concatenate([*blocks_of(rows[name])])) * idf)
        own = own[np.linalg.norm(own, axis=1) > 0]
        if not len(own):
            continue
        c = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
        for _ in range(10):
            nearest = (own @ c.T).argmax(axis=1)
            c = unit_rows(np.stack([own[nearest == k].sum(axis=0) if (nearest == k).any() else c[k] for k in range(len(c))]))
        labels += [name] * len(c)
        centres += [*c]
    return LanguageModel(labels, idf, np.array(centres, np.float32).reshape(-1, size), np.zeros(1), np.zeros(1))


def _measured(model: LanguageModel, grams: GramTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How far above chance texts are, and their lengths."""
    found = [(model.measure(tf)[2], doublings(tf)) for k in range(0, len(texts), 256) for tf in [grams.vectors(texts[k : k + 256])[0]]]
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.zeros(0), np.zeros(0))


def random_texts(words: list[str], n: int, count: int, rng: np.random.Generator) -> list[str]:
    """Texts of n words that are as long as the given ones, of letters that occur in these, each as likely."""
    alphabet = np.array(sorted({c for w in words for c in w}))
    lengths = rng.choice(np.fromiter(map(len, words), np.int64, len(words)), n * count)
    letters = "".join(rng.choice(alphabet, int(lengths.sum())))
    ends = np.cumsum(lengths)
    cut = [letters[b - k : b] for b, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
    return [" ".join(cut[k * n : (k + 1) * n]) for k in range(count)]


def _floors(model: LanguageModel, texts: list[str], langs: list[str], clusters: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and the floor at each: from texts of random letters, and from texts that a model of the others has not seen."""
    rng, grams = np.random.default_rng(seed), GramTable(model.size)
    cut = [LETTERS.findall(t.lower()) for t in texts]
    part = rng.permutation(len(texts)) % FOLDS
    unseen: dict[int, list[np.ndarray]] = {n: [] for n in LENGTHS}
    for k in range(FOLDS):
        others = np.flatnonzero(part != k)
        own = _centroids([texts[i] for i in others], [langs[i] for i in others], model.size, clusters, seed)
        if own.languages:
            for n in LENGTHS:
                some = [cut[i] for i in np.flatnonzero(part == k) if len(cut[i]) >= n]
                some = [w[(len(w) - n) // 2 :][:n] for w in some]  # n words of the middle
                unseen[n].append(_measured(own, grams, [" ".join(w) for w in some])[0])
    words = [w for c in cut for w in c[:50]]  # letters and lengths
    marks, floor = [], []
    for n in LENGTHS:
        if not words:
            break
        margin, length = _measured(model, grams, random_texts(words, n, RANDOM_TEXTS, rng))
        top = float(margin.mean() + DEVIATIONS * margin.std())
        own = np.concatenate(unseen[n]) if unseen[n] else np.zeros(0)
        marks.append(float(length.mean()))
        floor.append(max(0.0, min(top, float(np.quantile(own, QUANTILE))) if len(own) >= 1 / QUANTILE else top))
    order = np.argsort(marks)
    return (np.array(marks)[order], np.array(floor)[order]) if marks else (np.zeros(1), np.zeros(1))


def train(docs: DataFrame, per_language: int = 300, hold_out: bool = True) -> LanguageModel:
    """Fits on at most per_language documents of each language; the driver's part grows with their number.

    Bounded sample (documented parameters): of the rows with a lang whose crc32(doc_id) mod 4 is not
    2, about the per_language lowest by hash of the id in each language, whole texts. lang, source and
    doc_id serve to choose rows and as labels only.
    """
    rows = docs.select("doc_id", "lang").where("lang is not null and doc_id is not null")
    if hold_out:
        rows = rows.where(fold("doc_id", 4) != 2)
    chosen = lowest(rows, "lang", "doc_id", per_language)
    ids = [tuple(r) for r in chosen.select("doc_id", "lang").distinct().collect()]  # per_language x languages at most
    if not ids:
        return fit([], [])
    keys = docs.sparkSession.createDataFrame(ids, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string")
    picked = docs.select("doc_id", "lang", "text").join(F.broadcast(keys), ["doc_id", "lang"]).where("text is not null")
    picked = picked.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))  # of several texts one, always the same
    got = picked.orderBy("doc_id", "lang").select("text", "lang").collect()
    return fit([r[0] for r in got], [r[1] for r in got])


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with three columns, by default lang_pred, score and rejected.

    lang_pred is a learned language, or `und` if the text is null or has no letter; score is the
    cosine to the nearest centroid, 0 for `und`; rejected says that the text is `und` or that this
    cosine exceeds what collisions of n-grams give by less than the floor of texts of its length (_floors). Equal texts get equal answers; columns of docs with the
    names of the new ones are replaced; other columns, lang, source and doc_id are carried, never
    used. One pass without a shuffle; the model's size depends on languages and n-gram slots only.
    """
    new = [*names]
    fields = [f for f in docs.schema.fields if f.name not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    grams: list[GramTable] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if not grams:
            grams.append(GramTable(m.size))
        labels = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for part, texts in blocks(batch, "text", DENSE_ROWS):
                tf, n_words = grams[0].vectors(texts)
                if len(m.languages):
                    best, score, far = m.predict(tf)
                else:
                    best, score, far = np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool)
                none = (n_words == 0) | (len(m.languages) == 0)
                best = np.where(none, len(m.languages), best)
                score = np.where(none, 0.0, np.clip(score, 0, 1)).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(labels[best].tolist(), pa.string()), pa.array(score), pa.array(none | far)],
                    [*part.schema.names, *new],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(
        run, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"
    )
