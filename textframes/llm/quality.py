"""Quality scores by gradient-boosted trees over document statistics, trained on histograms in numpy (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm.shared import fold, lowest, mix, slices
from textframes.llm.words import WordCutter, utf8

#: Score at and above which a text is predicted good.
CUT = 0.5
_U = np.uint64
#: Kinds of bytes, and the kind of each byte.
KINDS = ["control", "space", "line", "lower", "upper", "digit", "stop", "comma", "quote", "symbol", "wide"]
_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate([[], [0x20, 0x09], [*range(0x0A, 0x0E)], [*range(97, 123)], [*range(65, 91)], [*range(48, 58)], b".!?", b",;:", b"'\"()-/", b"#$%&*+<=>@[\\]^_`{|}~", [*range(128, 256)]]):
    _KIND[list(_bytes)] = _k
#: Numbers that each text is described by, in order.
STATISTICS = [f"{k}_share" for k in KINDS] + [
    "log_bytes", "log_words", "word_length", "word_spread", "longest_word", "upper_letters", "symbol_ends", "stop_ends", "symbol_words", "capital_words", "upper_words",
    "wordless", "distinct", "same_as_last", "soon_again", "commonest", "pairs_again", "runs_again", "words_a_stop", "words_a_line",
]
#: Words after which a repeated word no longer counts as soon; length of a run, a power of two.
SOON, RUN = 32, 8


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the same key came before, and how many places before (0 if never)."""
    order = np.argsort(key, kind="stable")
    gap = np.zeros(len(key), np.int64)
    if len(key) > 1:
        same = key[order[1:]] == key[order[:-1]]
        gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    return gap > 0, gap


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of `length` words (a power of two) that begin at each word; the last ones are cut off."""
    step = 1
    while step < length and len(h):
        h = mix(h[:-step] * _U(0x9E3779B97F4A7C15) + h[step:]) if len(h) > step else h[:0]
        step *= 2
    return h


def statistics(column: pa.Array, cutter: WordCutter) -> np.ndarray:
    """A row of STATISTICS for each text of a column (null counts as empty: all zero). All texts are computed together."""
    data, offsets = utf8(column)
    size = np.diff(offsets)
    n = len(size)
    kind = _KIND[data]
    shares = np.bincount(np.repeat(np.arange(n), size) * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, len(KINDS)).astype(np.float64)
    starts, ends, count = cutter.bounds(data, offsets)
    h, _ = cutter.hashes(column)
    doc = np.repeat(np.arange(n), count)
    words = np.maximum(count, 1)
    total = lambda x: np.bincount(doc[: len(x)] if len(x) < len(doc) else doc, weights=x, minlength=n)
    mean = lambda x: total(x.astype(np.float64)) / words
    length = (ends - starts).astype(np.float64)
    word_length = mean(length)
    inside = lambda k: (lambda c: c[ends] - c[starts])(np.r_[0, np.cumsum(np.isin(kind, [KINDS.index(x) for x in k]))])
    letters, upper, symbols = inside(("lower", "upper", "wide")), inside(("upper",)), inside(("symbol",))
    first, last = (kind[starts], kind[ends - 1]) if len(starts) else (kind[:0], kind[:0])
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    own = h ^ mix(doc.astype(_U) + _U(1)) if len(h) else h
    seen, gap = _again(own)
    run, counts = np.unique(own, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, doc, counts[np.searchsorted(run, own)])
    repeated = []
    for k in (2, RUN):
        key = _runs(h, k)
        whole = doc[: len(key)] == doc[k - 1 : k - 1 + len(key)]
        at = doc[: len(key)][whole]
        again, _ = _again(key[whole] ^ mix(at.astype(_U) + _U(1)))
        repeated.append(np.bincount(at[again], minlength=n) / np.maximum(1, np.bincount(at, minlength=n)))
    letter_bytes = shares[:, KINDS.index("lower")] + shares[:, KINDS.index("upper")]
    out = [
        np.log1p(size), np.log1p(count), word_length, np.sqrt(np.maximum(0, mean(length**2) - word_length**2)), np.log1p(longest),
        shares[:, KINDS.index("upper")] / np.maximum(1, letter_bytes), mean(last == KINDS.index("symbol")), mean(last == KINDS.index("stop")), mean(symbols > 0),
        mean(first == KINDS.index("upper")), mean((upper > 1) & (upper == letters)), mean(letters == 0), mean(~seen), mean(gap == 1), mean(seen & (gap <= SOON)), most / words, *repeated,
        count / (1 + shares[:, KINDS.index("stop")]), count / (1 + shares[:, KINDS.index("line")]),
    ]
    return np.column_stack([shares / np.maximum(1, size)[:, None], *out])


@dataclass
class Forest:
    """Complete binary trees of one depth, flattened: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # trees x inner nodes: a row goes right if its value is above
    leaf: np.ndarray  # trees x leaves: added to the logit
    base: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """All trees at once: each step takes every row of every tree one level down."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(rows), self.base)
        each, at = np.arange(trees), np.zeros((len(rows), trees), np.int64)
        of = np.arange(len(rows))[:, None]
        for _ in range(self.leaf.shape[1].bit_length() - 1):
            at = 2 * at + 1 + (rows[of, self.feature[each, at]] > self.above[each, at])
        return self.base + self.leaf[each, at - inner].sum(axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -60, 60)))


def _binned(rows: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of each feature (features x bins - 1, padded with infinity), midway between values, and each value's bin."""
    cuts = np.full((rows.shape[1], bins - 1), np.inf)
    for k in range(rows.shape[1]):
        values = np.unique(rows[:, k])
        middle = (values[1:] + values[:-1]) / 2
        some = middle if len(middle) < bins else np.unique(middle[np.linspace(0, len(middle) - 1, bins - 1).astype(int)])
        cuts[k, : len(some)] = some
    return cuts, np.column_stack([np.searchsorted(cuts[k], rows[:, k], "left") for k in range(rows.shape[1])]) if rows.shape[1] else rows.astype(int)


def boost(rows: np.ndarray, good: np.ndarray, weight: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Fits trees to the logistic loss by second-order steps on histograms of binned features.

    A node without a split that lowers the loss, or with less than `least` of second derivative on a
    side, sends all its rows right. Without rows of both kinds there is no tree and the score is the share of good
    rows, or CUT without any.
    """
    inner = (1 << depth) - 1
    share = float((weight * good).sum() / weight.sum()) if len(good) else CUT
    base = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
    if not len(good) or good.min() == good.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts, bin_of = _binned(rows, bins)
    n, m = bin_of.shape
    flat = bin_of + np.arange(m) * bins
    feature, above, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), -np.inf), np.zeros((trees, inner + 1))
    z = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - good), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            key = ((at - first)[:, None] * (m * bins) + flat).ravel()
            sums = [np.bincount(key, weights=np.repeat(x, m), minlength=wide * m * bins).reshape(wide, m, bins).cumsum(axis=2) for x in (g, h)]
            (gl, hl), (ga, ha) = sums, (sums[0][..., -1:], sums[1][..., -1:])
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (ha - hl < least)] = 0
            gain[..., -1] = 0
            best = gain.reshape(wide, -1).argmax(axis=1)
            take = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9
            f, b = best // bins, best % bins
            feature[t, first : first + wide] = np.where(take, f, 0)
            above[t, first : first + wide] = np.where(take, cuts[f, np.minimum(b, bins - 2)], -np.inf)
            own = at - first
            at = 2 * at + 1 + np.where(take[own], bin_of[np.arange(n), f[own]] > b[own], True)
        sums = [np.bincount(at - inner, weights=x, minlength=inner + 1) for x in (g, h)]
        leaf[t] = -rate * sums[0] / (sums[1] + ridge)
        z += leaf[t][at - inner]
    return Forest(feature, above, leaf, base)


def described(docs: DataFrame) -> DataFrame:
    """docs with statistics (array of doubles) of each whole text in place of text: one pass without a shuffle."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "statistics")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "statistics array<double>"])
    cutters: list[WordCutter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cutters:
            cutters.append(WordCutter(fold=False))
        for batch in batches:
            for part in slices(batch, "text"):
                rows = statistics(part.column("text"), cutters[0])
                values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), values], [*(f.name for f in kept), "statistics"])

    return docs.select(*[f"`{f.name}`" for f in kept], "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, **options: float) -> Forest:
    """Fits on at most per_class documents of each label.

    Bounded sample (a documented parameter): of the rows whose crc32(doc_id) mod 3 is not 1, about
    those lowest by hash of the id in each class, whole texts (null: empty). Each class has the weight that it has
    among all such rows. Rows of one id with different labels, and null ids or labels, are left out.
    Statistics are computed in tasks; the driver gets numbers only.
    """
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_max"))
    marked = marked.where((F.col("quality") == F.col("_max")) & (fold("doc_id", 3) != 1)).select("doc_id", "quality")
    known = docs.select("doc_id").join(marked, "doc_id").distinct()
    there = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [(r[0], r[1]) for r in lowest(known, "quality", "doc_id", per_class).select("doc_id", "quality").collect()]  # 2 x per_class at most
    if not chosen:
        return boost(np.zeros((0, len(STATISTICS))), np.zeros(0), np.zeros(0))
    keys = docs.sparkSession.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _good int")
    picked = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(keys), "doc_id")
    # of several texts of an id one, always the same
    picked = picked.groupBy("doc_id", "_good").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "_good", "x.text")
    got = sorted(((r["doc_id"], r["_good"], r["statistics"]) for r in described(picked).collect()), key=lambda r: r[0])
    good = np.array([r[1] for r in got], np.float64)
    weight = np.array([there[r[1]] for r in got]) / np.maximum(1, np.where(good > 0, good.sum(), (1 - good).sum()))
    return boost(np.array([r[2] for r in got]), good, weight / weight.mean(), **options)


def quality(docs: DataFrame, model: Forest) -> DataFrame:
    """docs (without text) with score (0 to 1) and predicted (1 if score >= CUT) of each whole text.

    Only the text is looked at; a null text counts as empty and gets the score of all statistics at zero; equal
    texts get equal scores; columns of docs with the new names are replaced. One pass without a shuffle.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("text", "score", "predicted", "statistics")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double", "predicted int"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cutters: list[WordCutter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cutters:
            cutters.append(WordCutter(fold=False))
        for batch in batches:
            for part in slices(batch, "text"):
                score = np.round(shared.value.scores(statistics(part.column("text"), cutters[0])), 6)
                columns = [*(part.column(f.name) for f in kept), pa.array(score), pa.array((score >= CUT).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "score", "predicted"])

    return docs.select(*[f"`{f.name}`" for f in kept], "text").mapInArrow(run, schema)
