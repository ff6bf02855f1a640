"""Toxicity scores by a convolutional text classifier trained in numpy (operator 2)."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframes.llm.shared import blocks, dropped, fold, lowest, mix, saved, small

TOKENS = re.compile(r"\w+")
#: Score at and above which a text is predicted toxic; each language's threshold is mapped to it.
CUT = 0.7
#: Prefix lengths whose hashes are embedded beside the whole word's.
PREFIXES = (3, 4, 5, 6, 7)
#: Weight of other languages' texts in a language's threshold.
OTHERS = 0.1
#: Share of a text's words that a training step leaves out, others each time: what is learnt must not hang on one text's words.
DROPPED = 0.5
#: Texts below which a sample is small: it is cross-fitted in more parts, and learnt in smaller steps. Texts that training sees at least, repeats counted.
SMALL, SEEN = 1024, 11_500
#: Rows that one task goes on learning from, rate of its steps, and rounds at most (a round sees every row once).
SHARD_ROWS, SHARD_RATE, SHARD_ROUNDS = 16_384, 0.004, 6
#: Numbers that a task gives away together, and steps of a logit that thresholds are told apart by.
PIECE, STEPS = 1 << 16, 256
FEATURES = 1 + len(PREFIXES)


class WordTable:
    """Distinct lower-case words and the embedding slots of each: of the word and of its prefixes."""

    def __init__(self, slots: int, limit: int = 300_000) -> None:
        self.slots, self.limit = slots, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.features = np.zeros((1 << 12, FEATURES), np.int32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and each text's number of words."""
        cut = [TOKENS.findall(t.lower()) for t in texts]
        if len(self.index) > self.limit:
            self.clear()
        self._add([*{w for ws in cut for w in ws}.difference(self.index)])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        return np.fromiter((i for ws in cut for i in map(self.index.__getitem__, ws)), np.int64, int(n.sum())), n

    def _add(self, words: list[str]) -> None:
        if not words:
            return
        start = len(self.index)
        self.index.update(zip(words, range(start, start + len(words)), strict=True))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(n) - n
        state = np.full(len(words), np.uint64(14695981039346656037))
        out = np.zeros((len(words), FEATURES), np.int32)
        order = np.argsort(-n, kind="stable")  # longer words first: those that go on are a prefix
        for k in range(int(n.max())):
            live = order[: int((n > k).sum())]
            state[live] = mix((state[live] ^ code[begin[live] + k]) * np.uint64(1099511628211))
            if k + 1 in PREFIXES:
                out[live, 1 + PREFIXES.index(k + 1)] = 1 + (state[live] + np.uint64(k)) % np.uint64(self.slots - 1)
        out[:, 0] = 1 + mix(state) % np.uint64(self.slots - 1)
        need = start + len(words)
        if need > len(self.features):
            self.features = np.concatenate([self.features, np.zeros((max(need, len(self.features)), FEATURES), np.int32)])
        self.features[start:need] = out


@dataclass
class TextCnn:
    """score = sigmoid of a linear layer over the largest response of each filter in a text."""

    embedding: np.ndarray  # slots x d; slot 0 stays 0: padding
    filters: list[np.ndarray]  # of each width: width x d x f
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str]
    profile: np.ndarray  # slots x languages: log-odds of a word
    threshold: np.ndarray  # of each language: score = sigmoid(z - threshold + logit(CUT))

    @classmethod
    def start(cls, slots: int, d: int, f: int, widths: tuple[int, ...], rng: np.random.Generator) -> TextCnn:
        e = rng.normal(0, 0.1, (slots, d)).astype(np.float32)
        e[0] = 0
        w = [rng.normal(0, (2 / (k * d)) ** 0.5, (k, d, f)).astype(np.float32) for k in widths]
        b = [np.zeros(f, np.float32) for _ in widths]
        return cls(e, w, b, rng.normal(0, 0.3, f * len(widths)).astype(np.float32), -2.0, [], np.zeros((slots, 0), np.float32), np.zeros(1))

    def pooled(self, words: np.ndarray, vectors: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest responses (texts x filters), where they are, and the padded word sequence.

        vectors: of each distinct word; row 0 is padding. words: of all texts in a row. Each text is
        followed by as many paddings as the widest filter has words.
        """
        pad = max(len(w) for w in self.filters)
        ends = np.cumsum(n)
        padded = np.zeros(len(words) + pad * len(n), np.int64)
        padded[np.arange(len(words)) + pad * np.repeat(np.arange(len(n)), n)] = words
        starts = ends - n + pad * np.arange(len(n))
        values, places = [], []
        for w, b in zip(self.filters, self.biases, strict=True):
            size = len(padded) - len(w) + 1
            response = (vectors @ w[0])[padded[:size]]
            for k in range(1, len(w)):
                response += (vectors @ w[k])[padded[k : k + size]]
            for t in range(1, len(w)):  # places from which the filter would reach the next text
                over = starts + n + pad - t
                response[over[over < size]] = -np.inf
            values.append(np.maximum.reduceat(response, starts, axis=0) + b)
            places.append(response)
        return np.concatenate(values, axis=1), places, padded

    def logits(self, words: np.ndarray, vectors: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(words, vectors, n)[0], 0) @ self.out + self.out_bias

    def vectors(self, features: np.ndarray) -> np.ndarray:
        """Sums of the embeddings of words' slots, after a row for padding."""
        return np.concatenate([np.zeros((1, self.embedding.shape[1]), np.float32), self.embedding[features].sum(axis=1)])

    def language(self, words: np.ndarray, features: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Likeliest language of each text by its words, 0 without any; a language known by its words only."""
        if not len(self.languages):
            return np.zeros(len(n), np.int64)
        sums = np.r_[np.zeros((1, len(self.languages))), np.cumsum(self.profile[features[:, 0]][words], axis=0, dtype=np.float64)]
        ends = np.cumsum(n)
        return (sums[ends] - sums[ends - n]).argmax(axis=1)

    def know(self, names: list[str], seen: np.ndarray) -> None:
        """Takes over the languages' words: how often each language has words of each slot."""
        p = (seen + 1) / (seen + 1).sum(axis=0)
        self.languages, self.threshold = names, np.zeros(len(names))
        self.profile = np.log(p / p.mean(axis=1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        """All that training moves, in a row."""
        return np.concatenate([*(x.ravel() for x in (self.embedding, *self.filters, *self.biases, self.out)), [self.out_bias]]).astype(np.float32)

    def moved(self, flat: np.ndarray) -> TextCnn:
        """The same model with other numbers of flat()."""
        own, at = [], 0
        for x in (self.embedding, *self.filters, *self.biases, self.out):
            own.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        k = len(self.filters)
        return replace(self, embedding=own[0], filters=own[1 : 1 + k], biases=own[1 + k : 1 + 2 * k], out=own[-1], out_bias=float(flat[at]))

    def score(self, table: WordTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = table.ids(texts)
        distinct, words = np.unique(ids, return_inverse=True)
        features = table.features[distinct]
        z = self.logits(words + 1, self.vectors(features), n)
        lang = self.language(words, features, n)
        return sigmoid(z - self.threshold[lang] + np.log(CUT / (1 - CUT))), lang


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Moves value (of it, the given rows) against the gradient."""
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad * grad
        c1, c2 = 1 - 0.9**self.t, 1 - 0.999**self.t
        value[at] -= self.rate * (m[at] / c1) / (np.sqrt(v[at] / c2) + 1e-8)


@dataclass
class Sample:
    """Labelled texts, and their part in cross-fitting."""

    texts: list[str]
    toxic: np.ndarray
    langs: list[str | None]
    parts: np.ndarray | None = None  # of each text, if its part is fixed
    languages: list[str] | None = None  # of all texts there are, if the sample isn't all

    @property
    def folds(self) -> int:
        """Parts that thresholds are cross-fitted in: each model should see nearly as much as the one that is kept."""
        return 6 if len(self.texts) < SMALL else 3

    def part(self, seed: int = 3) -> np.ndarray:
        return self.parts if self.parts is not None else np.random.default_rng(seed).permutation(len(self.texts)) % self.folds

    @property
    def flat(self) -> bool:
        """Whether there aren't texts of both kinds."""
        return not len(self.toxic) or self.toxic.min() == self.toxic.max()

    def learn(self, rows: np.ndarray, **options: int) -> TextCnn:
        own = Sample([self.texts[k] for k in rows], self.toxic[rows], [self.langs[k] for k in rows])
        return learn(own, self.languages if self.languages is not None else sorted({x for x in self.langs if x is not None}), **options)

    def judged(self, model: TextCnn, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's logits and languages of rows."""
        table, out = WordTable(len(model.embedding)), []
        for at in range(0, len(rows), 256):
            ids, n = table.ids([self.texts[k] for k in rows[at : at + 256]])
            distinct, words = np.unique(ids, return_inverse=True)
            features = table.features[distinct]
            out.append((model.logits(words + 1, model.vectors(features), n), model.language(words, features, n)))
        return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (np.zeros(0), np.zeros(0, np.int64))


def learn(sample: Sample, names: list[str], slots: int = 1 << 15, d: int = 12, f: int = 8,
          widths: tuple[int, ...] = (1, 2, 3), epochs: int = 0, batch: int = 0, seed: int = 3) -> TextCnn:
    """Trains on all texts of the sample. Without texts of both kinds the model gives every text the same score, below CUT.

    epochs, batch: by default six passes in steps of 32 texts; smaller samples in more passes, so that as many texts are
    seen, and in smaller steps.
    """
    n_texts = max(1, len(sample.texts))
    epochs, batch = epochs or max(6, -(-SEEN // n_texts)), batch or (8 if n_texts < SMALL else 16 if n_texts < 2 * SMALL else 32)
    rng = np.random.default_rng(seed)
    model = TextCnn.start(slots, d, f, widths, rng)
    y = sample.toxic.astype(np.float32)
    if sample.flat:
        model.out[:] = 0
        model.threshold = np.array([model.out_bias + 4.0])
        return model
    table = WordTable(slots, limit=1 << 30)
    ids, n = table.ids(sample.texts)
    ends = np.cumsum(n)
    docs = [ids[e - k : e] for e, k in zip(ends, n, strict=True)]
    if names:
        seen = np.zeros((slots, len(names)))
        for words, lang in zip(docs, sample.langs, strict=True):
            if lang is not None:
                np.add.at(seen[:, names.index(lang)], table.features[words, 0], 1)
        model.know(names, seen)
    weight = np.where(y > 0, (y == 0).sum() / (y > 0).sum(), 1.0).astype(np.float32) ** 0.5
    order, adam = rng.permutation(len(docs)), Adam(0.004)
    for epoch in range(epochs):
        if epoch == epochs - 2:
            adam.rate /= 4
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            _learn(model, table, adam, [docs[k][rng.random(len(docs[k])) >= DROPPED] for k in own], y[own], weight[own])
    return model


def fit(texts: list[str], toxic: list[int], langs: list[str | None], **options: int) -> TextCnn:
    """Trains on all texts; thresholds come from models that did not see the text in question."""
    sample = Sample(texts, np.array(toxic, np.int64), langs)
    part, every = sample.part(), np.arange(len(texts))
    model = sample.learn(every, **options)
    if not sample.flat:
        z, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for k in range(sample.folds):
            z[part == k], lang[part == k] = sample.judged(sample.learn(every[part != k], **options), every[part == k])
        calibrate(model, z, lang, sample.toxic)
    return model


def _pack(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    distinct, words = np.unique(np.concatenate(docs), return_inverse=True)
    return distinct, words, n


def _learn(model: TextCnn, table: WordTable, adam: Adam, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
    """One step of logistic loss. Through the maxima, only their words get a gradient."""
    adam.t += 1
    distinct, words, n = _pack(docs)
    features = table.features[distinct]
    vectors = model.vectors(features)
    value, responses, padded = model.pooled(words + 1, vectors, n)
    hidden = np.maximum(value, 0)
    z = hidden @ model.out + model.out_bias
    dz = ((sigmoid(z) - y) * weight / len(y)).astype(np.float32)
    dh = dz[:, None] * model.out * (value > 0)
    pad = max(len(w) for w in model.filters)
    starts = np.cumsum(n) - n + pad * np.arange(len(n))
    dv, at = np.zeros_like(vectors), 0
    for i, (w, response) in enumerate(zip(model.filters, responses, strict=True)):
        f = w.shape[2]
        g = dh[:, at : at + f]
        at += f
        best = np.stack([s + response[s : s + k + pad - len(w) + 1].argmax(axis=0) for s, k in zip(starts, n, strict=True)])
        dw = np.zeros_like(w)
        for k in range(len(w)):
            word = padded[best + k]  # texts x filters
            dw[k] = np.einsum("tfd,tf->df", vectors[word], g)
            np.add.at(dv, word.ravel(), (g[:, :, None] * w[k].T[None]).reshape(-1, w.shape[1]))
        adam.step(f"w{i}", w, dw + 1e-5 * w)
        adam.step(f"b{i}", model.biases[i], g.sum(axis=0))
    out = np.r_[model.out, np.float32(model.out_bias)]
    adam.step("out", out, np.r_[hidden.T @ dz, dz.sum()].astype(np.float32))
    model.out, model.out_bias = out[:-1], float(out[-1])
    used = np.flatnonzero(np.abs(dv[1:]).sum(axis=1) > 0)
    slots, back = np.unique(features[used].ravel(), return_inverse=True)
    ge = np.zeros((len(slots), dv.shape[1]), np.float32)
    np.add.at(ge, back, np.repeat(dv[1:][used], FEATURES, axis=0))
    keep = slots > 0
    adam.step("e", model.embedding, ge[keep], slots[keep])


def calibrate(model: TextCnn, z: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> None:
    """Each language's threshold: the best F-measure that weighs precision twice, midway to the next text.

    Texts of other languages count too, with the weight OTHERS, so that a language with few texts
    follows the rest. n: texts that each row stands for, if not one; equal logits then aren't parted.
    """
    order = np.argsort(-z, kind="stable")
    value = z[order]
    last = np.ones(len(value), bool) if n is None else np.r_[value[1:] != value[:-1], True]
    for k in range(len(model.threshold)):
        w = np.where(lang[order] == k, 1.0, OTHERS)
        if n is not None:
            w = w * n[order]
        hits = np.cumsum(w * y[order])
        measure = np.where(last, 1.25 * hits / (np.cumsum(w) + 0.25 * hits[-1]), -1.0)
        at = int(measure.argmax())
        model.threshold[k] = (value[at] + value[at + 1]) / 2 if at + 1 < len(value) else value[at] - 1


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> TextCnn:
    """Fits on all labelled documents whose crc32(doc_id) mod 3 is not 1, whole texts.

    Rows of one id with different labels, and null ids, labels or texts, are left out. lang serves to learn which words a
    language has. A model is begun on per_class documents of each class at most, those lowest by hash of the id. Where that
    leaves some out, it only is a start: all rows are dealt to shards, a task of each goes on from there, and the
    shards' models are averaged by their numbers of rows (_on_all). Languages' words are counted, and thresholds set, on all rows.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_max"))
    marked = marked.where((F.col("toxic") == F.col("_max")) & (fold("doc_id", 3) != 1)).select("doc_id", "toxic")
    known = docs.select("doc_id").join(marked, "doc_id")
    chosen = lowest(known.distinct(), "toxic", "doc_id", per_class).select("doc_id", "toxic")
    rows = chosen.collect()  # 2 x per_class at most
    if not rows:
        return fit([], [], [])
    spark = docs.sparkSession
    keys = spark.createDataFrame([(r[0], r[1]) for r in rows], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _toxic int")
    picked = docs.select("doc_id", "lang", "text").join(F.broadcast(keys), "doc_id").where("text is not null")
    # of several texts of an id one, always the same
    picked = picked.groupBy("doc_id", "_toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "text")).alias("x"))
    got = picked.orderBy("doc_id").select("x.text", "_toxic", "x.lang", _part(3).alias("part")).collect()
    sample = Sample([r[0] for r in got], np.array([r[1] for r in got], np.int64), [r[2] for r in got])
    every, more = None, known.groupBy("doc_id", "toxic").agg(F.count("*").alias("n")).groupBy("toxic").agg(F.count("*").alias("ids"), F.sum("n").alias("n")).collect()
    if any(r["ids"] > per_class for r in more):
        every = docs.select("doc_id", "lang", "text").join(small(marked), "doc_id").where("text is not null")
        sample.languages = sorted(r[0] for r in every.where("lang is not null").select("lang").distinct().collect())
        if len(sample.texts) >= SMALL:
            sample.parts = np.array([r[3] for r in got], np.int64)
        else:  # six parts
            sample.parts = np.array([r[0] for r in picked.orderBy("doc_id").select(_part(sample.folds)).collect()], np.int64)
    if sample.flat:
        return sample.learn(np.arange(len(got)))
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = shared.value, shared.value.part()
        for batch in batches:
            for k in batch.column("id").to_pylist():
                model = own.learn(np.flatnonzero(part != k))
                result = pickle.dumps(model if k == own.folds or own.parts is not None else own.judged(model, np.flatnonzero(part == k)))
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([result], pa.binary())], ["k", "result"])

    # the model, and one for each part that is left out, each in a task of its own
    found = {r["k"]: pickle.loads(r["result"]) for r in spark.range(0, sample.folds + 1, 1, sample.folds + 1).mapInArrow(run, "k bigint, result binary").collect()}
    if every is not None:
        return _on_all(every, [found[k] for k in range(sample.folds + 1)], sample.languages, {r["toxic"]: r["n"] for r in more})
    model, part = found[sample.folds], sample.part()
    z, lang = np.zeros(len(part)), np.zeros(len(part), np.int64)
    for k in range(sample.folds):
        z[part == k], lang[part == k] = found[k]
    calibrate(model, z, lang, sample.toxic)
    return model


def _part(folds: int) -> F.Column:
    """A document's part in cross-fitting."""
    return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(folds)).cast("int")


def _on_all(rows: DataFrame, models: list[TextCnn], names: list[str], n: dict[int, int]) -> TextCnn:
    """The last of the models, learnt on from all rows (doc_id, lang, text, toxic), with its thresholds.

    The others each leave a part out, on which they are judged. n: rows of each class, about. A text goes to a shard by its id's hash, so
    models don't depend on how rows were parted. What leaves a shard is of fixed size, is summed by tasks, and only sums reach the driver.
    """
    folds, total = len(models) - 1, sum(n.values())
    dealt = rows.select(_part(folds).alias("part"), "toxic", "lang", "text", F.xxhash64("doc_id", F.lit(1)).alias("place"), F.xxhash64("text").alias("h"))
    count = -(-total // SHARD_ROWS)
    dealt = dealt.withColumn("shard", F.pmod("place", F.lit(count)).cast("int")).repartition(max(2, count), "shard").sortWithinPartitions("shard", "place", "h")
    rounds = min(SHARD_ROUNDS, -(-SEEN // total))
    written = dealt = saved(dealt, "toxicity-rows") if rounds > 1 else dealt
    for number in range(rounds):
        models = _round(dealt, models, names if not number else None, (n.get(0, 1) / max(1, n.get(1, 1))) ** 0.5, number, rounds > 1)
    if rounds > 1:
        dropped(written)
    model = models[-1]
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value, WordTable(len(shared.value[-1].embedding))
        for batch in batches:
            for rows_, texts in blocks(batch, "text", 256):
                ids, size = table.ids(texts)
                distinct, words = np.unique(ids, return_inverse=True)
                features, part = table.features[distinct], rows_.column("part").to_numpy()
                lang, of = own[-1].language(words, features, size), np.repeat(part, size)
                z = np.zeros(len(texts))
                for k in np.unique(part).tolist():
                    z[part == k] = own[k].logits(words[of == k] + 1, own[k].vectors(features), size[part == k])
                step = np.floor(np.clip(z, -100, 100) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(step), rows_.column("toxic")], ["lang", "step", "toxic"])

    judged = rows.select(_part(folds).alias("part"), F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(judge, "lang int, step int, toxic int")
    got = judged.groupBy("lang", "step", "toxic").count().orderBy("lang", "step", "toxic").toArrow()  # steps of languages at most, not rows
    lang, step, toxic, number = (got.column(c).to_numpy() for c in ("lang", "step", "toxic", "count"))
    calibrate(model, (step + 0.5) / STEPS, lang, toxic, number)
    return model


def _round(dealt: DataFrame, models: list[TextCnn], names: list[str] | None, weight: float, number: int, small_: bool) -> list[TextCnn]:
    """The models after each shard went on from them over its rows, averaged. names: also count the languages' words. small_: there are few rows."""
    shared = dealt.sparkSession.sparkContext.broadcast(models)
    steps, slots, index = 16 if small_ else 32, len(models[0].embedding), {x: i for i, x in enumerate(names or [])}
    schema = "k int, piece int, shard int, weight double, data binary"

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, table = None, WordTable(slots)
        own: list[TextCnn] = []

        def out() -> Iterator[pa.RecordBatch]:
            counts = [] if names is None else [(-1, 1.0, seen)]
            for k, w, flat in [*((k, float(m_rows[k]), m.flat()) for k, m in enumerate(own)), *counts]:
                for at in range(0, len(flat), PIECE):
                    values = [pa.array([k], pa.int32()), pa.array([at // PIECE], pa.int32()), pa.array([shard], pa.int32()), pa.array([w]), pa.array([flat[at : at + PIECE].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(values, ["k", "piece", "shard", "weight", "data"])

        for batch in batches:
            for rows, texts in blocks(batch, "text", 256):
                of, toxic, part, langs = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "toxic", "part", "lang"))
                ids, size = table.ids(texts)
                ends = np.cumsum(size)
                words = [ids[e - k : e] for e, k in zip(ends, size, strict=True)]
                for at in np.unique(of).tolist():
                    if at != shard:
                        if own:
                            yield from out()
                        shard, own = at, [pickle.loads(pickle.dumps(m)) for m in shared.value]
                        adams, m_rows = [Adam(SHARD_RATE) for _ in own], [0] * len(own)
                        rng, seen = np.random.default_rng([11, number, at]), np.zeros(slots * len(index))
                    here = np.flatnonzero(of == at)
                    for i in here.tolist() if names is not None else []:
                        if langs[i] is not None:
                            np.add.at(seen, table.features[words[i], 0] * len(index) + index[langs[i]], 1)
                    for k, model in enumerate(own):
                        some = here[part[here] != k]
                        m_rows[k] += len(some)
                        for b in range(0, len(some), steps):
                            step = some[b : b + steps]
                            y = toxic[step].astype(np.float32)
                            kept = [words[i][rng.random(len(words[i])) >= DROPPED] for i in step.tolist()]
                            _learn(model, table, adams[k], kept, y, np.where(y > 0, weight, 1.0).astype(np.float32))
        if own:
            yield from out()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, w = None, np.zeros(0), 0.0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([0], pa.int32()), pa.array([w]), pa.array([total.tobytes()], pa.binary())], ["k", "piece", "shard", "weight", "data"])

        for batch in batches:
            for k, piece, _, weight_, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, piece) != key:
                    if key is not None:
                        yield out()
                    key, total, w = (k, piece), 0.0, 0.0
                total, w = total + weight_ * np.frombuffer(data, np.float64 if k < 0 else np.float32).astype(np.float64), w + weight_
        if key is not None:
            yield out()

    pieces = dealt.mapInArrow(learnt, schema).repartition("k", "piece").sortWithinPartitions("k", "piece", "shard").mapInArrow(summed, schema)
    got: dict[int, list] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["k"], r["piece"])):  # as many as the models and the languages' words have pieces
        values = np.frombuffer(r["data"], np.float64)
        got.setdefault(r["k"], []).append(values if r["k"] < 0 else values / max(1.0, r["weight"]))
    out = [m.moved(np.concatenate(got[k])) for k, m in enumerate(models)]
    if index:
        out[-1].know(names, np.concatenate(got[-1]).reshape(slots, len(index)))
    return out


def toxicity(docs: DataFrame, model: TextCnn) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= CUT) of each whole text.

    Only the text is looked at; a null text counts as empty and gets the score of no word at all;
    equal texts get equal scores; columns of docs with the new names are replaced. One pass without
    a shuffle; the model's size is fixed but for a number for each slot and language.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tables: list[WordTable] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(WordTable(len(shared.value.embedding)))
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                score = np.round(shared.value.score(tables[0], texts)[0].astype(float), 5)  # batches differ in the last bits
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array((score >= CUT).astype(np.int32))], [*part.schema.names, "score", "predicted"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema + ", score double, predicted int")
