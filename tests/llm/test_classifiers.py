from __future__ import annotations

import random
import re
import string
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from textframes.llm import language_id, queries, toxicity

DATA = "/root/testdata/sf0.1"
ODD = [(1, None, "en", "s", None), (2, "", None, None, None), (3, "12345 !!", "en", "s", 1), (4, "the and " * 40_000, "en", "s", 1), (5, "x", "en", "s", 1), (5, "x", "en", "s", 1), (None, "und der die das", "de", None, 1)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_language_held_out(spark):
    out = queries.op4_language_id(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(docs, on="doc_id")
    assert len(out) == len(docs)
    assert (both["held_out"] == both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = both[both["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.99
    assert out["score"].between(0, 1).all() and out["rejected"].mean() < 0.001


def test_language_by_brute_force():
    """Cosines from n-grams that are counted one by one, and rejection from the floors."""
    from textframes.llm.shared import mix

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text", "lang"]).to_pylist()
    docs = [r for r in docs if r["text"] and r["lang"]]
    model = language_id.fit([r["text"] for r in docs], [r["lang"] for r in docs], size=512)
    table = language_id.GramTable(model.size)
    texts = [r["text"] for r in docs[::9]] + ["½ ② Ⅷ", "x", "a½b ½", "die und der"]
    best, value, far = model.predict(table.vectors(texts)[0])
    for k, text in enumerate(texts):
        tf = np.zeros(model.size)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            word = "".join(c for c in word if c.isalpha())
            code = [10, *map(ord, word), 10]
            grams = [c for c in code[1:-1]]
            grams += [a * 0x110000 + b + (1 << 62) for a, b in zip(code, code[1:], strict=False)] if word else []
            grams += [((a * 0x110000 + b) * 0x110000 + c + (1 << 63)) % (1 << 64) for a, b, c in zip(code, code[1:], code[2:], strict=False)]
            for g in grams:
                tf[int(mix(np.array([g], np.uint64))[0] % np.uint64(model.size))] += 1
        v = np.log1p(tf) * model.idf
        cosine = model.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        assert np.isclose(cosine.max(), value[k], atol=1e-5)
        assert cosine[best[k]] > cosine.max() - 1e-5
    assert table.vectors(["½ ② Ⅷ", "½a"])[1].tolist() == [0, 1]


def test_floors_lie_between_random_letters_and_unseen_texts():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    docs = [r for r in docs if r["text"] and r["lang"]]
    seen, unseen = docs[::2], docs[1::2]
    model = language_id.fit([r["text"] for r in seen], [r["lang"] for r in seen])
    assert len(model.floor) == len(language_id.LENGTHS) and (np.diff(model.marks) > 0).all() and (model.floor > 0).all()
    table = language_id.GramTable(model.size)
    far = model.predict(table.vectors([r["text"] for r in unseen])[0])[2]
    assert far.mean() < 0.005  # of texts that took no part
    rng = np.random.default_rng(5)
    words = [w for r in seen for w in re.findall(r"[^\W\d_]+", r["text"].lower())]
    for n in (16, 100, 400):
        texts = language_id.random_texts(words, n, 200, rng)
        assert {len(t.split()) for t in texts} == {n}
        assert model.predict(table.vectors(texts)[0])[2].mean() > 0.98


def test_real_sentences_stay_and_foreign_ones_go(spark):
    """Plain sentences of the learnt languages, whose words the corpus doesn't have, and the pipeline's first stage; other scripts and noise."""
    import corpus_pipeline

    sentences = {
        "en": ["The weather was very nice yesterday, so we walked along the river and had lunch in the garden of an old house.", "She would like to know when the next train leaves and whether there is still a seat near the window."],
        "de": ["Am Wochenende fahren wir mit den Kindern an den See, denn dort kann man schwimmen und in der Sonne liegen.", "Ich habe gestern ein Buch gelesen, das mir meine Schwester vor einem Jahr zum Geburtstag geschenkt hatte."],
        "fr": ["Ça va très bien mon ami merci beaucoup", "Nous avons mangé dans un petit restaurant près de la gare, puis nous sommes rentrés à la maison sous la pluie."],
        "es": ["Los niños juegan en el parque mientras sus padres hablan de las vacaciones y toman un café en la terraza.", "Ayer por la tarde visitamos el museo de la ciudad y después cenamos con unos amigos en una casa antigua."],
    }
    foreign = ["Привет, как дела сегодня? Мы идём домой.", "今天天气很好，我们去公园散步。", "Καλημέρα σας, τι κάνετε σήμερα;", "xq zvw kkj wqx zzq jvk qqw xkz vjq wzx kqz jxw zqk vwx qjz kxv wqj zxk jqv xwz"]
    rows = [(10**9 + k, t, None, "new", len(t)) for k, t in enumerate([s for v in sentences.values() for s in v] + foreign)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").select(docs.columns))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, both, "/root/testdata/sf0.01").select("doc_id").collect()}
    assert {r[0] for r in rows} & kept == {r[0] for r in rows[:8]}
    assert docs.count() - len(kept - {r[0] for r in rows}) <= 2
    model = language_id.train(docs)
    found = language_id.identify(spark.createDataFrame(rows[:8], "doc_id bigint, text string, lang string, source string, n_chars bigint"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found] == [lang for lang, v in sentences.items() for _ in v]


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in ODD], SCHEMA + ", score string, lang_pred string")
    model = language_id.fit(["the and of is to " * 5, "der die das und ist " * 5] * 3, ["en", "de"] * 3, clusters=2)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == len(ODD) and set(rows[0].asDict()) == {*docs.columns, "rejected"}
    by = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3):
        assert by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0
    assert by[4]["lang_pred"] == "en" and by[None]["lang_pred"] == "de"
    assert language_id.identify(docs.limit(0), model).count() == 0
    far = spark.createDataFrame([(9, "Привет, как дела сегодня?", None, None, None)], SCHEMA)
    assert language_id.identify(far, model).head()["rejected"]
    nothing = language_id.identify(docs, language_id.fit([], [])).collect()
    assert all(r["lang_pred"] == "und" for r in nothing)


def test_rejection_at_any_length():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    docs = [r for r in docs if r["text"] and r["lang"]]
    model = language_id.fit([r["text"] for r in docs], [r["lang"] for r in docs])
    table, rng = language_id.GramTable(model.size), random.Random(3)
    words = [w for r in docs for w in r["text"].split()]
    for n in (5, 20, 60, 200, 600, 2000, 5000):
        own = [" ".join(words[k : k + n]) for k in rng.sample(range(len(words) - n), 20)]
        foreign = [t.lower().translate({c: first + c % 26 for c in range(97, 123)}) for t in own for first in (0x3B1, 0x430, 0x5D0, 0x905)]
        foreign = [re.sub(r"[a-zà-ÿ]", "", t) for t in foreign]
        if n >= 20:
            foreign += [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(n)) for _ in range(20)]
        assert model.predict(table.vectors(foreign)[0])[2].all()
        assert not model.predict(table.vectors(own)[0])[2].any()


def test_grams_by_brute_force():
    table = language_id.GramTable(1 << 12)
    words = ["ab", "é", "straße", "abab"]
    tf, n = table.vectors([" ".join(words), "", "ab ab"])
    assert n.tolist() == [4, 0, 2] and tf[1].sum() == 0
    # letters, pairs with borders, triples with borders
    assert tf[0].sum() == sum(len(w) + len(w) + 1 + len(w) for w in words)
    assert (tf[2] == 2 * table.vectors(["ab"])[0][0]).all()


def test_training_uses_other_folds_only(spark):
    docs = spark.createDataFrame([(i, f"wort{i % 7} und", "de" if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i in range(60)], "doc_id bigint, text string, lang string")
    assert set(language_id.train(docs).languages) == {"de"}


def test_training_learns_every_language(spark):
    docs = spark.createDataFrame([(i // 2, f"wort{i} und", f"l{i % 230}") for i in range(690)], "doc_id bigint, text string, lang string")
    model = language_id.train(docs, hold_out=False)
    assert set(model.languages) == {f"l{i}" for i in range(230)}


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op2_toxicity(spark, DATA).toPandas()


def test_toxicity_held_out(spark, scored):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    both = scored.merge(labels, on="doc_id")
    assert (both["held_out"] == both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = both[both["held_out"] & both["toxic"].isin([0, 1])]
    hit = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert hit / (held["predicted"] == 1).sum() > 0.9
    assert hit / (held["toxic"] == 1).sum() > 0.8
    assert ((scored["score"] >= 0.7) == (scored["predicted"] == 1)).all() and scored["score"].between(0, 1).all()


def test_toxicity_with_few_labels(spark):
    """33 toxic texts to learn from; the same model again, and the query's scores by a forward pass word by word."""
    few = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{few}/documents.parquet"), spark.read.parquet(f"{few}/labels.parquet")
    scored = queries.op2_toxicity(spark, few).toPandas()
    both = scored.merge(labels.toPandas(), on="doc_id")
    held = both[both["held_out"] & both["toxic"].isin([0, 1])]
    hit = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert hit / (held["predicted"] == 1).sum() > 0.8
    assert hit / (held["toxic"] == 1).sum() > 0.6
    model = toxicity.train(docs.repartition(3), labels.repartition(5))  # tasks in another order
    score, table = scored.set_index("doc_id")["score"], toxicity.WordTable(len(model.embedding))
    for row in docs.where("doc_id % 97 = 5").collect():
        ids, _ = table.ids([row["text"] or ""])
        words = [model.embedding[table.features[i]].sum(axis=0) for i in ids]
        profile = sum((model.profile[table.features[i][0]].astype(float) for i in ids), np.zeros(len(model.languages)))
        z, at, pad = model.out_bias, 0, max(len(x) for x in model.filters)
        for w, b in zip(model.filters, model.biases, strict=True):
            padded = np.array(words + [np.zeros(w.shape[1])] * pad)
            places = range(max(1, len(words) + pad - len(w) + 1))
            response = np.array([sum(padded[p + j] @ w[j] for j in range(len(w))) for p in places]).max(axis=0) + b
            z += np.maximum(0, response) @ model.out[at : at + w.shape[2]]
            at += w.shape[2]
        expected = 1 / (1 + np.exp(-(z - model.threshold[int(profile.argmax())] + np.log(0.7 / 0.3))))
        assert abs(score[row["doc_id"]] - expected) < 2e-4


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ODD], SCHEMA + ", score string")
    model = toxicity.fit(["you idiot", "fine day", "idiot there", "good day"] * 10, [1, 0, 1, 0] * 10, ["en", None] * 20, epochs=3)
    rows = toxicity.toxicity(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] == "x"}) == 1
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
    none = toxicity.toxicity(docs, toxicity.fit([], [], [])).collect()
    assert {r["predicted"] for r in none} == {0}
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.train(docs, labels).languages == []


def test_scores_by_brute_force():
    """The network's score word by word, filter by filter."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["you", "idiot", "fine", "day", "good", "there", "été"]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    model = toxicity.fit(texts, [int("idiot" in t) for t in texts], ["en", "fr"] * 30, epochs=3)
    table = toxicity.WordTable(len(model.embedding))
    score, lang = model.score(table, [*texts, "", "new words"])
    for k, text in enumerate([*texts, "", "new words"]):
        ids, _ = table.ids([text])
        words = [model.embedding[table.features[i]].sum(axis=0) for i in ids]
        z = model.out_bias
        at = 0
        for w, b in zip(model.filters, model.biases, strict=True):
            padded = words + [np.zeros(w.shape[1])] * max(len(x) for x in model.filters)
            places = range(max(1, len(words) + max(len(x) for x in model.filters) - len(w) + 1))
            for f in range(w.shape[2]):
                z += max(0.0, max(sum(padded[p + j] @ w[j, :, f] for j in range(len(w))) for p in places) + b[f]) * model.out[at + f]
            at += w.shape[2]
        t = model.threshold[lang[k]]
        assert abs(score[k] - 1 / (1 + np.exp(-(z - t + np.log(0.7 / 0.3))))) < 1e-4


def test_thresholds_by_brute_force():
    r = np.random.default_rng(8)
    z, lang, y = r.normal(size=80), r.integers(0, 2, 80), r.integers(0, 2, 80)
    model = toxicity.TextCnn.start(50, 3, 2, (1, 2), r)
    model.threshold = np.zeros(2)
    toxicity.calibrate(model, z, lang, y)
    for k in range(2):
        w = np.where(lang == k, 1.0, toxicity.OTHERS)
        measure = lambda t: 1.25 * (w * y)[z >= t].sum() / (w[z >= t].sum() + 0.25 * (w * y).sum())  # noqa: B023,E731
        assert np.isclose(measure(model.threshold[k]), max(map(measure, z)))


def test_gradient_of_the_network():
    """The step's direction against finite differences of the loss."""
    rng = np.random.default_rng(0)
    model = toxicity.TextCnn.start(50, 3, 2, (1, 2, 3), rng)
    model.embedding = model.embedding.astype(np.float64) * 5
    model.filters = [w.astype(np.float64) for w in model.filters]
    model.out = model.out.astype(np.float64)
    table = toxicity.WordTable(50)
    ids, n = table.ids(["a b c d", "b c", "d"])
    docs = np.split(ids, np.cumsum(n)[:-1])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        distinct, own, n = toxicity._pack(docs)
        z = model.logits(own + 1, model.vectors(table.features[distinct]), n)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    seen = {}

    class Keep(toxicity.Adam):
        def step(self, name, value, grad, rows=None):
            seen[name] = (grad.copy(), rows)

    toxicity._learn(model, table, Keep(0.0), docs, y, np.ones(3))
    for k in range(3):
        grad, w, e = seen[f"w{k}"][0] - 1e-5 * model.filters[k], model.filters[k], 1e-5
        for at in np.ndindex(*w.shape):
            w[at] += e
            up = loss()
            w[at] -= 2 * e
            down = loss()
            w[at] += e
            assert abs((up - down) / (2 * e) - grad[at]) < 1e-3
    grad, slots = seen["e"]
    for row, slot in enumerate(slots[:6].tolist()):
        model.embedding[slot, 0] += 1e-5
        up = loss()
        model.embedding[slot, 0] -= 2e-5
        down = loss()
        model.embedding[slot, 0] += 1e-5
        assert abs((up - down) / 2e-5 - grad[row, 0]) < 1e-3


def test_toxicity_learns_from_all_rows(spark):
    """Toxic words are many and each in few texts: a sample of them can't tell the others."""
    rng, rows = random.Random(5), []
    bad = [f"{a}{b}rk" for a in ("zu", "vo", "qi", "xe", "ju", "wy") for b in ("bal", "dem", "fin", "gop", "hus", "kyl", "lam", "nep", "rit", "sov")]
    plain = [a + b + c for a in "bdfglm" for b in "aeiou" for c in ("n", "s", "t", "ma")]
    for i in range(3000):
        words = rng.choices(plain, k=12)
        if i % 3 == 0:
            words[rng.randrange(12)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(3000)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels, per_class=40)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    score, _ = model.score(toxicity.WordTable(len(model.embedding)), [r[1] for r in held])
    toxic = np.array([r[0] % 3 == 0 for r in held])
    assert (score[toxic] >= toxicity.CUT).mean() > 0.8 and (score[~toxic] >= toxicity.CUT).mean() < 0.1
    again = toxicity.train(docs.repartition(7), labels, per_class=40)
    assert np.allclose(again.score(toxicity.WordTable(len(model.embedding)), [r[1] for r in held])[0], score, atol=1e-4)
