"""Operators 11 to 13 against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from textframes.llm import importance, phrases, quality, queries
from textframes.llm.words import WordCutter

DATA = "/root/testdata"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, rank string, key string, n string"
FOLD = {c: c + 32 for c in range(65, 91)}


def rows_of(texts, seed=0, langs=("en", "de", None, "und")):
    r = random.Random(seed)
    return [(i, t, r.choice(langs), None, None, "clash", "clash", "clash", "clash") for i, t in texts]


# ---------------------------------------------------------------- 11


def resampled(docs, target, order, buckets, seed, least, percent):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))

    def features(t):
        w = cut(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(x for _, text in docs for x in features(text)), Counter(x for text in target for x in features(text))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(cut(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted(map(repr, [tuple(r[:5]) for r in out]))


def corpus11(seed):
    r = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "é", "x1", "中文", "q", "z9"]
    text = lambda n: r.choice([" ", "-", "\n", "! "]).join(r.choice(words) for _ in range(n))
    docs = [(k, text(r.randint(0, 40))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "\x00 \t"), (None, text(30)), (None, text(25)), docs[5], docs[5], (103, text(4000)), (7, text(22))]
    return docs, [text(12) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("order, buckets, least, percent", [(1, 10_000, 20, 10), (2, 50, 5, 55), (3, 1000, 0, 100), (1, 7, 20, 0)])
def test_resampling_by_brute_force(spark, order, buckets, least, percent):
    docs, target = corpus11(order)
    df = spark.createDataFrame(rows_of(docs), DOCS).repartition(5)
    bench = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(target)], "item_id bigint, text string, bucket string")
    rows = importance.resample(df, bench, order, buckets, 2024, least, percent)
    assert rows.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(repr, [tuple(r) for r in rows.collect()])) == resampled(docs, target, order, buckets, 2024, least, percent)


def test_resampling_of_empty_tables(spark):
    docs, target = corpus11(1)
    df = spark.createDataFrame(rows_of(docs), DOCS)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert importance.resample(df.limit(0), bench).count() == 0
    rows = importance.resample(df, bench.limit(0)).collect()
    assert sorted(map(repr, [tuple(r) for r in rows])) == resampled(docs, [], 1, 10_000, 2024, 20, 10)


def test_ranks_go_over_partitions(spark):
    """Many partitions, many ties: ranks are those of one sort."""
    docs = [(k % 300, "w " * (20 + k % 2)) for k in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = importance.resample(spark.createDataFrame(rows_of(docs), DOCS), spark.createDataFrame([("v",)], "text string"), percent=60).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["rank"] for r in rows if r["rank"]) == [*range(1, 541)]
    assert sorted(map(repr, [tuple(r) for r in rows])) == resampled(docs, ["v"], 1, 10_000, 2024, 20, 60)


# ---------------------------------------------------------------- 12


def mined(docs, longest, least, share, top):
    """(lang, rank, phrase, a, l, r, n, score) by the definition."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= share * a for q, b in cands.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, rank, *r) for rank, r in enumerate(rows[:top], 1)]
    return sorted(out)


def corpus12(seed):
    r = random.Random(seed)
    words = ["a", "B", "c", "été", "new", "york", "city", "times", "中", "x-y"]
    out = []
    for k in range(80):
        w = [r.choice(words) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w) + 1) : 0] = ["New", "york", "city", "TIMES"][: r.randint(2, 4)]
        out.append((k, "".join(x + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? "]) for x in w), r.choice(["en", "de", None, "und"])))
    out += [(200, None, "en"), (201, "", "en"), (202, " . ,\n", "fr"), out[3], out[3], (None, "a a a a a a a a", None), (203, "b " * 600, "en"), (204, "city", "once")]
    return out


def in_docs(spark, docs):
    return spark.createDataFrame([(i, t, lang, None, None, "clash", "clash", "clash", "clash") for i, t, lang in docs], DOCS).repartition(4)


@pytest.mark.parametrize("longest, least, share, top", [(5, 4, 100, 2000), (5, 2, 60, 2000), (3, 3, 100, 7), (2, 5, 100, 2000), (6, 3, 90, 2000)])
def test_phrases_by_brute_force(spark, monkeypatch, longest, least, share, top):
    monkeypatch.setattr("textframes.llm.shared.BLOCK_CHARS", 700)  # many shards
    docs = corpus12(longest + least)
    rows = phrases.collocations(in_docs(spark, docs), longest, least, share, top).collect()
    want = mined(docs, longest, least, share, top)
    assert sorted(tuple(r) for r in rows) == want and len(want) > 5


def test_phrases_of_nothing(spark):
    docs = in_docs(spark, corpus12(1))
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0
    assert phrases.collocations(docs.where("text is null")).count() == 0


def test_scores_beyond_64_bits(spark):
    """1000 a n and l r of counts near those of a large corpus."""
    big = 3 * 10**14
    df = spark.createDataFrame([(big, 9 * big, 2 * big, 4 * big)], "a bigint, n bigint, l bigint, r bigint")
    got = df.select(phrases._score(df.a, df.n, df.l, df.r).alias("s")).head()["s"]
    assert got == 1000 * big * 9 * big // (2 * big * 4 * big)


def test_states_of_a_shard():
    """States, links and counts of end places against all substrings."""
    r = np.random.default_rng(2)
    words = r.integers(1, 4, 60).astype(np.uint64)
    breaks = np.zeros(60, bool)
    breaks[[0, 17, 18, 40]] = True
    start = np.maximum.accumulate(np.where(breaks, np.arange(60), 0))
    room, marks = np.arange(60) - start + 1, r.integers(0, 99, 60)
    states = phrases.SuffixStates(words, room, marks, 1, 5)
    places = defaultdict(list)
    for e in range(60):
        for k in range(1, min(5, room[e]) + 1):
            places[tuple(words[e - k + 1 : e + 1].tolist())].append(e)
    key, n, mark = states.substrings()
    assert sorted(n.tolist()) == sorted(map(len, places.values())) and len(set(key.tolist())) == len(places)
    assert Counter(zip(n.tolist(), mark.tolist(), strict=True)) == Counter((len(p), int(marks[p].min())) for p in places.values())
    whole = lambda s: tuple(words[states.end[s] - states.last[s] + 1 : states.end[s] + 1].tolist())
    for s in range(len(states.first)):
        p = whole(s)
        shortest = p[len(p) - states.first[s] :]
        assert places[p] == places[shortest]  # all of a state end at the same places
        assert states.count[s] == len(places[p])
        if states.link[s] >= 0:
            assert whole(states.link[s]) == shortest[1:] and len(places[shortest[1:]]) > len(places[p])
        else:
            assert states.first[s] == 1


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    for name in ("op11_importance_resampling", "op12_phrase_mining"):
        ours = queries.queries()[name](spark, f"{DATA}/sf0.01")
        theirs = con.sql(queries.oracle_sql()[name])
        columns = sorted(ours.columns)
        assert sorted(map(repr, [tuple(r[c] for c in columns) for r in ours.collect()])) == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())), name
        assert sorted(theirs.columns) == columns


# ---------------------------------------------------------------- 13


def described(text: str) -> dict[str, float]:
    """Some of the statistics, one by one."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    n = max(1, len(words))
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b > 127
    symbol = lambda b: 32 < b < 127 and not letter(b) and not 48 <= b <= 57 and chr(b) not in ".!?,;:'\"()-/"
    last: dict[bytes, int] = {}
    gaps = []
    for k, w in enumerate(words):
        gaps.append(k - last[w] if w in last else 0)
        last[w] = k
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    return {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / n,
        "longest_word": math.log1p(max(map(len, words), default=0)), "upper_share": sum(65 <= b <= 90 for b in data) / max(1, len(data)),
        "symbol_ends": sum(symbol(w[-1]) for w in words) / n, "symbol_words": sum(any(map(symbol, w)) for w in words) / n,
        "wordless": sum(not any(map(letter, w)) for w in words) / n, "distinct": len(set(words)) / n, "same_as_last": gaps.count(1) / n,
        "soon_again": sum(0 < g <= 32 for g in gaps) / n, "commonest": max(Counter(words).values(), default=0) / n,
        "upper_words": sum(len(re.findall(rb"[A-Z]", w)) > 1 and len(re.findall(rb"[A-Z]", w)) == sum(map(letter, w)) for w in words) / n,
        "runs_again": (len(runs) - len(set(runs))) / max(1, len(runs)),
        "words_a_line": len(words) / (1 + sum(10 <= b <= 13 for b in data)),
    }


def odd_texts(seed=4):
    r = random.Random(seed)
    words = ["one", "Two", "THREE", "fo#ur", "été!", "x", "99", "|", "(a)", "ß"]
    texts = [None, "", " \n\t", "x", "x", "ABC DEF", "a" * 5000, "\x00\x01"]
    return texts + [r.choice([" ", "\n", "  "]).join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(40)] + ["same words here " * 3000]


def test_statistics_by_brute_force():
    texts = odd_texts()
    rows = quality.statistics(pa.array(texts, pa.string()), WordCutter(fold=False))
    assert rows.shape == (len(texts), len(quality.STATISTICS)) and np.isfinite(rows).all() and (rows[:2] == 0).all()
    for text, row in zip(texts, rows, strict=True):
        for name, value in described(text).items():
            assert abs(row[quality.STATISTICS.index(name)] - value) < 1e-9, (name, (text or "")[:60])
        alone = quality.statistics(pa.array([text], pa.string()), WordCutter(fold=False))[0]
        assert np.allclose(alone, row)


def test_trees_are_walked_as_they_are_written():
    r = np.random.default_rng(6)
    rows = r.normal(size=(400, 6))
    good = ((rows[:, 0] > 0.2) ^ (rows[:, 3] > 0)).astype(float)
    model = quality.boost(rows, good, np.ones(400), trees=25, depth=3)

    def walk(row):
        z = model.base
        for f, above, leaf in zip(model.feature, model.above, model.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > above[at])
            z += leaf[at - len(f)]
        return z

    new = r.normal(size=(50, 6))
    assert np.allclose(model.logits(new), [walk(x) for x in new])
    held = r.normal(size=(400, 6))
    assert ((model.scores(held) >= 0.5) == ((held[:, 0] > 0.2) ^ (held[:, 3] > 0))).mean() > 0.93


def test_first_split_is_the_best_one():
    """One tree of depth one against every possible cut."""
    r = np.random.default_rng(7)
    rows = np.round(r.normal(size=(60, 3)), 1)
    good, weight = r.integers(0, 2, 60).astype(float), r.uniform(0.5, 2, 60)
    model = quality.boost(rows, good, weight, trees=1, depth=1, ridge=1.0, least=2.0)
    p = (weight * good).sum() / weight.sum()
    g, h = weight * (p - good), weight * p * (1 - p)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max((gain(rows[:, k] <= c) for k in range(3) for c in np.unique(rows[:, k])[:-1] if min(h[rows[:, k] <= c].sum(), h[rows[:, k] > c].sum()) >= 2), default=0)
    own = rows[:, model.feature[0, 0]] <= model.above[0, 0]
    assert np.isclose(gain(own), best)
    assert np.allclose(model.leaf[0], [-0.1 * g[own].sum() / (h[own].sum() + 1), -0.1 * g[~own].sum() / (h[~own].sum() + 1)])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_held_out(spark, sf):
    scored = queries.op13_quality_classifier(spark, f"{DATA}/{sf}").toPandas()
    labels = spark.read.parquet(f"{DATA}/{sf}/labels.parquet").toPandas()
    assert (scored["held_out"] == scored["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert scored["score"].between(0, 1).all() and ((scored["score"] >= 0.5) == (scored["predicted"] == 1)).all()
    both = scored.merge(labels, on="doc_id")
    held = both[both["held_out"] & both["quality"].isin([0, 1])]
    assert (held["predicted"] == held["quality"]).mean() > 0.98
    assert (held[held["quality"] == 1]["predicted"] == 1).mean() > 0.99  # clean ones are left alone
    # the query's scores, one text at a time
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DATA}/{sf}/labels.parquet"))
    some = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 17 = 3").collect()}
    score = scored.set_index("doc_id")["score"]
    for i, text in some.items():
        row = quality.statistics(pa.array([text], pa.string()), WordCutter(fold=False))
        assert abs(float(model.scores(row)[0]) - score[i]) < 2e-6


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, "en", None, None, "clash", None, None, None) for k, t in enumerate(odd_texts())] + [(None, "x", None, None, None, None, None, None, None)], DOCS + "")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(3, 0, 0), (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.quality(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows) and "text" not in rows[0]
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, None)}) == 1  # equal texts
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1  # null is empty
    assert quality.quality(docs.limit(0), model).count() == 0
    for none in (quality.train(docs, labels.limit(0)), quality.train(docs.limit(0), labels), quality.train(docs, labels.where("quality = 1"))):
        assert len(none.feature) == 0 and len({r["score"] for r in quality.quality(docs, none).collect()}) == 1
