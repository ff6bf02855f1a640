"""The pipeline against plain Python on a small table."""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from textframes.llm import language_id, mixing, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(5)
    english, german = ["the", "and", "house", "water", "over", "think"], ["der", "und", "haus", "wasser", "über", "denken"]
    rows = []
    for k in range(60):
        lang = "en" if k % 2 else "de"
        rows.append((k, " ".join(r.choice(english if k % 2 else german) + str(r.randrange(40)) for _ in range(80)), lang, f"s{k % 3}", 1, "extra"))
    copy = rows[13][1]
    words = rows[11][1].split(" ")
    words[40] = "changed"
    rows += [(100, copy.upper(), "en", "s0", 1, "x"), (101, copy, "en", "s1", 1, "x"), (102, " ".join(words), "en", "s1", 1, "x"), (103, None, "en", None, None, None),
             (104, "12345", None, "s2", 1, "x"), (105, "Привет как дела сегодня вечером", None, "s2", 1, "x"), (101, copy, "en", "s1", 1, "x")]
    path = tmp_path_factory.mktemp("sf")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


def expected(spark, docs):
    model = language_id.train(docs)
    grams = language_id.GramTable(model.size)
    rows = docs.collect()
    tf, n = grams.vectors([x["text"] or "" for x in rows])
    far = model.predict(tf)[2] | (n == 0)
    rows = [x for x, f in zip(rows, far, strict=True) if not f]
    best: dict[str, object] = {}
    for x in rows:
        key = lower(x["text"])
        if key not in best or x["doc_id"] > best[key]["doc_id"]:
            best[key] = x
    rows = [*best.values()]
    sets = []
    for x in rows:
        w = WORD.findall(lower(x["text"]))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    label = [*range(len(rows))]

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    groups: dict[int, object] = {}
    for k, x in enumerate(rows):
        if root(k) not in groups or x["doc_id"] < groups[root(k)]["doc_id"]:
            groups[root(k)] = x
    return groups.values()


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {x["doc_id"]: x for x in expected(spark, docs)}
    assert 100 not in want and 101 in want and 102 not in want and not {103, 104, 105} & set(want)
    library = Tokenizer.from_file(queries.vocab_path())
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(want)
    for r in found:
        assert r["ids"] == library.encode(want[r["doc_id"]]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert (r["lang"], r["source"]) == (want[r["doc_id"]]["lang"], want[r["doc_id"]]["source"])


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))


def test_the_mix_reaches_the_end(spark, sf_dir, tmp_path):
    """Ordered by position, the encoded rows come in the order of the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id <> 101")
    want = [r["doc_id"] for r in mixing.mix(docs.drop("slot")).orderBy("slot", "place").collect()]
    corpus_pipeline.mix_sources(spark, docs, sf_dir).write.parquet(str(tmp_path / "mixed"))
    read = spark.read.option("maxPartitionBytes", 1000).parquet(str(tmp_path / "mixed"))
    coded = corpus_pipeline.encode_tokens(spark, read, sf_dir).orderBy("position").collect()
    assert [r["doc_id"] for r in coded] == want
    assert corpus_pipeline.encode_tokens(spark, spark.createDataFrame([(1, "a", None, None)], "doc_id int, text string, lang string, source string"), sf_dir).count() == 1


def test_near_copies_by_row(spark, sf_dir):
    """Rows that share an id are judged by their own texts."""
    words = [" ".join(f"w{k * 7 % 50 + s}" for k in range(40)) for s in (0, 100, 200)]
    rows = [(1, words[0]), (1, words[1]), (2, words[1] + " z"), (3, words[2]), (None, words[2]), (None, ""), (4, "")]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id int, text string"), sf_dir).collect()
    assert sorted(map(str, left)) == sorted(map(str, spark.createDataFrame([rows[k] for k in (0, 1, 3, 5, 6)], "doc_id int, text string").collect()))
