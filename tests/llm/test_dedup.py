from __future__ import annotations

import hashlib
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from textframes.llm import exact_dedup, jaccard_join, queries, substring_dedup
from textframes.llm.components import components
from textframes.llm.shared import BitFilter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def corpus(seed: int) -> list[tuple]:
    """Families of near copies, exact copies, passages in common, nulls, short, empty and long texts."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["É", "Ü", "A", "b"]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    out: list[str | None] = [None, "", " \n", "one", "One", "a b", "a b", "x y z", "x y z", "É é", "é é"]
    passage = text(50)
    for n in (9, 12, 30, 120, 400):
        base = text(n)
        for _ in range(12):
            own = base.copy()
            for _ in range(r.randint(0, max(1, n // 25))):
                own[r.randrange(n)] = r.choice(vocab)
            out.append(r.choice([" ", "\t", "  "]).join(own))
        out.append(" ".join(base).upper())
        out.append(" ".join(base[: n // 2] + passage + base[n // 2 :]))
    out += [" ".join(text(20) + passage) for _ in range(4)] + [" ".join(passage + passage), " ".join(text(6000))]
    rows = [(k * 3 % 1009, t, None, r.choice(["s", None]), None) for k, t in enumerate(out)]
    return rows + [rows[20], (None, "nobody knows this", None, None, None), (None, rows[25][1], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "clash", "clash") for r in corpus(1)]
    return spark.createDataFrame(rows, SCHEMA + ", n string, data string").repartition(3)


def test_exact_groups_by_brute_force(docs):
    groups: dict[str, list] = {}
    for doc_id, text, *_ in corpus(1):
        groups.setdefault(lower(text), []).append(doc_id)
    want = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        want += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    rows = exact_dedup.exact_groups(docs, bits=6, bucket_bytes=500).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], key=key) == sorted(want, key=key)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_directory_splits_until_buckets_fit():
    load = np.zeros(256, np.int64)
    load[:4] = 100
    load[200] = 5000
    d = exact_dedup.Directory.build(load, 150)
    assert d.depth == 8 and len(d.bucket) == 256
    for b in set(d.bucket.tolist()):
        at = np.flatnonzero(d.bucket == b)
        assert len(at) & (len(at) - 1) == 0 and (np.diff(at) == 1).all()
        assert load[at].sum() <= 150 or len(at) == 1
    assert exact_dedup.Directory.build(load, 10**9).depth == 0
    assert [b for k, b in enumerate(d.bucket.tolist()) if k == 0 or b != d.bucket[k - 1]] == [*range(d.bucket.max() + 1)]
    even = np.full(256, 10)
    d2 = exact_dedup.Directory.build(even, 40)
    owners = d2.owners(even, 4)
    assert (np.diff(owners) >= 0).all() and np.bincount(owners[d2.bucket]).tolist() == [16] * 4
    assert exact_dedup.Directory.build(np.zeros(8, int), 5).owners(np.zeros(8, int), 3).tolist() == [0]
    hashes = np.array([0, 200 << 56, (1 << 64) - 1], np.uint64)
    assert d.lookup(hashes).tolist() == [d.bucket[0], d.bucket[200], d.bucket[255]]


def test_chain_tells_texts_of_one_hash_apart():
    chain = exact_dedup.Chain()
    chain.add(1, 10, b"a", 5, 2)
    chain.add(2, 11, b"b", 9, 1)
    chain.add(3, 12, b"a", 7, 1)
    chain.add(4, 12, None, None, 3)
    assert chain.rows() == [(10, 7, 3, 6), (11, 9, 2, 1), (12, 7, 3, 6)]


def brute_components(rows, width, t):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    ids = [r[0] for r in rows]
    label = {i: i for i in ids if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if None not in (ids[a], ids[b]) and both and both >= t * either:
                x, y = root(ids[a]), root(ids[b])
                label[max(x, y)] = min(x, y)
    out = []
    for i, s in zip(ids, sets, strict=True):
        if i is not None:
            out.append((i, len(s), root(i)))
        else:
            same = [root(j) for j, o in zip(ids, sets, strict=True) if j is not None and o == s and s]
            out.append((None, len(s), min(same) if same else None))
    return sorted(map(str, out))


@pytest.mark.parametrize(("width", "t", "chunk"), [(3, Fraction(9, 10), 256), (5, Fraction(4, 5), 256), (5, Fraction(4, 5), 3), (3, Fraction(1, 2), 5)])
def test_similar_groups_by_brute_force(docs, width, t, chunk, monkeypatch):
    if chunk < 256:  # crowds that are parted, chunks of clusters, guests
        monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(jaccard_join, "RUN_ROWS", chunk + 1)
        monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    rows = jaccard_join.similar_groups(docs, width, t).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in rows) == brute_components(corpus(1), width, t)


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_linked_sets_have_a_block_in_common(t):
    """Sets that differ as much as linked sets can share a key, for any seed; so do those of neighbouring bands."""
    r = np.random.default_rng(3)
    for seed in range(3):
        for n in [1, 2, 3, 9, 10, 11, 40, 100, 333, 1000]:
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            for m in {n, n + 1, int(n / t)}:
                for _ in range(8):
                    # as few in common as a link allows: i >= t (n + m - i)
                    i = min(n, m, math.ceil(t * (n + m) / (1 + t)))
                    b = np.r_[r.permutation(a)[:i], r.integers(0, 1 << 63, m - i).astype(np.uint64)]
                    if i < t * (n + m - i):
                        continue
                    keys = [set(jaccard_join.block_keys(x, np.array([len(x)]), t, seed)[0].tolist()) for x in (a, b)]
                    assert keys[0] & keys[1], (n, m, i)
    both = [r.integers(0, 1 << 63, n).astype(np.uint64) for n in (7, 90, 1, 30)]
    key, owner = jaccard_join.block_keys(np.concatenate(both), np.array([7, 90, 1, 30]), t, 5)
    for k, x in enumerate(both):
        assert sorted(key[owner == k].tolist()) == sorted(jaccard_join.block_keys(x, np.array([len(x)]), t, 5)[0].tolist())


def templates(n: int, seed: int) -> list[str]:
    """Ten of sixty sentences each: every sentence is common, and no two texts link."""
    r = random.Random(seed)
    sentences = [" ".join(f"w{r.randrange(5000)}" for _ in range(11)) for _ in range(60)]
    return [" ".join(sentences[k] for k in r.sample(range(60), 10)) for _ in range(n)]


def boilerplate(n: int, seed: int) -> list[str]:
    """Two thirds of each text are the same in all, the rest comes from a pool."""
    r = random.Random(seed)
    same = " ".join(f"b{r.randrange(5000)}" for _ in range(90))
    pool = [" ".join(f"p{r.randrange(5000)}" for _ in range(4)) for _ in range(40)]
    return [same + " " + " ".join(pool[k] for k in r.sample(range(40), 10)) for _ in range(n)]


@pytest.mark.parametrize("make", [templates, boilerplate])
def test_common_keys_are_parted(spark, monkeypatch, make):
    """Crowds with a common key in which nothing links: hardly a set is left to be searched, none visits other chunks; a planted pair is found."""
    monkeypatch.setattr(jaccard_join, "RUN_ROWS", 64)
    texts = make(1500, 4)
    texts += [texts[10] + " extra", texts[20].replace(texts[20].split()[5], "changed", 1)]
    left: list[int] = []

    def counted(placed, threshold, links=jaccard_join._links):
        left.append(placed.count())
        return links(placed, threshold)

    monkeypatch.setattr(jaccard_join, "_links", counted)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").repartition(4)
    rows = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(df).collect()}
    assert {k: v for k, v in rows.items() if k != v} == {1500: 10, 1501: 20}
    assert left[0] <= 40


def test_families_of_near_copies_stay_whole(spark, monkeypatch):
    """A crowd of near copies, which no key parts, is one cluster and one component."""
    monkeypatch.setattr(jaccard_join, "RUN_ROWS", 32)
    r = random.Random(6)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    texts = []
    for _ in range(300):
        own = base.copy()
        own[r.randrange(120)] = f"z{r.randrange(200)}"
        texts.append(" ".join(own))
    texts += templates(50, 7)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").repartition(4)
    rows = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(df).collect()}
    assert {rows[k] for k in range(300)} == {0} and all(rows[k] == k for k in range(300, 350))


def test_rows_of_one_id_with_different_texts(spark):
    """Links of every text count, also of texts that share an id."""
    r = random.Random(8)
    a, b = (" ".join(r.choice("abcdefghij") + str(r.randrange(90)) for _ in range(120)) for _ in range(2))
    rows = [(1, a), (1, b), (2, b + " z"), (3, a + " y"), (5, b + " z"), (7, "alone in here")]
    for order in (rows, rows[::-1]):
        found = jaccard_join.similar_groups(spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)).collect()
        assert sorted((x["doc_id"], x["component_id"]) for x in found) == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (7, 7)]


def test_ids_of_other_types(spark):
    rows = [(1, "a b c d"), (2, "A b c d"), (3, "x")]
    for kind in ("smallint", "string", "decimal(10,0)"):
        df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
        found = sorted((str(x["doc_id"]), str(x["component_id"])) for x in jaccard_join.similar_groups(df).collect())
        assert found == [("1", "1"), ("2", "1"), ("3", "3")]
        kept = sorted((str(x["doc_id"]), str(x["keep_id"])) for x in exact_dedup.exact_groups(df, bits=4).collect())
        assert kept == [("1", "2"), ("2", "2"), ("3", "3")]


def test_words_and_shingles_by_brute_force(monkeypatch):
    import pyarrow as pa

    from textframes.llm import words

    monkeypatch.setattr(words, "PIECE", 40)
    r = random.Random(4)
    texts = [None, "", " a", "a b", "x" * 300 + " y"] + ["".join(r.choice("abAB \t\né日ü😀\x0b\x0c\x1c") for _ in range(r.randint(0, 60))) for _ in range(500)]
    column = pa.array(["zz", *texts]).slice(1)
    for fold in (True, False):
        cut = [WORD.findall(lower(t) if fold else t or "") for t in texts]
        hashes, n = words.WordCutter(fold).hashes(column)
        assert n.tolist() == [*map(len, cut)]
        names: dict[str, int] = {}
        for w, h in zip([w for ws in cut for w in ws], hashes.tolist(), strict=True):
            assert names.setdefault(w, h) == h
        assert len({*names.values()}) == len(names)
    value, owner, n = jaccard_join.Shingles(3).sets(column)
    sets = [{tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for w in ([WORD.findall(lower(t)) for t in texts])]
    assert n.tolist() == [*map(len, sets)] and owner.tolist() == np.repeat(np.arange(len(sets)), n).tolist()
    own = np.split(value, np.cumsum(n)[:-1])
    for a in range(0, len(sets), 7):
        for b in range(len(sets)):
            assert len(np.intersect1d(own[a], own[b])) == len(sets[a] & sets[b])


def test_census_by_brute_force(spark):
    import pyarrow as pa

    from textframes.llm import census

    r = np.random.default_rng(9)
    pool = r.integers(0, 1 << 64, 400, dtype=np.uint64)
    rows = [(k, r.choice(pool, 30).tobytes()) for k in range(40)]

    def ask(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 20
        for batch in batches:
            for k, data in enumerate(batch.column("data").to_pylist()):
                q, flush = census.Question(np.frombuffer(data, np.uint64)), census.flush_number(task + k, 0)
                columns = [[*c, x] for c, x in zip(q.rows(flush, 4, np.arange(len(q.value), dtype=np.uint32), True), (flush, census.luggage_part(flush), None, None, None), strict=True)]
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [None] * (len(columns[0]) - 1) + [data]], types, strict=True)], ["flush", "part", "hashes", "who", "n", "data"])

    def settle(batches):
        for luggage, answers in census.flushes(batches):
            data = luggage.column("data")[0].as_py()
            q = census.Question(np.frombuffer(data, np.uint64))
            often = np.ones(len(q.value), np.int64)
            for x in answers:
                who, n = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint32) for c in ("who", "n"))
                often[who] = n
            yield pa.RecordBatch.from_arrays([pa.array([data]), pa.array([q.spread(often).tolist()])], ["data", "often"])

    asked = spark.createDataFrame(rows, "k int, data binary").mapInArrow(ask, census.ASK + ", data binary")
    found = census.census(asked, np.uint32, settle, "data binary, often array<bigint>").collect()
    every = np.concatenate([np.frombuffer(d, np.uint64) for _, d in rows])
    value, n = np.unique(every, return_counts=True)
    assert len(found) == len(rows)
    for x in found:
        assert x["often"] == n[np.searchsorted(value, np.frombuffer(x["data"], np.uint64))].tolist()


def test_tree_loses_no_link():
    r = np.random.default_rng(2)
    sets = []
    for n in (20, 40, 41, 300):
        base = r.integers(0, 1 << 62, n).astype(np.uint64)
        for _ in range(40):
            own = base.copy()
            own[r.integers(0, n, r.integers(0, n // 8 + 1))] = r.integers(0, 1 << 62)
            sets.append(np.unique(own))
    sizes = np.array([len(s) for s in sets])
    points = jaccard_join.count_vectors(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets))
    t = Fraction(9, 10)
    tree = jaccard_join.CountTree(points, sizes, t)
    n_found = 0
    for a, s in enumerate(sets):
        found = set(tree.search(points[a], len(s)).tolist())
        n_found += len(found)
        for b, o in enumerate(sets):
            both = len(np.intersect1d(s, o))
            assert b in found or 10 * both < 9 * (len(s) + len(o) - both)
    assert n_found < len(sets) ** 2 / 3


def test_linked_sets_share_a_key():
    """Whatever the order of elements, linked sets share an element of both prefixes."""
    r = np.random.default_rng(3)
    for t in (Fraction(9, 10), Fraction(4, 5), Fraction(1, 2), Fraction(1, 3)):
        linked = 0
        for _ in range(400):
            n = int(r.integers(1, 200))
            a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
            b = a[r.random(len(a)) > r.random() * 1.5 * (1 - t)]
            b = np.unique(np.r_[b, r.integers(0, 1 << 62, r.integers(0, n // 10 + 1)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or both < t * (len(a) + len(b) - both):
                continue
            linked += 1
            often = lambda x: np.where(np.isin(x, a) & np.isin(x, b), 2 + x % np.uint64(3), x % np.uint64(4) + np.uint64(1)).astype(np.int64)
            keys = [jaccard_join.prefix(x, often(x), t) for x in (a, b)]
            assert np.intersect1d(*keys).size
        assert linked > 50


def test_similar_groups_at_one_half(spark):
    rows = [(1, " ".join("abcdefgh")), (2, " ".join("abcdefghijklmnop")), (3, " ".join("abcdefghijklmnopq"))]
    found = jaccard_join.similar_groups(spark.createDataFrame([*rows[:2], (4, "x y z")], "doc_id bigint, text string"), 1, Fraction(1, 2)).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == {1: 1, 2: 1, 4: 4}
    found = jaccard_join.similar_groups(spark.createDataFrame(rows[::2], "doc_id bigint, text string"), 1, Fraction(1, 2)).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == {1: 1, 3: 3}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert found == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bit_filter(spark):
    hashes = np.random.default_rng(4).integers(0, 1 << 64, 500, dtype=np.uint64)
    rows = spark.createDataFrame([(int(h >> np.uint64(24)),) for h in hashes], "p bigint")
    f = BitFilter(rows, "p", 40)
    assert f.holds(hashes).all()
    assert f.holds(np.random.default_rng(5).integers(0, 1 << 64, 5000, dtype=np.uint64)).mean() < 0.1


def brute_repeats(rows, window):
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    seen: dict[tuple, int] = {}
    for w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc_id, *_), w in zip(rows, texts, strict=True):
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("window", [35, 9, 5])
def test_repeats_by_brute_force(docs, window):
    rows = substring_dedup.without_repeats(docs, window).collect()
    want = brute_repeats(corpus(1), window)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in rows) == want


def test_periodic_texts(spark):
    rows = [(1, "a b " * 60, None, None, None), (2, "a " * 30, None, None, None), (3, "a " * 36, None, None, None), (4, "c " * 35, None, None, None)]
    found = substring_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA), 35).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in found) == brute_repeats(rows, 35)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert exact_dedup.exact_groups(none).collect() == []
    assert jaccard_join.similar_groups(none).collect() == []
    assert substring_dedup.without_repeats(none).collect() == []


@pytest.mark.parametrize("name", ["op5_jaccard_join", "op7_exact_dedup", "op8_source_mixing", "op10_substring_dedup", "op6_exact_top_k"])
def test_query_against_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    ours, theirs = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)
