from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textframes.llm import html_extract, mixing, topk_bitslice
from textframes.llm.labelled_pages import pages


def test_top_k_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_bitslice, "BLOCK", 64)
    monkeypatch.setattr(topk_bitslice, "QUERIES", 3)
    r = np.random.default_rng(0)
    vectors = [[float(x) for x in r.normal(0, 0.2, 16)] for _ in range(300)]
    vectors[7:30] = [vectors[50]] * 23  # ties
    rows = [(k, v) for k, v in enumerate(vectors)]
    odd = [(1001, None), (1002, [None] * 16), (1050, [math.nan] * 16), (1100, [math.inf] + [0.0] * 15), (None, vectors[0]), (50, vectors[50]), (1150, [0.5] * 4)]
    df = spark.createDataFrame([(*x, "clash") for x in rows + odd], "vec_id bigint, embedding array<float>, score string")
    valid = [(i, np.floor(np.float32(v).astype(float) * 256).astype(int)) for i, v in [*rows, (50, vectors[50]), (1150, [0.5] * 4 + [0.0] * 12)]]
    want = []
    for at, (q, v) in enumerate(valid):  # rows that repeat a vec_id ask, and are found, each by itself
        if q % 50 == 0:
            scores = sorted((-int(v @ w), i) for k, (i, w) in enumerate(valid) if k != at)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_bitslice.top_k(df).collect()]
    assert sorted(found) == sorted(want)
    assert topk_bitslice.top_k(df.limit(0)).collect() == []
    own = sum(int(x) ** 2 for x in np.floor(np.float32(vectors[50]).astype(float) * 256))
    assert [tuple(r) for r in topk_bitslice.top_k(df.where("vec_id = 50")).collect()] == [(50, 1, 50, own)] * 2
    assert topk_bitslice.top_k(df.where("vec_id = 1150")).collect() == []


def test_top_k_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk_bitslice, "BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.float32(r.normal(0, 0.2, 8))]) for k in range(60)]
    for k in (3, 20, 50, 51):  # sums of large products that cancel
        rows[k][1][:2] = [float(np.float32(x)) for x in (262_144.5 + k, -262_144.5 + k)]
    rows[9][1][:3] = [2.0**40, 2.0**40, 0.25]
    far = [0.0] * 8
    far[5] = -1e38 if rows[0][1][5] > 0 else 1e38  # a score beyond a bigint, but the lowest
    odd = [(100, [1e30, math.nan] + [0.0] * 6), (101, [1e30, None] + [0.0] * 6), (102, far)]
    rows[50][1][5] = rows[0][1][5]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    valid = {i: [math.floor(float(np.float32(x)) * 256) for x in v] for i, v in [*rows, odd[2]]}
    want = {}
    for q in (0, 50):
        scores = sorted((-sum(x * y for x, y in zip(valid[q], w, strict=True)), i) for i, w in valid.items() if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scores)}
    found = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk_bitslice.top_k(df).collect()}
    assert found == want


def test_slices_add_up():
    r = np.random.default_rng(1)
    values = r.integers(-200, 200, (130, 9))
    index = topk_bitslice.SliceIndex(values)
    weights = r.integers(-90, 90, 9)
    digits = index.sum_slices(weights)
    got = sum(np.unpackbits(d.view(np.uint8), bitorder="little")[:130].astype(int) << b for b, d in enumerate(digits))
    want = np.zeros(130, int)
    for d, w in enumerate(weights.tolist()):
        kept = (values[:, d] - index.base[d]) >> topk_bitslice.DROPPED
        top = (1 << max(0, index.bits[d] - topk_bitslice.DROPPED)) - 1
        want += abs(w) * (kept if w >= 0 else top - kept)
    assert (got == want).all()


def check_mix(rows, weights, block):
    """Every row once, slots without gaps, and at each slot less than one block from the frame's share."""
    slots = defaultdict(list)
    for r in rows:
        slots[r["slot"]].append(r)
    assert sorted(slots) == [*range(len(slots))]
    order = []
    for s in range(len(slots)):
        kinds = {(r["source"] or "", r["block"]) for r in slots[s]}
        assert len(kinds) == 1 and len(slots[s]) <= block
        order.append(kinds.pop())
    blocks = Counter(x for x, _ in order)
    for source, n in blocks.items():
        assert [b for x, b in order if x == source] == [*range(n)]
    at, left = 0, dict(blocks)
    while any(left.values()):
        frame = {s: min(weights.get(s, 1), n) for s, n in left.items() if n}
        size, done = sum(frame.values()), Counter()
        for k in range(size):
            done[order[at + k][0]] += 1
            assert all(abs(done[s] - c * (k + 1) / size) < 1 for s, c in frame.items())
        assert done == Counter(frame)
        left = {s: n - frame.get(s, 0) for s, n in left.items()}
        at += size


@pytest.mark.parametrize("block", [1, 7])
def test_mix(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 50)
    rows = [(k, f"s{k % 3}" if k % 2 else "hot", "clash") for k in range(900)] + [(None, None, "x"), (None, None, "x"), (5, "s2", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, slot string")
    weights = {"hot": 5, "s0": 3, "s1": 2, "absent": 4}
    given = spark.createDataFrame([*weights.items()], "source string, weight int")
    found = mixing.mix(df, given, block=block).collect()
    assert Counter((r["doc_id"], r["source"]) for r in found) == Counter(r[:2] for r in rows)
    check_mix(found, weights, block)
    counted = Counter(r[1] or "" for r in rows)
    total = sum(math.sqrt(n) for n in counted.values())
    own = {s: max(1, math.floor(math.sqrt(n) * 100 / total + 0.5)) for s, n in counted.items()}
    check_mix(mixing.mix(df, block=block).collect(), own, block)
    assert mixing.mix(df.limit(0)).collect() == []


def test_mix_of_large_weights(spark):
    """Weights whose sum is far above the slots of a run."""
    df = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(3000)] + [(k, "c") for k in range(3000, 3600)], "doc_id bigint, source string")
    weights = {"a": 9000, "b": 4001, "c": 700}
    found = mixing.mix(df, spark.createDataFrame([*weights.items()], "source string, weight int"), block=1).collect()
    assert len(found) == 3600
    check_mix(found, weights, 1)


def test_pages_like_those_of_the_table(spark):
    """The article of each page of the table, cut out by its own tags."""
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    for r in table.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))
        assert found[r["page_id"]] == " ".join(html.unescape(plain).split())


def test_held_out_labelled_pages():
    model, wrong, n = html_extract.trained(), 0, 0
    for page in pages(150, seed=77):
        blocks = [b for b in html_extract.leaf_blocks(page, marked=True) if b.label >= 0]
        labels = model.decode([html_extract.features(b) for b in blocks])
        wrong += sum(a != b.label for a, b in zip(labels, blocks, strict=True))
        n += len(blocks)
    assert wrong / n < 0.01


def test_viterbi_and_gradient_by_brute_force():
    import itertools

    r = np.random.default_rng(2)
    model = html_extract.ChainField(r.normal(size=html_extract.SLOTS), r.normal(size=(2, 2)), r.normal(size=2))
    rows = [[1, 2], [3], [2, 4], [5]]

    def score(y):
        e = model.scores(rows)
        return model.start[y[0]] + sum(e[k] * y[k] for k in range(4)) + sum(model.step[a, b] for a, b in itertools.pairwise(y))

    every = [*itertools.product([0, 1], repeat=4)]
    assert tuple(model.decode(rows)) == max(every, key=score)
    p = np.exp([score(y) for y in every])
    p /= p.sum()
    block, step, start = model.gradient(rows, [1, 0, 1, 1])
    assert np.allclose(block, np.array([1, 0, 1, 1]) - sum(q * np.array(y) for q, y in zip(p, every, strict=True)))
    assert np.allclose(step[0, 1], 1 - sum(q * sum((a, b) == (0, 1) for a, b in itertools.pairwise(y)) for q, y in zip(p, every, strict=True)))
    assert np.allclose(start[1], 1 - sum(q * y[0] for q, y in zip(p, every, strict=True)))


def test_odd_pages(spark):
    html = [None, "", "plain text", "<p>one<p>two&nbsp;&amp;amp; three", "<script>x</script><style>y", "<<<>>> a < b", "<div", "<nav><a href=x>Home</a></nav>", "<p>" + "word " * 50_000 + "</p>", "<p title='a > b'>in</p>", "<!-- <p>no</p> --><p>yes</p>"]
    df = spark.createDataFrame([(k, None, h, "clash") for k, h in enumerate(html)], "page_id bigint, url string, html string, text string")
    rows = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert [rows[k]["text"] for k in range(5)] == ["", "", "plain text", "one two &amp; three", ""]
    assert rows[7]["text"] == "" and rows[8]["n_chars"] == 249_999 and rows[9]["text"] == "in" and rows[10]["text"] == "yes"
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert html_extract.extract(df.limit(0)).count() == 0


def test_broken_markup_is_no_text():
    for html, want in {
        '<p class="a>Hello there</p>': "Hello there", "<p>hi there you</p": "hi there you", "<p>hello</a": "hello", '<div data-x="<b>x</b>">good</div>': "good",
        '<p class="a>Hello</p><p title="x">more</p>': "Hello more", "<p>one</p><p id='two": "one", "a < b": "a < b",
    }.items():
        assert " ".join(b.text for b in html_extract.leaf_blocks(html)) == want


@pytest.mark.parametrize("page", ["<div>x" * 20_000, '<p class="' * 20_000, '<p class="x>y' * 20_000, "<b>x" * 20_000 + "</i>" * 20_000, "<a href=x><div>x" * 10_000 + "</a>" * 10_000, "".join(f'<div class="c{k}q">x' for k in range(10_000))])
def test_hostile_pages_in_linear_time(page):
    import time

    model, began = html_extract.trained(), time.process_time()
    html_extract.main_text(model, page)
    assert time.process_time() - began < 6


def test_features_are_those_of_all_elements_above():
    block = html_extract.leaf_blocks('<div class="main"><div class="main post"><p>words</p></div></div>')[0]
    names = [f"above {t}" for t in ("div", "p")] + ["named main", "named post", "joined mainpost", "bias", "depth 3", "own p", "near0 p", "near1 div", "near1 main", "near1 post", "near2 div", "near2 main", "words 1", "links 0", "end "]
    slots = {html_extract._slot(n) for n in names}
    assert {*html_extract.features(block)} == slots
    model = html_extract.ChainField(np.random.default_rng(1).normal(size=html_extract.SLOTS))
    assert np.isclose(model.scores([html_extract.features(block)])[0], model.weight[sorted(slots)].sum())


def test_mix_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, source string")
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert mixing.mix(df).select(F.max("slot")).head()[0] == 0
