from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textframes.llm import bpe_codec, queries, token_counts
from textframes.llm.byte_bpe import vocabulary
from textframes.llm.suffix_automaton import SuffixAutomaton

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, ids string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocab_path())


def texts() -> list[str | None]:
    r = random.Random(1)
    odd = ["", None, " ", "a", "a  b \n c\n\n  d", "<|endoftext|> e<|endoftext|><|endoftext|>x <|endoftext", "aaaaaaaaaaaaaaa" * 60, "!\x1c\x1d  x　y  ", "don't I'LL 123 45,6 \t\tz",
           "日本語テキスト😀😀 é", "x" * 5000, "word " * 30_000, "ab ab ab", "ab ab ab"]
    return odd + ["".join(r.choice(["a", "b", " ", "\n", "\t", "'s", "é", "1", ",", "<|endoftext|>", "ing", "tion"]) for _ in range(r.randint(1, 120))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 3 else k, t, None, "s", None, "clash", "clash") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_and_digests_against_the_library(docs, library):
    want = {}
    for k, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[None if k == 3 else k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    counted = token_counts.token_counts(docs, queries.vocab_path()).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in counted} == {k: v[0] for k, v in want.items()}
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in counted)
    sizes = {None if k == 3 else k: len((t or "").encode()) for k, t in enumerate(texts())}
    assert {r["doc_id"]: r["n_bytes"] for r in counted} == sizes
    coded = bpe_codec.digests(docs, queries.vocab_path()).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in coded} == want


def test_long_words(library):
    """A text that is one pre-token, of any content, costs time in proportion to its length."""
    import string
    import time

    r = random.Random(6)
    coder, counter = bpe_codec.Codec(queries.vocab_path()), token_counts.UnitCounter(queries.vocab_path())
    for text in ("a" * 200_000, "".join(r.choices(string.ascii_letters, k=200_000)), "".join(chr(0x4E00 + r.randrange(5000)) for _ in range(60_000)), "-=" * 50_000):
        want, began = library.encode(text, add_special_tokens=False).ids, time.process_time()
        assert coder.encode(text) == want and counter.counts([text]).tolist() == [len(want)]
        assert time.process_time() - began < 8


def test_encode_keeps_columns_and_round_trips(docs):
    coder = bpe_codec.Codec(queries.vocab_path())
    rows = bpe_codec.encode(docs, queries.vocab_path()).collect()
    assert set(rows[0].asDict()) == {*docs.columns}
    assert all(coder.decode(r["ids"]) == (r["text"] or "") and r["n_tokens"] == "clash" for r in rows)


def test_empty_table(docs):
    none = docs.limit(0)
    assert token_counts.token_counts(none, queries.vocab_path()).collect() == []
    assert bpe_codec.digests(none, queries.vocab_path()).collect() == []
    assert bpe_codec.encode(none, queries.vocab_path()).collect() == []


def test_prefix_coder_equals_rank_merger():
    vocab = vocabulary(queries.vocab_path())
    coder, merger = bpe_codec.PrefixCoder(vocab), token_counts.RankMerger(vocab)
    r = random.Random(2)
    words = [bytes(r.choice(b"abcdetion \xc3\xa9") for _ in range(r.randint(1, 70))) for _ in range(2000)] + [b"", b"a" * 900]
    flat, counts = merger.encode(words)
    ends = counts.cumsum()
    long = [bytes(r.choice(b"abcdetion \xc3\xa9") for _ in range(r.randint(1, 300))) for _ in range(200)] + [b"a" * 301, b"ab" * 150]
    assert all(merger.encode_long(w).tolist() == merger.encode([w])[0].tolist() for w in long)
    assert coder.encode_many(words) == [flat[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def test_suffix_automaton_knows_every_substring():
    r = random.Random(3)
    strings = [[r.randrange(3) for _ in range(r.randint(1, 12))] for _ in range(8)]
    sam = SuffixAutomaton(4)
    for s in strings:
        sam.add(s)
    inside = {tuple(s[a:b]) for s in strings for a in range(len(s)) for b in range(a + 1, len(s) + 1)}

    def known(s):
        state = 0
        for x in s:
            state = sam.go.get(state << 4 | x)
            if state is None:
                return False
        return True

    assert all(map(known, inside))
    assert not any(known(s) for s in {tuple(r.randrange(3) for _ in range(5)) for _ in range(200)} - inside)


def test_query_over_the_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs}
    for name in ("op1_token_counts", "op3_bpe_codec"):
        assert {r["doc_id"]: r["n_tokens"] for r in queries.queries()[name](spark, "/root/testdata/sf0.001").select("doc_id", F.col("n_tokens")).collect()} == want
