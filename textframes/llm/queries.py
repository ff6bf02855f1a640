"""The queries of this folder by name, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textframes.llm import bpe_codec, exact_dedup, html_extract, importance, jaccard_join, language_id, mixing, phrases, quality, substring_dedup, token_counts, topk_bitslice, toxicity
from textframes.llm.shared import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def vocab_path() -> str:
    """The byte-level BPE vocabulary of the public tokenizer files that are installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocab_path(), limit=512)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), vocab_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_bitslice.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, block=16, alpha=0.5, total=100)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance.resample(docs, target, order=1, buckets=10_000, seed=2024, least_words=20, percent=10)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=5, least=100, share=100, top=2000)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.quality(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_toxicity": op2_toxicity,
        "op3_bpe_codec": op3_bpe_codec,
        "op4_language_id": op4_language_id,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_source_mixing": op8_source_mixing,
        "op9_html_extract": op9_html_extract,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_phrase_mining": op12_phrase_mining,
        "op13_quality_classifier": op13_quality_classifier,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_jaccard_join": OP5, "op6_exact_top_k": OP6, "op7_exact_dedup": OP7, "op8_source_mixing": OP8, "op10_substring_dedup": OP10,
        "op11_importance_resampling": OP11, "op12_phrase_mining": OP12,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, hash(s) AS h, s FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM k a JOIN k b ON a.h = b.h AND a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""

OP8 = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS k FROM d),
c AS (SELECT s, count(*) AS rows FROM d GROUP BY s),
v AS (SELECT s, CAST(greatest(1, round(pow(rows, 0.5) * 100 / sum(pow(rows, 0.5)) OVER ())) AS BIGINT) AS w, CAST(ceil(rows / 16) AS BIGINT) AS n FROM c),
q AS (SELECT s, w, n, n // w AS f, row_number() OVER (ORDER BY s) AS i FROM v),
b AS (SELECT DISTINCT unnest([0, f, f + 1]) AS b FROM q),
p AS (SELECT b, lead(b) OVER (ORDER BY b) - b AS times FROM b),
m AS (SELECT b, times, list(CASE WHEN b < f THEN w WHEN b = f THEN n - f * w ELSE 0 END ORDER BY i) AS c,
             CAST(sum(CASE WHEN b < f THEN w WHEN b = f THEN n - f * w ELSE 0 END) AS BIGINT) AS p FROM p CROSS JOIN q GROUP BY b, times),
z AS (SELECT *, coalesce(sum(p * times) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM m WHERE p > 0),
e AS (
  SELECT b, c, p, CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, list_transform(c, lambda x: CAST(0 AS BIGINT)) AS done FROM z
  UNION ALL
  SELECT b, c, p, t + 1, k, done[k], list_transform(done, lambda x, y: CASE WHEN y = k THEN x + 1 ELSE x END) FROM (
    SELECT *, list_sort(list_filter(list_transform(range(1, len(c) + 1), lambda y:
      {'late': CASE WHEN done[y] < c[y] THEN -((-(done[y] + 1) * p - c[y] + 1) // c[y]) ELSE 0 END,
       'y': y, 'ok': done[y] < c[y] AND done[y] * p // greatest(c[y], 1) <= t + 1}), lambda x: x.ok))[1].y AS k
    FROM e WHERE t + 1 < p)),
a AS (SELECT r.doc_id, r.source, r.s, r.k // 16 AS block, CAST(r.k % 16 AS INTEGER) AS place, least(r.k // 16 // q.w, q.f) AS frame, q.w, q.i FROM r JOIN q USING (s))
SELECT a.doc_id, a.source, CAST(z.base + (a.frame - z.b) * z.p + e.t AS BIGINT) AS slot, CAST(a.block AS BIGINT) AS block, a.place
FROM a JOIN z ON z.b <= a.frame AND a.frame < z.b + coalesce(z.times, 1)
JOIN e ON e.b = z.b AND e.i = a.i AND e.j = a.block - a.frame * a.w
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

OP10 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
x AS (SELECT r, i, sha256(array_to_string(w.w[i : i + 34], ' ')) AS x FROM p JOIN w USING (r)),
d AS (SELECT x FROM x GROUP BY x HAVING count(*) > 1),
c AS (SELECT DISTINCT r, i + k.k AS i FROM x JOIN d USING (x) CROSS JOIN (SELECT unnest(range(0, 35)) AS k) k),
m AS (SELECT r, list(i) AS gone FROM c GROUP BY r),
o AS (SELECT w.doc_id, w.w, m.gone FROM w LEFT JOIN m USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM o
"""

GRAM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {GRAM.format(LOWER)} AS w FROM documents),
f AS (SELECT r, unnest(w) AS x FROM w),
b AS (SELECT unnest({GRAM.format(LOWER)}) AS x FROM benchmark),
tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(0, 256) u(i))),
byte AS (SELECT x, list_transform(range(0, CAST(len(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS y
         FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM (SELECT x FROM f UNION ALL SELECT x FROM b)))),
k AS (SELECT x, xor(list_reduce(y, lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS k FROM byte, tab),
s AS (SELECT k, count(*) AS s FROM f JOIN k USING (x) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN k USING (x) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM b) AS t),
g AS (SELECT s.k, CAST(floor(1000 * ln((CAST(coalesce(t.t, 0) AS DOUBLE) + 1) * (CAST(n.s AS DOUBLE) + 10000) / ((CAST(s.s AS DOUBLE) + 1) * (CAST(n.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain
      FROM s LEFT JOIN t ON t.k = s.k, n),
m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN k USING (x) JOIN g USING (k) GROUP BY r),
e AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(total, 0) AS total, CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (r)),
v AS (SELECT *, (total - ((total % greatest(n_features, 1)) + greatest(n_features, 1)) % greatest(n_features, 1)) // greatest(n_features, 1) AS weight FROM e),
c AS (SELECT r, doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM v),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM o) // 100 THEN place END AS rank FROM c LEFT JOIN o USING (r)
"""

OP12 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
w AS (SELECT p, lang, unnest(w) AS w, unnest(range(0, CAST(len(w) AS BIGINT))) AS i FROM p),
y AS (SELECT lang, w AS w1, lead(w, 1) OVER z AS w2, lead(w, 2) OVER z AS w3, lead(w, 3) OVER z AS w4, lead(w, 4) OVER z AS w5 FROM w WINDOW z AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, 1 AS m, w1 AS phrase FROM y UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM y WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM y WHERE w3 IS NOT NULL
      UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM y WHERE w4 IS NOT NULL
      UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM y WHERE w5 IS NOT NULL),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m >= 2 AND f >= 100),
k AS (SELECT c.*, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail FROM c, range(1, 5) t(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * k.a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.tail JOIN n ON n.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM s),
i AS (SELECT lang, part, max(a) AS longer FROM (
        SELECT lang, a, array_to_string(w[i : i + j - 1], ' ') AS part FROM c, range(1, 5) u(i), range(2, 5) v(j) WHERE j < m AND i + j - 1 <= m) GROUP BY lang, part),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.part = b.phrase WHERE best = 1 AND coalesce(100 * longer < 100 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
