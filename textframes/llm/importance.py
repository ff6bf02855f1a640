"""Resampling of documents towards a target corpus by hashed n-gram importance weights (operator 11), in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textframes.llm.shared import saved

#: Letters a-z, digits, and everything outside ASCII, in a row.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a partition that monotonically_increasing_id() counts up to, in bits.
PLACE_BITS = 33


def words(text: Column) -> Column:
    """Words of a whole text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def grams(of: Column, order: int) -> Column:
    """All runs of 1 to order consecutive words, joined by a space."""

    def of_length(k: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(of) - (k - 1)), lambda i: F.array_join(F.slice(of, i, F.lit(k)), " "))
        return F.when(F.size(of) >= k, some).otherwise(F.array().cast("array<string>"))

    return F.concat(of, *map(of_length, range(2, order + 1)))


def bucketed(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """texts (columns with _text) with n_words and _buckets: crc32 of each feature modulo buckets, repeats included."""
    cut = texts.withColumn("_words", words(F.col("_text"))).drop("_text")
    own = F.transform(grams(F.col("_words"), order), lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))
    return cut.select(*[c for c in cut.columns if c != "_words"], F.size("_words").cast("bigint").alias("n_words"), own.alias("_buckets"))


def counts(features: DataFrame, name: str) -> DataFrame:
    """bucket, name: occurrences of each bucket; tasks send one row for each bucket at most."""
    return features.select(F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of every bucket: 1000 times the logarithm of its share in target over its share in source, add-one smoothed, cut down.

    source (bucket, s) and target (bucket, t). As many rows as there are buckets: a bound that is a parameter.
    """
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(source, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"])
    totals = F.broadcast(source.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(target.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))))  # one row
    real = lambda c, more: F.col(c).cast("double") + more
    share = real("t", 1) * real("all_s", buckets) / (real("s", 1) * real("all_t", buckets))
    return rows.crossJoin(totals).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def noise(doc_id: str, seed: int) -> Column:
    """A Gumbel variate in thousandths, cut down, from the first 32 bits of sha256(`seed:doc_id`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / 4294967296)))


def weighted(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, _row of every document, written to the shared folder.

    Texts are cut once: their buckets are written, counted, and then meet the gains, so that the long
    part of the work is done in two scans of small numbers.
    """
    own = docs.select("doc_id", F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    own = saved(bucketed(own, order, buckets), "importance-buckets")
    there = bucketed(target.select(F.col("text").alias("_text")), order, buckets)
    table = gains(counts(own, "s"), counts(there, "t"), buckets)
    each = own.select("_row", "doc_id", "n_words", F.explode_outer("_buckets").alias("bucket")).join(F.broadcast(table), "bucket", "left")
    sums = each.groupBy("_row", "doc_id", "n_words").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"), F.count("bucket").alias("n_features"))
    n = F.greatest(F.col("n_features"), F.lit(1).cast("bigint"))
    weight = F.call_function("div", F.col("_sum") - F.pmod("_sum", n), n)  # whole numbers, so that any sum is exact
    out = sums.select("_row", "doc_id", "n_words", "n_features", weight.alias("weight"))
    return saved(out.withColumn("score", F.col("weight") + noise("doc_id", seed)), "importance-scores")


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs; rank (from 1) of those that are drawn, else null.

    docs has doc_id and text, target text; other columns are not looked at. weight is the mean gain
    of a document's features (floored; 0 without any), score adds Gumbel noise of the id, so that the
    highest scores are a sample without replacement by weight. Of the rows with least_words words, the
    percent with the highest scores are drawn, ties to the smaller doc_id.

    A null or empty text has no words, weight 0 and is never drawn. Rows that share an id are documents
    of their own, with the same noise; a null id counts as an empty one and comes after the others in
    ties. Equal rows take their places in any order. An empty target, or empty docs, gives gains from
    the smoothing alone, or no rows.

    Rows that can be drawn are sorted by ranges of (score, doc_id): a row's rank is its place in its
    partition and the number of rows in partitions before, of which the driver gets one number each.
    """
    scored = weighted(docs, target, order, buckets, seed)
    able = scored.where(F.col("n_words") >= least_words)
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("_row")]
    placed = able.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = saved(placed.withColumn("_part", F.shiftright("_at", PLACE_BITS).cast("int")), "importance-order")
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    offsets = scored.sparkSession.createDataFrame(before, "_part int, _before bigint")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    columns = ("doc_id", "n_features", "weight", "score")
    drawn = placed.join(F.broadcast(offsets), "_part").select(*columns, F.when(place <= at * percent // 100, place).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(rest)
