"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textframes.llm import bpe_codec, exact_dedup, jaccard_join, language_id, mixing
from textframes.llm.queries import vocab_path
from textframes.llm.shared import saved, shared_path, small, table

NEAR_WORDS, NEAR_SIMILARITY = 5, Fraction(4, 5)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those too far from every language of the corpus.

    The decision rests on the text alone: rejected texts are named by hash and length, and docs go
    through one anti-join.
    """
    name = [F.xxhash64(F.col("text").cast("string")).alias("_hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("_length")]
    found = language_id.identify(docs.select("text", *name), language_id.train(docs), ("_pred", "_score", "_rejected"))
    far = small(saved(found.where("_rejected").select("_hash", "_length").distinct(), "pipeline-far"))
    return docs.select(*[f"`{c}`" for c in docs.columns], *name).join(far, ["_hash", "_length"], "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id stays."""
    groups = saved(exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "kept", F.col("text_sha256").alias("_sha")), "pipeline-copies")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = docs.withColumn("_sha", F.sha2(lower, 256))
    dropped = groups.where("not kept").select(F.col("doc_id").alias("_id"), "_sha", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("_again")).distinct()
    dropped = saved(dropped, "pipeline-dropped")
    same = lambda other: (keyed["_sha"] == other["_sha"]) & keyed["doc_id"].eqNullSafe(other["_id"])
    gone = small(saved(dropped.select("_id", "_sha").distinct(), "pipeline-ids"))
    out = keyed.join(gone, same(gone), "left_anti")
    if not (again := dropped.where("_again")).isEmpty():  # the row that stays is repeated with its id
        again = small(saved(again.select("_id", "_sha"), "pipeline-ids"))
        out = out.union(keyed.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "_sha"]))
    return out.select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that word shingles link (five words, similarity 0.8), one with the smallest doc_id stays."""
    rows = jaccard_join.similar_groups(docs, width=NEAR_WORDS, threshold=NEAR_SIMILARITY).where("group_id is not null")
    rows = saved(rows.select("group_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("row")), "pipeline-groups")
    first = rows.groupBy("group_id").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = rows.join(first, "group_id").where("row <> first").select(F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash")).distinct()
    gone = small(saved(gone, "pipeline-gone"))
    keyed = docs.withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    same = (keyed["_hash"] == gone["_hash"]) & keyed["doc_id"].eqNullSafe(gone["_id"])
    return keyed.join(gone, same, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the rows in the order of the mix; all stay. Written, the rows of the files, file by file, are the mix."""
    mixed = mixing.mix(docs.withColumnsRenamed({c: f"_kept_{c}" for c in ("slot", "block", "place") if c in docs.columns}))
    ordered = mixed.repartitionByRange("slot").sortWithinPartitions("slot", "place")
    return ordered.select(*[F.col(f"`_kept_{c}`" if f"_kept_{c}" in ordered.columns else f"`{c}`").alias(c) for c in docs.columns])


def _position(docs: DataFrame) -> F.Column:
    """A row's place in files that were written in order: the file's number and the row's; else in the order of partitions."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    return F.shiftleft(F.coalesce(F.nullif(number, F.lit("")), F.lit("0")).cast("bigint"), 40) + F.col("_metadata.row_index")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and position of each document: ordered by position they are the mix."""
    coded = bpe_codec.encode(docs.select("doc_id", "lang", "source", "text", _position(docs).alias("position")), vocab_path(), keep_text=False)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "position")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each to what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := shared_path(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the language classifier nor the encoder; tests hold run() against brute force.
ORACLE_SQL = None
