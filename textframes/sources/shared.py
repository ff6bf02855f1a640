"""Tables that several steps read: written once to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a table that are broadcast at most, once measured.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, only a local session gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/textframes-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df, written to a new path in the shared folder and read again: computed once, and executors may be lost.

    paths: gets the path, for removed().
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that saved() wrote, once nothing reads them any more."""
    while paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _bytes(name: str, kind: str) -> Column:
    """Bytes of a column's value, about; what isn't flat is measured as text."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(name), F.lit(0)).cast("bigint")
    if kind.startswith(("array<", "struct<", "map<")):
        flat = kind.removeprefix("array<")[:-1] in ("bigint", "int", "double", "float", "smallint", "tinyint", "boolean")
        return F.coalesce(8 * F.size(name) if flat else F.length(F.to_json(name)), F.lit(0)).cast("bigint")
    return F.lit(8).cast("bigint")


def few(ids: DataFrame) -> DataFrame:
    """A table, marked for broadcast if its counted rows and measured bytes are few; else left to a shuffle."""
    size = F.lit(0).cast("bigint")
    for name, kind in ids.dtypes:
        size = size + _bytes(name, kind)
    rows, total = ids.agg(F.count("*"), F.sum(size)).head()
    return F.broadcast(ids) if rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else ids
