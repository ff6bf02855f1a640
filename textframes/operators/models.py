"""Model files and character tables where only the driver has them: sent with the session, found again in a worker."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark import SparkFiles
from pyspark.sql import SparkSession


def ship(spark: SparkSession, *paths: str) -> list[str]:
    """Sends files to every executor, those that start later included; the names that found() knows them by."""
    for path in paths:
        if not os.path.isfile(path):
            raise FileNotFoundError(path)
        spark.sparkContext.addFile(path)
    return [os.path.basename(p) for p in paths]


def found(name: str, folders: Iterable[str] = ()) -> str:
    """Path of a file by name, in a worker or on the driver: as it is, in one of the folders, or among the files that were sent."""
    tried = [name, *(os.path.join(f, name) for f in folders), SparkFiles.get(os.path.basename(name))]
    for path in tried:
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(f"{name}: not in {', '.join(tried)}")


def characters(path: str) -> list[str]:
    """A recogniser's classes from a character table: the blank, the lines in order, a space."""
    with open(path, encoding="utf-8") as f:
        return ["", *f.read().removesuffix("\n").replace("\r\n", "\n").split("\n"), " "]
