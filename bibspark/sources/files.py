"""Bibliographies from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("txt", "bib", "ris")
UPLOAD_BYTES = 1_000_000


def read_bibliographies(spark: SparkSession, path: str, most_bytes: int | None = None, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """bib_id (a hash of the path), path and text of each file; a byte order mark is dropped.

    Size and extension, if given, are limits of uploads; larger and other files are left out
    before they are read.
    """
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_size")
    if most_bytes is not None:
        rows = rows.where(F.col("file_size") <= most_bytes)
    if extensions is not None:
        rows = rows.where(F.lower(F.substring_index("file_path", ".", -1)).isin(*extensions))
    return rows.select(F.xxhash64("file_path").alias("bib_id"), F.col("file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def from_text(spark: SparkSession, text: str, bib_id: int = 1) -> DataFrame:
    """One bibliography that is at hand as a string."""
    return spark.createDataFrame([(bib_id, text.removeprefix("﻿"))], "bib_id long, text string")


def limit_references(references: DataFrame, most: int = 100) -> DataFrame:
    """Bibliographies of over ``most`` references are refused whole, not cut."""
    sizes = references.groupBy("bib_id").count().where(F.col("count") > most)
    return references.join(sizes, "bib_id", "left_anti")
