"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bibspark.functions.text import TEXT_ROWS, small_batches  # noqa: F401
from bibspark.staging import shared_dir, staged  # noqa: F401

#: The characters that separate words in every contract of this subpackage.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words of a text as a long; 0 for null.

    Runs of spaces part a text; empty first and last parts are no words.
    """
    spaces = [chr(c) for c in (32, *range(9, 14))]
    outer = F.substring(text, 1, 1).isin(spaces).cast("int") + F.substring(text, -1, 1).isin(spaces).cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(text, SPACES + "+")) - outer).cast("long")


def schema_with(df: DataFrame, more: str) -> StructType:
    """The frame's schema and further fields, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def slices(texts: pa.Array, most: int, rows: int = 1 << 31) -> Iterator[tuple[int, int]]:
    """Runs of at most ``rows`` texts of about ``most`` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // most + np.arange(len(texts)) // rows * (1 << 40)
    cuts = [0, *(np.nonzero(np.diff(run))[0] + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def text_key(text: Column) -> Column:
    """A hash that stands for a text; null is like empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def rows_of(documents: DataFrame, kept: DataFrame, all_rows: DataFrame) -> DataFrame:
    """One row of ``documents`` for each doc_id and text_key of ``kept``; ``all_rows`` has those of all."""
    row_key = lambda text: F.md5(F.concat_ws(" ", text, F.col("doc_id").cast("string"))).alias("near_row")
    kept = staged(kept.select(row_key(F.col("text_key"))), "near-kept")
    again = all_rows.select(row_key(F.col("text_key"))).groupBy("near_row").count().where("count > 1").select("near_row")
    again = staged(again.join(kept, "near_row", "left_semi"), "near-repeats")
    rows = documents.withColumn("near_row", row_key(text_key(F.col("text")))).join(kept, "near_row", "left_semi")
    if not again.isEmpty():
        once = rows.join(again, "near_row", "left_semi").dropDuplicates(["near_row"])
        rows = rows.join(again, "near_row", "left_anti").unionByName(once)
    return rows.select(*documents.columns)
