"""Bibliographies that arrive as files, analysed batch by batch.

A count of people needs its whole bibliography, so each micro-batch runs the batch plan over
the bibliographies that it brings; results are written under the batch's number, and a batch
that is run again after a failure replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bibspark.operators.resolve import Catalogue
from bibspark.plans.analysis import Analysis
from bibspark.schemas import MatchConfig


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, primary: Catalogue, secondary: Catalogue | None = None, config: MatchConfig | None = None, files_a_batch: int = 1000) -> StreamingQuery:
    """Starts the stream; ``out/people`` and ``out/summary`` have a folder for each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        result = Analysis.from_text(rows, primary, secondary, config)
        for name, table in (("people", result.people), ("summary", result.summary)):
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    texts = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder, wholetext=True)
    rows = texts.select(F.xxhash64("_metadata.file_path").alias("bib_id"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
