"""A training corpus from ``documents``: five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.llm import decontaminate, mixing, near_copies, token_output, toxicity
from bibspark.llm.common import shared_dir, table
from bibspark.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples reject go.

    Null and empty texts are scored like any other and stay; repeated rows are judged alike;
    an empty table stays empty; columns stay, whatever their names.
    """
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: that of the least id.

    Copies are judged by text, so repeated and null ids lose nothing; null and empty texts are
    copies of each other, of rows equal in id and text one stays, and ties of the id go by a
    hash of the text. An empty table stays empty; columns stay, whatever their names.
    """
    return near_copies.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain nothing and stay; repeated rows are judged alike; an empty table
    or benchmark changes nothing; columns stay, whatever their names.
    """
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, twice at most.

    Texts without words (null, empty) have no size and are not taken; a null source is a source;
    rows equal in id and text are taken alike; an empty table stays empty; columns stay.
    """
    return mixing.repeated(docs, F.array("source"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, read back from their files in ascending doc_id order.

    Null ids come first; null and empty texts have the end id alone; repeated rows are repeated
    documents; an empty table gives no rows; other columns are dropped.
    """
    return token_output.encoded(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix_sources),
    ("token-id output", write_tokens),
]

#: Nearest examples, components of near copies, edit distances and seeded draws are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/bibspark/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
