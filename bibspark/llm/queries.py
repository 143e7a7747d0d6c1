"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.llm import chat, decontaminate, mixing, pu_quality, quality_rules, sharding, simhash, token_output, toxicity, url_filter
from bibspark.llm.common import shared_dir, table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
ODD_TEXT = "\\### Assistant: </turn> ok"


def op1_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    documents = table(spark, sf_dir, "documents")
    found = toxicity.scored(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the base rules and its language's histograms."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages against the fixed rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op4_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from the windows."""
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.read_back(chat.format_windows(rows))


def tokenizer_path() -> str:
    """The vocabulary of the token queries, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written and read back."""
    return token_output.checksums(token_output.encoded(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the benchmark in every document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, by the slot map that is stored for this folder's documents."""
    path = f"{shared_dir(spark)}/bibspark/slot-map-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return sharding.shard(table(spark, sf_dir, "documents"), 40, map_path=path)


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    documents = table(spark, sf_dir, "documents")
    found = pu_quality.scored(documents, pu_quality.fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mix_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    sizes = mixing.by_source(mixed)
    info = spark.createDataFrame([(s, size, goal) for s, (size, goal) in sizes.items()], "source string, source_size long, target double")
    info = F.broadcast(info) if len(sizes) <= mixing.BROADCAST_ROWS else info
    rows = mixed.select("doc_id", F.col("members")[0].alias("own"), F.col("mix_size").alias("size"), F.col("mix_taken").alias("taken"))
    return rows.join(info, rows["own"].eqNullSafe(info["source"])).select("doc_id", "size", "source_size", "target", "taken", F.col("own").alias("source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_knn": op1_toxicity_knn,
    "op2_quality_divergence": op2_quality_divergence,
    "op3_url_filter": op3_url_filter,
    "op4_simhash_gph": op4_simhash_gph,
    "op5_chat_windows": op5_chat_windows,
    "op6_token_parquet": op6_token_parquet,
    "op7_decontaminate": op7_decontaminate,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_pu_quality": op9_pu_quality,
    "op10_mix_flow": op10_mix_flow,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": """WITH u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT n, page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(own, start, told) AS (VALUES """
    + ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    + """),
f AS (SELECT p.*, own || start AS rule, told, row_number() OVER (PARTITION BY n ORDER BY length(own) + length(start) DESC) AS best
  FROM p LEFT JOIN r ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start))
SELECT page_id, host, path, rule, coalesce(told, 'allow') AS verdict FROM f WHERE best = 1""",
}
