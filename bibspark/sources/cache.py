"""Stored responses: keys, expiry and replay."""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.sources.payload import _get

# Parameters that are no part of a request's identity.
SECRET = {"api_key", "token", "access_token"}
SCHEMA = "key_digest string, key string, created_at double, value string"


def request_key(url: str, params: dict[str, object]) -> str:
    """The identity of a request: sorted parameters, without secrets and missing ones."""
    kept = sorted((k, v) for k, v in params.items() if v is not None and k.lower() not in SECRET)
    return f"GET {url}?{urlencode(kept)}"


def retry_delay(attempt: int, retry_after: str | None = None) -> float:
    """Seconds to wait before another attempt."""
    try:
        return min(60.0, max(0.0, float(retry_after)))
    except (TypeError, ValueError):
        return min(30.0, 0.5 * 2**attempt)


def digest(key: Column) -> Column:
    return F.sha2(key, 256)


def entries(requests: DataFrame, now: float) -> DataFrame:
    """Cache rows of key and value (JSON); append them to the cache table."""
    return requests.select(digest(F.col("key")).alias("key_digest"), "key", F.lit(now).alias("created_at"), "value")


def store(rows: DataFrame, path: str) -> None:
    """Appends cache rows; Spark commits all files or none, so readers see no half-written row."""
    rows.select("key_digest", "key", "created_at", "value").write.mode("append").parquet(path)


def fresh(cache: DataFrame, now: float | Column, ttl: float | None = None) -> DataFrame:
    """The latest entry of each key whose age is at most ``ttl``; entries that are no JSON
    object are misses, and no ``ttl`` means never too old."""
    rows = cache.where(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))
    if ttl is not None:
        rows = rows.where(F.lit(now) - F.col("created_at") <= ttl)
    latest = Window.partitionBy("key_digest").orderBy(F.desc("created_at"), "value")
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def replay(requests: DataFrame, cache: DataFrame, now: float, ttl: float | None = None) -> DataFrame:
    """Requests with their stored value; a miss has an error instead, for its reference."""
    found = fresh(cache, now, ttl).select("key_digest", F.col("key").alias("_key"), "value")
    rows = requests.withColumn("key_digest", digest(F.col("key"))).join(found, "key_digest", "left")
    hit = F.col("_key").eqNullSafe(F.col("key"))
    return rows.select(*requests.columns, F.when(hit, F.col("value")).alias("value"), F.when(~hit, F.concat(F.lit("no stored response for "), "key")).alias("error"))


def clear(cache: DataFrame, prefix: str) -> DataFrame:
    """The cache without the entries whose key has a prefix."""
    return cache.where(~F.col("key").startswith(prefix))


def payload_items(responses: DataFrame, path: str, key: str = "payload_id") -> tuple[DataFrame, DataFrame]:
    """JSON items of responses that hold a list at ``path``, and the keys of those that don't."""
    rows = responses.select(key, _get(F.try_parse_json("value"), path, "array<variant>").alias("items"))
    items = rows.select(key, F.posexplode("items").alias("pos", "v")).select(key, "pos", F.to_json("v").alias("item"))
    return items, rows.where("items is null").select(key, F.lit("response has no list of works").alias("error"))
