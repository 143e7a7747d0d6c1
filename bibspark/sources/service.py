"""Catalogues behind a JSON service: paced requests, retries, and a table of stored responses."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import quote, urlencode

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bibspark.operators.keys import join_same, spread
from bibspark.schemas import WORK
from bibspark.sources import cache, payload
from bibspark.staging import staged

# What a service's clients keep to.
RETRIED = frozenset({429, 500, 502, 503, 504})
MISSING_STATUS, RETRIES, TIMEOUT, MOST_ROWS = 404, 3, 20.0, 20
PRIMARY_INTERVAL, SECONDARY_INTERVAL = 0.1, 0.02
PRIMARY_FIELDS = "DOI,title,author,published-print,published-online,published,issued,created,container-title,URL"
SECONDARY_FIELDS = "id,doi,display_name,publication_year,authorships,primary_location"

Answer = tuple[int, Mapping[str, str], str]
Opener = Callable[[str, Mapping[str, str], float], Answer]


def open_url(url: str, headers: Mapping[str, str], timeout: float) -> Answer:
    """Status, headers and body of a GET; raises OSError if there is no answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.read().decode("utf-8")
    except urllib.error.HTTPError as told:
        return told.code, dict(told.headers), ""


@dataclass
class Client:
    """Asks for JSON objects, one request at a time with at least ``interval`` seconds between."""

    interval: float = 0.0
    retries: int = RETRIES
    timeout: float = TIMEOUT
    headers: Mapping[str, str] = field(default_factory=dict)
    opener: Opener = open_url
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: float | None = None

    def ask(self, url: str) -> tuple[str | None, str | None]:
        """The object as text, or an error; both None if the service has no such thing."""
        error = None
        for attempt in range(self.retries + 1):
            if self._last is not None:
                self.sleep(max(0.0, self._last + self.interval - self.clock()))
            after = None
            try:
                status, headers, body = self.opener(url, self.headers, self.timeout)
                if status == MISSING_STATUS:
                    return None, None
                if status < 400:
                    return (body, None) if isinstance(json.loads(body), dict) else (None, "the response is no JSON object")
                error, after = f"status {status}", headers.get("Retry-After")
                if status not in RETRIED:
                    break
            except ValueError as wrong:
                return None, f"the response is no JSON object: {wrong}"
            except OSError as wrong:
                error = str(wrong)
            finally:
                self._last = self.clock()
            if attempt < self.retries:
                self.sleep(cache.retry_delay(attempt, after))
        return None, error


def fetch(requests: DataFrame, store: str | None, client: Client, now: float, ttl: float | None = None, offline: bool = False) -> DataFrame:
    """Adds ``value`` and ``error`` to requests of ``key`` and ``url``.

    Stored responses that are young enough answer first. The rest go through one task, since the
    service's pace holds for all of them together, each different key once; what it finds is
    appended to the store. ``offline`` asks nothing: a miss is an error.
    """
    spark = requests.sparkSession
    asked = staged(requests.groupBy("key").agg(F.min("url").alias("url")), "service-requests")
    found = cache.replay(asked, _stored(spark, store), now, ttl)
    if not offline:
        found = staged(found, "service-replayed")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                told = [client.ask(u) for u in rows["url"]]
                yield rows.assign(value=pd.Series([v for v, _ in told], dtype=object), error=pd.Series([e for _, e in told], dtype=object))

        misses = found.where("value is null").coalesce(1)
        fresh = staged(misses.mapInPandas(run, misses.schema), "service-fetched")
        if store:
            cache.store(cache.entries(fresh.where("value is not null"), now), store)
        found = found.where("value is not null").unionByName(fresh)
    return requests.join(found.drop("url"), "key", "left")


def _stored(spark: SparkSession, store: str | None) -> DataFrame:
    if store:
        try:
            return spark.read.schema(cache.SCHEMA).parquet(store)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], cache.SCHEMA)


@F.pandas_udf(StringType())
def _quoted(values: pd.Series) -> pd.Series:
    return values.map(lambda v: quote(v, safe=""), na_action="ignore")


@F.pandas_udf(StringType())
def _parameter(values: pd.Series) -> pd.Series:
    return values.map(lambda v: urlencode({"": v})[1:], na_action="ignore")


@dataclass(frozen=True)
class ServiceCatalogue:
    """A catalogue that is asked over the network; the same methods as a stored one.

    ``kind`` is ``primary`` or ``secondary`` and tells the payloads' form; ``secret`` (a key)
    goes into the request but not into the stored one's identity.
    """

    label: str
    url: str
    kind: str
    client: Client
    now: float
    store: str | None = None
    ttl: float | None = None
    offline: bool = False
    secret: tuple[str, str] | None = None

    def _fetched(self, rows: DataFrame, path: Column, query: str, text: Column | None) -> DataFrame:
        key = F.concat(F.lit(f"GET {self.url}"), path, F.lit(f"?{query}"), F.lit("") if text is None else _parameter(text))
        secret = urlencode([self.secret]) if self.secret else ""
        url = F.substring(key, F.lit(5), F.lit(1 << 30)) if query else F.concat(F.lit(self.url), path, F.lit("?" if secret else ""))
        url = F.concat(url, F.lit("&" if query and secret else ""), F.lit(secret))
        return fetch(rows.withColumns({"key": key, "url": url}), self.store, self.client, self.now, self.ttl, self.offline)

    def _works(self, items: DataFrame) -> DataFrame:
        return (payload.primary_works if self.kind == "primary" else payload.secondary_works)(items)

    def look_up(self, rows: DataFrame, doi: str, out: str, label: str) -> DataFrame:
        """Rows with the work of a DOI in ``out``, and ``_error``."""
        asked = rows.where(F.col(doi).isNotNull()).select(F.col(doi).alias("payload_id")).distinct()
        head = F.lit("/works/") if self.kind == "primary" else F.lit("/works/https://doi.org/")
        named = _quoted(F.col("payload_id")) if self.kind == "primary" else F.replace(_quoted(F.col("payload_id")), F.lit("%2F"), F.lit("/"))
        told = staged(self._fetched(asked, F.concat(head, named), "", None), "service-lookup")
        message = F.to_json(F.try_variant_get(F.try_parse_json("value"), "$.message", "variant")) if self.kind == "primary" else F.col("value")
        found = join_same(told.select("payload_id", "error"), self._works(told.select("payload_id", message.alias("item"))), ["payload_id"])
        found = found.select(F.col("payload_id").alias("_of"), F.col("work").alias(out), F.concat(F.lit(f"{label}: "), "error").alias("_error"))
        return rows.withColumn("_doi_key", spread(doi, "bib_id", "index")).join(found, F.col("_doi_key") == F.col("_of"), "left").drop("_of", "_doi_key")

    def find(self, rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """Rows with ``_error``, and the candidates (bib_id, index, pos, work) in the service's order."""
        n = max(1, min(limit, MOST_ROWS))
        query = f"rows={n}&select={quote(PRIMARY_FIELDS)}&query.bibliographic=" if self.kind == "primary" else f"per_page={n}&select={quote(SECONDARY_FIELDS)}&search="
        told = staged(self._fetched(rows.select("bib_id", "index", "raw"), F.lit("/works"), query, F.col("raw")), "service-search")
        path = "$.message.items" if self.kind == "primary" else "$.results"
        items, bad = payload_items(told, path)
        error = F.concat(F.lit(f"{self.label} search: "), F.coalesce("error", F.when(F.col("value").isNotNull() & ~F.col("listed"), F.lit("response has no list of works"))))
        out = join_same(rows, bad.select("bib_id", "index", error.alias("_error")), ["bib_id", "index"])
        works = self._works(items.select(F.struct("bib_id", "index", "pos").alias("payload_id"), "item")).where("work is not null")
        return out, works.select("payload_id.bib_id", "payload_id.index", (F.col("payload_id.pos") + 1).alias("pos"), F.col("work").cast(WORK).alias("work"))


def payload_items(told: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON items (with ``pos``) of responses, and all responses with whether they hold a list."""
    rows = told.withColumn("items", F.try_variant_get(F.try_parse_json("value"), path, "array<variant>"))
    items = rows.select("bib_id", "index", F.posexplode("items").alias("pos", "v")).select("bib_id", "index", "pos", F.to_json("v").alias("item"))
    return items, rows.withColumn("listed", F.col("items").isNotNull())
