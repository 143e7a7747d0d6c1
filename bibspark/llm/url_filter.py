"""URL allow and block rules as a sort-merge range join.

A host with its labels reversed, each closed by a separator that sorts below every other
character, turns "this host and its subdomains" into one interval of keys. Urls and rules are
sorted by that key; one sweep keeps a stack of the rules whose intervals hold the current key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import schema_with, staged

#: Up to this many rules go to every task; more are range partitioned together with the urls.
BROADCAST_RULES = 50_000
CLOSE = "\x00"
Rule = tuple[str, str, str]  # host, path, verdict


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def host_key(host: Column) -> Column:
    """Reversed labels, each closed: a host's key is a prefix of its subdomains' keys."""
    labels = F.reverse(F.split(host, r"\."))
    return F.concat(F.array_join(labels, CLOSE), F.lit(CLOSE))


def rule_key(host: str) -> str:
    return CLOSE.join(reversed(host.split("."))) + CLOSE


class Sweep:
    """Merges sorted host keys with sorted rules; the stack holds the rules around the key."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        by_host: dict[str, dict[str, tuple[int, str, str]]] = {}
        for host, path, verdict in rules:
            at = by_host.setdefault(rule_key(host), {})
            if path not in at or verdict == "block":  # of equal rules block wins
                at[path] = (len(host) + len(path), host + path, verdict)
        self.keys = sorted(by_host)
        self.paths = [by_host[k] for k in self.keys]
        self.lengths = [sorted({len(p) for p in x}, reverse=True) for x in self.paths]
        self.next, self.stack, self.key = 0, [], None

    def move(self, key: str) -> None:
        if key == self.key:
            return
        if self.key is not None and key < self.key:
            self.next, self.stack = 0, []
        self.key = key
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            while self.stack and not self.keys[self.next].startswith(self.keys[self.stack[-1]]):
                self.stack.pop()
            self.stack.append(self.next)
            self.next += 1
        while self.stack and not key.startswith(self.keys[self.stack[-1]]):
            self.stack.pop()

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        self.move(key)
        best: tuple[int, str, str] | None = None
        for i in reversed(self.stack):
            for n in self.lengths[i]:
                if n <= len(path) and (hit := self.paths[i].get(path[:n])):
                    if best is None or hit[0] > best[0]:
                        best = hit
                    break
        return best[1:] if best else (None, None)


def _swept(rows: pd.DataFrame, sweep: Sweep, default: str) -> pd.DataFrame:
    found = [sweep.judge(k, p) for k, p in zip(rows["_key"], rows["path"], strict=True)]
    rows["rule"] = [f[0] for f in found]
    rows["verdict"] = [f[1] or default for f in found]
    # strings as objects: chunked string columns can't be sent back as one array
    return rows.drop(columns="_key").astype({c: object for c in ("host", "path", "rule", "verdict")})


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page's url by ``rules`` (host, path, verdict).

    A rule fits its host and subdomains if the url's path starts with the rule's; the longest
    wins (of equal ones block). Rules with a null host, path or verdict fit nothing. Null urls
    and urls without ``://`` have an empty host and path and get ``default``, as does every url
    that no rule fits. Other columns are ignored; repeated pages give repeated rows.

    Few rules (their number is counted first) go to each task, which sorts and sweeps the urls
    that it has: no url is shuffled. More rules are range partitioned on the same split points
    as the urls; the url's hash is the last part of the sort key, so that a hot host or url is
    split too.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_key", host_key(F.col("host")))
    rules = rules.select("host", "path", "verdict").dropna()
    out = schema_with(keyed.drop("_key"), "rule string, verdict string")
    if rules.limit(broadcast_rules + 1).count() <= broadcast_rules:
        few = spark.sparkContext.broadcast([tuple(r) for r in rules.collect()])

        def sweep_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sweep = Sweep(few.value)
            for rows in batches:
                yield _swept(rows, sweep, default)

        return keyed.sortWithinPartitions("_key").mapInPandas(sweep_sorted, out)

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = staged(keyed.withColumn("_sort", F.concat("_key", F.lit("\x01"), F.hex(F.xxhash64("page_id", "path")))), "url-keys")
    total = keyed.count()
    drawn = keyed.select("_sort").sample(min(1.0, 40 * n / max(total, 1)), seed=7).limit(80 * n)
    keys = sorted(r[0] for r in drawn.collect())  # 80 * n at most
    bounds = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect.bisect_right(bounds, k))

    @F.pandas_udf("array<int>")
    def parts(key: pd.Series) -> pd.Series:
        return key.map(lambda k: list(range(bisect.bisect_right(bounds, k), bisect.bisect_right(bounds, k + "\U0010ffff") + 1)))

    ranged = rules.withColumn("_part", F.explode(parts(host_key(F.col("host")))))

    def sweep_range(urls: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        sweep = Sweep(own[["host", "path", "verdict"]].itertuples(index=False, name=None))
        return _swept(urls.sort_values("_key").drop(columns=["_sort", "_part"]), sweep, default)

    urls = keyed.withColumn("_part", part("_sort"))
    return urls.groupBy("_part").cogroup(ranged.groupBy("_part")).applyInPandas(sweep_range, out)
