"""Registered queries: each operator over whole tables, with DuckDB SQL where SQL has it.

The driver's tables hold no citations, so references, works and payloads are derived from
orders, lineitem, supplier and part by the same fixed rules on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark import output
from bibspark.functions import features, links, similarity, text
from bibspark.operators import candidates, matching, people
from bibspark.operators.identity import person_keys
from bibspark.operators.resolve import Catalogue, resolve
from bibspark.schemas import AUTHOR, CANDIDATE, WORK, MatchConfig
from bibspark.sources import cache as stored
from bibspark.sources import payload, split
from bibspark.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if oracle is not None:
            ORACLES[query.__name__] = oracle
        return query

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- resolutions derived from orders, authors from lineitem and supplier -----------------

BASE = """
WITH RECURSIVE res AS (
  SELECT o_custkey AS bib_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, o_orderkey,
         CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'ambiguous' ELSE 'unmatched' END AS status,
         'w' || (o_orderkey % 5) AS wkey, o_orderkey % 3 = 0 AS et_al
  FROM orders),
au AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS pos,
         CASE WHEN l_linenumber % 5 = 0 THEN 'Dr ' || s_name ELSE s_name END AS name,
         CASE WHEN s_suppkey % 3 <> 0 AND l_linenumber % 4 <> 0 THEN '0000-' || s_suppkey END AS orcid,
         CASE WHEN s_suppkey % 2 = 0 AND l_linenumber % 4 <> 0 THEN 'A' || (s_suppkey // 4) END AS openalex,
         s_suppkey % 10 = 0 AS coll
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
inc0 AS (
  SELECT *, min(CASE WHEN status = 'matched' THEN idx END) OVER (PARTITION BY bib_id, CASE WHEN status = 'matched' THEN wkey END) AS first_idx FROM res),
inc AS (
  SELECT *, CASE WHEN status = 'matched' AND idx > first_idx THEN first_idx END AS duplicate_of,
         status = 'matched' AND idx = first_idx AS included FROM inc0),
ships AS (
  SELECT bib_id, idx, wkey, pos, name, orcid, openalex, trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g')) AS nname,
         coalesce('0orcid:' || orcid, '1openalex:' || openalex) AS node,
         CASE WHEN orcid IS NOT NULL THEN '1openalex:' || openalex END AS other
  FROM inc JOIN au ON l_orderkey = o_orderkey WHERE included AND NOT coll),
e AS (
  SELECT DISTINCT bib_id, node AS a, other AS b FROM ships WHERE other IS NOT NULL
  UNION SELECT DISTINCT bib_id, other, node FROM ships WHERE other IS NOT NULL),
reach(bib_id, n, r) AS (
  SELECT bib_id, a, a FROM e
  UNION SELECT reach.bib_id, e.b, reach.r FROM reach JOIN e ON e.bib_id = reach.bib_id AND e.a = reach.n),
roots AS (SELECT bib_id, n, min(r) AS root FROM reach GROUP BY bib_id, n),
own AS (
  SELECT s.*, substr(coalesce(root, node), 2) AS own FROM ships s LEFT JOIN roots r ON r.bib_id = s.bib_id AND r.n = s.node),
known AS (
  SELECT bib_id, nname, min(own) AS only_one FROM own WHERE own IS NOT NULL GROUP BY bib_id, nname HAVING min(own) = max(own)),
keyed AS (
  SELECT o.*, coalesce(own, only_one, 'name:' || o.nname) AS key FROM own o LEFT JOIN known k ON k.bib_id = o.bib_id AND k.nname = o.nname),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bib_id, idx, key ORDER BY pos) AS n FROM keyed) WHERE n = 1),
cred AS (SELECT *, count(*) OVER (PARTITION BY bib_id, idx) AS persons FROM firsts),
parts AS (SELECT bib_id, key, persons, count(*) AS n FROM cred GROUP BY bib_id, key, persons),
nums AS (
  SELECT bib_id, key, CAST(sum(n) AS BIGINT) AS full_count, sum(CAST(n AS DOUBLE) / persons ORDER BY persons) AS fraction
  FROM parts GROUP BY bib_id, key),
names AS (
  SELECT bib_id, key, name, row_number() OVER (PARTITION BY bib_id, key ORDER BY count(*) DESC, length(name) DESC, lower(name) DESC, min(idx * 1000 + pos)) AS n
  FROM cred GROUP BY bib_id, key, name),
rest AS (
  SELECT bib_id, key, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases, string_agg(DISTINCT wkey, '|' ORDER BY wkey) AS works,
         arg_min(orcid, idx * 1000 + pos) FILTER (orcid IS NOT NULL) AS orcid,
         arg_min(openalex, idx * 1000 + pos) FILTER (openalex IS NOT NULL) AS openalex_id, min(idx * 1000 + pos) AS seen
  FROM cred GROUP BY bib_id, key),
ppl AS (
  SELECT nums.bib_id, nums.key, names.name AS display_name, aliases, works, full_count, fraction, orcid, openalex_id, seen
  FROM nums JOIN names ON names.bib_id = nums.bib_id AND names.key = nums.key AND names.n = 1
  JOIN rest ON rest.bib_id = nums.bib_id AND rest.key = nums.key)
"""


def _status() -> Column:
    return F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "O", "ambiguous").otherwise("unmatched")


def derived_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and its authors in order, for orders that have a work.

    Lines are gathered with what an author is made of, and made into authors afterwards.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    lines = lines.join(table(spark, sf_dir, "orders").where(_status() == "matched"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    rows = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "s_name"))).alias("all"))
    none = F.lit(None).cast("string")

    def author(line: Column) -> Column:
        id_, name, given = line["l_suppkey"], line["s_name"], line["l_linenumber"] % 4 != 0
        return F.struct(
            F.when(line["l_linenumber"] % 5 == 0, F.concat(F.lit("Dr "), name)).otherwise(name).alias("display_name"),
            none.alias("given"),
            none.alias("family"),
            F.when((id_ % 3 != 0) & given, F.concat(F.lit("0000-"), id_.cast("string"))).alias("orcid"),
            F.when((id_ % 2 == 0) & given, F.concat(F.lit("A"), F.floor(id_ / 4).cast("string"))).alias("openalex_id"),
            none.alias("provider_id"),
            (id_ % 10 == 0).alias("is_collective"),
        )

    return rows.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("all", author).cast(f"array<{AUTHOR}>").alias("authors"))


def derived_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bibliography for each customer, a reference for each order."""
    orders = table(spark, sf_dir, "orders").join(derived_authors(spark, sf_dir), "o_orderkey", "left")
    none = F.lit(None).cast("string")
    key = F.concat(F.lit("w"), (F.col("o_orderkey") % 5).cast("string"))
    work = F.struct(key.alias("id"), key.alias("title"), F.coalesce("authors", F.array().cast(f"array<{AUTHOR}>")).alias("authors"), F.lit("crossref").alias("provider"), F.year("o_orderdate").alias("year"), none.alias("doi"), none.alias("venue"), none.alias("source_url")).cast(WORK)
    status = _status()
    return orders.select(
        F.col("o_custkey").alias("bib_id"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("index"),
        F.lit("").alias("raw"),
        none.alias("doi"),
        F.array().cast("array<int>").alias("years"),
        F.array(F.lit("a")).alias("visible_surnames"),
        (F.col("o_orderkey") % 3 == 0).alias("has_et_al"),
        status.alias("status"),
        F.when(status == "matched", work).alias("work"),
        F.lit(1.0).alias("confidence"),
        none.alias("method"),
        none.alias("reason"),
        F.array().cast(f"array<{CANDIDATE}>").alias("alternatives"),
        F.array().cast("array<string>").alias("provider_errors"),
    ).withColumn("duplicate_of", F.lit(None).cast("int"))


@lru_cache(maxsize=1)
def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.include(derived_resolutions(spark, sf_dir))


def _persons(spark: SparkSession, sf_dir: str, marked: DataFrame | None = None) -> DataFrame:
    return people.people(people.credited(person_keys(people.authorships(_marked(spark, sf_dir) if marked is None else marked))))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people and summary both read of the resolutions, derived once."""
    return staged(_marked(spark, sf_dir).select("bib_id", "index", "status", "has_et_al", "visible_surnames", "work", "work_key", "duplicate_of", "included"), "marked")


@register(BASE + "SELECT bib_id, CAST(idx AS BIGINT) AS ref_index, status, coalesce(CAST(duplicate_of AS BIGINT), 0) AS duplicate_of, included FROM inc")
def work_dedupe_first(spark, sf_dir):
    rows = _marked(spark, sf_dir)
    return rows.select("bib_id", F.col("index").cast("long").alias("ref_index"), "status", F.coalesce(F.col("duplicate_of").cast("long"), F.lit(0)).alias("duplicate_of"), "included")


@register(BASE + "SELECT bib_id, count(*) AS n FROM inc WHERE status = 'matched' GROUP BY bib_id")
def keep_duplicates_counts(spark, sf_dir):
    rows = people.include(derived_resolutions(spark, sf_dir), deduplicate=False)
    return rows.where("included").groupBy("bib_id").agg(F.count(F.lit(1)).alias("n"))


@register(BASE + "SELECT bib_id, idx AS ref_index, count(*) AS n FROM ships GROUP BY ALL")
def collective_filter(spark, sf_dir):
    rows = people.authorships(_marked(spark, sf_dir))
    return rows.groupBy("bib_id", F.col("index").cast("long").alias("ref_index")).agg(F.count(F.lit(1)).alias("n"))


@register(BASE + "SELECT bib_id, idx AS ref_index, CAST(pos AS BIGINT) AS pos, key FROM keyed")
def identity_components(spark, sf_dir):
    rows = person_keys(people.authorships(_marked(spark, sf_dir)))
    return rows.select("bib_id", F.col("index").cast("long").alias("ref_index"), F.col("pos").cast("long").alias("pos"), "key")


@register(BASE + "SELECT bib_id, idx AS ref_index, key, CAST(pos AS BIGINT) AS pos, CAST(persons AS BIGINT) AS persons FROM cred")
def distinct_authors_per_work(spark, sf_dir):
    rows = people.credited(person_keys(people.authorships(_marked(spark, sf_dir))))
    return rows.select("bib_id", F.col("index").cast("long").alias("ref_index"), "key", F.col("pos").cast("long").alias("pos"), F.col("persons").cast("long").alias("persons"))


@register(BASE + "SELECT bib_id, key, display_name, aliases, works, full_count, round(fraction, 6) AS fractional_count, orcid, openalex_id FROM ppl")
def people_counts(spark, sf_dir):
    rows = _persons(spark, sf_dir)
    return rows.select("bib_id", "key", "display_name", F.array_join("aliases", "|").alias("aliases"), F.array_join("work_ids", "|").alias("works"), "full_count", F.round("fractional_count", 6).alias("fractional_count"), "orcid", "openalex_id")


def _rank_sql(first: str, second: str) -> str:
    order = f"{first} DESC, {second} DESC, lower(display_name), seen"
    return BASE + f"SELECT * FROM (SELECT bib_id, row_number() OVER (PARTITION BY bib_id ORDER BY {order}) AS rank, key, full_count FROM ppl) WHERE rank <= 3"


def _rank(spark: SparkSession, sf_dir: str, ranking: str) -> DataFrame:
    return people.ranked(_persons(spark, sf_dir), ranking, 3).select("bib_id", F.col("rank").cast("long").alias("rank"), "key", "full_count")


@register(_rank_sql("full_count", "fraction"))
def rank_full_topk(spark, sf_dir):
    return _rank(spark, sf_dir, "full")


@register(_rank_sql("fraction", "full_count"))
def rank_fractional_topk(spark, sf_dir):
    return _rank(spark, sf_dir, "fractional")


SUMMARY = """, hid AS (
  SELECT l_orderkey, count(*) AS n FROM au GROUP BY l_orderkey)
SELECT inc.bib_id, count(*) AS input_references, CAST(count_if(status = 'matched') AS BIGINT) AS matched_references, CAST(count_if(status = 'ambiguous') AS BIGINT) AS ambiguous_references,
  CAST(count_if(status = 'unmatched') AS BIGINT) AS unmatched_references, CAST(0 AS BIGINT) AS errored_references, count(duplicate_of) AS duplicate_references,
  CAST(count_if(included) AS BIGINT) AS distinct_matched_works, coalesce(any_value(ranked), 0) AS ranked_people, CAST(count_if(et_al) AS BIGINT) AS et_al_references,
  CAST(sum(CASE WHEN status = 'matched' AND et_al THEN greatest(0, coalesce(hid.n, 0) - 1) ELSE 0 END) AS BIGINT) AS hidden_authors_expanded
FROM inc LEFT JOIN hid ON hid.l_orderkey = inc.o_orderkey LEFT JOIN (SELECT bib_id, count(*) AS ranked FROM ppl GROUP BY bib_id) p ON p.bib_id = inc.bib_id
GROUP BY inc.bib_id"""


@register(BASE + SUMMARY)
def summary_counts(spark, sf_dir):
    marked = _stored(spark, sf_dir)
    return people.summary(marked, _persons(spark, sf_dir, marked)).select("bib_id", *output.COUNTERS)


@register(BASE + "SELECT ppl.bib_id, key, round(full_count / CAST(n AS DOUBLE), 6) AS share FROM ppl JOIN (SELECT bib_id, count_if(included) AS n FROM inc GROUP BY bib_id) USING (bib_id)")
def share_of_works(spark, sf_dir):
    marked = _stored(spark, sf_dir)
    return people.share(_persons(spark, sf_dir, marked), people.counters(marked)).select("bib_id", "key", F.round("share", 6).alias("share"))


@register(BASE + "SELECT bib_id, 'Reference ' || idx || ' matched ''' || wkey || ''' but had no countable authors' AS warning FROM inc WHERE included AND NOT EXISTS (SELECT 1 FROM ships s WHERE s.bib_id = inc.bib_id AND s.idx = inc.idx)")
def no_author_warnings(spark, sf_dir):
    return people.warnings(_marked(spark, sf_dir)).select("bib_id", "warning")


# --- references and identifiers derived from orders ----------------------------------------


def _raw() -> list:
    """supplier, A., et al. (year). part. Journal ... with a DOI for every second order."""
    key = F.col("o_orderkey")
    doi = F.when(key % 2 == 0, F.concat(F.lit(" https://doi.org/10.1000/O"), key.cast("string"), F.lit("."))).otherwise("")
    raw = F.concat(F.lit("Supplier, A., et al. ("), F.year("o_orderdate").cast("string"), F.lit("). Order "), key.cast("string"), F.lit(" on "), F.lower("o_orderpriority"), F.lit(". Journal 7, 10-20."), doi)
    return [key.alias("o_orderkey"), raw.alias("raw")]


REFS = """WITH refs AS (SELECT o_orderkey, 'Supplier, A., et al. (' || year(o_orderdate) || '). Order ' || o_orderkey || ' on ' || lower(o_orderpriority)
  || '. Journal 7, 10-20.' || CASE WHEN o_orderkey % 2 = 0 THEN ' https://doi.org/10.1000/O' || o_orderkey || '.' ELSE '' END AS raw FROM orders) """


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*_raw())


@register(REFS + "SELECT o_orderkey, nullif(lower(regexp_replace(regexp_extract(raw, '10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+'), '[.,;:)]+$', '')), '') AS doi FROM refs")
def extract_doi(spark, sf_dir):
    return _refs(spark, sf_dir).select("o_orderkey", features.extract_doi(F.col("raw")).alias("doi"))


@register(
    REFS
    + """SELECT o_orderkey, array_to_string(list_distinct_ordered, ',') AS years FROM (SELECT o_orderkey,
  list_filter(ys, lambda y, i: list_position(ys, y) = i) AS list_distinct_ordered FROM (SELECT o_orderkey,
  regexp_extract_all(raw, '(?:^|[^0-9])((?:18|19|20|21)[0-9]{2})[a-z]?(?:[^0-9]|$)', 1) AS ys FROM (
    SELECT o_orderkey, regexp_replace(raw, '([^0-9])', '\\1\\1', 'g') AS raw FROM refs)))"""
)
def extract_years(spark, sf_dir):
    return _refs(spark, sf_dir).select("o_orderkey", F.array_join(features.extract_years(F.col("raw")).cast("array<string>"), ",").alias("years"))


_NAMES = ("Abel", "Bruno", "Çelik", "Dumas", "Éloi", "O'Hara", "Ng")
_OTHERS = ("Ito", "Løv", "Paz-Ruiz", "Quist", "Rao")


@register(
    f"""WITH n AS (SELECT o_orderkey, ['abel', 'bruno', 'celik', 'dumas', 'eloi', 'ohara', 'ng'][o_orderkey % {len(_NAMES)} + 1] AS a,
  ['ito', 'løv', 'pazruiz', 'quist', 'rao'][o_orderkey % {len(_OTHERS)} + 1] AS b FROM orders)
SELECT o_orderkey, o_orderkey % 5 IN (0, 3) AS has_et_al, CASE o_orderkey % 5 WHEN 2 THEN 'ab,' || a || ',' || b WHEN 3 THEN a WHEN 4 THEN '' ELSE a || ',' || b END AS surnames FROM n"""
)
def et_al_and_surnames(spark, sf_dir):
    """Each way in which names stand, alone and with et al."""
    key = F.col("o_orderkey")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    a, b, year = pick(_NAMES), pick(_OTHERS), F.year("o_orderdate").cast("string")
    raw = (
        F.when(key % 5 == 0, F.concat(a, F.lit(", A., "), b, F.lit(", Bo, et al. ("), year, F.lit("). Title.")))
        .when(key % 5 == 1, F.concat(F.lit("B. "), a, F.lit(" and C. D. "), b, F.lit(". "), year, F.lit(". Title, E.")))
        .when(key % 5 == 2, F.concat(a, F.lit(" AB, "), b, F.lit(" C; "), year))
        .when(key % 5 == 3, F.concat(F.lit("as "), a, F.lit(" ET  al told in "), year))
        .otherwise(F.concat(F.lit("no names "), year, F.lit(" Smith, J.")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", features.has_et_al(F.col("raw")).alias("has_et_al"), F.array_join(features.visible_surnames(F.col("raw")), ",").alias("surnames"))


DOIS = """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' https://dx.doi.org/10.1000/AbC' || o_orderkey || '.' WHEN 1 THEN 'DOI: (10.1000/x' || o_orderkey || ')'
  WHEN 2 THEN '10.1/' || o_orderkey || ';' ELSE ' ' END AS s FROM orders) """


def _doi_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    n = key.cast("string")
    s = F.when(key % 4 == 0, F.concat(F.lit(" https://dx.doi.org/10.1000/AbC"), n, F.lit("."))).when(key % 4 == 1, F.concat(F.lit("DOI: (10.1000/x"), n, F.lit(")"))).when(key % 4 == 2, F.concat(F.lit("10.1/"), n, F.lit(";"))).otherwise(" ")
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))


_DOI_SQL = "nullif(lower(regexp_replace(regexp_replace(trim(regexp_replace(trim(s), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '', 'i')), '[.,;:)\\]}>\"'']+$', ''), '^[(\\[{<\"'']+', '')), '')"


@register(DOIS + f"SELECT o_orderkey, {_DOI_SQL} AS doi, coalesce('doi:' || {_DOI_SQL}, 'id' || o_orderkey) AS work_key FROM d")
def doi_normalize(spark, sf_dir):
    rows = _doi_strings(spark, sf_dir)
    return rows.select("o_orderkey", text.normalize_doi(F.col("s")).alias("doi"), text.stable_work_key(F.concat(F.lit("id"), F.col("o_orderkey").cast("string")), F.col("s")).alias("work_key"))


@register("SELECT s_suppkey, '0000-x' || s_suppkey AS orcid, 'A' || s_suppkey AS openalex_id, s_suppkey % 7 = 0 AS collective, 'supplier' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS surname FROM supplier")
def identifier_normalize(spark, sf_dir):
    n = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 7 == 0, F.concat("s_name", F.lit(" Study-Group"))).otherwise(F.col("s_name"))
    padded = F.concat(F.lit("Súpplier#"), F.lpad(n, 9, "0"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        text.normalize_orcid(F.concat(F.lit(" HTTPS://orcid.org/0000-X"), n)).alias("orcid"),
        text.short_openalex_id(F.concat(F.lit("https://openalex.org/A"), n, F.lit("/ "))).alias("openalex_id"),
        text.is_collective_name(name).alias("collective"),
        text.normalize_surname(padded).alias("surname"),
    )


@register("SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS normal FROM documents")
def normalize_documents(spark, sf_dir):
    text.small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text("text").alias("normal"))


# --- segmentation ----------------------------------------------------------------------------


def _lists(spark: SparkSession, sf_dir: str, mark: Callable, glue: str, head: str = "", tail: str = "") -> DataFrame:
    """A list of a customer's references, each with a mark of its place."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", *_raw())
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("bib_id"), place.alias("n"), "raw")
    rows = rows.groupBy("bib_id").agg(F.array_sort(F.collect_list(F.struct("n", "raw"))).alias("all"))
    return rows.select("bib_id", F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: mark(x["n"].cast("string"), x["raw"])), glue), F.lit(tail)).alias("text"))


_PARSED = REFS.replace("SELECT o_orderkey,", "SELECT o_custkey, o_orderkey,") + "SELECT o_custkey AS bib_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ref_index, {} AS raw FROM refs"


def _parsed(lists: DataFrame) -> DataFrame:
    return split.parse_references(lists).select("bib_id", F.col("index").cast("long").alias("ref_index"), "raw")


@register(_PARSED.format("raw"))
def split_numbered(spark, sf_dir):
    return _parsed(_lists(spark, sf_dir, lambda n, raw: F.concat(F.lit("["), n, F.lit("] "), raw), "\n", "References\n"))


@register(_PARSED.format("raw"))
def split_numbered_lines(spark, sf_dir):
    """Numbers that don't count upwards, so only the lines tell."""
    return _parsed(_lists(spark, sf_dir, lambda n, raw: F.concat(F.lit("7."), F.replace(raw, F.lit(" Journal"), F.lit("\n Journal"))), "\n"))


@register(_PARSED.format("regexp_replace(raw, ' https.*', '')") + " QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def split_starts(spark, sf_dir):
    """Wrapped lines without marks: a start behind a whole reference opens the next one."""

    def wrapped(n: Column, raw: Column) -> Column:
        raw = F.regexp_replace(raw, " https.*", "")  # a number of a DOI may look like a year
        for before in (" Order", " on ", " Journal"):
            raw = F.replace(raw, F.lit(before), F.lit("\n" + before[1:]))
        return raw

    lists = _lists(spark, sf_dir, wrapped, "\n")
    return _parsed(lists.where(F.col("text").contains("\nSupplier")))


@register(_PARSED.format("raw"))
def split_blank_blocks(spark, sf_dir):
    return _parsed(_lists(spark, sf_dir, lambda n, raw: F.when(n == "1", raw).otherwise(F.replace(raw, F.lit(" Journal"), F.lit("\n  Journal"))), "\n\n"))


@register(_PARSED.format("raw"))
def split_lines(spark, sf_dir):
    return _parsed(_lists(spark, sf_dir, lambda n, raw: F.concat(F.lit("- "), raw), "\n", "Works cited:\n"))


@register(_PARSED.format("'TY - JOUR TI - ' || raw || ' ER -'"))
def split_ris(spark, sf_dir):
    return _parsed(_lists(spark, sf_dir, lambda n, raw: F.concat(F.lit("TY  - JOUR\nTI  - "), raw, F.lit("\nER  -")), "\n"))


@register(_PARSED.format("'@article{k, title = {' || raw || '} }'"))
def split_bibtex(spark, sf_dir):
    return _parsed(_lists(spark, sf_dir, lambda n, raw: F.concat(F.lit("@article{k,\n  title = {"), raw, F.lit("}\n}")), "\n"))


@register(_PARSED.format("raw"))
def split_semicolon(spark, sf_dir):
    return _parsed(_lists(spark, sf_dir, lambda n, raw: raw, "; "))


# --- matching ----------------------------------------------------------------------------------


def _works(spark: SparkSession, sf_dir: str, provider: str, keep) -> DataFrame:
    """A work for each part, with a DOI; the second catalogue has other fields."""
    none = F.lit(None).cast("string")
    n = F.col("p_partkey").cast("string")
    author = F.array(F.struct(F.concat(F.lit("Ann "), "p_brand").alias("display_name"), F.lit("Ann").alias("given"), F.col("p_brand").alias("family"), none.alias("orcid"), F.when(F.lit(provider == "openalex"), F.concat(F.lit("A"), n)).alias("openalex_id"), none.alias("provider_id"), F.lit(False).alias("is_collective")))
    work = F.struct(F.concat(F.lit(f"{provider}:"), n).alias("id"), F.concat_ws(" ", "p_name", "p_type", n).alias("title"), author.alias("authors"), F.lit(provider).alias("provider"), (F.lit(1990) + F.col("p_size")).alias("year"), F.concat(F.lit("10.1000/P"), n).alias("doi"), F.col("p_type").alias("venue"), none.alias("source_url"))
    return table(spark, sf_dir, "part").where(keep).select(work.cast(WORK).alias("work"))


def _catalogues(spark: SparkSession, sf_dir: str) -> tuple[Catalogue, Catalogue]:
    key = F.col("p_partkey")
    return Catalogue("Crossref", _works(spark, sf_dir, "crossref", key % 3 != 0)), Catalogue("OpenAlex", _works(spark, sf_dir, "openalex", key % 2 == 0))


@register(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN 'crossref_openalex_doi' WHEN p_partkey % 2 = 0 THEN 'openalex_doi'
  WHEN p_partkey % 3 <> 0 THEN 'crossref_doi' END AS method, CASE WHEN p_partkey % 2 = 0 THEN 'openalex:' || p_partkey WHEN p_partkey % 3 <> 0 THEN 'crossref:' || p_partkey END AS work_id,
  CASE WHEN p_partkey % 2 = 0 THEN 'A' || p_partkey END AS openalex_id FROM part"""
)
def doi_lookup_merge(spark, sf_dir):
    from bibspark.operators.resolve import exact

    refs = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("10.1000/p"), F.col("p_partkey").cast("string")).alias("doi"))
    return exact(refs, *_catalogues(spark, sf_dir)).select("p_partkey", "method", F.col("work.id").alias("work_id"), F.col("work.authors")[0]["openalex_id"].alias("openalex_id"))


def _part_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws(" ", F.concat("p_brand", F.lit(", A. (")), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit(")."), F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string")), F.lit("."))
    return split.with_features(table(spark, sf_dir, "part").select(F.lit(1).cast("long").alias("bib_id"), F.col("p_partkey").cast("int").alias("index"), raw.alias("raw")))


@register()
def resolve_by_search(spark, sf_dir):
    """Candidates, scores, gates, fallback and enrichment; tests hold them against models."""
    rows = resolve(_part_refs(spark, sf_dir), *_catalogues(spark, sf_dir))
    return rows.select("index", "status", F.round("confidence", 6).alias("confidence"), "method", "reason", F.col("work.id").alias("work_id"))


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9_]+', ' ', 'g'))"


@register(
    f"""WITH works AS (SELECT 'crossref:' || p_partkey AS id, {_PLAIN.format("p_name || ' ' || p_type || ' ' || p_partkey")} AS title FROM part WHERE p_partkey % 3 <> 0),
w AS (SELECT id, unnest(list_distinct(string_split(title, ' '))) AS word FROM works),
n AS (SELECT word, 1 / ln(count(*) + 1.5) AS weight FROM w GROUP BY word),
asked AS (SELECT p_partkey AS idx, unnest(list_distinct(string_split({_PLAIN.format("p_brand || ', A. (' || (1990 + p_size) || '). ' || p_name || ' ' || p_type || ' ' || p_partkey || ' .'")}, ' '))) AS word FROM part),
hits AS (SELECT idx, id, round(sum(weight ORDER BY word), 9) AS weight FROM asked JOIN w USING (word) JOIN n USING (word) GROUP BY idx, id)
SELECT * FROM (SELECT CAST(idx AS INTEGER) AS "index", CAST(row_number() OVER (PARTITION BY idx ORDER BY weight DESC, id) AS INTEGER) AS pos, id AS work_id FROM hits) WHERE pos <= 3"""
)
def candidate_topk(spark, sf_dir):
    """The works that share the rarest title words."""
    rows = candidates.search(_part_refs(spark, sf_dir), _catalogues(spark, sf_dir)[0].works, 3)
    return rows.select("index", "pos", F.col("work.id").alias("work_id"))


#: Longest common subsequences by dynamic programming: a row for each character of ``a``.
_RATIOS = """WITH RECURSIVE p AS (
  SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS ta, list_sort(list_distinct(string_split(lower(p_type), ' '))) AS tb FROM part),
s AS (SELECT *, list_filter(ta, lambda x: list_contains(tb, x)) AS common, list_filter(ta, lambda x: NOT list_contains(tb, x)) AS oa, list_filter(tb, lambda x: NOT list_contains(ta, x)) AS ob FROM p),
k AS (SELECT p_partkey, a, b, len(common) AS n, len(oa) AS na, len(ob) AS nb, array_to_string(common, ' ') AS shared, array_to_string(list_concat(common, oa), ' ') AS one, array_to_string(list_concat(common, ob), ' ') AS two FROM s),
pairs AS (SELECT a AS x, b AS y FROM k UNION SELECT one, two FROM k UNION SELECT shared, one FROM k UNION SELECT shared, two FROM k),
dp AS (
  SELECT x, y, 0 AS i, list_transform(range(len(y)), lambda j: 0) AS r FROM pairs
  UNION ALL
  SELECT x, y, i + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(t[1:j])) FROM (
    SELECT x, y, i, list_transform(range(1, len(y) + 1), lambda j: CASE WHEN y[j] = x[i + 1] THEN 1 + CASE WHEN j > 1 THEN r[j - 1] ELSE 0 END ELSE r[j] END) AS t FROM dp WHERE i < len(x))),
lcs AS (SELECT x, y, CASE WHEN x = y THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE 2.0 * list_max(r) / (len(x) + len(y)) END::DOUBLE AS ratio FROM dp WHERE i = len(x))
SELECT p_partkey, round(l0.ratio, 6) AS indel, round(CASE WHEN n > 0 AND (na = 0 OR nb = 0) THEN 1.0 WHEN n = 0 THEN l1.ratio ELSE greatest(l1.ratio, l2.ratio, l3.ratio) END::DOUBLE, 6) AS token_set
FROM k JOIN lcs l0 ON l0.x = a AND l0.y = b JOIN lcs l1 ON l1.x = one AND l1.y = two JOIN lcs l2 ON l2.x = shared AND l2.y = one JOIN lcs l3 ON l3.x = shared AND l3.y = two"""


@register(_RATIOS)
def fuzzy_ratios(spark, sf_dir):
    """Ratios of part names to types."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return rows.select("p_partkey", *(F.round(f(F.col("a"), F.col("b")), 6).alias(n) for n, f in (("indel", similarity.indel_ratio), ("token_set", similarity.token_set_ratio))))


@register()
def partial_ratios(spark, sf_dir):
    """Best windows of part names to types; held against dynamic programming in tests."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return rows.select("p_partkey", F.round(similarity.partial_ratio(F.col("a"), F.col("b")), 6).alias("partial"))


YEARS = """SELECT p_partkey, CASE abs(p_size - (p_partkey % 50)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 0.0 END AS year_score"""


@register(
    "WITH s AS (" + YEARS + """, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 10) / 10.0 END AS a, (p_size % 11) / 10.0 AS t, CASE WHEN p_partkey % 3 = 0 THEN 0.5 END AS v FROM part)
SELECT p_partkey, CAST(year_score AS DOUBLE) AS year_score, round(least(1, greatest(0, (CASE WHEN t < 0.45 THEN t / 0.45 ELSE 1 END) * (0.64 * t + 0.21 * coalesce(a, 0) + 0.11 * year_score + 0.04 * coalesce(v, 0))
  / (0.75 + CASE WHEN a IS NOT NULL THEN 0.21 ELSE 0 END + CASE WHEN v IS NOT NULL THEN 0.04 ELSE 0 END))), 6)::DOUBLE AS score FROM s"""
)
def score_weights(spark, sf_dir):
    key = F.col("p_partkey")
    year = similarity.year_similarity(F.array(F.col("p_size"), F.lit(5000)), (key % 50).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", year.alias("year_score"), F.when(key % 4 != 0, (key % 10) / 10).alias("a"), ((F.col("p_size") % 11) / 10).alias("t"), F.when(key % 3 == 0, 0.5).alias("v"))
    return rows.select("p_partkey", "year_score", F.round(similarity.combined_score(F.col("t"), F.col("a"), F.col("year_score"), F.col("v")), 6).alias("score"))


GATES = """WITH c AS (SELECT l_orderkey AS idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS pos, 's' || (l_suppkey % 30) AS id,
  (50 + l_quantity) / 100.0 AS score, (l_partkey % 100) / 100.0 AS title, l_partkey % 20 = 0 AS same FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY idx, id ORDER BY score DESC, pos) AS best, min(pos) OVER (PARTITION BY idx, id) AS first_pos FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, title DESC, first_pos) AS rank, lead(score) OVER (PARTITION BY idx ORDER BY score DESC, title DESC, first_pos) AS next FROM d WHERE best = 1)
SELECT CAST(idx AS BIGINT) AS idx, id AS best_id, NOT (score < 0.74) AND NOT (title < 0.55 AND NOT same) AND NOT coalesce(score - next < 0.04, false) AS accepted,
  NOT (score < 0.74) AND NOT (title < 0.55 AND NOT same) AND coalesce(score - next < 0.04, false) AS ambiguous FROM r WHERE rank = 1"""


@register(GATES)
def choose_gates(spark, sf_dir):
    """Dedupe, order and gates over given scores."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    none = F.lit(None)
    id_ = F.concat(F.lit("s"), (F.col("l_suppkey") % 30).cast("string"))
    work = F.struct(id_.alias("id"), id_.alias("title"), F.array().cast(f"array<{AUTHOR}>").alias("authors"), none.alias("provider"), none.alias("year"), none.alias("doi"), none.alias("venue"), none.alias("source_url")).cast(WORK)
    score = (F.lit(50) + F.col("l_quantity")) / 100
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit(1).alias("bib_id"),
        F.col("l_orderkey").alias("index"),
        F.row_number().over(order).alias("pos"),
        work.alias("work"),
        score.alias("score"),
        ((F.col("l_partkey") % 100) / 100).alias("title_score"),
        *(none.cast("double").alias(f"{c}_score") for c in ("author", "year", "venue")),
        (F.col("l_partkey") % 20 == 0).alias("doi_matches"),
    )
    refs = rows.select("bib_id", "index").distinct()
    return matching.decide(refs, rows, MatchConfig()).select(F.col("index").alias("idx"), F.col("best.work.id").alias("best_id"), "accepted", "ambiguous")


# --- payloads, links, cache, sinks -------------------------------------------------------------


@register(
    """SELECT o_orderkey AS payload_id, 'doi:10.1000/o' || o_orderkey AS work_id, 'Order ' || o_orderkey AS title, CAST(year(o_orderdate) AS INTEGER) AS year,
  lower(o_orderpriority) AS venue, 'Ann C' || o_custkey || '|' || 'Clerk Team' AS authors, 'false|true' AS collective FROM orders"""
)
def primary_payloads(spark, sf_dir):
    key, none = F.col("o_orderkey").cast("string"), F.lit(None).cast("string")
    item = F.concat(
        F.lit('{"DOI": "10.1000/O'), key, F.lit('", "title": ["", "Order '), key, F.lit('"], "published-print": {"date-parts": [[]]}, "issued": {"date-parts": [['), F.year("o_orderdate").cast("string"),
        F.lit(', 1]]}, "container-title": ["'), F.lower("o_orderpriority"), F.lit('"], "author": [{"given": "Ann", "family": "C'), F.col("o_custkey").cast("string"), F.lit('"}, {"given": " "}, {"name": "Clerk Team"}]}'),
    )
    rows = payload.primary_works(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("payload_id"), item.alias("item")))
    w = F.col("work")
    return rows.select("payload_id", w["id"].alias("work_id"), w["title"].alias("title"), w["year"].alias("year"), w["venue"].alias("venue"), F.array_join(w["authors"]["display_name"], "|").alias("authors"), F.array_join(w["authors"]["is_collective"].cast("array<string>"), "|").alias("collective"))


@register("SELECT s_suppkey AS payload_id, 'openalex:W' || s_suppkey AS work_id, 'Supply' AS title, s_name AS family, 'A' || s_suppkey AS openalex_id, 'https://openalex.org/W' || s_suppkey AS source_url FROM supplier")
def secondary_payloads(spark, sf_dir):
    n = F.col("s_suppkey").cast("string")
    item = F.concat(F.lit('{"id": "https://openalex.org/W'), n, F.lit('", "display_name": " Supply ", "authorships": [{"author": {"display_name": "Mx '), "s_name", F.lit('", "id": "https://openalex.org/A'), n, F.lit('"}}]}'))
    rows = payload.secondary_works(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("payload_id"), item.alias("item")))
    w = F.col("work")
    return rows.select("payload_id", w["id"].alias("work_id"), w["title"].alias("title"), w["authors"][0]["family"].alias("family"), w["authors"][0]["openalex_id"].alias("openalex_id"), w["source_url"].alias("source_url"))


@register("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '10.1000/o' || o_orderkey WHEN 1 THEN '10.1000/a+' || o_orderkey WHEN 2 THEN '10.1000/q' || o_orderkey END AS doi FROM orders")
def paper_links(spark, sf_dir):
    key, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    link = (
        F.when(key % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/O"), n))
        .when(key % 4 == 1, F.concat(F.lit("https://x.example/p/10.1000/A+"), n, F.lit("?b=1")))
        .when(key % 4 == 2, F.concat(F.lit("http://x.example/p?doi=10.1000%2FQ"), n))
        .otherwise(F.concat(F.lit("10.1000/"), n))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", links.doi_from_link(link).alias("doi"))


@register(
    """SELECT o_custkey AS bib_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ref_index,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://doi.org/10.1000/o' || o_orderkey || ' as told' ELSE 'C' || o_custkey || ', A. (' || year(o_orderdate) || '). Order ' || o_orderkey || '. 7' END AS raw
FROM orders WHERE o_orderkey % 3 <> 2"""
)
def deposited_references(spark, sf_dir):
    key, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    item = (
        F.when(key % 3 == 0, F.concat(F.lit('{"DOI": "10.1000/O'), n, F.lit('", "unstructured": " as  told "}')))
        .when(key % 3 == 1, F.concat(F.lit('{"author": "C'), F.col("o_custkey").cast("string"), F.lit(', A.", "year": "'), F.year("o_orderdate").cast("string"), F.lit('", "article-title": "Order '), n, F.lit('.", "volume": "7"}')))
        .otherwise(F.lit('{"year": "2000"}'))
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bib_id"), "o_orderkey", item.alias("r"))
    papers = rows.groupBy("bib_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "r"))).alias("all"))
    papers = papers.select("bib_id", F.concat(F.lit('{"reference": ['), F.array_join("all.r", ","), F.lit("]}")).alias("item"))
    cited, _ = links.paper_references(papers)
    return cited.select("bib_id", F.col("index").cast("long").alias("ref_index"), "raw")


@register(
    """SELECT user_id, max(ts) AS ts, arg_max(props, ts) AS props FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM events) - 86400 * 30 GROUP BY user_id"""
)
def cache_ttl_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    age = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    now = events.agg(F.max(age)).first()[0]
    key = F.col("user_id").cast("string")
    rows = events.select("user_id", "ts", F.col("props").alias("value"), key.alias("key"), stored.digest(key).alias("key_digest"), age.alias("created_at"))
    return stored.fresh(rows, now, 86400.0 * 30).select("user_id", "ts", F.col("value").alias("props"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '''=' || p_name WHEN p_partkey % 3 = 1 THEN '''@' || p_name ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'ORCID ' || p_partkey WHEN p_partkey % 3 = 0 THEN 'OpenAlex ' || p_partkey ELSE '' END AS identifier FROM part")
def csv_guard(spark, sf_dir):
    key, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    name = F.when(key % 3 == 0, F.concat(F.lit("="), "p_name")).when(key % 3 == 1, F.concat(F.lit("@"), "p_name")).otherwise(F.col("p_name"))
    shown = output.identifier(F.when(key % 2 == 0, n).otherwise(""), F.when(key % 3 == 0, n))
    return table(spark, sf_dir, "part").select("p_partkey", output.csv_guarded(name).alias("name"), shown.alias("identifier"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most cited persons of all bibliographies together."""
    rows = _persons(spark, sf_dir).groupBy("key").agg(F.sum("full_count").alias("cited_works"), F.round(F.sum("fractional_count"), 6).alias("fractional_count"))
    return rows.orderBy(F.desc("cited_works"), F.desc("fractional_count"), "key").limit(25)
