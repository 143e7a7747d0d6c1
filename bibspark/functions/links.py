"""DOIs from paper links, and deposited references as citation strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions.features import extract_doi
from bibspark.functions.text import normalize_doi, stripped
from bibspark.sources.payload import text_at

_WHOLE = r"^10\.\d{4,9}/\S+$"
_IN_TEXT = r"(?i)(10\.\d{4,9}/[^\s?#]+)"


def _decoded(text: Column, plus_is_space: bool = False) -> Column:
    """URL-decoded, or as it is where that fails; a plus sign stays in paths and fragments."""
    kept = text if plus_is_space else F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(kept), text)


def _whole(text: Column) -> Column:
    bare = F.regexp_replace(stripped(text), r"(?i)^(?:https?://(?:dx[.])?doi[.]org/|doi:\s*)", "")
    doi = F.lower(F.regexp_replace(bare, "^/+", ""))
    return F.when(doi.rlike(_WHOLE), doi)


def doi_from_link(link: Column) -> Column:
    """The DOI that an http(s) link names; null for bare DOIs, other schemes and other links.

    A doi.org link names it by its path; any other link by its path, a query value or its
    fragment, in this order, after decoding.
    """
    link = stripped(link)
    parts = lambda k: F.regexp_extract(link, r"(?is)^https?://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    host, path = F.lower(parts(1)), _decoded(parts(2))
    at_doi = F.regexp_replace(host, r"^.*@|:\d+$", "").isin("doi.org", "dx.doi.org")
    direct = _whole(F.regexp_replace(path, "^/+", ""))
    values = F.transform(F.split(parts(3), "&"), lambda q: _decoded(F.regexp_replace(q, "^[^=]*=?", ""), True))
    found = F.transform(F.concat(F.array(path), values, F.array(_decoded(parts(4)))), lambda t: _whole(F.nullif(F.regexp_extract(t, _IN_TEXT, 1), F.lit(""))))
    other = F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))
    return F.when(host != "", F.when(at_doi, direct).otherwise(other))


def citation(reference: Column) -> Column:
    """A deposited reference (VARIANT) as a citation string; null if it identifies nothing.

    Its own text is used as it is, after its DOI's URL unless it has that DOI. Else the parts
    are joined, given a title or both author and year.
    """
    field = lambda n: F.nullif(F.regexp_replace(stripped(text_at(reference, f"$['{n}']")), r"(?U)\s+", " "), F.lit(""))
    doi = _whole(text_at(reference, "$.DOI"))
    url = F.concat(F.lit("https://doi.org/"), doi)
    own = field("unstructured")
    names = ("article-title", "volume-title", "journal-title", "series-title", "volume", "issue", "first-page")
    author, year = field("author"), field("year")
    parts = [author, F.concat(F.lit("("), year, F.lit(")")), *(field(n) for n in names)]
    bare = F.filter(F.transform(F.array(*parts), lambda p: F.regexp_replace(p, r"(?U)[.\s]+$", "")), lambda p: p.isNotNull() & (p != ""))
    told = field("article-title").isNotNull() | field("volume-title").isNotNull() | (author.isNotNull() & year.isNotNull())
    joined = F.when(told, F.nullif(F.array_join(bare, ". "), F.lit("")))
    same = F.coalesce(extract_doi(own) == doi, F.lit(False))
    return F.when(own.isNotNull(), F.when(doi.isNotNull() & ~same, F.concat_ws(" ", url, own)).otherwise(own)).otherwise(F.nullif(F.concat_ws(" ", url, joined), F.lit("")))


def paper_references(papers: DataFrame, item: str = "item", key: str = "bib_id") -> tuple[DataFrame, DataFrame]:
    """Citations (bib_id, index, raw) of deposited papers, and a row for each paper.

    The second has doi, title, skipped_references and error: ``no_references`` where none are
    deposited, ``malformed`` where the payload or its list is something else.
    """
    rows = papers.select(F.col(key).alias("bib_id"), F.try_parse_json(item).alias("p"))
    listed = F.try_variant_get("p", "$.reference", "array<variant>")
    absent = F.try_variant_get("p", "$.reference", "variant").isNull() | F.coalesce(F.is_variant_null(F.try_variant_get("p", "$.reference", "variant")), F.lit(False))
    rows = rows.withColumns({"listed": listed, "absent": absent, "object": F.coalesce(F.schema_of_variant("p").startswith("OBJECT"), F.lit(False))})
    each = rows.select("bib_id", F.posexplode("listed").alias("at", "r")).select("bib_id", "at", citation(F.col("r")).alias("raw"))
    so_far = Window.partitionBy("bib_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = each.withColumn("before", F.count("raw").over(so_far))
    citations = numbered.where("raw is not null").select("bib_id", F.col("before").cast("int").alias("index"), "raw")
    skipped = each.groupBy("bib_id").agg(F.count_if(F.col("raw").isNull()).alias("skipped_references"), F.count("raw").alias("n"))
    title = F.coalesce(text_at(F.col("p"), "$.title[0]"), text_at(F.col("p"), "$.title"), F.lit("Untitled work"))
    told = rows.join(skipped, "bib_id", "left")
    error = F.when(~F.col("object"), "malformed").when(F.col("absent"), "no_references").when(F.col("listed").isNull(), "malformed").when(F.coalesce("n", F.lit(0)) == 0, "no_references")
    return citations, told.select("bib_id", normalize_doi(text_at(F.col("p"), "$.DOI")).alias("doi"), title.alias("title"), F.coalesce("skipped_references", F.lit(0)).cast("long").alias("skipped_references"), error.alias("error"))
