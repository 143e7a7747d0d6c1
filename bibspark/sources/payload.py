"""Catalogue payloads (JSON) as works, field by field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.text import collective_names, last_token, normalize_doi, normalize_orcid, short_openalex_id, stripped
from bibspark.schemas import AUTHOR, AUTHOR_FIELDS, WORK

DATES = ("published-print", "published-online", "published", "issued", "created")
UNTITLED = "Untitled work"


def _get(payload: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(payload, path, kind)


def text_at(payload: Column, path: str) -> Column:
    """A string field; null if it is missing or something else."""
    return F.when(F.schema_of_variant(_get(payload, path, "variant")) == "STRING", _get(payload, path, "string"))


def integer_at(payload: Column, path: str) -> Column:
    """A whole number; null if it is missing or something else."""
    return F.when(F.schema_of_variant(_get(payload, path, "variant")) == "BIGINT", _get(payload, path, "int"))


def _shown(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))


def first_string(payload: Column, path: str) -> Column:
    """The string, or the first of a list that isn't blank; stripped."""
    listed = _get(payload, path, "array<variant>")
    texts = F.transform(listed, lambda v: _shown(text_at(v, "$")))
    return F.coalesce(_shown(text_at(payload, path)), F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0)))


def date_year(payload: Column) -> Column:
    """The year of the first of the payload's dates that has one."""
    return F.coalesce(*(integer_at(payload, f"$['{d}']['date-parts'][0][0]") for d in DATES))


def hashed_id(provider: str, title: Column, year: Column, venue: Column) -> Column:
    text = F.concat_ws("|", title, F.coalesce(year.cast("string"), F.lit("None")), F.coalesce(venue, F.lit("")))
    return F.concat(F.lit(f"{provider}:"), F.substring(F.sha2(text, 256), 1, 20))


def _authors(listed: Column, fields: Callable[[Column], dict[str, Column]], collective: Callable[[Column], Column]) -> Column:
    """The authors that have a name, in order; nothing leaves the row."""
    rows = F.transform(F.coalesce(listed, F.array().cast("array<variant>")), lambda a: F.struct(*(c.alias(n) for n, c in fields(a).items())))
    named = F.filter(rows, lambda a: a["display_name"].isNotNull())
    return F.transform(named, lambda a: F.struct(*(a[n].alias(n) for n in AUTHOR_FIELDS), collective(a).alias("is_collective"))).cast(f"array<{AUTHOR}>")


def _collective_flags(names: Column) -> Column:
    """Whether each name of an array tells of a group of people; one call for all of a row."""
    return collective_names(F.coalesce(names, F.array().cast("array<string>")))


def primary_works(payloads: DataFrame, item: str = "item", key: str = "payload_id") -> DataFrame:
    """key and work of each payload of the primary catalogue; ``item`` is a JSON string.

    Each row is read by itself: payloads of the same key stay apart.

    A payload that is no JSON object gives a null work (the caller's provider error).
    """
    rows = payloads.select(key, F.try_parse_json(item).alias("p"))
    rows = rows.withColumn("p", F.when(F.schema_of_variant("p").startswith("OBJECT"), F.col("p")))

    def fields(a: Column) -> dict[str, Column]:
        given, family, name = (text_at(a, f"$.{n}") for n in ("given", "family", "name"))
        full = F.nullif(F.concat_ws(" ", _shown(given), _shown(family)), F.lit(""))
        grouped = name.isNotNull() & (name != "")
        return {
            "display_name": F.when(grouped, _shown(name)).otherwise(full),
            "given": F.when(given != "", stripped(given)),
            "family": F.when(family != "", stripped(family)),
            "orcid": normalize_orcid(text_at(a, "$.ORCID")),
            "openalex_id": F.lit(None).cast("string"),
            "provider_id": F.lit(None).cast("string"),
            "named": F.coalesce(grouped, F.lit(False)),
        }

    p = F.col("p")
    rows = rows.withColumn("authors", _authors(_get(p, "$.author", "array<variant>"), fields, lambda a: a["named"]))
    flags = _collective_flags(F.col("authors.display_name"))
    rows = rows.withColumn("flags", flags).withColumn("authors", F.zip_with("authors", "flags", lambda a, f: a.withField("is_collective", a["is_collective"] | F.coalesce(f, F.lit(False)))).cast(f"array<{AUTHOR}>"))
    rows = rows.withColumns({"doi": normalize_doi(text_at(p, "$.DOI")), "title": F.coalesce(first_string(p, "$.title"), F.lit(UNTITLED)), "year": date_year(p), "venue": first_string(p, "$['container-title']"), "url": first_string(p, "$.URL")})
    work = F.struct(
        F.coalesce(F.concat(F.lit("doi:"), "doi"), hashed_id("crossref", F.col("title"), F.col("year"), F.col("venue"))).alias("id"),
        "title",
        "authors",
        F.lit("crossref").alias("provider"),
        "year",
        "doi",
        "venue",
        F.coalesce(F.concat(F.lit("https://doi.org/"), "doi"), "url").alias("source_url"),
    ).cast(WORK)
    return rows.select(key, F.when(p.isNotNull(), work).alias("work"))


def secondary_works(payloads: DataFrame, item: str = "item", key: str = "payload_id") -> DataFrame:
    """key and work of each payload of the secondary catalogue."""
    rows = payloads.select(key, F.try_parse_json(item).alias("p"))
    rows = rows.withColumn("p", F.when(F.schema_of_variant("p").startswith("OBJECT"), F.col("p")))

    def fields(a: Column) -> dict[str, Column]:
        name = _shown(text_at(a, "$.author.display_name"))
        family = last_token(name)
        return {
            "display_name": name,
            "given": F.nullif(stripped(F.substring(name, F.lit(1), F.length(name) - F.length(family))), F.lit("")),
            "family": family,
            "orcid": normalize_orcid(text_at(a, "$.author.orcid")),
            "openalex_id": short_openalex_id(text_at(a, "$.author.id")),
            "provider_id": F.lit(None).cast("string"),
        }

    p = F.col("p")
    rows = rows.withColumn("authors", _authors(_get(p, "$.authorships", "array<variant>"), fields, lambda a: F.lit(False)))
    title = F.coalesce(_shown(F.coalesce(F.nullif(text_at(p, "$.display_name"), F.lit("")), text_at(p, "$.title"))), F.lit(UNTITLED))
    rows = rows.withColumns({"title": title, "doi": normalize_doi(text_at(p, "$.doi")), "short": short_openalex_id(text_at(p, "$.id")), "year": integer_at(p, "$.publication_year"), "venue": _shown(text_at(p, "$.primary_location.source.display_name"))})
    work = F.struct(
        F.coalesce(F.concat(F.lit("openalex:"), "short"), F.concat(F.lit("doi:"), "doi"), hashed_id("openalex", F.col("title"), F.col("year"), F.col("venue"))).alias("id"),
        "title",
        "authors",
        F.lit("openalex").alias("provider"),
        "year",
        "doi",
        "venue",
        F.coalesce(F.concat(F.lit("https://openalex.org/"), "short"), F.concat(F.lit("https://doi.org/"), "doi")).alias("source_url"),
    ).cast(WORK)
    return rows.select(key, F.when(p.isNotNull(), work).alias("work"))
