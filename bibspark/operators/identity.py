"""Who is who: author identities within a bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.text import normalize_name, normalize_orcid, short_openalex_id, stripped
from bibspark.operators.components import connected_components
from bibspark.operators.keys import spread
from bibspark.staging import staged

AUTHORSHIP = ["bib_id", "index", "pos"]


def strong_keys(author: str = "author") -> Column:
    """The author record's identifiers, strongest first: ORCID, then catalogue, then provider.

    Each is prefixed by its rank, so that the least key of a set is its canonical one.
    """
    orcid, openalex = normalize_orcid(F.col(f"{author}.orcid")), short_openalex_id(F.col(f"{author}.openalex_id"))
    provider = F.nullif(stripped(F.col(f"{author}.provider_id")), F.lit(""))
    keys = F.array(F.concat(F.lit("0orcid:"), orcid), F.concat(F.lit("1openalex:"), openalex), F.concat(F.lit("2provider:"), provider))
    return F.filter(keys, lambda k: k.isNotNull())


def person_keys(authorships: DataFrame) -> DataFrame:
    """Adds ``key`` and ``name`` (normalised) to rows of bib_id, index, pos and ``author``.

    Identifiers on one record are the same person, transitively. A record without any takes the
    identity that its name has in the bibliography, if it has exactly one, else its name. Only
    records of two or more identifiers are edges, so the graph stays small; nodes carry their
    bibliography, whose identities are its own.
    """
    # read three times below: for edges, for names' owners, and for the result
    rows = staged(authorships.withColumns({"ids": strong_keys(), "name": normalize_name(F.col("author.display_name"))}), "identity-rows")
    node = lambda k: F.concat(F.coalesce(F.col("bib_id").cast("string"), F.lit("")), F.lit("\x01"), k)
    rows = rows.withColumn("node", node(F.get("ids", F.lit(0))))
    pairs = rows.where(F.size("ids") > 1).select("node", F.explode(F.slice("ids", 2, 2)).alias("other"), "bib_id")
    roots = connected_components(pairs.select("node", node(F.col("other")).alias("other")), "node", "other", name="identity")
    roots = roots.select(F.col("node").alias("_node"), "root")
    rows = rows.withColumn("_spread", spread("node", *AUTHORSHIP)).join(roots, F.col("_spread") == F.col("_node"), "left").drop("_node", "_spread")
    bare = lambda n: F.substring(F.substring_index(n, "\x01", -1), F.lit(2), F.lit(1 << 30))
    rows = rows.withColumn("own", bare(F.coalesce("root", "node")))
    known = rows.where("own is not null").groupBy(F.col("bib_id").alias("_bib"), F.col("name").alias("_name"))
    known = known.agg(F.min("own").alias("_least"), F.max("own").alias("_most")).where("_least = _most")
    rows = rows.join(known, F.col("bib_id").eqNullSafe(F.col("_bib")) & F.col("name").eqNullSafe(F.col("_name")) & F.col("own").isNull(), "left")
    return rows.withColumn("key", F.coalesce("own", "_least", F.concat(F.lit("name:"), F.coalesce("name", F.lit(""))))).drop("ids", "node", "root", "own", "_bib", "_name", "_least", "_most")
