"""From resolutions to counts of people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions.text import casefolded, stable_work_key
from bibspark.operators.identity import person_keys
from bibspark.operators.keys import join_same
from bibspark.staging import staged

UNKNOWN = "Unknown author"


def hidden_authors(work: Column, et_al: Column, visible: Column) -> Column:
    """Authors that a reference hid behind et al. and its work shows."""
    hidden = F.size(work["authors"]) - F.greatest(F.lit(1), F.size(visible))
    return F.when(work.isNotNull() & et_al, F.greatest(F.lit(0), hidden)).otherwise(0)


def include(resolutions: DataFrame, deduplicate: bool = True) -> DataFrame:
    """Resolutions with work_key, duplicate_of and whether they count.

    The first matched reference of a work counts; later ones name it.
    """
    rows = resolutions.withColumn("work_key", F.when(F.col("status") == "matched", stable_work_key(F.col("work.id"), F.col("work.doi"))))
    rows = rows.drop("duplicate_of")
    if not deduplicate:
        return rows.withColumns({"duplicate_of": F.lit(None).cast("int"), "included": F.col("work_key").isNotNull()})
    # rows that don't match share no key: they are spread by their index
    same = Window.partitionBy("bib_id", "work_key", F.when(F.col("work_key").isNull(), F.col("index")))
    rows = rows.withColumn("_first", F.min("index").over(same))
    later = F.col("work_key").isNotNull() & (F.col("index") > F.col("_first"))
    return rows.withColumns({"duplicate_of": F.when(later, F.col("_first")).cast("int"), "included": F.col("work_key").isNotNull() & ~later}).drop("_first")


def authorships(included: DataFrame, collectives: bool = False) -> DataFrame:
    """A row for each countable author record of each included work."""
    rows = included.where("included").select("bib_id", "index", "work_key", F.posexplode("work.authors").alias("pos", "author"))
    return rows if collectives else rows.where(~F.coalesce("author.is_collective", F.lit(False)))


def credited(keyed: DataFrame) -> DataFrame:
    """The first record of each person in each work, with the work's number of persons.

    Rows are dealt by work once, for both windows.
    """
    keyed = keyed.repartition("bib_id", "index")
    first = Window.partitionBy("bib_id", "index", "key").orderBy("pos")
    rows = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumn("persons", F.count(F.lit(1)).over(Window.partitionBy("bib_id", "index")))


def people(credits: DataFrame) -> DataFrame:
    """key, display_name, folded_name, aliases, work_ids, counts and identifiers of each person.

    Credits are read once: they are summed by person, name and number of co-authors, then by
    person. Fractions are added by denominator, least first: the same sum on any cluster.
    """
    seen = F.struct("index", "pos")
    own = lambda c: F.when(F.nullif(F.col(f"author.{c}"), F.lit("")).isNotNull(), F.struct("index", "pos", F.col(f"author.{c}").alias("value")))
    names = credits.groupBy("bib_id", "key", F.col("author.display_name").alias("shown"), "persons").agg(
        F.count(F.lit(1)).alias("n"), F.min(seen).alias("seen"), F.collect_set("work_key").alias("works"), F.min(own("orcid")).alias("orcid"), F.min(own("openalex_id")).alias("openalex_id")
    )
    # one more pass gathers a person: a row for each name and number of co-authors
    each = F.struct("persons", "n", "shown", casefolded("shown").alias("folded"), "seen", "works")
    rows = names.groupBy("bib_id", "key").agg(
        F.array_sort(F.collect_list(each)).alias("all"), F.sum("n").alias("full_count"), F.min("seen").alias("first_seen"), F.min("orcid").alias("orcid"), F.min("openalex_id").alias("openalex_id")
    )
    aliases = F.array_sort(F.array_distinct(F.transform("all", lambda x: x["shown"])))

    def ranked_name(name: Column) -> Column:
        rows = F.filter("all", lambda x: x["shown"].eqNullSafe(name))
        first = F.array_min(F.transform(rows, lambda x: x["seen"]))
        count = F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.struct(count.alias("n"), F.length(name).alias("length"), rows[0]["folded"].alias("folded"), (-first["index"]).alias("index"), (-first["pos"]).alias("pos"), name.alias("shown"))

    # the sum over denominators, least first; rows are sorted by them
    state = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("persons"))
    add = lambda a: a["total"] + a["n"] / a["persons"]
    fraction = F.aggregate(
        "all",
        state,
        lambda a, x: F.when(a["persons"] == x["persons"], F.struct(a["total"].alias("total"), (a["n"] + x["n"]).alias("n"), a["persons"].alias("persons"))).otherwise(F.struct(add(a).alias("total"), x["n"].alias("n"), x["persons"].alias("persons"))),
        add,
    )
    best = F.array_max(F.transform("aliases", ranked_name))
    works = F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: x["works"]))))
    rows = rows.withColumn("aliases", F.filter(aliases, lambda x: x.isNotNull())).withColumn("best", best)
    named = F.nullif("best.shown", F.lit("")).isNotNull()
    return rows.select(
        "bib_id",
        "key",
        F.when(named, F.col("best.shown")).otherwise(UNKNOWN).alias("display_name"),
        F.when(named, F.col("best.folded")).otherwise(UNKNOWN.casefold()).alias("folded_name"),
        "aliases",
        works.alias("work_ids"),
        "full_count",
        fraction.alias("fractional_count"),
        F.col("orcid.value").alias("orcid"),
        F.col("openalex_id.value").alias("openalex_id"),
        "first_seen",
    )


def ranking_order(ranking: str = "full") -> list[Column]:
    """Counts downwards, then folded names, then who was seen first."""
    counts = [F.desc("full_count"), F.desc("fractional_count")]
    if ranking == "fractional":
        counts.reverse()
    elif ranking != "full":
        raise ValueError("ranking must be full or fractional")
    return [*counts, F.asc("folded_name"), F.asc("first_seen")]


def ranked(persons: DataFrame, ranking: str = "full", top: int = 0) -> DataFrame:
    """Adds ``rank`` within each bibliography; ``top`` of 0 keeps all."""
    order = Window.partitionBy("bib_id").orderBy(*ranking_order(ranking))
    rows = persons.withColumn("rank", F.row_number().over(order)).drop("folded_name")
    return rows.where(F.col("rank") <= top) if top > 0 else rows


def top_people(persons: DataFrame, ranking: str = "full", top: int = 25) -> DataFrame:
    """The top of a single bibliography, without a sort of the rest."""
    return persons.orderBy(*ranking_order(ranking)).limit(top).drop("folded_name")


def share(persons: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds the share of the bibliography's distinct matched works."""
    works = summary.select("bib_id", "distinct_matched_works")
    rows = join_same(persons, works, ["bib_id"])
    return rows.withColumn("share", F.when(F.col("distinct_matched_works") > 0, F.col("full_count") / F.col("distinct_matched_works")).otherwise(0.0)).drop("distinct_matched_works")


def warnings(included: DataFrame, collectives: bool = False) -> DataFrame:
    """A warning for each included work without a countable author."""
    countable = F.col("work.authors") if collectives else F.filter("work.authors", lambda a: ~F.coalesce(a["is_collective"], F.lit(False)))
    rows = included.where(F.col("included") & (F.size(countable) <= 0))
    text = F.concat(F.lit("Reference "), F.col("index").cast("string"), F.lit(" matched '"), F.col("work.title"), F.lit("' but had no countable authors"))
    return rows.select("bib_id", "index", text.alias("warning"))


def counters(included: DataFrame) -> DataFrame:
    """The counters of each bibliography that need no people."""
    count = lambda c, name: F.count_if(c).alias(name)
    return included.groupBy("bib_id").agg(
        F.count(F.lit(1)).alias("input_references"),
        *(count(F.col("status") == s, f"{n}_references") for s, n in (("matched", "matched"), ("ambiguous", "ambiguous"), ("unmatched", "unmatched"), ("error", "errored"))),
        count(F.col("duplicate_of").isNotNull(), "duplicate_references"),
        count(F.col("included"), "distinct_matched_works"),
        count(F.col("has_et_al"), "et_al_references"),
        F.sum(hidden_authors(F.col("work"), F.col("has_et_al"), F.col("visible_surnames"))).cast("long").alias("hidden_authors_expanded"),
    )


def summary(included: DataFrame, persons: DataFrame) -> DataFrame:
    """Ten counters for each bibliography, over all its resolutions."""
    rows = counters(included)
    ranks = persons.groupBy("bib_id").agg(F.count(F.lit(1)).alias("ranked_people"))
    return join_same(rows, ranks, ["bib_id"], "left").withColumn("ranked_people", F.coalesce("ranked_people", F.lit(0)).cast("long"))


def aggregate(resolutions: DataFrame, deduplicate: bool = True, collectives: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Resolutions with duplicates told, people, summary and warnings."""
    marked = include(resolutions, deduplicate)
    # ranking, shares and summary all read the people
    persons = staged(people(credited(person_keys(authorships(marked, collectives)))), "people")
    return marked, persons, summary(marked, persons), warnings(marked, collectives)
