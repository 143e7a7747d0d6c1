"""Scores of candidates, and the gates that a match must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions.similarity import author_similarity, combined_score, partial_ratio, token_set_ratio, year_similarity
from bibspark.functions.text import family_name, normalize_doi, normalize_text, stable_work_key
from bibspark.operators.keys import join_same
from bibspark.schemas import MISSING, MatchConfig

KEY = ["bib_id", "index"]
SCORES = ("score", "title_score", "author_score", "year_score", "venue_score")


def work_surnames(work: Column) -> Column:
    """Normalised surnames of a work's authors as a set."""
    shown = F.filter(work["authors"], lambda a: a["display_name"] != "")
    joined = F.array_join(F.transform(shown, family_name), " _0_ ")
    parts = F.split(normalize_text(joined), "(?:^| )_0_(?: |$)")
    return F.array_distinct(F.filter(F.transform(parts, lambda s: F.replace(s, F.lit(" "), F.lit(""))), lambda s: s != ""))


def score(candidates: DataFrame) -> DataFrame:
    """Adds the scores to rows of reference columns and ``work``.

    Texts are normalised once into columns before they are compared. Equal DOIs score 1 in
    every part.
    """
    w = F.col("work")
    rows = candidates.withColumns(
        {
            "_title": normalize_text(w["title"]),
            "_raw": normalize_text(F.col("raw")),
            "_venue": normalize_text(F.nullif(w["venue"], F.lit(""))),
            "_present": work_surnames(w),
            "_same": F.coalesce(F.col("doi") == normalize_doi(w["doi"]), F.lit(False)),
        }
    )
    rows = rows.withColumns(
        {
            "title_score": F.when((F.col("_title") != "") & (F.col("_raw") != ""), token_set_ratio(F.col("_title"), F.col("_raw"))).otherwise(0.0),
            "author_score": author_similarity(F.col("visible_surnames"), F.col("_present")),
            "year_score": year_similarity(F.col("years"), w["year"]),
            "venue_score": F.when((F.col("_venue") != "") & (F.col("_raw") != ""), partial_ratio(F.col("_venue"), F.col("_raw"))),
        }
    )
    rows = rows.withColumn("score", combined_score(*(F.col(c) for c in ("title_score", "author_score", "year_score", "venue_score"))))
    exact = {c: F.when(F.col("_same"), 1.0).otherwise(F.col(c)) for c in SCORES}
    return rows.withColumns(exact).withColumn("doi_matches", F.col("_same")).drop("_title", "_raw", "_venue", "_present", "_same")


def deduplicate(scored: DataFrame) -> DataFrame:
    """One candidate of each work key: the best, the first on a tie, in the key's first place."""
    key = stable_work_key(F.col("work.id"), F.col("work.doi"))
    same = Window.partitionBy(*KEY, "_key")
    rows = scored.withColumn("_key", key)
    rows = rows.withColumns({"_best": F.row_number().over(same.orderBy(F.desc("score"), "pos")), "first_pos": F.min("pos").over(same)})
    return rows.where("_best = 1").drop("_best", "_key")


def decide(references: DataFrame, scored: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """A decision for each reference: accepted, ambiguous, reason, best, alternatives.

    Alternatives are the first few candidates by score, title score and place.
    """
    config = config or MatchConfig()
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), F.desc("title_score"), "first_pos")
    ranked = deduplicate(scored).withColumns({"rank": F.row_number().over(order), "next": F.lead("score").over(order)})
    top = ranked.where(F.col("rank") <= config.alternatives)
    candidate = F.struct("work", *SCORES)
    found = top.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("rank", candidate.alias("c")))).alias("_top"),
        F.max(F.when(F.col("rank") == 1, F.struct("score", "title_score", "doi_matches", "next"))).alias("_first"),
    )
    rows = join_same(references.select(*KEY), found, KEY, "left")
    best, margin = F.col("_first"), F.col("_first.score") - F.col("_first.next")
    low, poor = best["score"] < config.min_confidence, (best["title_score"] < 0.55) & ~best["doi_matches"]
    close = F.coalesce(margin < config.min_margin, F.lit(False))
    shown = lambda x: F.format_string("%.3f", x)
    reason = (
        F.when(best.isNull(), MISSING)
        .when(low, F.concat(F.lit("Best candidate confidence "), shown(best["score"]), F.lit(f" is below {config.min_confidence:.3f}")))
        .when(poor, F.concat(F.lit("Best candidate title similarity "), shown(best["title_score"]), F.lit(" is too low")))
        .when(close, F.concat(F.lit("Top candidates are separated by only "), shown(margin)))
        .otherwise("Candidate passed confidence gates")
    )
    passes = best.isNotNull() & ~low & ~poor
    return rows.select(
        *KEY,
        F.coalesce(passes & ~close, F.lit(False)).alias("accepted"),
        F.coalesce(passes & close, F.lit(False)).alias("ambiguous"),
        reason.alias("reason"),
        F.transform("_top", lambda t: t["c"])[0].alias("best"),
        F.coalesce(F.transform("_top", lambda t: t["c"]), F.array()).alias("alternatives"),
    )
