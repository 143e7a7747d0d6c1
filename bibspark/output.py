"""Rankings and audit trails for people and programs.

Only a ranking's rows, cut to its top, reach the driver; the audit is written by Spark unless a
single document is asked for.
"""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.operators.keys import join_same
from bibspark.operators.people import hidden_authors
from bibspark.plans.analysis import Analysis

RISKY = r"^[=+\-@\t\r]"
CSV_COLUMNS = ("rank", "name", "cited_works", "fractional_count", "share_of_matched_works", "orcid", "openalex_id", "aliases")
COUNTERS = ("input_references", "matched_references", "ambiguous_references", "unmatched_references", "errored_references", "duplicate_references", "distinct_matched_works", "ranked_people", "et_al_references", "hidden_authors_expanded")


def csv_guarded(text: Column) -> Column:
    """A text that no spreadsheet takes for a formula."""
    return F.when(text.rlike(RISKY), F.concat(F.lit("'"), text)).otherwise(text)


def identifier(orcid: Column, openalex_id: Column) -> Column:
    """The identifier to show."""
    told = lambda p, c: F.concat(F.lit(p), F.nullif(c, F.lit("")))
    return F.coalesce(told("ORCID ", orcid), told("OpenAlex ", openalex_id), F.lit(""))


def person_records(analysis: Analysis, ranking: str | None = None, top: int | None = 0) -> DataFrame:
    """Ranked people as records: aliases without the displayed name, numbers rounded to six."""
    rows = join_same(analysis.ranking(ranking, top), analysis.summary.select("bib_id", "distinct_matched_works"), ["bib_id"])
    works = F.col("distinct_matched_works")
    share = F.when(works > 0, F.col("full_count") / works).otherwise(0.0)
    return rows.select(
        "bib_id",
        "rank",
        "key",
        F.col("display_name").alias("name"),
        F.array_except("aliases", F.array("display_name")).alias("aliases"),
        F.col("full_count").alias("cited_works"),
        F.round("fractional_count", 6).alias("fractional_count"),
        F.round(share, 6).alias("share_of_matched_works"),
        "orcid",
        "openalex_id",
        identifier(F.col("orcid"), F.col("openalex_id")).alias("identifier"),
        F.col("fractional_count").alias("_fraction"),
        share.alias("_share"),
    )


def resolution_records(resolutions: DataFrame) -> DataFrame:
    """The audit trail: a record for each reference."""
    six = lambda c: F.round(c, 6)
    scores = ("score", "title_score", "author_score", "year_score", "venue_score")
    other = F.transform(
        "alternatives",
        lambda c: F.struct(c["work"]["id"].alias("work_id"), *(c["work"][n].alias(n) for n in ("title", "year", "doi", "provider")), *(six(c[s]).alias(s) for s in scores)),
    )
    author = lambda a: F.struct(a["display_name"].alias("name"), *(a[n].alias(n) for n in ("given", "family", "orcid", "openalex_id", "is_collective")))
    w = F.col("work")
    matched = F.when(w.isNotNull(), F.struct(*(w[n].alias(n) for n in ("id", "title", "year", "doi", "venue", "provider", "source_url")), F.transform(w["authors"], author).alias("authors")))
    return resolutions.select(
        "bib_id",
        "index",
        "raw",
        "status",
        six(F.col("confidence")).alias("confidence"),
        "method",
        "reason",
        F.col("doi").alias("input_doi"),
        F.col("years").alias("input_years"),
        "visible_surnames",
        F.col("has_et_al").alias("had_et_al"),
        hidden_authors(w, F.col("has_et_al"), F.col("visible_surnames")).alias("hidden_authors_expanded"),
        "duplicate_of",
        "provider_errors",
        matched.alias("matched_work"),
        other.alias("alternatives"),
    )


def write_audit(analysis: Analysis, path: str) -> None:
    """All resolutions as JSON lines, by Spark, for any number of bibliographies."""
    resolution_records(analysis.resolutions).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(analysis: Analysis, path: str, ranking: str | None = None, top: int = 0) -> None:
    """The rankings as CSV files, by Spark: a folder for each bibliography, rows by rank.

    A bibliography's rows are in one file, since its ranking is ordered in one task anyway;
    bibliographies are spread over tasks.
    """
    rows = csv_rows(analysis, ranking, top).repartition("bib_id").sortWithinPartitions("bib_id", "rank")
    rows.write.mode("overwrite").partitionBy("bib_id").option("header", True).option("escape", '"').csv(path)


def csv_rows(analysis: Analysis, ranking: str | None = None, top: int | None = 0) -> DataFrame:
    rows = person_records(analysis, ranking, top)
    exact = lambda c: F.col(c).cast("decimal(38,6)").cast("string")
    return rows.select(
        "bib_id",
        "rank",
        csv_guarded(F.col("name")).alias("name"),
        "cited_works",
        exact("fractional_count").alias("fractional_count"),
        exact("share_of_matched_works").alias("share_of_matched_works"),
        F.coalesce("orcid", F.lit("")).alias("orcid"),
        F.coalesce("openalex_id", F.lit("")).alias("openalex_id"),
        csv_guarded(F.array_join("aliases", " | ")).alias("aliases"),
    )


def _people(analysis: Analysis, bib_id: int, ranking: str, top: int) -> list[dict]:
    rows = person_records(analysis, ranking, top).where(F.col("bib_id") == bib_id).orderBy("rank")
    return [r.asDict(recursive=True) for r in rows.collect()]


def document(analysis: Analysis, bib_id: int, ranking: str = "full", top: int = 0, audit: bool = True) -> dict:
    """One bibliography's whole result as one document."""
    of = F.col("bib_id") == bib_id
    summary = analysis.summary.where(of).first()
    hidden = ("bib_id", "rank", "identifier", "_fraction", "_share")
    people = [{k: v for k, v in p.items() if k not in hidden} for p in _people(analysis, bib_id, ranking, top)]
    references = None
    if audit:
        references = [{k: v for k, v in r.asDict(recursive=True).items() if k != "bib_id"} for r in resolution_records(analysis.resolutions.where(of)).orderBy("index").collect()]
    told = [r["warning"] for r in analysis.warnings.where(of).orderBy("index").collect()]
    return {"summary": {c: summary[c] if summary else 0 for c in COUNTERS}, "ranking_mode": ranking, "people": people, "references": references, "warnings": told}


def render(analysis: Analysis, stream: TextIO, output_format: str = "table", bib_id: int = 1, ranking: str = "full", top: int = 25) -> None:
    """One bibliography as ``table``, ``json``, ``csv`` or ``markdown``."""
    if output_format == "json":
        stream.write(json.dumps(document(analysis, bib_id, ranking, top), ensure_ascii=False, indent=2) + "\n")
    elif output_format == "csv":
        out = csv.DictWriter(stream, CSV_COLUMNS, lineterminator="\n", extrasaction="ignore")
        out.writeheader()
        rows = csv_rows(analysis, ranking, top).where(F.col("bib_id") == bib_id).orderBy("rank")
        out.writerows(r.asDict() for r in rows.collect())
    elif output_format in ("table", "markdown"):
        rows = [[p["rank"], p["name"], p["cited_works"], f"{p['_fraction']:.3f}", f"{p['_share']:.1%}", p["identifier"]] for p in _people(analysis, bib_id, ranking, top)]
        head = ["Rank", "Person", "Cited works", "Fractional", "Share", "Identifier"]
        if output_format == "markdown":
            lines = [head, ["---:", "---", "---:", "---:", "---:", "---"], *([r[0], r[1].replace("|", "\\|"), *r[2:]] for r in rows)]
            stream.writelines("| " + " | ".join(map(str, x)) + " |\n" for x in lines)
        else:
            cells = [[str(c) for c in r] for r in [head, *rows]]
            widths = [max(map(len, c)) for c in zip(*cells, strict=True)]
            stream.writelines("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in cells)
    else:
        raise ValueError(f"unknown format {output_format}")


def write_audit_document(analysis: Analysis, bib_id: int, path: Path) -> None:
    """The full ranking and the audit of one bibliography as one JSON file."""
    text = io.StringIO()
    render(analysis, text, "json", bib_id, "full", 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text.getvalue(), encoding="utf-8")


def summary_line(s: dict) -> str:
    """The counters in a sentence."""
    return (
        f"{s['input_references']} references: {s['matched_references']} matched, {s['ambiguous_references']} ambiguous, "
        f"{s['unmatched_references']} unmatched, {s['errored_references']} with errors; {s['distinct_matched_works']} works, "
        f"{s['hidden_authors_expanded']} hidden authors found"
    )
