"""Resolution of references against one or two catalogues of works."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.text import normalize_doi
from bibspark.operators.candidates import lookup, search
from bibspark.operators.keys import join_same, spread
from bibspark.operators.matching import KEY, decide, score
from bibspark.operators.merge import merge_works
from bibspark.schemas import CANDIDATE, WORK, MatchConfig
from bibspark.staging import staged

REFERENCE = [*KEY, "raw", "doi", "years", "visible_surnames", "has_et_al"]


class CandidateSource(Protocol):
    """What resolution needs of a catalogue: a stored table, a service, or another's own class."""

    label: str

    def look_up(self, rows: DataFrame, doi: str, out: str, label: str) -> DataFrame:
        """Rows with the work of the DOI in column ``doi`` as ``out``, and ``_error``."""

    def find(self, rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """Rows with ``_error``, and bib_id, index, pos (from 1) and work of candidates."""


#: Called with the references that are settled so far and with all.
Progress = Callable[[int, int], None]


@dataclass(frozen=True)
class Catalogue:
    """A table of works (column ``work``) with what failed to be read from its service.

    ``lookup_errors`` has doi and error, ``search_errors`` raw and error, a row for each failed
    request; such a request finds nothing.
    """

    label: str
    works: DataFrame
    lookup_errors: DataFrame | None = None
    search_errors: DataFrame | None = None

    def look_up(self, rows: DataFrame, doi: str, out: str, label: str) -> DataFrame:
        rows = lookup(rows, self.works, doi, out)
        return self._failed(rows, self.lookup_errors, "doi", doi, out, label)

    def _failed(self, rows: DataFrame, errors: DataFrame | None, on: str, key: str, out: str | None, label: str) -> DataFrame:
        if errors is None:
            return rows.withColumn("_error", F.lit(None).cast("string"))
        failed = errors.groupBy(F.col(on).alias("_on")).agg(F.concat(F.lit(f"{label}: "), F.min("error")).alias("_error"))
        rows = rows.withColumn("_failed_key", spread(key, *KEY, "raw")).join(failed, F.col("_failed_key") == F.col("_on"), "left").drop("_on", "_failed_key")
        return rows if out is None else rows.withColumn(out, F.when(F.col("_error").isNull(), F.col(out)))

    def find(self, rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """Rows with ``_error``, and the candidates of those without."""
        rows = self._failed(rows, self.search_errors, "raw", "raw", None, f"{self.label} search")
        return rows, search(rows.where("_error is null"), self.works, limit)


def _with_error(errors: Column) -> Column:
    return F.concat(errors, F.when(F.col("_error").isNotNull(), F.array("_error")).otherwise(F.array().cast("array<string>")))


def _note(rows: DataFrame) -> DataFrame:
    return rows.withColumn("provider_errors", _with_error(F.col("provider_errors"))).drop("_error")


def _no_work() -> Column:
    return F.lit(None).cast(WORK)


def exact(references: DataFrame, primary: CandidateSource | None, secondary: CandidateSource | None) -> DataFrame:
    """References with ``work`` and ``method`` of their own DOI, from both catalogues at once."""
    rows = references.withColumn("provider_errors", F.array().cast("array<string>"))
    rows = _note(primary.look_up(rows, "doi", "_p", primary.label)) if primary else rows.withColumn("_p", _no_work())
    rows = _note(secondary.look_up(rows, "doi", "_s", secondary.label)) if secondary else rows.withColumn("_s", _no_work())
    method = F.when(F.col("_p").isNotNull() & F.col("_s").isNotNull(), "crossref_openalex_doi").when(F.col("_s").isNotNull(), "openalex_doi").when(F.col("_p").isNotNull(), "crossref_doi")
    return rows.withColumns({"work": merge_works(F.col("_p"), F.col("_s")), "method": method}).drop("_p", "_s")


def resolve(references: DataFrame, primary: CandidateSource | None, secondary: CandidateSource | None = None, config: MatchConfig | None = None, progress: Progress | None = None) -> DataFrame:
    """A resolution for each reference.

    Order of attempts: DOI in both catalogues; search of the primary one; for what that doesn't
    settle, search of the secondary one and a decision over both; then the secondary record of
    an accepted primary work. Each later step only gets the rows that still need it, and
    ``progress`` is called after each.
    """
    if primary is None and secondary is None:
        raise ValueError("at least one catalogue is needed")
    config = config or MatchConfig()
    looked = staged(exact(references.select(*REFERENCE), primary, secondary), "resolve-exact")
    none = F.array().cast(f"array<{CANDIDATE}>")
    done = looked.where("work is not null").withColumns({"status": F.lit("matched"), "confidence": F.lit(1.0), "reason": F.lit("Exact DOI lookup"), "alternatives": none})
    todo = looked.where("work is null").drop("work", "method")
    total, settled_rows = 0, 0

    def tell(rows: DataFrame | None) -> None:
        nonlocal total, settled_rows
        if progress:
            total = total or looked.count()
            settled_rows += 0 if rows is None else rows.count()
            progress(settled_rows if rows is not None else total, total)

    tell(done)

    first = None
    if primary:
        todo, first = primary.find(todo, config.candidate_limit)
        todo = todo.withColumn("_searched", F.col("_error").isNull())
        todo = staged(_note(todo), "resolve-search")
    else:
        todo = todo.withColumn("_searched", F.lit(False))
    scored = staged(score(join_same(todo, first, KEY)), "resolve-scored") if first is not None else None
    decided = decide(todo, scored, config) if scored is not None else None
    rows = join_same(todo, decided, KEY) if decided is not None else todo.withColumns({"accepted": F.lit(False)})
    rows = rows.withColumn("method", F.when(F.col("_searched"), "crossref_search"))
    if secondary:
        rows = staged(rows, "resolve-decided")
        tell(rows.where("accepted"))
        settled, open_ = rows.where("accepted"), rows.where("not accepted").select(*REFERENCE, "provider_errors", "_searched")
        open_, more = secondary.find(open_, config.candidate_limit)
        open_ = open_.withColumn("_also", F.col("_error").isNull())
        open_ = staged(_note(open_), "resolve-fallback")
        second = score(join_same(open_, more.withColumn("pos", F.col("pos") + config.candidate_limit), KEY))
        if scored is not None:
            kept = join_same(scored, open_.select(*KEY), KEY, "left_semi")
            columns = [*KEY, "pos", "work", "doi_matches", "score", "title_score", "author_score", "year_score", "venue_score"]
            second = kept.select(*columns).unionByName(second.select(*columns))
        again = join_same(open_, decide(open_, second, config), KEY)
        method = F.when(F.col("_searched") & F.col("_also"), "crossref_and_openalex_search").when(F.col("_also"), "openalex_search").when(F.col("_searched"), "crossref_search")
        again = again.withColumn("method", method).drop("_also")
        rows = again if decided is None else settled.unionByName(again)
    rows = rows.drop("_searched")
    tell(None)

    accepted = rows.where("accepted").withColumn("work", F.col("best.work"))
    if secondary:
        accepted = accepted.withColumn("_doi", F.when(F.col("work.provider") == "crossref", normalize_doi(F.col("work.doi"))))
        accepted = _note(secondary.look_up(accepted, "_doi", "_s", f"{secondary.label} enrichment"))
        accepted = accepted.withColumn("work", merge_works(F.col("work"), F.col("_s"))).drop("_s", "_doi")
    accepted = accepted.withColumns({"status": F.lit("matched"), "confidence": F.col("best.score")})
    failed = (F.size("alternatives") == 0) & (F.size("provider_errors") > 0)
    rest = rows.where("not accepted").withColumns(
        {
            "work": _no_work(),
            "status": F.when(failed, "error").when(F.col("ambiguous"), "ambiguous").otherwise("unmatched"),
            "confidence": F.coalesce("best.score", F.lit(0.0)),
        }
    )
    columns = [*REFERENCE, "status", "work", "confidence", "method", "reason", "alternatives", "provider_errors"]
    out = done.select(*columns)
    for part in (accepted, rest):
        out = out.unionByName(part.withColumn("alternatives", F.col("alternatives").cast(f"array<{CANDIDATE}>")).select(*columns))
    return out.withColumn("duplicate_of", F.lit(None).cast("int"))
