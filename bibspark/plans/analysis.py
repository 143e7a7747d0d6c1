"""The whole analysis, from texts to a ranking."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.operators import people as P
from bibspark.operators.resolve import CandidateSource, Progress, resolve
from bibspark.schemas import MatchConfig
from bibspark.sources.files import from_text
from bibspark.sources.split import parse_references
from bibspark.staging import staged


@dataclass(frozen=True)
class Analysis:
    """Four lazy tables; ``resolutions`` is stored, so options of counting can change at once."""

    resolutions: DataFrame
    people: DataFrame
    summary: DataFrame
    warnings: DataFrame
    config: MatchConfig

    @classmethod
    def from_resolutions(cls, resolutions: DataFrame, config: MatchConfig | None = None) -> Analysis:
        config = config or MatchConfig()
        marked, persons, summary, warnings = P.aggregate(resolutions, config.deduplicate_works, config.include_collective_authors)
        return cls(marked, persons, summary, warnings, config)

    @classmethod
    def from_references(cls, references: DataFrame, primary: CandidateSource | None, secondary: CandidateSource | None = None, config: MatchConfig | None = None, progress: Progress | None = None) -> Analysis:
        return cls.from_resolutions(staged(resolve(references, primary, secondary, config, progress), "resolutions"), config)

    @classmethod
    def from_text(cls, bibliographies: DataFrame, primary: CandidateSource | None, secondary: CandidateSource | None = None, config: MatchConfig | None = None, progress: Progress | None = None) -> Analysis:
        """bibliographies: bib_id and text."""
        return cls.from_references(parse_references(bibliographies), primary, secondary, config, progress)

    def again(self, **options) -> Analysis:
        """Counts with other options over the same resolutions; duplicates are told anew."""
        return Analysis.from_resolutions(self.resolutions.drop("work_key", "included"), replace(self.config, **options))

    def ranking(self, ranking: str | None = None, top: int | None = None) -> DataFrame:
        return P.ranked(self.people, ranking or self.config.ranking, self.config.top if top is None else top)

    def unsettled(self) -> DataFrame:
        """Bibliographies with references that no match settles, for strict callers."""
        return self.summary.where("ambiguous_references + unmatched_references + errored_references > 0").select("bib_id")


def analyze_text(spark: SparkSession, text: str, primary: CandidateSource | None, secondary: CandidateSource | None = None, config: MatchConfig | None = None, progress: Progress | None = None) -> Analysis:
    """The analysis of one bibliography that is at hand as a string (bib_id 1)."""
    return Analysis.from_text(from_text(spark, text), primary, secondary, config, progress)


def cancel(spark: SparkSession, group: str) -> None:
    """Stops the jobs of a group, set by ``spark.sparkContext.setJobGroup``."""
    spark.sparkContext.cancelJobGroup(group)


def progress(resolutions: DataFrame) -> DataFrame:
    """References by status, so far."""
    return resolutions.groupBy("bib_id", "status").agg(F.count(F.lit(1)).alias("n"))
