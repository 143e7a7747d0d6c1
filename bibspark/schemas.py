"""Schemas of the data model, and the options of an analysis."""

from __future__ import annotations

from dataclasses import dataclass

AUTHOR_FIELDS = ("display_name", "given", "family", "orcid", "openalex_id", "provider_id")
AUTHOR = f"struct<{','.join(f'{n}:string' for n in AUTHOR_FIELDS)},is_collective:boolean>"
WORK = f"struct<id:string,title:string,authors:array<{AUTHOR}>,provider:string,year:int,doi:string,venue:string,source_url:string>"
WORK_FIELDS = ("id", "title", "authors", "provider", "year", "doi", "venue", "source_url")
REFERENCE = "bib_id bigint, index int, raw string, doi string, years array<int>, visible_surnames array<string>, has_et_al boolean"
CANDIDATE = f"struct<work:{WORK},score:double,title_score:double,author_score:double,year_score:double,venue_score:double>"
STATUSES = ("matched", "ambiguous", "unmatched", "error")
MISSING = "No metadata candidates were returned"


@dataclass(frozen=True)
class MatchConfig:
    """Options of resolution and ranking; wrong ones raise ValueError."""

    min_confidence: float = 0.74
    min_margin: float = 0.04
    candidate_limit: int = 5
    alternatives: int = 3
    deduplicate_works: bool = True
    include_collective_authors: bool = False
    ranking: str = "full"
    top: int = 25

    def __post_init__(self) -> None:
        for name in ("min_confidence", "min_margin"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        if not 1 <= self.candidate_limit <= 20:
            raise ValueError("candidate_limit must be between 1 and 20")
        if self.top < 0:
            raise ValueError("top must not be negative")
        if self.ranking not in ("full", "fractional"):
            raise ValueError("ranking must be full or fractional")


def providers(choice: str, has_key: bool) -> tuple[bool, bool]:
    """Whether the primary and the secondary catalogue are used."""
    if choice not in ("auto", "crossref", "openalex", "both"):
        raise ValueError(f"unknown provider {choice}")
    if choice in ("openalex", "both") and not has_key:
        raise ValueError("the secondary catalogue requires a key")
    return choice != "openalex", choice in ("openalex", "both") or (choice == "auto" and has_key)
