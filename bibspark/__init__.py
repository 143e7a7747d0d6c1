"""Bibliographic analytics on Spark: from messy reference lists to the people cited most."""

from bibspark.operators.resolve import CandidateSource, Catalogue, resolve
from bibspark.plans.analysis import Analysis, analyze_text
from bibspark.schemas import MatchConfig
from bibspark.sources.split import parse_references, split_references, split_text

__version__ = "0.2"

__all__ = ["Analysis", "CandidateSource", "Catalogue", "MatchConfig", "analyze_text", "parse_references", "resolve", "split_references", "split_text"]
