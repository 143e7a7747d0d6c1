"""Command line: a bibliography against stored catalogues."""

from __future__ import annotations

import argparse
import os
import re
import sys
import time
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from bibspark import output
from bibspark.operators.resolve import CandidateSource, Catalogue
from bibspark.plans.analysis import Analysis
from bibspark.schemas import MatchConfig, providers
from bibspark.sources.files import from_text
from bibspark.sources.service import PRIMARY_INTERVAL, SECONDARY_INTERVAL, Client, ServiceCatalogue
from bibspark.sources.split import parse_references
from bibspark.staging import shared_dir

VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bibspark", description=__doc__)
    p.add_argument("input", nargs="?", default="-", help="a text, BibTeX or RIS file, or - for standard input (default)")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--provider", choices=("auto", "crossref", "openalex", "both"), default="auto")
    p.add_argument("--primary", help="Parquet table of works (column work) of the primary catalogue, or the address of its service")
    p.add_argument("--secondary", help="the same of the secondary catalogue; a service needs the key in BIBSPARK_SECONDARY_KEY")
    p.add_argument("--email", default=os.environ.get("BIBSPARK_EMAIL"), help="sent to the primary service")
    p.add_argument("--cache-dir", default=os.environ.get("BIBSPARK_CACHE_DIR"), help="table of stored responses of services")
    p.add_argument("--cache-ttl-days", type=float, default=30.0, help="age from which a stored response is asked for again")
    p.add_argument("--no-cache", action="store_true", help="store no responses and use none")
    p.add_argument("--offline", action="store_true", help="use stored responses only")
    p.add_argument("--format", choices=("table", "json", "csv", "markdown"), default="table")
    p.add_argument("--output", type=Path)
    p.add_argument("--audit", type=Path)
    p.add_argument("--top", type=int, default=25)
    p.add_argument("--ranking", choices=("full", "fractional"), default="full")
    p.add_argument("--min-confidence", type=float, default=0.74)
    p.add_argument("--min-margin", type=float, default=0.04)
    p.add_argument("--candidate-limit", type=int, default=5)
    for flag in ("keep-duplicates", "include-collective-authors", "fail-on-unmatched", "quiet"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def source(args: argparse.Namespace, spark: SparkSession, kind: str, label: str, place: str, interval: float) -> CandidateSource:
    """A stored catalogue, or a service with the options of the cache."""
    if not re.match("https?://", place):
        return Catalogue(label, spark.read.parquet(place))
    contact = f"; mailto:{args.email}" if args.email and kind == "primary" else ""
    client = Client(interval, headers={"Accept": "application/json", "User-Agent": f"bibspark/{VERSION}{contact}"})
    stored = None if args.no_cache else args.cache_dir or f"{shared_dir(spark)}/bibspark/responses"
    key = os.environ.get("BIBSPARK_SECONDARY_KEY", "").strip()
    secret = ("api_key", key) if kind == "secondary" and key else None
    return ServiceCatalogue(label, place.rstrip("/"), kind, client, time.time(), stored, args.cache_ttl_days * 86400, args.offline, secret)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin: TextIO = sys.stdin, stdout: TextIO = sys.stdout, stderr: TextIO = sys.stderr) -> int:
    """0 if all went well, 1 for unusable input or catalogues, 2 for strict callers if
    references stay unsettled."""
    p = parser()
    args = p.parse_args(argv)
    if args.output and args.audit and args.output.resolve() == args.audit.resolve():
        p.error("--output and --audit must differ")
    if args.cache_ttl_days <= 0:
        p.error("--cache-ttl-days must be positive")
    if args.offline and args.no_cache:
        p.error("--offline needs the cache")
    try:
        config = MatchConfig(args.min_confidence, args.min_margin, args.candidate_limit, deduplicate_works=not args.keep_duplicates, include_collective_authors=args.include_collective_authors, ranking=args.ranking, top=args.top)
    except ValueError as wrong:
        p.error(str(wrong))
    try:
        use_primary, use_secondary = providers(args.provider, bool(args.secondary))
        if use_primary and not args.primary:
            raise ValueError("--primary is needed")
        text = stdin.read() if args.input == "-" else Path(args.input).read_text(encoding="utf-8-sig")
    except (OSError, ValueError) as wrong:
        print(f"error: {wrong}", file=stderr)
        return 1
    spark = spark or SparkSession.builder.appName("bibspark").getOrCreate()
    references = parse_references(from_text(spark, text))
    if references.isEmpty():
        print("error: no references were found in the input", file=stderr)
        return 1
    report = None if args.quiet else lambda n, total: print(f"{n} of {total} references settled", file=stderr)
    primary = source(args, spark, "primary", "Crossref", args.primary, PRIMARY_INTERVAL) if use_primary else None
    secondary = source(args, spark, "secondary", "OpenAlex", args.secondary, SECONDARY_INTERVAL) if use_secondary else None
    result = Analysis.from_references(references, primary, secondary, config, report)
    try:
        if args.output:
            args.output.parent.mkdir(parents=True, exist_ok=True)
            with args.output.open("w", encoding="utf-8", newline="") as out:
                output.render(result, out, args.format, 1, args.ranking, args.top)
        else:
            output.render(result, stdout, args.format, 1, args.ranking, args.top)
        if args.audit:
            output.write_audit_document(result, 1, args.audit)
    except OSError as wrong:
        print(f"error: {wrong}", file=stderr)
        return 1
    counters = result.summary.first().asDict()
    if not args.quiet:
        print(output.summary_line(counters), file=stderr)
    open_ = sum(counters[f"{s}_references"] for s in ("ambiguous", "unmatched", "errored"))
    return 2 if args.fail_on_unmatched and open_ else 0


if __name__ == "__main__":
    sys.exit(main())
