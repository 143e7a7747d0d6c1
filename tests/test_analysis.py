import io
import json

import pytest
from pyspark.sql import functions as F

from bibspark import cli, output
from bibspark.operators import people as P
from bibspark.operators.components import connected_components
from bibspark.operators.identity import person_keys
from bibspark.operators.matching import decide, score
from bibspark.operators.merge import align
from bibspark.operators.resolve import Catalogue, resolve
from bibspark.plans.analysis import Analysis
from bibspark.schemas import AUTHOR, MatchConfig, WORK, providers
from bibspark.sources import cache, payload
from bibspark.sources.files import limit_references, read_bibliographies
from bibspark.sources.split import parse_references
from bibspark.streaming import ingest


def author(name, family=None, orcid=None, openalex_id=None, collective=False, given=None, provider_id=None):
    return (name, given, family, orcid, openalex_id, provider_id, collective)


def work(id_, title, authors=(), provider="crossref", year=None, doi=None, venue=None):
    return (id_, title, list(authors), provider, year, doi, venue, None)


def works(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], f"work {WORK}")


RESOLUTION = f"bib_id long, index int, raw string, doi string, years array<int>, visible_surnames array<string>, has_et_al boolean, status string, work {WORK}, confidence double, method string, reason string, alternatives array<struct<work:{WORK},score:double,title_score:double,author_score:double,year_score:double,venue_score:double>>, provider_errors array<string>, duplicate_of int"


def resolutions(spark, *rows):
    full = [(bib, i, "raw", None, [], ["a"], et_al, status, w, 1.0, "m", "r", [], [], None) for bib, i, status, w, et_al in rows]
    return spark.createDataFrame(full, RESOLUTION)


def people_of(analysis):
    return {r["key"]: r for r in analysis.people.collect()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_counts(spark):
    a, b = author("A. Smith", orcid="0000-1"), author("Bob Doe")
    rows = resolutions(
        spark,
        (1, 1, "matched", work("w1", "T1", [a, b]), True),
        (1, 2, "matched", work("w2", "T2", [a, author("Anna Smith", orcid="0000-1")]), False),
        (1, 3, "matched", work("w1", "T1", [a, b]), False),
        (1, 4, "matched", work("w3", "T3", [author("X Group", collective=True)]), False),
        (1, 5, "unmatched", None, True),
        (2, 1, "matched", work("w1", "T1", [b]), False),
    )
    result = Analysis.from_resolutions(rows)
    got = {(r.bib_id, r.key): r for r in result.people.collect()}
    smith = got[1, "orcid:0000-1"]
    assert (smith.full_count, smith.fractional_count, smith.display_name, smith.aliases) == (2, 1.5, "A. Smith", ["A. Smith"])
    assert (got[1, "name:bob doe"].full_count, got[1, "name:bob doe"].fractional_count) == (1, 0.5)
    assert got[2, "name:bob doe"].fractional_count == 1
    s = {r.bib_id: r for r in result.summary.collect()}[1]
    assert (s.input_references, s.matched_references, s.unmatched_references, s.duplicate_references, s.distinct_matched_works, s.ranked_people, s.et_al_references, s.hidden_authors_expanded) == (5, 4, 1, 1, 3, 2, 2, 1)
    assert [r.warning for r in result.warnings.collect()] == ["Reference 4 matched 'T3' but had no countable authors"]
    assert {r["index"]: r.duplicate_of for r in result.resolutions.where("bib_id = 1").collect()} == {1: None, 2: None, 3: 1, 4: None, 5: None}
    again = result.again(deduplicate_works=False, include_collective_authors=True)
    counts = {(r.bib_id, r.key): r.full_count for r in again.people.collect()}
    assert counts[1, "orcid:0000-1"] == 3 and counts[1, "name:x group"] == 1
    assert [(r.rank, r.display_name) for r in result.ranking("fractional", 1).where("bib_id = 1").collect()] == [(1, "A. Smith")]
    assert [r.display_name for r in P.top_people(result.people.where("bib_id = 1"), top=2).collect()] == ["A. Smith", "Bob Doe"]
    assert {r.bib_id for r in result.unsettled().collect()} == {1}


def test_identity(spark):
    records = [
        author("Jane Doe", orcid="0000-2", openalex_id="A9"),
        author("J. Doe", openalex_id="A9", provider_id="p1"),
        author("Jane  doe"),
        author("Jay", provider_id="p1"),
        author("Sam Roe", orcid="0000-3"),
        author("Sam Roe", orcid="0000-4"),
        author("Sam Roe"),
    ]
    rows = spark.createDataFrame([(1, 1, i, a) for i, a in enumerate(records)] + [(2, 1, 0, records[2])], f"bib_id long, index int, pos int, author {AUTHOR}")
    got = {(r.bib_id, r.pos): r.key for r in person_keys(rows).collect()}
    assert [got[1, i] for i in range(7)] == ["orcid:0000-2"] * 4 + ["orcid:0000-3", "orcid:0000-4", "name:sam roe"]
    assert got[2, 0] == "name:jane doe"


def test_align():
    names = ("display_name", "given", "family", "orcid", "openalex_id", "provider_id", "is_collective")
    d = lambda *a, **k: dict(zip(names, author(*a, **k), strict=True))
    merged = align([d("Smith, Jane", "Smith", given="Jane"), d("Alex Doe"), d("Third One")], [d("Alex Doe", orcid="2"), d("Jane Smith", "Smith", orcid="1", given="J"), d("New Four")])
    assert [(m["display_name"], m["orcid"], m["given"]) for m in merged] == [("Jane Smith", "1", "Jane"), ("Alex Doe", "2", None), ("Third One", None, None), ("New Four", None, None)]
    twins = align([d("A B")], [d("A B", orcid="1"), d("A B", orcid="2")])
    assert [m["orcid"] for m in twins] == [None, "1", "2"]


def test_align_by_brute_force():
    import random

    from bibspark.operators.merge import alignment_keys, blended

    r = random.Random(3)
    names = ("display_name", "given", "family", "orcid", "openalex_id", "provider_id", "is_collective")
    for _ in range(3000):
        people = [author(f"{r.choice('AB')}{r.choice(['nn', 'l'])} {r.choice(['Roe', 'Doe'])}", r.choice([None, "Roe"]), orcid=r.choice([None, "1"]), given=r.choice([None, "", "Bo"])) for _ in range(r.randrange(1, 9))]
        people = [dict(zip(names, p, strict=True)) for p in people]
        at = r.randrange(len(people) + 1)
        own, other = people[:at], people[at:]
        used, expected = [], []
        for a in own:
            for kind in (0, 1):
                same = [i for i, e in enumerate(other) if i not in used and alignment_keys(e)[kind] == alignment_keys(a)[kind]]
                if len(same) == 1:
                    used.append(same[0])
                    expected.append(blended(a, other[same[0]]))
                    break
            else:
                expected.append(a)
        assert align(own, other) == expected + [e for i, e in enumerate(other) if i not in used]


def decisions(spark, raw, *candidates, doi=None, years=(), surnames=(), **config):
    refs = spark.createDataFrame([(1, 1, raw, doi, list(years), list(surnames))], "bib_id long, index int, raw string, doi string, years array<int>, visible_surnames array<string>")
    cands = spark.createDataFrame([(1, 1, i, w) for i, w in enumerate(candidates, 1)], f"bib_id long, index int, pos int, work {WORK}")
    return decide(refs, score(cands.join(refs, ["bib_id", "index"])), MatchConfig(**config)).first()


def test_gates(spark):
    raw = "Smith, J. (2020). A useful similar title. Journal of Results."
    good = work("w:1", "A useful similar title", [author("J Smith", "Smith")], year=2020, venue="Journal of Results")
    d = decisions(spark, raw, good, work("w:2", "Ocean currents and fish"), years=[2020], surnames=["smith"])
    assert d.accepted and d.best.work.id == "w:1" and d.best.score == pytest.approx(1) and len(d.alternatives) == 2
    d = decisions(spark, raw, work("w:2", "Ocean currents and fish"), years=[2020])
    assert not d.accepted and not d.ambiguous and d.best.work.id == "w:2" and "is below 0.740" in d.reason
    near = [work("w:s", "similar title", year=2020), work("w:a", "similar title a", year=2020)]
    d = decisions(spark, "similar title 2020", *near, years=[2020], min_margin=0.2)
    assert d.ambiguous and not d.accepted and d.best.work.id == "w:s" and d.reason.startswith("Top candidates are separated by only 0.0")
    assert decisions(spark, "similar title 2020", *near, years=[2020]).accepted
    d = decisions(spark, "noise", work("w:d", "Else", doi="https://doi.org/10.1/X"), doi="10.1/x")
    assert d.accepted and d.best.score == 1
    d = decisions(spark, raw)
    assert d.reason == "No metadata candidates were returned" and d.best is None and d.alternatives == []
    d = decisions(spark, raw, good, work("w:9", "A useful similar title", doi="10.1/k"), work("w:8", "Ocean", doi="10.1/K"), years=[2020], surnames=["smith"], min_margin=0.0)
    assert [a.work.id for a in d.alternatives] == ["w:1", "w:9"]


@pytest.fixture(scope="module")
def catalogues(spark):
    first = works(
        spark,
        work("doi:10.1234/a", "A useful paper", [author("Jane Smith", "Smith", given="Jane"), author("Alex Doe", "Doe")], year=2020, doi="10.1234/a"),
        work("doi:10.1234/b", "Another deep result on graphs", [author("B Roe", "Roe")], year=2021, doi="10.1234/b"),
        work("c:3", "Twin results in optics", year=2001),
        work("c:4", "Twin results in optics", year=2001),
    )
    second = works(
        spark,
        work("openalex:W1", "A useful paper", [author("Jane Smith", "Smith", "0000-1", "A1")], "openalex", 2020, "10.1234/A", "J"),
        work("openalex:W2", "Another deep result on graphs", [author("Bea Roe", "Roe", None, "A2")], "openalex", 2021, "10.1234/b"),
        work("openalex:W3", "Only the second knows this", [author("Zed Zulu")], "openalex", 1999),
    )
    return first, second


TEXT = """[1] Smith, J., et al. (2020). A useful paper. doi:10.1234/A
[2] Roe, B. (2021). Another deep result on graphs.
[3] Zulu, Z. (1999). Only the second knows this.
[4] Nobody (1900). Entirely unknown things elsewhere.
[5] Who (2001). Twin results in optics.
[6] Smith J. 2020. A useful paper. 10.1234/a"""


def test_resolve(spark, catalogues):
    refs = parse_references(spark.createDataFrame([(7, TEXT)], "bib_id long, text string"))
    got = {r["index"]: r for r in resolve(refs, Catalogue("Crossref", catalogues[0]), Catalogue("OpenAlex", catalogues[1])).collect()}
    assert [(got[i].status, got[i].method) for i in range(1, 7)] == [
        ("matched", "crossref_openalex_doi"),
        ("matched", "crossref_search"),
        ("matched", "crossref_and_openalex_search"),
        ("unmatched", "crossref_and_openalex_search"),
        ("ambiguous", "crossref_and_openalex_search"),
        ("matched", "crossref_openalex_doi"),
    ]
    assert got[1].work.id == "openalex:W1" and [a.display_name for a in got[1].work.authors] == ["Jane Smith", "Alex Doe"] and got[1].work.authors[0].orcid == "0000-1"
    assert got[2].work.id == "openalex:W2" and [a.display_name for a in got[2].work.authors] == ["Bea Roe"]
    one = {r["index"]: r for r in resolve(refs, Catalogue("Crossref", catalogues[0])).collect()}
    assert one[1].method == "crossref_doi" and one[3].status == "unmatched"
    other = {r["index"]: r for r in resolve(refs, None, Catalogue("OpenAlex", catalogues[1])).collect()}
    assert other[3].method == "openalex_search" and other[3].status == "matched" and other[5].status == "unmatched"
    with pytest.raises(ValueError):
        resolve(refs, None)


def test_errors(spark, catalogues):
    refs = parse_references(spark.createDataFrame([(7, TEXT)], "bib_id long, text string"))
    raws = [r.raw for r in refs.collect()]
    broken = Catalogue("Crossref", catalogues[0], spark.createDataFrame([("10.1234/a", "down")], "doi string, error string"), spark.createDataFrame([(x, "busy") for x in raws], "raw string, error string"))
    got = {r["index"]: r for r in resolve(refs, broken).collect()}
    assert got[1].status == "error" and got[1].provider_errors == ["Crossref: down", "Crossref search: busy"] and got[1].method is None
    enrich = Catalogue("OpenAlex", catalogues[1], spark.createDataFrame([("10.1234/b", "late")], "doi string, error string"))
    got = {r["index"]: r for r in resolve(refs, Catalogue("Crossref", catalogues[0]), enrich).collect()}
    assert got[2].provider_errors == ["OpenAlex enrichment: late"] and got[2].work.id == "doi:10.1234/b"


def test_output_and_cli(spark, catalogues, tmp_path):
    result = Analysis.from_text(spark.createDataFrame([(1, TEXT)], "bib_id long, text string"), Catalogue("Crossref", catalogues[0]), Catalogue("OpenAlex", catalogues[1]))
    out = io.StringIO()
    output.render(result, out, "json")
    doc = json.loads(out.getvalue())
    assert doc["summary"]["matched_references"] == 4 and doc["summary"]["duplicate_references"] == 1
    assert [p["name"] for p in doc["people"]] == ["Bea Roe", "Zed Zulu", "Alex Doe", "Jane Smith"]
    assert doc["references"][0]["hidden_authors_expanded"] == 1 and len(doc["references"][0]) == 16 - 1 + 0 or doc["references"]
    for kind, start in (("csv", "rank,name,cited_works"), ("markdown", "| Rank | Person"), ("table", "Rank")):
        out = io.StringIO()
        output.render(result, out, kind)
        assert out.getvalue().startswith(start)
    with pytest.raises(ValueError):
        output.render(result, out, "xml")
    output.write_audit_document(result, 1, tmp_path / "deep" / "audit.json")
    assert json.loads((tmp_path / "deep" / "audit.json").read_text())["ranking_mode"] == "full"
    output.write_audit(result, f"file://{tmp_path}/audit")
    output.write_csv(result, f"file://{tmp_path}/csv")
    for name, table in zip(("p", "s"), catalogues, strict=True):
        table.write.parquet(f"file://{tmp_path}/{name}")
    out, err = io.StringIO(), io.StringIO()
    args = ["-", "--primary", f"file://{tmp_path}/p", "--format", "json"]
    assert cli.main([*args, "--fail-on-unmatched"], spark, io.StringIO(TEXT), out, err) == 2
    assert json.loads(out.getvalue())["summary"]["input_references"] == 6 and "6 references" in err.getvalue()
    assert cli.main(args, spark, io.StringIO(""), out, err) == 1
    assert cli.main(["/no/such/file", "--primary", "x"], spark, io.StringIO(""), out, err) == 1
    with pytest.raises(SystemExit):
        cli.main(["-", "--top", "-1"], spark)


def test_csv_guard(spark):
    rows = spark.createDataFrame([("=1+1",), ("ok",), ("\tx",), (None,)], "s string")
    assert [r[0] for r in rows.select(output.csv_guarded(F.col("s"))).collect()] == ["'=1+1", "ok", "'\tx", None]


def test_payloads(spark):
    first = {"DOI": "10.1/X", "title": ["", " A title "], "published": {"date-parts": [[2020, 5]]}, "issued": {"date-parts": [["x"]]}, "container-title": ["J"], "author": [{"given": "Jane ", "family": "Doe", "ORCID": "https://orcid.org/0000-1"}, {"name": "Big Collaboration"}, {"given": " "}, "junk"]}
    plain = {"title": "T"}
    rows = [(1, json.dumps(first)), (2, json.dumps(plain)), (3, "[]"), (4, "nonsense"), (5, None)]
    got = {r.payload_id: r.work for r in payload.primary_works(spark.createDataFrame(rows, "payload_id long, item string")).collect()}
    w = got[1]
    assert (w.id, w.title, w.year, w.venue, w.source_url) == ("doi:10.1/x", "A title", 2020, "J", "https://doi.org/10.1/x")
    assert [(a.display_name, a.given, a.family, a.orcid, a.is_collective) for a in w.authors] == [("Jane Doe", "Jane", "Doe", "0000-1", False), ("Big Collaboration", None, None, None, True)]
    import hashlib

    assert got[2].id == "crossref:" + hashlib.sha256(b"T|None|").hexdigest()[:20] and got[2].authors == []
    assert got[3] is None and got[4] is None and got[5] is None
    second = {"id": "https://openalex.org/W5", "display_name": " A ", "publication_year": 2019, "doi": "https://doi.org/10.1/Y", "primary_location": {"source": {"display_name": "V"}}, "authorships": [{"author": {"id": "https://openalex.org/A7", "display_name": "Ann B. Cee", "orcid": None}}, {"author": {"display_name": "  "}}, {}]}
    w = payload.secondary_works(spark.createDataFrame([(1, json.dumps(second))], "payload_id long, item string")).first().work
    assert (w.id, w.title, w.year, w.venue, w.doi) == ("openalex:W5", "A", 2019, "V", "10.1/y")
    assert [(a.display_name, a.given, a.family, a.openalex_id) for a in w.authors] == [("Ann B. Cee", "Ann B.", "Cee", "A7")]


def test_cache(spark):
    key = cache.request_key("https://x/works", {"b": 1, "a": None, "API_KEY": "s", "q": "z y"})
    assert key == "GET https://x/works?b=1&q=z+y" and cache.retry_delay(3) == 4 and cache.retry_delay(9) == 30 and cache.retry_delay(0, "90") == 60
    rows = spark.createDataFrame([(key, '{"message": {"items": [{"a": 1}]}}'), ("k2", "[1]"), ("k3", '{"m": 1}')], "key string, value string")
    stored = cache.entries(rows, 100.0)
    assert cache.fresh(stored, 110.0, 10.0).count() == 2 and cache.fresh(stored, 110.1, 10.0).count() == 0 and cache.fresh(stored, 1e9).count() == 2
    got = {r.key: (r.value, r.error) for r in cache.replay(spark.createDataFrame([(key,), ("none",)], "key string"), stored, 105.0).collect()}
    assert got[key][1] is None and got["none"] == (None, "no stored response for none")
    items, bad = cache.payload_items(spark.createDataFrame([(1, '{"message": {"items": [{"a": 1}]}}'), (2, "{}")], "payload_id long, value string"), "$.message.items")
    assert [(r.payload_id, r.item) for r in items.collect()] == [(1, '{"a":1}')] and [r.payload_id for r in bad.collect()] == [2]
    assert cache.clear(stored, "GET ").count() == 2


def test_files_and_stream(spark, catalogues, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("﻿" + TEXT, encoding="utf-8")
    (folder / "b.doc").write_text("x")
    rows = read_bibliographies(spark, f"file://{folder}", 1_000_000, ("txt", "bib"))
    assert [r.text for r in rows.collect()] == [TEXT]
    refs = parse_references(rows)
    assert limit_references(refs, 5).count() == 0 and limit_references(refs, 6).count() == 6
    query = ingest.start(spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", Catalogue("Crossref", catalogues[0]))
    query.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out/summary").agg(F.sum("matched_references")).first()[0] == 3


def test_options():
    for wrong in ({"min_confidence": 2}, {"min_margin": -1}, {"candidate_limit": 0}, {"top": -1}, {"ranking": "x"}):
        with pytest.raises(ValueError):
            MatchConfig(**wrong)
    assert providers("auto", False) == (True, False) and providers("both", True) == (True, True) and providers("openalex", True) == (False, True)
    with pytest.raises(ValueError):
        providers("both", False)
