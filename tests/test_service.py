import io
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from bibspark import CandidateSource, MatchConfig, analyze_text, cli, resolve
from bibspark.operators.resolve import Catalogue
from bibspark.output import write_csv
from bibspark.schemas import WORK
from bibspark.sources import cache, payload
from bibspark.sources.service import Client, ServiceCatalogue, fetch
from bibspark.sources.split import parse_references

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def served(url, headers, timeout):
    """A small service of both kinds."""
    if "down" in url:
        return 500, {"Retry-After": "7"}, ""
    if url.endswith("/works/10.5555%2Fwall.1"):
        return 200, {}, json.dumps({"message": {"DOI": "10.5555/WALL.1", "title": ["Salt in old walls"], "author": [{"given": "Pia", "family": "Ibarra"}]}})
    if "/works/https://doi.org/10.5555/wall.1" in url:
        return 200, {}, json.dumps({"id": "https://openalex.org/W1", "doi": "10.5555/wall.1", "display_name": "Salt in old walls", "authorships": [{"author": {"display_name": "Pia Ibarra", "orcid": "0000-1"}}]})
    if "query.bibliographic=Feld" in url:
        return 200, {}, json.dumps({"message": {"items": [{"DOI": "10.5555/m.2", "title": ["Lime and mortar of towns"], "issued": {"date-parts": [[2011]]}, "author": [{"family": "Feld"}]}]}})
    if "query.bibliographic" in url:
        return 200, {}, "{}"
    return 404, {}, ""


def client(asked=None, **options):
    def opener(url, headers, timeout):
        if asked is not None:
            asked.append(url)
        return served(url, headers, timeout)

    return Client(opener=opener, sleep=lambda s: None, **options)


def test_client_paces_and_retries():
    slept, asked, now = [], [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    c = Client(interval=0.5, opener=lambda *a: (asked.append(a[0]), served(*a))[1], sleep=sleep, clock=lambda: now[0])
    assert c.ask("http://x/down") == (None, "status 500") and len(asked) == 4
    assert [s for s in slept if s > 1] == [7.0] * 3
    assert c.ask("http://x/none") == (None, None) and slept[-1] == 0.5
    assert c.ask("http://x/works?query.bibliographic=z")[0] == "{}"
    broken = Client(opener=lambda *a: (200, {}, "[1]"), sleep=sleep)
    assert broken.ask("u")[1] == "the response is no JSON object"

    def lost(*a):
        raise OSError("no route")

    assert Client(opener=lost, sleep=sleep, retries=1).ask("u") == (None, "no route")
    denied = []
    assert Client(opener=lambda *a: (denied.append(1), (403, {}, ""))[1], sleep=sleep).ask("u")[1] == "status 403" and len(denied) == 1


def test_fetch_stores_and_replays(spark, tmp_path):
    store = f"file://{tmp_path}/cache"
    rows = spark.createDataFrame([("GET a", "http://x/works?query.bibliographic=Feld", 1), ("GET a", "http://x/works?query.bibliographic=Feld", 2), ("GET b", "http://x/none", 3)], "key string, url string, n int")
    first = {r.n: (r.value is not None, r.error) for r in fetch(rows, store, client(), 100.0).collect()}
    assert first == {1: (True, None), 2: (True, None), 3: (False, None)}
    assert spark.read.parquet(store).count() == 1
    away = {r.n: (r.value is not None, r.error) for r in fetch(rows, store, Client(opener=None), 150.0, 60.0, offline=True).collect()}
    assert away[1] == (True, None) and away[3] == (False, "no stored response for GET b")
    late = {r.n: r.value for r in fetch(rows, store, Client(opener=None), 200.0, 60.0, offline=True).collect()}
    assert late[1] is None


def test_resolution_by_services(spark, tmp_path):
    text = "[1] Ibarra, P. (2004). Salt in old walls. doi:10.5555/wall.1\n[2] Feld, M. (2011). Lime and mortar of towns.\n[3] Unknown, U. (1900). Nothing of the kind."
    refs = parse_references(spark.createDataFrame([(1, text)], "bib_id long, text string"))
    first = ServiceCatalogue("Crossref", "http://one", "primary", client(), 10.0, f"file://{tmp_path}/s")
    second = ServiceCatalogue("OpenAlex", "http://two", "secondary", client(), 10.0, f"file://{tmp_path}/s", secret=("api_key", "hidden"))
    seen = []
    got = {r["index"]: r for r in resolve(refs, first, second, progress=lambda n, total: seen.append((n, total))).collect()}
    assert (got[1].method, got[1].work.id, got[1].work.authors[0].orcid) == ("crossref_openalex_doi", "openalex:W1", "0000-1")
    assert (got[2].status, got[2].method, got[2].work.id) == ("matched", "crossref_search", "doi:10.5555/m.2")
    assert got[3].status == "error" and "Crossref search: response has no list of works" in got[3].provider_errors
    assert seen[0] == (1, 3) and seen[-1] == (3, 3)
    stored = [r.key for r in spark.read.parquet(f"file://{tmp_path}/s").collect()]
    assert stored and not any("hidden" in k for k in stored)


def test_rows_without_keys_are_kept(spark):
    works = spark.createDataFrame([(("w1", "Salt in old walls", [], "crossref", 2004, None, None, None),), ((None, "Other things", [], "crossref", 1, None, None, None),)], f"work {WORK}")
    refs = parse_references(spark.createDataFrame([(None, "Ibarra, P. (2004). Salt in old walls."), (1, "Ibarra, P. (2004). Salt in old walls.")], "bib_id long, text string"))
    got = resolve(refs, Catalogue("Crossref", works)).collect()
    assert {(r.bib_id, r.status, r.work.id) for r in got} == {(None, "matched", "w1"), (1, "matched", "w1")}
    item = json.dumps({"title": ["A"], "author": [{"family": "B"}]})
    twice = payload.primary_works(spark.createDataFrame([(1, item), (1, item.replace("B", "C")), (None, item)], "payload_id long, item string")).collect()
    assert sorted([a.display_name for a in r.work.authors] for r in twice) == [["B"], ["B"], ["C"]]


def test_csv_of_many_bibliographies(spark, tmp_path):
    works = spark.createDataFrame([(("w1", "Salt in old walls", [("Pia Ibarra", None, None, None, None, None, False), ("Al Ferro", None, None, None, None, None, False)], "crossref", 2004, None, None, None),)], f"work {WORK}")
    from bibspark import Analysis

    texts = spark.createDataFrame([(i, "Ibarra, P. (2004). Salt in old walls.") for i in (3, 4)], "bib_id long, text string")
    write_csv(Analysis.from_text(texts, Catalogue("Crossref", works)), f"file://{tmp_path}/csv")
    for i in (3, 4):
        (file,) = (tmp_path / "csv" / f"bib_id={i}").glob("*.csv")
        assert [x.split(",")[:2] for x in file.read_text().splitlines()] == [["rank", "name"], ["1", "Al Ferro"], ["2", "Pia Ibarra"]]
    one = analyze_text(spark, "Ibarra, P. (2004). Salt in old walls.", Catalogue("Crossref", works), config=MatchConfig(top=1))
    assert [r.display_name for r in one.ranking().collect()] == ["Al Ferro"]
    assert issubclass(CandidateSource, object)


@pytest.mark.parametrize("args", [["--offline", "--no-cache"], ["--cache-ttl-days", "0"]])
def test_cache_options(spark, args):
    with pytest.raises(SystemExit):
        cli.main(args, spark, io.StringIO("x"))


def test_cli_offline(spark, tmp_path):
    out, err = io.StringIO(), io.StringIO()
    args = ["--primary", "http://one", "--offline", "--cache-dir", f"file://{tmp_path}/none", "--format", "json"]
    assert cli.main(args, spark, io.StringIO("Ibarra, P. (2004). Salt in old walls."), out, err) == 0
    doc = json.loads(out.getvalue())
    assert doc["summary"]["errored_references"] == 1 and "1 of 1 references settled" in err.getvalue()
    stored = spark.createDataFrame([("k", "{}")], "key string, value string")
    cache.store(cache.entries(stored, 1.0), f"file://{tmp_path}/kept")
    assert spark.read.parquet(f"file://{tmp_path}/kept").agg(F.count("*")).first()[0] == 1
