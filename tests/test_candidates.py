import math
import random
from collections import Counter

import pytest

from bibspark.operators import candidates
from bibspark.operators.resolve import Catalogue, resolve
from bibspark.schemas import WORK
from bibspark.sources.split import parse_references


def catalogue(spark, titles):
    return spark.createDataFrame([((i, t, [], "crossref", None, None, None, None),) for i, t in titles.items()], f"work {WORK}")


def asked(spark, rows):
    return spark.createDataFrame(rows, "bib_id long, index int, raw string")


def found(hits):
    got = {}
    for r in sorted(hits.collect(), key=lambda r: r.pos):
        got.setdefault((r.bib_id, r["index"]), []).append((r.pos, r.work.id))
    return got


def brute(titles, rows, limit):
    held = {i: set(t.split()) for i, t in titles.items()}
    n = Counter(w for words in held.values() for w in words)
    out = {}
    for bib, index, raw in rows:
        words = sorted(set(raw.split()) & set(n))
        score = {i: round(sum(1 / math.log(n[w] + 1.5) for w in words if w in own), 9) for i, own in held.items() if own & set(words)}
        best = sorted(score, key=lambda i: (-score[i], i))[:limit]
        if best:
            out[bib, index] = list(enumerate(best, 1))
    return out


@pytest.mark.parametrize("rare", [0, 2, 100])
def test_search_by_brute_force(spark, monkeypatch, rare):
    monkeypatch.setattr(candidates, "RARE", rare)
    monkeypatch.setattr(candidates, "BLOCK_WORKS", 30)
    monkeypatch.setattr(candidates, "BLOCK_REFERENCES", 30)
    draw = random.Random(7)
    common, odd = [f"c{i}" for i in range(6)], [f"o{i}" for i in range(60)]
    text = lambda: " ".join(draw.sample(common, draw.randint(0, 4)) + draw.sample(odd, draw.randint(0, 3)))
    titles = {f"w{i}": text() for i in range(150)}
    rows = [(1, i, text() + " unknown") for i in range(80)]
    assert found(candidates.search(asked(spark, rows), catalogue(spark, titles), 4)) == brute(titles, rows, 4)


def test_search_compares_equal_sets_once(spark, monkeypatch):
    """Works and references that differ in rare words only stand for one pair, not for all pairs."""
    kept = {}
    monkeypatch.setattr(candidates, "staged", lambda df, name, stage=candidates.staged: kept.setdefault(name, stage(df, name)))
    titles = {f"w{i:03}": f"blue ring {i}" for i in range(200)}
    rows = [(1, i, f"on the blue ring {i}") for i in range(200)]
    assert found(candidates.search(asked(spark, rows), catalogue(spark, titles), 3)) == brute(titles, rows, 3)
    assert kept["search-sets"].count() == 1 and kept["search-index"].count() == 3


def test_resolution_compares_equal_sets_once(spark, monkeypatch):
    """Both catalogues are searched by different sets of words, and a reference keeps its own number's work."""
    monkeypatch.setattr(candidates, "RARE", 2)
    kept = []
    monkeypatch.setattr(candidates, "staged", lambda df, name, stage=candidates.staged: kept.append((name, stage(df, name))) or kept[-1][1])
    first, second = (catalogue(spark, {f"{c}{i:03}": f"blue ring number {i}" for i in range(400, 450) if i % 3 == k}) for k, c in enumerate("ab"))
    rows = parse_references(spark.createDataFrame([(i, f"blue ring number {i}") for i in range(400, 450)], "bib_id long, text string"))
    got = {r.bib_id: r.alternatives[0].work.id for r in resolve(rows, Catalogue("A", first), Catalogue("B", second)).collect()}
    assert all(got[i] == f"a{i}" for i in range(400, 450) if i % 3 == 0)
    assert [df.count() for name, df in kept if name == "search-sets"] == [1, 1]
