import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bibspark.llm import toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(r, n=60):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def examples(seed=3, n=400):
    r = random.Random(seed)
    return [(i, prose(r, r.randrange(1, 90)) + (" vile filthy" * r.randrange(1, 3) if i % 6 == 0 else ""), int(i % 6 == 0)) for i in range(n)]


def brute(rows, texts, leave=None):
    """Cosines of each text to each row, straight from the definition."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    terms = lambda t: Counter(x for w in split(t) for x in ["=" + w, *(w[:k] for k in toxicity.BEGINNINGS if k < len(w))])
    counts = [terms(t) for _, t, _ in rows]
    held = Counter(t for c in counts for t in c)
    toxic = Counter(t for c, r in zip(counts, rows, strict=True) if r[2] for t in c)
    factor = {t: (math.log((len(rows) + 1) / (n + 1)) + 1) * math.log2(2 + toxic[t] / max(1, n - toxic[t])) ** 2 for t, n in held.items()}

    def unit(c):
        v = {t: (1 + math.log(n)) * factor[t] for t, n in c.items() if t in factor}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / length for t, x in v.items()}

    vectors = [unit(c) for c in counts]
    return np.array([[sum(x * v.get(t, 0.0) for t, x in q.items()) for v in vectors] for q in (unit(terms(t)) for t in texts)])


def test_block_max_search_is_exact():
    r = np.random.default_rng(1)
    n, terms = 500, 60
    dense = np.where(r.random((n, terms)) < r.choice([0.02, 0.05, 0.3], terms), np.round(r.random((n, terms)) * 2**20) / 2**24, 0.0)
    dense[10] = dense[20] = dense[30]
    doc, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(doc, term, dense[doc, term], n, terms)
    assert 0 < len(index.full) < terms
    for k in (1, 12, 600):
        for leave in (None, np.arange(0, n, 7)):
            asked = np.arange(0, n, 7)
            query, own = np.nonzero(dense[asked])
            got, least = index.search(query, own, dense[asked][query, own], len(asked), k, leave)
            all_ = dense[asked] @ dense.T
            if leave is not None:
                all_[np.arange(len(asked)), leave] = -1
            kept = min(k, n - (leave is not None))
            assert (least == np.sort(all_, axis=1)[:, n - kept]).all()
            for x, y, z in zip(got, all_, least, strict=True):
                assert set(np.nonzero(x >= max(z, 0))[0]) == set(np.nonzero(y >= max(z, 0))[0])
                assert (x[: n][x[:n] >= 0] == y[x[:n] >= 0]).all()


def test_vectors_neighbours_votes_and_calibration():
    rows = examples()
    model = toxicity.Model(rows)
    texts = [t for _, t, _ in examples(4, 60)] + ["", None, "unknown", "Vile! FILTHY_vile"]
    expected = brute(rows, texts)
    place = {d: i for i, d in enumerate(model.ids)}
    at = [place[d] for d, _, _ in rows]
    scores, evidence = model.score(pa.array(texts, pa.string()))
    # leave-one-out votes and their calibration, from the definition
    label = np.array([x[2] for x in rows], float)

    def vote(c):
        k = min(toxicity.NEAREST, np.count_nonzero(c >= 0))
        last = np.sort(c)[-k]
        near = np.nonzero(c >= last - 1e-7)[0]
        weight = 1 / (1.001 - c[near])
        tied = np.abs(c[near] - last) < 1e-7
        weight[tied] *= (k - np.count_nonzero(~tied)) / np.count_nonzero(tied)
        return (weight * label[near]).sum() / weight.sum()

    loo = brute(rows, [t for _, t, _ in rows])
    np.fill_diagonal(loo, -1)
    x, y = toxicity.isotonic(np.array([vote(c) for c in loo])[np.argsort(at)], label[np.argsort(at)])
    assert model.x == pytest.approx(x, abs=1e-4) and model.y == pytest.approx(y, abs=1e-4)
    for c, score, found in zip(expected, scores, evidence, strict=True):
        v = vote(c)
        assert score == pytest.approx(0.98 * np.interp(v, x, y) + 0.02 * v, abs=1e-3)
        best = sorted(((-round(z, 6), d) for z, (d, _, _) in zip(c, rows, strict=True)))[:3]
        assert [-e["cosine"] for e in found] == pytest.approx([z for z, _ in best], abs=2e-6)
    assert len({tuple(e["doc_id"] for e in found) for found in evidence[:60]}) > 40


def test_isotonic_is_the_best_rising_fit():
    r = np.random.default_rng(5)
    votes = r.random(60)
    labels = (r.random(60) < votes).astype(float)
    x, y = toxicity.isotonic(votes, labels)
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()
    # the classic max-min formula, over positions in order of the votes
    z = labels[np.argsort(votes)]
    best = [max(min(z[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert len(set(np.round(best, 9))) == len(x)


def test_toxicity(spark, odd_documents, no_documents):
    rows = examples(n=600)
    documents = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (8, 0), (9, 0)], "doc_id long, toxic int")
    repeats = documents.unionByName(documents.where("doc_id = 8")).unionByName(documents.limit(3).withColumn("text", F.lit(None).cast("string")))
    model = toxicity.fit(repeats, labels)
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in model.ids) and len(set(model.ids)) == len(model.ids)
    got = {x.doc_id: x for x in toxicity.scored(documents, model).collect()}
    assert all((got[i].score >= 0.7) == (i % 6 == 0) for i in range(600))
    assert got[0].evidence[0].label == 1
    kept = [x.doc_id for x in toxicity.accepted(documents, model).collect()]
    assert kept == [i for i in range(600) if i % 6]
    odd = toxicity.scored(odd_documents, model).collect()
    assert len(odd) == 13 and all(0 <= x.score < 0.7 for x in odd)
    assert toxicity.accepted(odd_documents, model).columns == odd_documents.columns
    assert toxicity.accepted(odd_documents, model).count() == 13
    assert toxicity.scored(no_documents, model).count() == 0
    assert toxicity.scored(odd_documents, toxicity.fit(no_documents, labels)).agg(F.max("score")).first()[0] == 0.5
    few = toxicity.fit(documents.where("doc_id in (0, 2)"), labels)
    assert all(0 <= x.score <= 1 for x in toxicity.scored(odd_documents, few).collect())


def test_queries_score_the_held_out_fold(spark):
    from bibspark.llm import queries

    got = queries.op1_toxicity_knn(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert got.count() == got.select("doc_id").distinct().count() == 1000
    toxic = [x for x in rows if x.toxic]
    assert sum(x.predicted for x in toxic) >= 0.7 * len(toxic)
    assert sum(x.predicted for x in rows if not x.toxic) <= 0.02 * len(rows)
