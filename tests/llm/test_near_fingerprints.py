import random
from itertools import combinations

import pytest
import xxhash
from bibspark.llm import near_copies, simhash
from pyspark.sql import functions as F


def bits_of(text):
    words = set((text or "").lower().split())
    hashes = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(words))


def five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def texts():
    """Pairs of near copies that have nothing in common with others."""
    r = random.Random(31)
    out = []
    for k in range(60):
        words = [f"w{k}x{r.randrange(400)}" for _ in range(300)]
        out.append(" ".join(words))
        for _ in range(1 + k % 12):
            words[r.randrange(300)] = f"n{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_fingerprint_is_the_majority_of_the_different_words(texts):
    for text in [*texts[:10], "", None, "one", "b a a B"]:
        assert int(near_copies.fingerprint(near_copies.words(text))) == bits_of(text)


@pytest.mark.parametrize("radius", [1, 5, 6, 9])
def test_every_radius_has_a_plan(radius):
    r = random.Random(radius)
    marks = [r.getrandbits(64) for _ in range(60)]
    counts = near_copies.np.array([[sum(m >> i & m >> j & 1 for m in marks) for j in range(64)] for i in range(64)], float)
    masks = simhash.plan(counts, len(marks), radius)
    for _ in range(300):
        change = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not change & m for m in masks)


def test_fingerprints_alone_connect_near_copies(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.marks(docs).withColumn("keys", F.array().cast("array<long>"))
    roots = {x.node: x.root for x in near_copies.components(docs, found).collect()}
    node = {x.doc_id: x.node for x in found.select("doc_id", "node").collect()}
    got = {(i, j) for i, j in combinations(range(len(texts)), 2) if roots.get(node[i], i) == roots.get(node[j], j)}
    marks, sets = [bits_of(t) for t in texts], [five(t) for t in texts]
    near = {(i, j) for i, j in combinations(range(len(texts)), 2) if (marks[i] ^ marks[j]).bit_count() <= near_copies.RADIUS}
    copies = {(i, j) for i, j in combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert got == near & copies and len(got) > 15 and near - copies
