import random
from itertools import combinations

import corpus_pipeline
import pytest
from bibspark.llm import near_copies

EXTRA = "near_row string, node long, `key` string"


def five(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    sets, root = [five(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def varied(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(23)
    out = ["", None, " \t\n", "one", "ONE ", "two words", "a b c d e", "a b c d e f"]
    for _ in range(40):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([30, 120, 600]))]
        out += [varied(r, words, e * len(words) // 120) for e in (0, 0, 1, 2, 3, 5, 8)]
    hot = [f"h{i}" for i in range(200)]
    out += [varied(r, hot, r.randrange(1, 5)) for _ in range(120)]
    r.shuffle(out)
    return out


def test_stage_keeps_one_of_each_group_at_jaccard_0_8(spark, texts):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], f"doc_id long, text string, {EXTRA}").repartition(4)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(brute(texts)))


def test_forest_without_first_links(texts):
    some = [t for t in texts if five(t)]
    a, b = near_copies.forest([near_copies.shingles(t) for t in some], near_copies.np.arange(len(some)))
    root = list(range(len(some)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(a, b, strict=True):
        root[find(j)] = find(i)
    expected = brute(some)
    assert len({(find(i), expected[i]) for i in range(len(some))}) == len(set(expected)) == len({find(i) for i in range(len(some))})


def test_repeated_and_null_ids(spark):
    words = " ".join(f"x{i}" for i in range(50))
    other, third = words.replace("x", "y"), words.replace("x", "z")
    rows = [(1, words), (2, words), (2, other), (3, other), (None, third), (None, third), (None, words), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(x) for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert len(left) == 4 and set(left) == {(1, words), (2, other), (None, third), (4, "")}
    assert near_copies.deduplicated(docs.where("false")).count() == 0
