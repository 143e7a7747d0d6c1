import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspark.llm import decontaminate, mixing, pu_quality, quality_rules, sharding, token_output

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 2


def histograms(text, language):
    kinds = {"lower": 0, "blank": 0, "letter": 0, "upper": 0, "stop": 0, "digit": 0, "rest": 0}
    for c in text:
        kind = "lower" if "a" <= c <= "z" else "blank" if c in " \t\n\x0b\x0c\r" else "upper" if "A" <= c <= "Z" else "letter" if c.isalpha() else "stop" if c in ".,;:!?'\"()-" else "digit" if "0" <= c <= "9" else "rest"
        kinds[kind] += 1
    words = WORD.findall(text)
    count = Counter(w.lower() for w in words)
    own = [count[w] / max(1, len(words)) for w in quality_rules.COMMON[language].split()]
    return [v / max(1, len(text)) for v in kinds.values()], [*own, max(0.0, 1 - sum(own))]


def jensen_shannon(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def test_divergence_is_held_against_its_definition(spark):
    r = random.Random(7)
    rows = []
    for i in range(240):
        language = r.choice(["en", "fr"])
        common = quality_rules.COMMON[language].split()
        share = r.choice([0.35, 0.3, 0.05])
        words = [r.choice(common) if r.random() < share else r.choice("stone river Größe garden 77 paper été".split()) + r.choice(["", ".", "%%%%" if i % 9 == 0 else ","]) for _ in range(r.choice([30, 52, 70, 79, 80, 200, 900]))]
        rows.append((i, " ".join(words), language if i % 11 else None))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality_rules.judge(frame).collect()}
    means = {}
    for k in ("en", "fr"):
        own = [histograms(t, k) for _, t, g in rows if g == k and len(WORD.findall(t)) >= quality_rules.LEAST_WORDS]
        means[k] = [np.mean([h[j] for h in own], axis=0) for j in (0, 1)]
    kept = 0
    for i, text, _ in rows:
        n = len(WORD.findall(text))
        best = []
        for k, (chars, words) in means.items():
            c, w = histograms(text, k)
            dc, dw = jensen_shannon(c, chars), jensen_shannon(w, words)
            excess = [0.0]
            if len(text) >= quality_rules.LEAST_CHARS:
                excess.append(dc / (quality_rules.MOST_CHARS + quality_rules.SLACK_CHARS / math.sqrt(n)))
            if n >= quality_rules.LEAST_WORDS:
                excess.append(dw / (quality_rules.MOST_WORDS + quality_rules.SLACK_WORDS / math.sqrt(n)))
            best.append((max(excess), k, dc, dw))
        excess, k, dc, dw = min(best)
        x = got[i]
        assert (x.language, x.kept) == (k, not x.base_failed and excess <= 1)
        assert (x.js_chars, x.js_words) == (pytest.approx(dc, abs=1e-9), pytest.approx(dw, abs=1e-9))
        kept += x.kept
    assert 40 < kept < 200
    # the guard is longer than the base rule's: such a text is kept though its words fit nothing
    assert quality_rules.LEAST_WORDS > quality_rules.BASE_WORDS
    odd = spark.createDataFrame([(1, " ".join(f"w{i}x" for i in range(n)), None) for n in (60, 400)], "doc_id long, text string, lang string")
    assert [x.js_words > 0.3 for x in quality_rules.judge(frame.unionByName(odd)).where("lower(language) is not null and doc_id = 1 and n_words in (60, 400)").collect()] == [True, True]


# 6


def test_tokens_equal_whole_text_encoding(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from bibspark.llm.queries import tokenizer_path

    whole, own = Tokenizer.from_file(tokenizer_path()), token_output.Encoder(tokenizer_path())
    assert own.model is not None
    r = random.Random(3)
    letters = "aZé ÀÿßµªºŸ²½'sSrReE-_<|>\n\t\x0b\x85\xa0 “–’€.!9٣日本éİıſﬁΣς"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(4000)] + ["don't WE'LL x'S'", "<|endoftext|>", None, "", "a" * 70_000 + " 日 " + "b c" * 40_000]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for most in (token_output.REMEMBERED, 500):
        token_output.REMEMBERED, kept = most, token_output.REMEMBERED
        ids, sizes = own.encode(pa.array(texts, pa.string()))
        token_output.REMEMBERED = kept
        ends = np.cumsum(sizes)
        for t, a, b in zip(texts, ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, token_output.END_ID]


# 7


def test_short_items_and_string_ids(spark):
    docs = spark.createDataFrame([(1, "Well: the quick, BROWN fox."), (2, "the quick red fox"), (3, None), (4, "lone")], "doc_id long, text string")
    items = spark.createDataFrame([("four", "the quick brown fox"), ("one", "Lone!"), ("none", "..."), (None, "the")], "item_id string, text string")
    assert {(x.doc_id, x.item_id, x.distance) for x in decontaminate.contaminated(docs, items).collect()} == {(1, "four", 0), (4, "one", 0)}
    assert sorted(x.doc_id for x in decontaminate.cleaned(docs, items).collect()) == [2, 3]


# 8


def test_equal_rows_spread(spark):
    same = spark.range(20_000).selectExpr("7L as doc_id", "'the same text' as text")
    rest = spark.range(3_000).selectExpr("id as doc_id", "repeat('x', 20) as text")
    got = sharding.shard(same.unionByName(rest), 40).collect()
    loads, places = Counter(), {}
    for x in got:
        loads[x.shard] += x.size
        places.setdefault(x.shard, []).append(x.slot)
    assert len(got) == 23_000 and len(loads) == 40
    assert max(loads.values()) < 1.05 * min(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


# 9


def test_risk_and_its_gradient():
    r = np.random.default_rng(3)
    names = len(pu_quality.NAMES)
    p, u = r.random((40, names)), r.random((70, names)) * 1.2
    model = pu_quality.Model(p, u, 0.6)
    places = model.places(p), model.places(u)
    model.weights = r.normal(size=len(model.weights))
    first, g_first, second, g_second = model.risk(*places)
    sig = lambda x: 1 / (1 + math.exp(-x))
    z = lambda rows: [sum(model.weights[i] for i in row) + model.bias for row in rows]
    loss = lambda x: -math.log(sig(x))
    mean = lambda x: sum(x) / len(x)
    assert first == pytest.approx(0.6 * mean([loss(x) for x in z(places[0])]))
    assert second == pytest.approx(mean([loss(-x) for x in z(places[1])]) - 0.6 * mean([loss(-x) for x in z(places[0])]))
    for at in (*r.choice(len(model.weights), 12, replace=False), -1):
        found = []
        for d in (1e-5, -1e-5):
            if at < 0:
                model.bias += d
            else:
                model.weights[at] += d
            found.append(model.risk(*places))
            if at < 0:
                model.bias -= d
            else:
                model.weights[at] -= d
        assert g_first[at] == pytest.approx((found[0][0] - found[1][0]) / 2e-5, abs=1e-6)
        assert g_second[at] == pytest.approx((found[0][2] - found[1][2]) / 2e-5, abs=1e-6)


def test_the_negative_part_never_drives_below_zero():
    r = np.random.default_rng(4)
    p = r.random((30, len(pu_quality.NAMES)))
    model = pu_quality.Model(p, p, 0.9)
    places = model.places(p)
    model.bias = -8.0  # E_u - prior * E_p > 0 is impossible to break here: both samples are equal
    assert model.risk(places, places)[2] >= 0
    model.prior = 1.5  # a prior too high makes the part negative
    model.bias = 3.0
    _, first, second, g_second = model.risk(places, places)
    assert second < 0
    assert model.step(places, places) == pytest.approx(-g_second)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_is_estimated_without_negatives(prior):
    r = np.random.default_rng(5)
    names = len(pu_quality.NAMES)

    def draw(n, good):
        x = r.normal(size=(n, names))
        x[:, :3] += 3.0 * good
        return x

    positive = draw(3000, 1)
    n = round(3000 * prior)
    unlabelled = np.concatenate((draw(n, 1), draw(3000 - n, 0)))
    unlabelled = unlabelled[r.permutation(len(unlabelled))]
    halves = tuple(np.arange(len(x)) % 2 for x in (positive, unlabelled))
    model = pu_quality.Model(positive, unlabelled, pu_quality.estimated_prior(positive, unlabelled, halves))
    assert model.prior == pytest.approx(prior, abs=0.04)
    fresh = np.concatenate((draw(500, 1), draw(500, 0)))
    if prior < 0.7:  # where few negatives are mixed in, 22 statistics of pure noise hide them
        assert ((model.score(fresh) >= 0.5) == (np.arange(1000) < 500)).mean() > 0.93
    assert pu_quality.estimated_prior(positive[:1], unlabelled, (halves[0][:1], halves[1])) == 0.5


def test_null_and_repeated_labels(spark):
    rows = [(i, "word and more words here. " * (3 + i % 5) if i % 4 else "## && %% " * 9) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, "x"), (5, None), *rows[:3]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(None, 1), (7, None), (9, 1), (9, 1)], "doc_id long, quality int")
    a, b = pu_quality.fit(docs, labels), pu_quality.fit(docs.repartition(3), labels.repartition(2))
    assert a.prior == b.prior and (a.weights == b.weights).all()


# 10


def test_routed_is_the_min_cost_flow():
    r = random.Random(11)
    for _ in range(30):
        names = [None, *"abcdefgh"]
        sizes = {tuple(sorted(r.sample(names, r.choice([1, 1, 1, 2, 3])), key=mixing.by_code_point)): r.randrange(0, 90) for _ in range(9)}
        by_name = Counter()
        for p, n in sizes.items():
            for s in p:
                by_name[s] += n
        quota = mixing.targets(dict(by_name))
        whole, parts = mixing.min_cost_flow(sizes, quota), mixing.routed(sizes, quota)
        assert sum(parts.values()) == pytest.approx(sum(whole.values()), abs=1e-4)
        cost = lambda f: sum(max(0.0, sum(f.get((p, s), 0.0) for s in p) - n) for p, n in sizes.items())
        assert cost(parts) == pytest.approx(cost(whole), abs=1e-4)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 100)
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 as int)) as text", "cast(id % 2500 as string) as source")
    got = mixing.mix(docs, F.array("source")).collect()
    assert len(got) == 6000 and all(x.mix_taken in (0, x.mix_size, 2 * x.mix_size) for x in got)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for x in got:
        s = x.members[0]
        sizes[s] += x.mix_size
        taken[s] += x.mix_taken
        largest[s] = max(largest[s], x.mix_size)
    for s, goal in mixing.targets(dict(sizes)).items():
        assert taken[s] <= goal + 0.5 and goal - taken[s] < max(1, largest[s]) + 0.5
