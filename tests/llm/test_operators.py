import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bibspark.llm import chat, common, decontaminate, mixing, pu_quality, quality_rules, queries, sharding, simhash, token_output, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def prose(r, words=("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"), n=60):
    return " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))


# 2


def quality_numbers(t):
    words = WORD.findall(t)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, odd_documents, no_documents):
    r = random.Random(5)
    english = quality_rules.COMMON["en"].split()
    good = [" ".join(r.choice(english) if r.random() < 0.35 else r.choice("stone river window garden morning paper".split()) + r.choice(["", "ly", "s"]) for _ in range(200)) + "." for _ in range(60)]
    bad = [" | ".join(f"{r.randrange(10**6)}#" for _ in range(150)) for _ in range(4)]
    mixed = docs_of(spark, good + bad + ["a b a b a b a b " * 40]).unionByName(odd_documents.select("doc_id", "text", "lang", "source"))
    rows = quality_rules.judge(mixed).collect()
    assert len(rows) == 65 + 13
    by_id = {x.doc_id: x for x in rows if x.doc_id is not None and x.doc_id >= 11}
    assert all(by_id[i].kept for i in range(11, 60)) and not any(by_id[i].kept for i in range(60, 65))
    numbers = Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in rows)
    assert numbers == Counter((x.doc_id, *quality_numbers(x.text or "")) for x in mixed.select("doc_id", "text").collect())
    plan = quality_rules.judge(odd_documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality_rules.judge(no_documents).count() == 0


# 3

RULES = [*queries.URL_RULES, ("example.com", "/en/deep/", "allow"), ("example.com", "/en/deep/", "block"), (None, "/", "block"), ("org", "", "block")]
URLS = ["http://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/1", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "//no", None, "", "ftp://a.org", "http://example.com/en/deep/1", "http://example.com:80/en/", "a://b://c/d", "http://EXAMPLE.com?x/en/", "http://com/", "x://\x01com/"]


def verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), v == "block", h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("few", [50_000, 0])
def test_url_filter(spark, few):
    r = random.Random(9)
    urls = URLS + [f"http://{r.choice(['', 'www.', 'a.b.'])}{r.choice(['example.com', 'x.net', 'y.org', 'com'])}{r.choice(['/en/', '/es/', '/fr/a', '', '/en/deep/2'])}" for _ in range(300)] + ["http://hot.example.com/en/"] * 150
    pages = spark.createDataFrame([(i, u, "h", "k", "p") for i, u in enumerate(urls)] + [(None, None, None, None, None)], "page_id long, url string, html string, host string, _key string").repartition(4)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules, partitions=5, broadcast_rules=few).collect()
    assert Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in got) == Counter([(i, *verdict(u)) for i, u in enumerate(urls)] + [(None, *verdict(None))])
    assert url_filter.judge(pages.where("false"), rules, broadcast_rules=few, partitions=2).count() == 0
    assert {x.verdict for x in url_filter.judge(pages, rules.where("false"), broadcast_rules=few, partitions=2).collect()} == {"allow"}


# 4


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}


def test_fingerprint(odd_documents):
    for x in odd_documents.where("length(text) < 1000 or text is null").collect():
        assert simhash.fingerprint(x.text) == brute_fingerprint(x.text)


@pytest.mark.parametrize("bucket", [8192, 20])
def test_links_lose_nothing(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(11)
    fps = {0}
    for _ in range(60):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 3, 8])):
            fps.add(f)
            for _ in range(r.randrange(5)):
                f ^= 1 << r.randrange(64)
    centre = r.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a % 3)}
    signed = [simhash.signed(f) for f in fps]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, least long")
    masks = simhash.plan(simhash.bit_counts(nodes), len(signed))
    edges = [(x.a, x.b) for x in simhash.links(nodes, masks, 3).collect()]
    u = lambda x: x & (1 << 64) - 1
    assert all((u(a) ^ u(b)).bit_count() <= 3 for a, b in edges) and len(edges) < 60 * len(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges:
        root[find(u(a))] = find(u(b))
    expected = brute_components(fps)
    assert len({find(f) for f in fps}) == len(set(expected.values()))
    assert len({(find(f), expected[f]) for f in fps}) == len(set(expected.values()))


def test_plan_covers_every_pair():
    r = random.Random(13)
    for n in (100, 10**6, 10**10):
        masks = simhash.plan(np.diag(np.full(64, n / 2)) + n / 4 * (1 - np.eye(64)), n)
        for _ in range(2000):
            gone = sum(1 << b for b in r.sample(range(64), r.randrange(4)))
            assert any(not gone & m for m in masks)


def test_classes(spark, odd_documents, no_documents):
    rows = [(x.doc_id, x.fp, x.component_id) for x in simhash.classes(odd_documents).collect()]
    texts = odd_documents.select("doc_id", "text").collect()
    fps = {x.doc_id: brute_fingerprint(x.text) for x in texts if x.doc_id is not None}
    roots = brute_components([brute_fingerprint(x.text) for x in texts])
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert len(rows) == 13
    for i, f, c in rows:
        if i is not None:
            assert f & (1 << 64) - 1 == fps[i] and c == least[roots[fps[i]]]
    kept = simhash.deduplicated(odd_documents)
    ids = sorted(x.doc_id for x in kept.where("doc_id is not null").collect())
    assert kept.columns == odd_documents.columns and ids == sorted(set(least.values()))
    assert kept.where("doc_id is null").count() == 2
    assert simhash.classes(no_documents).count() == 0 and simhash.deduplicated(no_documents).count() == 0


# 5


def test_chat(spark):
    r = random.Random(17)
    odd = ["\\", "\\\\h", "#<:\\l", "### user: x </turn>\n", "", None, "a  b\n", queries.ODD_TEXT, "\\\\\\", "é😀 <"]
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 9)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2] if c % 7 else r.choice(["a:b#", None, "assistant"])
            text = r.choice(odd) if r.random() < 0.4 else " ".join("w" * r.randrange(1, 5) for _ in range(r.choice([3, 40, 130, 700])))
            rows.append((c, t, role, text, "x"))
    rows += [(None, 0, "user", "q", "x"), (None, None, "assistant", "r", "x"), (99, 1, "assistant", "tie", "x"), (99, 1, "assistant", "tie", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string").repartition(4)
    windows = chat.format_windows(frame)
    for w in windows.collect():
        assert w.n_tokens <= 512 or w.over_budget and len(re.findall("\n", w.formatted)) >= 1
        assert w.n_repeated <= 3
    assert windows.where("n_repeated > 0").count() > 0 and windows.where("window > 0").count() > 0
    assert windows.where("window > 0 and conv_id % 3 = 0 and conv_id % 7 <> 0 and not startswith(formatted, '### system: ')").count() == 0
    got = {x.conv_id: x for x in chat.read_back(windows).collect()}
    for c in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        text = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha(text), len(loss), sha(loss)), c
    assert chat.read_back(chat.format_windows(frame.where("false"))).count() == 0
    assert not re.search("Python|Pandas|Arrow", windows._jdf.queryExecution().toString())


# 6


def test_tokens(spark, odd_documents, no_documents, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    path = f"file://{tmp_path}/t"
    got = token_output.encoded(odd_documents, queries.tokenizer_path(), path)
    rows = got.collect()
    assert sorted(x.n_tokens for x in rows) == sorted(len(tokenizer.encode(x.text or "", add_special_tokens=False).ids) + 1 for x in odd_documents.collect())
    assert Counter((x.doc_id, tuple(x.tokens)) for x in rows) == Counter((x.doc_id, (*tokenizer.encode(x.text or "", add_special_tokens=False).ids, 1)) for x in odd_documents.collect())
    order = sorted(rows, key=lambda x: x.start)
    assert [x.start for x in order] == np.cumsum([0] + [x.n_tokens for x in order])[:-1].tolist()
    ids = [-1 if x.doc_id is None else x.doc_id for x in order]
    assert ids == sorted(ids)
    crc = {(x.doc_id, x.start): x.ids_crc32 for x in token_output.checksums(got).collect()}
    assert all(crc[x.doc_id, x.start] == zlib.crc32(np.array(x.tokens, "<u4").tobytes()) for x in rows)
    import pyarrow.parquet as pq

    files = [f for f in (tmp_path / "t/tokens").iterdir() if f.suffix == ".parquet"]
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(i) for f in files for i in range(5) if pq.ParquetFile(f).metadata.num_row_groups]
    assert all(c.has_offset_index for c in columns)
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns) and any("RLE_DICTIONARY" in c.encodings or "PLAIN_DICTIONARY" in c.encodings for c in columns)
    assert token_output.encoded(no_documents, queries.tokenizer_path()).count() == 0


# 7


def semi_global(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for j, x in enumerate(item, 1):
            new.append(min(row[j - 1] + (x != w), row[j] + 1, new[j - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_distance():
    r = random.Random(19)
    for _ in range(300):
        item, text = ([r.choice("abcd") for _ in range(r.randrange(1, n))] for n in (90, 60))
        assert decontaminate.nearest(item, text)[0] == semi_global(item, text)


def test_decontamination(spark, odd_documents, no_documents):
    r = random.Random(23)
    items = [[f"w{r.randrange(30)}" for _ in range(r.randrange(8, 40))] for _ in range(12)]
    texts = []
    for k in range(150):
        words = [f"w{r.randrange(30)}" for _ in range(r.randrange(0, 80))]
        if k % 2:
            copy = list(r.choice(items))
            for _ in range(r.randrange(0, 9)):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], ["new"], [copy[at], "more"]])
                copy = copy or ["x"]
            words[len(words) // 2 : len(words) // 2] = copy
        texts.append(r.choice([" ", ", ", "\n"]).join(w.upper() if r.random() < 0.2 else w for w in words))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, "too short"), (None, "a b c d e f g"), (51, None)], "item_id long, text string")
    documents = docs_of(spark, texts)
    expected = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            distance = semi_global(item, decontaminate.normal(t))
            if distance <= int(0.2 * len(item)):
                expected[d, i] = distance
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(documents, benchmark).collect()}
    assert got == expected and len({d for d, _ in got}) < 100
    kept = [x.doc_id for x in decontaminate.cleaned(documents, benchmark).collect()]
    assert kept == [d for d in range(150) if d not in {x for x, _ in expected}]
    assert decontaminate.contaminated(odd_documents, benchmark).count() == 0
    assert decontaminate.cleaned(odd_documents, benchmark).count() == 13
    assert decontaminate.contaminated(no_documents, benchmark).count() == 0
    assert decontaminate.contaminated(documents, benchmark.where("false")).count() == 0


# 8


def test_sharding(spark, odd_documents, no_documents, tmp_path):
    r = random.Random(29)
    documents = docs_of(spark, ["x" * r.choice([10, 100, 3000]) for _ in range(3000)])
    path = f"file://{tmp_path}/map"
    rows = sharding.shard(documents, 10, 512, path).collect()
    loads, places = Counter(), {}
    for x in rows:
        loads[x.shard] += x.size
        places.setdefault(x.shard, []).append(x.slot)
    assert max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    stored = sharding.load_map(spark, path)
    sizes = [0] * 512
    for x in rows:
        sizes[x.virtual_slot] += x.size
    grown = sharding.grown_map(stored, sizes)
    before, after = ({s: k for _, s, k in m} for m in (stored, grown))
    assert {after[s] for s in after if after[s] != before[s]} == {10} and {v for v, _, _ in grown} == {2}
    load = sum(sizes[s] for s in after if after[s] == 10)
    assert 0.8 < load / (sum(sizes) / 11) <= 1
    sharding.save_map(spark, grown, path)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 1) == stored
    got = sharding.shard(odd_documents, 3, 64).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((x.doc_id, len((x.text or "").encode()) + 16, zlib.crc32((x.text or "").encode())) for x in odd_documents.collect())
    assert sharding.shard(no_documents, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(documents, 0)
    assert not re.search("Python|Pandas|Arrow", sharding.shard(odd_documents, 3, 64)._jdf.queryExecution().toString())


# 9


def test_quality_classifier(spark, odd_documents, no_documents):
    r = random.Random(31)
    texts = [prose(r) + "." if i % 4 else " | ".join("#%&" * r.randrange(1, 4) for _ in range(r.randrange(20, 90))) for i in range(900)]
    documents = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(900)], "doc_id long, quality int")
    model = pu_quality.fit(documents, labels)
    assert model.prior == pytest.approx(0.75, abs=0.05)
    got = {x.doc_id: x.score for x in pu_quality.scored(documents, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 4 > 0) for i in held) > 0.97 * len(held)
    odd = pu_quality.scored(odd_documents, model).collect()
    assert len(odd) == 13 and all(0 <= x.score <= 1 for x in odd)
    assert pu_quality.scored(no_documents, model).count() == 0
    empty = pu_quality.fit(no_documents, labels.where("false"))
    assert {x.score for x in pu_quality.scored(odd_documents, empty).collect()} == {0.5}


# 10


def test_targets():
    goal = mixing.targets({"b": 100, "a": 10, None: 50, "c": 40})
    # a weighs 5, b 2, c 1, null 5
    assert goal["a"] == 20 and goal[None] == 100 and sum(goal.values()) == pytest.approx(300)
    assert goal["b"] == pytest.approx(180 * 2 / 3) and goal["c"] == pytest.approx(60)


def test_flow():
    sizes = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    flow = mixing.min_cost_flow(sizes, {"a": 100.0, "b": 100.0})
    assert sum(flow.values()) == pytest.approx(200)
    used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in sizes}
    # 210 tokens are there: nothing needs to be repeated
    assert all(used[p] <= sizes[p] + 1e-6 for p in sizes)


def test_mixing(spark, odd_documents, no_documents):
    r = random.Random(37)
    rows = [(i, " ".join("w" for _ in range(r.randrange(0, 60))), r.choice([["a"], ["b"], ["a", "b"], ["c"], [None]])) for i in range(4000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, m array<string>").repartition(5)
    got = mixing.mix(documents, F.col("m")).collect()
    assert len(got) == 4000 and all(x.mix_taken in (0, x.mix_size, 2 * x.mix_size) for x in got)
    sizes = Counter()
    taken = Counter()
    for x in got:
        sizes[tuple(sorted(x.members, key=lambda s: (s is None, s or "")))] += x.mix_size
        taken[tuple(sorted(x.members, key=lambda s: (s is None, s or "")))] += x.mix_taken
    by_source = Counter()
    for p, n in sizes.items():
        for s in p:
            by_source[s] += n
    flow = mixing.min_cost_flow(dict(sizes), mixing.targets(dict(by_source)))
    for p in sizes:
        assert abs(taken[p] - sum(flow[p, s] for s in p)) < 60
    again = mixing.mix(documents.repartition(2), F.col("m")).collect()
    assert {(x.doc_id, x.mix_taken) for x in got} == {(x.doc_id, x.mix_taken) for x in again}
    corpus = Counter(x.doc_id for x in mixing.repeated(documents, F.col("m")).collect())
    assert corpus == Counter({x.doc_id: x.mix_taken // x.mix_size for x in got if x.mix_taken})
    odd = mixing.mix(odd_documents, F.array("source")).collect()
    assert len(odd) == 13 and all(x.mix_taken <= 2 * x.mix_size for x in odd)
    assert mixing.repeated(odd_documents, F.array("source")).columns == odd_documents.columns
    assert mixing.mix(no_documents, F.array("source")).count() == 0 and mixing.by_source(mixing.mix(no_documents, F.array("source"))) == {}
    assert mixing.repeated(no_documents, F.array("source")).count() == 0


def test_word_count(spark, odd_documents):
    rows = odd_documents.select("text", common.word_count(F.col("text")).alias("n")).collect()
    assert all(x.n == len(WORD.findall(x.text or "")) for x in rows)
