"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that vary together are grouped into partitions. If the thresholds t_i of m partitions sum
to radius - m + 1, two fingerprints within the radius differ by at most t_i bits in some
partition i; t_i = -1 skips one. A dynamic programme gives each partition its threshold by
estimated candidate counts from statistics of all fingerprints. Fingerprints that meet in a
partition are verified on all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import rows_of, schema_with, staged, text_key
from bibspark.operators.components import connected_components

BITS = 64
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CHUNK = 1 << 16
#: A bucket of more fingerprints is split again by the bits that are still free.
BUCKET = 8192


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, each set if it is set in over half the shingles' hashes; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[shingle - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=False)
        hashes = np.array([digest(joined[s:e], 42) for s, e in pairs], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (a long with the bits) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    schema = schema_with(documents.select("doc_id"), "fp long")
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> np.ndarray:
    """counts[i, j]: in how many fingerprints bits i and j are both set. 4096 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), CHUNK):
                bits = np.unpackbits(raw[at : at + CHUNK], axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        cells = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.record_batch([pa.array(cells), pa.array(total.reshape(-1).astype(np.int64))], names=["cell", "n"])

    out = np.zeros(BITS * BITS)
    for r in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(BITS, BITS)


def grouped_bits(spin: np.ndarray, spins: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width; each takes the free bit that varies most with its own."""
    tie = np.abs(spins - np.outer(spin, spin))
    np.fill_diagonal(tie, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = (BITS * (g + 1)) // m - (BITS * g) // m
        own = [max(free, key=lambda b: (sum(tie[b, c] for c in free), -b))]
        free.remove(own[0])
        while len(own) < width:
            best = max(free, key=lambda b: (sum(tie[b, c] for c in own), -b))
            own.append(best)
            free.remove(best)
        groups.append(sorted(own))
    return groups


def within(spin: np.ndarray, spins: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimates P(distance in the group <= t) for t = 0..most of two random fingerprints.

    Mean and variance of the distance follow from the bits' first and second moments; a
    beta-binomial distribution with these stands for the rest.
    """
    w = len(group)
    differ = (1 - spin[group] ** 2) / 2
    mean = max(1e-6, min(w - 1e-6, float(differ.sum())))
    var = float((differ * (1 - differ)).sum())
    for b, c in combinations(group, 2):
        var += 2 * (spins[b, c] ** 2 - spin[b] ** 2 * spin[c] ** 2) / 4
    p = mean / w
    rho = min(0.95, max(1e-4, (var / max(1e-9, w * p * (1 - p)) - 1) / (w - 1))) if w > 1 else 1e-4
    a, b = p * (1 - rho) / rho, (1 - p) * (1 - rho) / rho
    lbeta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    out, total = [], 0.0
    for t in range(most + 1):
        total += math.comb(w, t) * math.exp(lbeta(t + a, w - t + b) - lbeta(a, b))
        out.append(min(1.0, total))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 that sum to ``total`` at least cost; costs[i][t + 1] is that of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t1, c in enumerate(row):
                s = done + t1 - 1
                if s not in step or cost + c < step[s][0]:
                    step[s] = (cost + c, [*chosen, t1 - 1])
        best = step
    return best[total]


def plan(counts: np.ndarray, n: int, radius: int = 3, most: int = 2) -> list[int]:
    """Bit masks to probe: a pair within the radius is equal under at least one of them.

    A threshold t over w bits is probed by the C(w, t) masks that leave out t of them. The cost
    of a choice: a signature a fingerprint and mask, plus the expected pairs to verify.
    """
    seen = max(n, 1)
    both, ones = counts / seen, np.diag(counts) / seen
    spin = 2 * ones - 1
    spins = 4 * both - 2 * ones[:, None] - 2 * ones[None, :] + 1
    best: tuple[float, list[int]] | None = None
    for m in range(2, radius + 3):
        if radius - m + 1 > most * m:
            continue
        groups = grouped_bits(spin, spins, m)
        costs = []
        for g in groups:
            p = within(spin, spins, g, most)
            costs.append([0.0] + [n * math.comb(len(g), t) + 0.01 * n * n / 2 * p[t] for t in range(most + 1)])
        total = radius - m + 1
        cost, thresholds = allocate(costs, total)
        if best is None or cost < best[0]:
            masks = []
            for g, t in zip(groups, thresholds, strict=True):
                if t >= 0:
                    masks += [sum(1 << b for b in g if b not in gone) for gone in combinations(g, t)]
            best = (cost, masks)
    return best[1]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def narrower(mask: int, radius: int) -> list[int]:
    """Masks that fix more bits: of radius + 1 groups of free bits a pair agrees on one."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    parts = [free[i :: radius + 1] for i in range(radius + 1)]
    return [mask | sum(1 << b for b in part) for part in parts]


def forest(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: rows i, j of the same bucket within the radius.

    ``starts`` has each row's first row of the bucket. Rows are compared at lag 1, 2, ...; pairs
    that are connected already are skipped, so at most one link a row comes out.
    """
    n = len(fps)
    label = np.arange(n)
    last = np.searchsorted(starts, starts, side="right") - 1
    left, right = [], []
    rows, lag = np.arange(n), 1
    while True:
        rows = rows[rows + lag <= last[rows]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fps[rows] ^ fps[rows + lag]) <= radius]
        near = near[label[near] != label[near + lag]]
        while len(near):
            a, b = label[near], label[near + lag]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            # each root is hung once: keep the first link of every hi
            roots, first = np.unique(hi, return_index=True)
            left.append(near[first])
            right.append(near[first] + lag)
            parent = np.arange(n)
            parent[roots] = lo[first]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            label = parent[label]
            near = near[label[near] != label[near + lag]]
        lag += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def links(fps: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within the radius.

    Fingerprints equal under a mask form a bucket. A bucket of over BUCKET is not compared but
    split by narrower masks; as its members are distinct, it is small once 13 bits are free.
    """
    found = None
    todo = dict(enumerate(masks))
    rows = fps.select("fp")
    waiting = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in todo.items()))).alias("s"), "fp").select("s.*", "fp")
    while True:
        waiting = staged(waiting, "simhash-probe")
        sizes = waiting.groupBy("mask", "key").count().where(F.col("count") > 1)
        big = staged(sizes.where(F.col("count") > BUCKET), "simhash-large")
        is_big = not big.isEmpty()
        ready = waiting.join(big.select("mask", "key"), ["mask", "key"], "left_anti") if is_big else waiting
        part = staged(_compared(ready, radius), "simhash-links")
        found = part if found is None else found.unionByName(part)
        if not is_big:
            return found
        below = {k: narrower(m, radius) for k, m in todo.items()}
        flat = sorted({m for ms in below.values() for m in ms})
        number = {m: i for i, m in enumerate(flat)}
        again = waiting.join(big.select("mask", "key"), ["mask", "key"])
        deeper = F.lit(None)
        for k, ms in below.items():
            deeper = F.when(F.col("mask") == k, F.array(*(F.struct(F.lit(number[m]).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for m in ms))).otherwise(deeper)
        waiting = again.select("fp", F.explode(deeper).alias("s")).select("s.*", "fp").distinct()
        todo = dict(enumerate(flat))


def _compared(buckets: DataFrame, radius: int) -> DataFrame:
    """Each bucket's forest; buckets are sorted runs, so many small ones go through at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3

        def out(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(fp), bool)
            new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
            i, j = forest(fp.view(np.uint64), starts, radius)
            return pa.record_batch([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate((k, c.to_numpy(zero_copy_only=False).astype(np.int64))) for k, c in zip(kept, batch.columns, strict=True)]
            if not len(cols[0]):
                continue
            change = np.nonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))[0]
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield out(*(c[:cut] for c in cols))
            kept = [c[cut:] for c in cols]
        if len(kept[0]):
            yield out(*kept)

    sorted_rows = buckets.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return sorted_rows.mapInArrow(run, "a long, b long")


def classes(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over links) of each document.

    Texts without words (null, empty) have fingerprint zero and link like others. Equal
    fingerprints are one node with its least doc_id, so copies of one text cost one node, ties
    and repeated rows included. A null doc_id is never a component's id unless the component
    has no other. Other columns are ignored; an empty table gives no rows.
    """
    marks = staged(fingerprints(documents, shingle), "simhash-marks")
    nodes = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    n = nodes.count()
    if not n:
        return marks.withColumn("component_id", F.col("doc_id"))
    edges = links(nodes, plan(bit_counts(nodes), n, radius), radius)
    roots = connected_components(edges, name="simhash-components")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One document of each component: that of the least doc_id, then of the least text hash.

    Rows that share an id but no component are judged apart, and of rows equal in id and text
    one stays. Rows with a null doc_id are no copies of named ones; of a component's one stays.
    """
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", text_key(F.col("text")).alias("text_key"))
    found = staged(classes(documents.select(named.alias("doc_id"), "text"), shingle, radius), "simhash-classes")
    kept = found.groupBy("component_id", "doc_id.unnamed").agg(F.min("doc_id").alias("first"))
    return rows_of(documents, kept.select("first.doc_id", "first.text_key"), found.select("doc_id.doc_id", "doc_id.text_key"))
