"""Near copies by exact Jaccard similarity of five-word shingles.

Candidates are SimHash fingerprints of the texts' word sets within RADIUS bits, found by op4's
generalised pigeonhole. At Jaccard 0.8 fingerprints may differ by more bits than any radius that
prunes, so texts that share a band of MinHash values are candidates too; a pair at Jaccard 0.8
shares none of the 30 bands of 5 values with probability 7e-6. Candidates are measured on the whole
shingle sets, so fingerprints and bands only decide what is compared, never what is a copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import rows_of, schema_with, small_batches, staged, text_key
from bibspark.llm.simhash import BITS, LOWER, bit_counts, links, plan
from bibspark.operators.components import connected_components

SHINGLE = 5
#: Least Jaccard similarity of copies, as a fraction of whole numbers.
ALIKE = (4, 5)
#: Fingerprints within so many bits are candidates.
RADIUS = 6
BANDS, ROWS = 30, 5
CHUNK = 1 << 12
#: A bucket of more members is compared in pairs of blocks of so many.
BLOCK = 512
_RANDOM = np.random.default_rng(20)
SCALES = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> np.ndarray:
    """The hash of every word, in order."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted; a shorter text is one shingle, none without words."""
    return cut(words(text))


def cut(found: np.ndarray) -> np.ndarray:
    """The shingles of a text's words."""
    n = len(found)
    if not n:
        return found
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * FACTOR + found[k : n - size + 1 + k])
    return np.unique(out)


def fingerprint(found: np.ndarray) -> np.uint64:
    """64 bits, each set if it is set in over half the different words' hashes; 0 without words."""
    found = np.unique(found)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(found), CHUNK):
        counts += np.unpackbits(found[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0]


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of least values; texts without words have none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), CHUNK):
        np.minimum(least, (short[at : at + CHUNK, None] * SCALES + SHIFTS).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * FACTOR + column)
    return keys.view(np.int64)


def alike(both: int | np.ndarray, a: int, b: int | np.ndarray) -> bool | np.ndarray:
    """Whether sets of a and b members that share ``both`` are copies."""
    return ALIKE[1] * both >= ALIKE[0] * (a + b - both)


def marks(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, node (hash of the shingle set), fingerprint and band keys of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys = [], [], []
            for text in batch.column(2):
                own = words(text.as_py())
                found = cut(own)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                fps.append(fingerprint(own))
                keys.append(bands(found))
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            cols = [batch.column(0), batch.column(1), *longs, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            yield pa.record_batch(cols, names=["doc_id", "text_key", "node", "fp", "keys"])

    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, schema_with(rows.select("doc_id", "text_key"), "node long, fp long, keys array<long>"))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints are within RADIUS bits.

    Nodes of one fingerprint are paired with the least of them, which stands for it. The pairs are
    a forest, so a copy that is joined by a text that is none is left to the bands.
    """
    fps = staged(nodes.groupBy("fp").agg(F.min("node").alias("own"), F.count(F.lit(1)).alias("n")), "near-fingerprints")
    n = fps.count()
    same = nodes.join(fps.where("n > 1"), "fp").where("node <> own").select(F.col("own").alias("a"), F.col("node").alias("b"))
    if n < 2:
        return same
    near = links(fps, plan(bit_counts(fps), n, RADIUS), RADIUS)
    for end in ("a", "b"):
        near = near.join(fps.select(F.col("fp").alias(end), F.col("own").alias(f"own_{end}")), end)
    return same.unionByName(near.select(F.col("own_a").alias("a"), F.col("own_b").alias("b")))


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its shingle set, for the text of each wanted node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "set"])

    texts = documents.select(text_key(F.col("text")).alias("text_key"), "text").join(wanted, "text_key")
    # of equal texts one is cut into shingles
    return texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, set array<long>")


def forest(sets: list[np.ndarray], roots: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect all copies of a bucket; those with the same root are connected already."""
    label = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left, right = [], []
    for i, own in enumerate(sets):
        small, large = np.minimum(sizes, len(own)), np.maximum(sizes, len(own))
        if not ((label != label[i])[i + 1 :] & (ALIKE[1] * small >= ALIKE[0] * large)[i + 1 :]).any():
            continue
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.bincount(owner[own[at] == flat], minlength=len(sets))
        for j in np.nonzero(alike(both, len(own), sizes))[0]:
            if j > i and label[j] != label[i]:
                left.append(i)
                right.append(int(j))
                label[label == label[j]] = label[i]
    return left, right


def _compared(buckets: DataFrame) -> DataFrame:
    """Each bucket's forest, from sorted runs of key, node, root and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> pa.RecordBatch:
            i, j = forest([r[2] for r in rows], np.array([r[1] for r in rows]))
            nodes = np.array([r[0] for r in rows], np.int64)
            return pa.record_batch([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

        for batch in batches:
            key, node, root = (batch.column(k).to_numpy() for k in range(3))
            for k in range(batch.num_rows):
                if rows and key[k] != now:
                    yield out()
                    rows = []
                now = key[k]
                rows.append((node[k], root[k], batch.column(3)[k].values.to_numpy().view(np.uint64)))
        if rows:
            yield out()

    return buckets.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def _blocked(buckets: DataFrame) -> DataFrame:
    """Buckets of key, node, root and n with new keys: one for each pair of a bucket's blocks.

    A member of a bucket of n goes to n / BLOCK pairs, so every two members meet and no task
    holds more than about two blocks of a bucket.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = buckets.withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(F.when(blocks > 1, pair).otherwise(F.col("key")).alias("key"), "node", "root")


def components(documents: DataFrame, found: DataFrame) -> DataFrame:
    """node and root of the nodes that have copies, from ``found``, the documents' marks.

    First the pairs that the fingerprints give are compared, and every member of a bucket with its
    least one. Buckets whose members are not all connected by then are compared pair by pair, large
    ones in blocks, so a large group of copies costs a comparison a member and a bucket, and
    nothing is left out.
    """
    nodes = staged(found.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-nodes")
    rows = nodes.select("node", F.explode("keys").alias("key"))
    groups = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who")).where("n > 1")
    # buckets of the same members are one
    groups = groups.groupBy("hub", "n", "who").agg(F.min("key").alias("key")).select("key", "hub", "n")
    members = staged(rows.join(groups, "key"), "near-members")
    star = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = fingerprint_pairs(nodes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = staged(star.unionByName(near).distinct(), "near-pairs")
    ends = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    sets = staged(_sets(documents, nodes.join(ends, "node", "left_semi").select("node", "text_key")), "near-sets")
    pairs = first.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("x", "y")))
    edges = staged(pairs.where(alike(F.col("both"), F.size("x"), F.size("y"))).select("a", "b"), "near-links")
    roots = staged(connected_components(edges, name="near-components"), "near-roots")
    unsure = members.where("n > 2").join(roots, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("root"))
    open_ = unsure.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    more = _blocked(unsure.join(open_, "key", "left_semi")).join(sets, "node").select("key", "node", "root", "set")
    more = staged(_compared(more), "near-links")
    if more.isEmpty():
        return roots
    return connected_components(edges.unionByName(more), name="near-components")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each component of near copies: that of the least doc_id, nulls last.

    Components follow from the texts alone, so rows that share an id but no text are judged
    apart, and copies without an id are reduced like others. Ties of the id go by a hash of the
    text; of rows equal in both one stays. Texts without words are copies of each other.
    """
    found = staged(marks(documents), "near-marks")
    whose = staged(components(documents, found), "near-classes")
    named = found.select("doc_id", "text_key", "node").join(whose, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    kept = named.groupBy("root").agg(F.min(first).alias("first")).select("first.doc_id", "first.text_key")
    return rows_of(documents, kept, found.select("doc_id", "text_key"))
