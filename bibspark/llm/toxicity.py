"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are all words of the examples and their beginnings of 3 to 7 letters. A term weighs
(1 + log tf) * idf * rf^2; rf = log2(2 + a / max(1, b)) is its relevance frequency in a toxic and b
other examples, which lets a toxic word outweigh the many words that say nothing.

A bounded sample of labelled texts is indexed as posting lists that are cut into blocks of
examples; each term's largest weight in a block bounds the block's cosines, so blocks that
cannot hold a nearest example are skipped and the result stays exact. Weights are multiples of
2^-24, so every sum is exact in double precision, in whatever order it is made. Distance-weighted
votes of the nearest examples are calibrated by isotonic regression on leave-one-out votes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import schema_with, slices, small_batches

#: Bounds of the sample of labelled rows: texts, and code points of each.
MAX_EXAMPLES, MAX_EXAMPLE_CHARS = 2400, 100_000
BEGINNINGS = (3, 5, 7)
NEAREST, BLOCK, EVIDENCE = 15, 64, 3
#: A term in more than this share of the examples has a row of weights instead of a list.
DENSE = 1 / 25
#: Texts that are cut into words at once (bytes, rows), and rows that are searched at once.
SLICE_BYTES, SLICE_ROWS, BATCH_ROWS = 1 << 20, 1024, 64
UNIT = float(1 << 24)
NOT_WORD = r"[^\pL\pN]+"


def word_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words, and each text's words: row, word number and count, sorted."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), NOT_WORD)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    key, count = np.unique(row * len(words) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return words, key // max(1, len(words)), key % max(1, len(words)), count


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def place_of(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each value stands in ``among``, -1 if nowhere."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class BlockMaxIndex:
    """Sparse vectors as posting lists with a largest weight for each term and block.

    Terms of many examples have full rows of weights and of block maxima, so that their share
    of all sums is a matrix product.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int) -> None:
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        spread = np.bincount(term, minlength=terms)
        common = np.nonzero(spread > DENSE * n)[0]
        self.row = np.full(terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        dense = self.row[term] >= 0
        self.full = np.zeros((len(common), self.blocks * BLOCK))
        self.full[self.row[term[dense]], doc[dense]] = weight[dense]
        self.full_max = self.full.reshape(len(common), self.blocks, BLOCK).max(axis=2)
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order].astype(np.min_scalar_type(n)), weight[order].astype(np.float32)
        cell = term[order].astype(np.int64) * self.blocks + self.doc // BLOCK
        first = np.nonzero(np.diff(cell, prepend=-1))[0]
        self.cell_block = (cell[first] % self.blocks).astype(np.min_scalar_type(self.blocks))
        self.cell_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.cell_at = np.append(first, len(cell)).astype(np.int32)
        self.start = np.searchsorted(cell[first] // self.blocks, np.arange(terms + 1)).astype(np.int32)

    def __getstate__(self) -> dict[str, object]:
        at = np.flatnonzero(self.full)
        return self.__dict__ | {"full": (self.full.shape, at.astype(np.int32), self.full.reshape(-1)[at].astype(np.float32)), "full_max": None}

    def __setstate__(self, state: dict[str, object]) -> None:
        self.__dict__.update(state)
        shape, at, weight = state["full"]
        self.full = np.zeros(shape)
        self.full.reshape(-1)[at] = weight
        self.full_max = self.full.reshape(len(self.full), self.blocks, BLOCK).max(axis=2)

    def search(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of each query to the examples (-1: can't be near) and the k-th largest.

        ``leave`` has an example for each query that doesn't count. Every example whose cosine
        reaches the k-th largest has its cosine, ties included.
        """
        row = self.row[term]
        dense = row >= 0
        common = np.zeros((queries, len(self.full)))
        common[query[dense], row[dense]] = weight[dense]
        sizes = self.start[term[~dense] + 1] - self.start[term[~dense]]
        cell = ranges(self.start[term[~dense]], sizes)
        of, share = np.repeat(query[~dense], sizes), np.repeat(weight[~dense], sizes)
        at = of * self.blocks + self.cell_block[cell]
        bound = common @ self.full_max + np.bincount(at, share * self.cell_max[cell], queries * self.blocks).reshape(queries, self.blocks)

        out = np.full((queries, self.blocks * BLOCK), -1.0)
        k = min(k, self.n - (leave is not None))

        def measure(wanted: np.ndarray) -> np.ndarray:
            own = wanted.reshape(-1)[at]
            n = self.cell_at[cell[own] + 1] - self.cell_at[cell[own]]
            place = ranges(self.cell_at[cell[own]], n)
            sums = np.bincount(np.repeat(of[own], n) * out.shape[1] + self.doc[place], np.repeat(share[own], n) * self.weight[place], out.size).reshape(out.shape)
            if 2 * np.count_nonzero(wanted) > wanted.size:
                sums = sums + common @ self.full
                np.copyto(out, sums, where=np.repeat(wanted, BLOCK, axis=1))
            else:
                for b in np.nonzero(wanted.any(axis=0))[0]:
                    rows, block = np.nonzero(wanted[:, b])[0], slice(b * BLOCK, (b + 1) * BLOCK)
                    out[rows, block] = common[rows] @ self.full[:, block] + sums[rows, block]
            out[:, self.n :] = -1
            if leave is not None:
                out[np.arange(queries), leave] = -1
            return np.partition(out, out.shape[1] - k, axis=1)[:, out.shape[1] - k]

        first = np.zeros((queries, self.blocks), bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, : 1 + -(-k // BLOCK)], True, axis=1)
        least = measure(first)
        rest = ~first & (bound >= least[:, None])
        return out, measure(rest) if rest.any() else least


class Model:
    """Terms, index, labels and calibration; as large as the sample, for any corpus."""

    def __init__(self, rows: list[tuple[int, str, int]]) -> None:
        rows = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
        n, self.label = len(rows), np.array([r[2] for r in rows], float)
        self.ids = [r[0] for r in rows]
        self.prior = float((self.label.sum() + 0.5) / (n + 1))
        self.index = None
        if not n:
            return
        # a few texts at a time, so that the driver needs little more than the index
        parts = [(i, pa.array([r[1] for r in rows[i : i + BATCH_ROWS]], pa.large_string())) for i in range(0, n, BATCH_ROWS)]
        words = pc.unique(pa.chunked_array([word_counts(texts)[0] for _, texts in parts]))
        self.words = words.filter(pc.not_equal(words, ""))
        starts = [pc.utf8_slice_codeunits(self.words.filter(pc.greater(pc.utf8_length(self.words), k)), 0, k) for k in BEGINNINGS]
        self.starts = pc.unique(pa.chunked_array(starts))
        found = [[x.astype(np.int32) for x in (row + i, term, times)] for i, texts in parts for row, term, times in [self.terms(*word_counts(texts))]]
        row, term, times = (np.concatenate(x) for x in zip(*found, strict=True))
        del parts, starts, found
        toxic = np.bincount(term, self.label[row], len(self.words) + len(self.starts))
        held = np.bincount(term, minlength=len(toxic))
        self.factor = (np.log((n + 1) / (held + 1)) + 1) * np.log2(2 + toxic / np.maximum(1, held - toxic)) ** 2
        weight = self.weights(row, term, times, n)
        # similar examples side by side: by the term that weighs most
        heaviest = np.zeros(n, np.int64)
        order = np.lexsort((weight, row))
        heaviest[row[order]] = term[order]
        place = np.empty(n, np.int64)
        place[np.lexsort((np.arange(n), heaviest))] = np.arange(n)
        self.ids = [self.ids[i] for i in np.argsort(place)]
        self.label = self.label[np.argsort(place)]
        self.index = BlockMaxIndex(place[row], term, weight, n, len(toxic))
        self.x, self.y = np.array([0.0, 1.0]), np.array([self.prior, self.prior])
        if n > 1:
            votes = np.zeros(n)
            for a in range(0, n, BATCH_ROWS):
                own = slice(*np.searchsorted(row, (a, a + BATCH_ROWS)))
                leave = place[a : a + BATCH_ROWS]
                cosines, least = self.index.search(row[own] - a, term[own], weight[own], len(leave), NEAREST, leave)
                votes[leave] = [self.vote(*self.near(c, x)) for c, x in zip(cosines, least, strict=True)]
            self.x, self.y = isotonic(votes, self.label)

    def terms(self, words: pa.Array, row: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and frequency from counts of words, rows in order."""
        size, w, of = pc.utf8_length(words).to_numpy(zero_copy_only=False), len(self.words), len(self.words) + len(self.starts)
        own = place_of(words, self.words)[word]
        begun = np.stack([np.where(size > k, place_of(pc.utf8_slice_codeunits(words, 0, k), self.starts), -1) for k in BEGINNINGS], axis=1)[word]
        at, which = np.nonzero(begun >= 0)
        key = row[at] * of + w + begun[at, which]
        if len(key) < 1 << 24 and len(key) and key[-1] < 1 << 38:
            order = np.sort(key << 24 | np.arange(len(key))) & (1 << 24) - 1  # faster than argsort()
        else:
            order = np.argsort(key)
        key = key[order]
        first = np.nonzero(np.diff(key, prepend=-1))[0]
        times = np.add.reduceat(count[at[order]], first) if len(first) else np.zeros(0, np.int64)
        key, known = key[first], own >= 0
        row = np.concatenate((row[known], key // max(1, of)))
        order = np.argsort(row, kind="stable")
        return row[order], np.concatenate((own[known], key % max(1, of)))[order], np.concatenate((count[known], times))[order]

    def weights(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, rows: int) -> np.ndarray:
        """Unit vectors' weights, rounded to multiples of 1 / UNIT."""
        weight = (1 + np.log(times)) * self.factor[term]
        length = np.sqrt(np.bincount(row, weight * weight, rows))
        return np.round(weight / length[row] * UNIT) / UNIT

    def near(self, cosines: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of all that are as near as the k-th nearest, ties included."""
        near = np.nonzero(cosines >= max(least, 0.0))[0]
        return near, cosines[near]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Votes weigh 1 / distance; examples that tie for the last places share these."""
        tied = cosine == cosine.min()
        weight = 1 / (1.001 - cosine)
        places = min(NEAREST, len(near)) - np.count_nonzero(~tied)
        weight[tied] *= places / np.count_nonzero(tied)
        return float((weight * self.label[near]).sum() / weight.sum())

    def score(self, texts: pa.Array) -> tuple[list[float], list[list[dict[str, object]]]]:
        """Calibrated scores and the nearest examples as evidence."""
        if self.index is None:
            return [self.prior] * len(texts), [[] for _ in range(len(texts))]
        scores, evidence = [], []
        for a, b in slices(texts, SLICE_BYTES, SLICE_ROWS):
            row, term, times = self.terms(*word_counts(texts.slice(a, b - a)))
            weight = self.weights(row, term, times, b - a)
            for c in range(0, b - a, BATCH_ROWS):
                n = min(BATCH_ROWS, b - a - c)
                own = slice(*np.searchsorted(row, (c, c + n)))
                cosines, least = self.index.search(row[own] - c, term[own], weight[own], n, NEAREST)
                for x, y in zip(cosines, least, strict=True):
                    near, cosine = self.near(x, y)
                    vote = self.vote(near, cosine)
                    scores.append(0.98 * float(np.interp(vote, self.x, self.y)) + 0.02 * vote)
                    shown = np.nonzero(cosine >= np.partition(cosine, -EVIDENCE)[-EVIDENCE])[0] if len(cosine) > EVIDENCE else range(len(cosine))
                    best = sorted((-cosine[i], self.ids[near[i]], near[i]) for i in shown)[:EVIDENCE]
                    evidence.append([{"doc_id": d, "cosine": -float(c), "label": int(self.label[i])} for c, d, i in best])
        return scores, evidence


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of the labels' mean over the votes, as points to interpolate."""
    order = np.argsort(votes, kind="stable")
    blocks: list[list[float]] = []
    for x, y in zip(votes[order], labels[order], strict=True):
        blocks.append([y, 1.0, x * 1.0])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y1, n1, x1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + n1, blocks[-1][2] + x1]
    x = np.array([b[2] / b[1] for b in blocks])
    y = np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks])
    return x, np.maximum.accumulate(y)


def training_rows(documents: DataFrame, labels: DataFrame, label: str, most: int = MAX_EXAMPLES, chars: int = MAX_EXAMPLE_CHARS) -> DataFrame:
    """doc_id, text and label of at most ``most`` labelled texts: those of least hashed ids.

    Labels come only from rows whose crc32(doc_id as text) mod 3 is not 1. Of labels of one id
    the largest counts, of texts of one id the least; a null label, id or text and texts of over
    ``chars`` code points are no examples.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # `most` rows
    return rows.where(F.length("text") <= chars).groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from the bounded sample of training_rows(); without examples it scores 0.5."""
    return Model([tuple(r) for r in training_rows(documents, labels, label).collect()])


EVIDENCE_SCHEMA = "array<struct<doc_id:bigint,cosine:double,label:int>>"


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence of each whole text, with no shuffle.

    Null and empty texts have no terms: every example is as near, and they get the calibrated
    share of toxic examples. Repeated rows are scored alike, other columns are ignored, and an
    empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = shared.value.score(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])
            pa.default_memory_pool().release_unused()

    schema = schema_with(documents.select("doc_id"), f"score double, evidence {EVIDENCE_SCHEMA}")
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def accepted(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is under ``threshold``, judged where they are.

    Columns stay, whatever their names. Null and empty texts are scored like any other and,
    unless most examples are toxic, stay; repeated rows are judged alike; an empty table gives
    no rows.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x < threshold for x in shared.value.score(batch.column(at))[0]], pa.bool_()))
            pa.default_memory_pool().release_unused()

    return documents.mapInArrow(run, documents.schema)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
