"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts, with an estimated class prior, give an unbiased risk of
a classifier; the part that stands for negatives is kept from going below zero (non-negative
risk). The prior is estimated from the same two samples: where a classifier is surest, unlabelled
texts are almost all positive, so their share over that of the positives bounds the prior. No
negative label is used. The model is additive: each statistic of a text is cut at its quantiles
and each interval has a weight.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import schema_with

#: Bound of the samples that the model is fitted on: texts of each kind, of any length.
MAX_SAMPLE = 6000
INTERVALS = 10
STEPS, RATE, DECAY = 600, 0.05, 1e-4
#: Positives that a threshold of the prior's estimate leaves above it, at least.
KEEP = 0.9

_CLASS = np.full(256, 7, np.uint8)  # bytes of other letters
for _chars, _kind in ((bytes(range(97, 123)), 0), (bytes(range(65, 91)), 1), (b"0123456789", 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:!?'\"-()", 5), (bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:!?'\"-()"), 6)):
    _CLASS[list(_chars)] = _kind
NAMES = (
    *("share of " + n for n in ("lower", "upper", "digits", "blanks", "newlines", "stops", "symbols", "other")),
    *("words", "mean word", "distinct words", "commonest word", "repeated neighbours", "capital words", "exclaiming words", "symbol words"),
    *("words a line", "distinct lines", "long words", "one-letter words", "repeated pairs", "stopped words"),
)


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; zeros for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    out = np.zeros(len(NAMES))
    if not n:
        return out
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    out[:8] = kinds / len(raw)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    pairs = set(zip(words, words[1:], strict=False))
    ends = Counter(w[-1] for w in words)
    out[8:] = (
        np.log1p(n),
        sizes.mean(),
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(k for w, k in counts.items() if w.isupper() and len(w) > 1) / n,
        ends[33] / n,
        sum(ends[c] for c in b"#*$%&|<>") / n,
        np.log1p(n / len(lines)),
        len(set(lines)) / len(lines),
        np.count_nonzero(sizes > 25) / n,
        np.count_nonzero(sizes == 1) / n,
        1 - (len(pairs) + 1) / n,
        (ends[46] + ends[44]) / n,
    )
    return out


class Model:
    """Cuts and weights of the intervals; a few kilobytes for any corpus."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> None:
        self.prior = float(np.clip(prior, 0.01, 0.99))
        both = np.concatenate((positive, unlabelled))
        shares = np.linspace(0, 1, INTERVALS + 1)[1:-1]
        # quantiles of either sample and of both tails, so that rare texts have intervals too
        shares = np.unique(np.concatenate((shares, [0.005, 0.02, 0.05, 0.95, 0.98, 0.995])))
        self.cuts = [np.unique(np.quantile(both[:, j], shares)) if len(both) else np.zeros(0) for j in range(len(NAMES))]
        self.offsets = np.concatenate(([0], np.cumsum([len(c) + 1 for c in self.cuts])))
        self.weights = np.zeros(self.offsets[-1])
        self.bias = float(np.log(self.prior / (1 - self.prior)))
        if len(positive) and len(unlabelled):
            self.fit(self.places(positive), self.places(unlabelled))

    def places(self, rows: np.ndarray) -> np.ndarray:
        """The weight that each statistic of each row falls on."""
        return np.stack([np.searchsorted(c, rows[:, j], side="right") + o for j, (c, o) in enumerate(zip(self.cuts, self.offsets[:-1], strict=True))], axis=1)

    def margins(self, places: np.ndarray) -> np.ndarray:
        return self.weights[places].sum(axis=1) + self.bias

    def risk(self, positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """The parts of the risk with their gradients (weights, then bias), l being logistic.

        First prior * E_p[l(z)], then E_u[l(-z)] - prior * E_p[l(-z)], which stands for negatives.
        """
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        def gradient(places: np.ndarray, slope: np.ndarray) -> np.ndarray:
            out = np.bincount(places.reshape(-1), np.repeat(slope, places.shape[1]), minlength=len(self.weights))
            return np.append(out, slope.sum()) / len(places)

        zp, zu = self.margins(positive), self.margins(unlabelled)
        first = self.prior * np.logaddexp(0, -zp).mean()
        second = np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()
        g_second = gradient(unlabelled, sigmoid(zu)) - self.prior * gradient(positive, sigmoid(zp))
        return first, self.prior * gradient(positive, -sigmoid(-zp)), second, g_second

    def step(self, positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
        """The direction to go against: both parts' gradient, or, where the negatives' part is
        below zero (overfitted), back out of that part alone."""
        _, g_first, second, g_second = self.risk(positive, unlabelled)
        return g_first + g_second if second >= 0 else -g_second

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray) -> None:
        """Adam on the non-negative risk."""
        size = len(self.weights)
        first, second = np.zeros(size + 1), np.zeros(size + 1)
        for step in range(1, STEPS + 1):
            g = self.step(positive, unlabelled)
            g[:-1] += DECAY * self.weights
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            self.weights -= move[:-1]
            self.bias -= float(move[-1])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of good quality."""
        return 1 / (1 + np.exp(-np.clip(self.margins(self.places(rows)), -40, 40)))


def upper_bound(positive: np.ndarray, unlabelled: np.ndarray, keep: float = KEEP) -> float:
    """The least share of unlabelled over positive scores above a threshold.

    Thresholds have at least ``keep`` of the positives above them: few scores can't decide.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = p[: int((1 - keep) * len(p)) + 1]
    q_p = 1 - np.searchsorted(p, cuts) / len(p)
    q_u = 1 - np.searchsorted(u, cuts) / len(u)
    return float((q_u / q_p).min())


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of positives among the unlabelled, by upper_bound() of two classifiers.

    ``halves`` has 0 or 1 for each row; a text that is in both samples must be in the same half.
    Each classifier tells one half of the positives from that of the unlabelled, and scores the
    other halves. The lesser bound is the prior of a second round, whose lesser bound is the
    estimate. One half if a half has no texts.
    """
    if any(not (h == k).any() for h in halves for k in (0, 1)):
        return 0.5
    prior = 0.5
    for _ in range(2):
        bounds = []
        for own in (0, 1):
            model = Model(*(x[h == own] for x, h in zip((positive, unlabelled), halves, strict=True)), prior)
            bounds.append(upper_bound(*(model.margins(model.places(x[h != own])) for x, h in zip((positive, unlabelled), halves, strict=True))))
        prior = min(1.0, *bounds)
    return prior


def _gathered(documents: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of one text (the least) of each of a bounded number of ids, and their halves.

    The driver gets numbers, no texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = documents.select("doc_id", "text").dropna().join(F.broadcast(ids), "doc_id")  # MAX_SAMPLE ids
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(run, schema_with(ids, "x array<double>"))
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])
    half = [zlib.crc32(str(r["doc_id"]).encode()) // 3 % 2 for r in found]
    return np.array([r["x"] for r in found]).reshape(-1, len(NAMES)), np.array(half, np.int64)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from at most MAX_SAMPLE trusted positives and as many unlabelled texts.

    Labels come only from rows whose crc32(doc_id as text) mod 3 is not 1, and of them only
    those that say 1. Positives are those of least hashed ids; unlabelled texts are drawn from
    all documents by a hash of their id, whatever their labels. Of an id's texts the least
    counts, and of its labels the largest; null labels, ids and texts are left out. Without
    positives or texts the prior is one half and every text scores it.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    trusted = known.where("label = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_SAMPLE)
    n = documents.select("doc_id").count()
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30))
    # a little more than needed, of which the least draws stay
    share = int(min(1.0, 1.2 * MAX_SAMPLE / max(n, 1)) * (1 << 30)) + 1
    drawn = documents.where(F.col("doc_id").isNotNull() & (draw < share)).select("doc_id").distinct().orderBy(draw, "doc_id").limit(MAX_SAMPLE)
    (positive, half_p), (unlabelled, half_u) = _gathered(documents, trusted), _gathered(documents, drawn)
    return Model(positive, unlabelled, estimated_prior(positive, unlabelled, (half_p, half_u)))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each whole text, with no shuffle.

    Null and empty texts have statistics of zero and a score like any other. Repeated rows are
    scored alike, other columns are ignored, and an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(NAMES))
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(rows))], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, schema_with(documents.select("doc_id"), "score double"))
