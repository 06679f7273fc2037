"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text is reduced to fixed statistics (sizes, shares of kinds of bytes, words and lines, repetition) by a map over
Arrow batches, written once to the shared folder. Trees are grown on binned statistics: each feature has at most BINS bins by
quantiles, a level of a tree adds gradients and curvatures up in one histogram a node, feature and bin, and each node takes
the cut of the largest gain. Trees are complete and flattened into arrays (feature and cut by node, value by leaf), so a
batch of rows goes down all trees at once by numpy indexing; the model travels with the function.

Learning uses a bounded sample of the labelled rows whose crc32(doc_id as text) mod 5 is not 0: up to SAMPLE_ROWS of
each label by a digest of the id, of which the driver gets the statistics only (SAMPLE_ROWS x 2 short rows). Everything
else covers all documents. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null texts count as empty, and an empty text has statistics 0 and the score that the trees give those. Very
long texts are counted whole. Of several labels for an id the largest counts, of several texts of an id the least statistics;
null labels and ids are not learnt from. Digests that tie go by id. Where the training rows hold one label only, the score is that
label's (0 or 1) throughout; without any it is 0.5. A null id is never held out. Repeated rows are scored each; empty
tables give no rows; extra columns are ignored by score(), carried by keep().
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table, written

SAMPLE_ROWS = 20_000
BINS, TREES, DEPTH, RATE, PENALTY, LEAST_CURVATURE = 64, 80, 4, 0.15, 1.0, 0.5
THRESHOLD = 0.3
#: Rows that go down the trees together.
SCORED_ROWS = 16_384

STATISTICS = (
    "bytes", "words", "lines", "word_length", "longest_word", "line_length", "upper", "lower", "digits", "space", "breaks", "stops", "symbols", "wide", "control",
    "top_symbol", "entropy", "distinct_words", "top_word", "capital_words", "upper_words", "wordless", "symbol_ends", "repeated_next", "repeated_lines", "repeated_pairs",
)

_KINDS = np.zeros(256, np.int64)  # 0 control, 1 upper, 2 lower, 3 digit, 4 space, 5 break, 6 stop, 7 symbol, 8 wide
_KINDS[33:127] = 7
for _kind, _bytes in ((1, range(65, 91)), (2, range(97, 123)), (3, range(48, 58)), (4, b" \t"), (5, b"\n\r\x0b\x0c"), (6, b".,;:!?'\"-()"), (8, range(128, 256))):
    _KINDS[list(_bytes)] = _kind
_SYMBOLS = _KINDS == 7
_ENDS = frozenset(chr(b) for b in np.flatnonzero(_SYMBOLS))


def statistics_of(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return [0.0] * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KINDS, counts, 9) / n
    share = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    known, pairs = Counter(words), len(set(pairwise(words)))
    m = len(words)
    per = 1 / m if m else 0.0
    return [
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), sum(map(len, words)) * per, np.log1p(max(map(len, words), default=0)), np.log1p(n / len(lines)),
        *kinds[[1, 2, 3, 4, 5, 6, 7, 8, 0]],
        counts[_SYMBOLS].max() / n, -(share * np.log2(share)).sum(), len(known) * per, max(known.values(), default=0) * per,
        sum(w[0].isupper() for w in words) * per, sum(w.isupper() for w in words) * per, sum(not any(map(str.isalnum, w)) for w in words) * per,
        sum(w[-1] in _ENDS for w in words) * per, sum(a == b for a, b in pairwise(words)) * per, 1 - len(set(lines)) / len(lines), (m - 1 - pairs) * per if m > 1 else 0.0,
    ]


def statistics(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `kept` with `statistics` of every whole text."""

    def run(batches):
        for batch in batches:
            rows = [statistics_of(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float32()))], [*kept, "statistics"])

    schema = StructType([*docs.select(*kept).schema.fields, *StructType.fromDDL("statistics array<float>").fields])
    return docs.select(F.col("text").cast("string").alias("_t"), *kept).mapInArrow(run, schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_sample(stats: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded number of labelled rows that aren't held out, by id."""
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    own = own.where(~held_out())
    digest = F.xxhash64("doc_id", F.lit("quality"))
    few = own.where("quality > 0").orderBy(digest, "doc_id").limit(SAMPLE_ROWS).unionByName(own.where("quality <= 0").orderBy(digest, "doc_id").limit(SAMPLE_ROWS))
    few = F.broadcast(few)  # at most 2 x SAMPLE_ROWS rows
    rows = stats.select(F.col("doc_id").cast("long").alias("doc_id"), "statistics").join(few, "doc_id").groupBy("doc_id", "quality").agg(F.min("statistics").alias("statistics"))
    found = rows.orderBy("doc_id").toPandas()  # short rows, a document each
    x = np.array(found["statistics"].tolist(), float).reshape(len(found), len(STATISTICS))
    return x, (found["quality"].to_numpy() > 0).astype(float)


@dataclass
class Forest:
    """Flattened complete trees: feature and cut by (tree, node), value by (tree, leaf); rows go right where they exceed the cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    constant: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        inner = self.feature.shape[1] if len(trees) else 0
        for _ in range(int(inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.base + self.value[trees, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.concatenate([1 / (1 + np.exp(-self.margin(x[i : i + SCORED_ROWS]))) for i in range(0, len(x), SCORED_ROWS)] or [np.zeros(0)])


def _binned(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Upper edges of each feature's bins, by quantiles, and each value's bin."""
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], at, method="lower")) for j in range(x.shape[1])]
    return edges, np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def best_cuts(bins: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its feature, its cut's bin and the gain, from one histogram over (node, feature, bin)."""
    features = bins.shape[1]
    place = ((node[:, None] * features + np.arange(features)) * BINS + bins).ravel()
    sums = [np.bincount(place, np.repeat(v, features), nodes * features * BINS).reshape(nodes, features, BINS).cumsum(axis=2) for v in (g, h)]
    left, total = [s[:, :, :-1] for s in sums], [s[:, :, -1:] for s in sums]
    right = [t - s for t, s in zip(total, left, strict=True)]
    worth = lambda s: s[0] * s[0] / (s[1] + PENALTY)
    gain = np.where((left[1] >= LEAST_CURVATURE) & (right[1] >= LEAST_CURVATURE), worth(left) + worth(right) - worth(total), 0.0).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    return best // (BINS - 1), best % (BINS - 1), gain[np.arange(nodes), best]


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees of DEPTH levels, one after another, on the gradient of the logistic loss."""
    inner = 2**DEPTH - 1
    feature, cut, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    if not len(y) or y.min() == y.max():
        return Forest(0.0, feature[:0], cut[:0], value[:0], constant=float(y[0]) if len(y) else 0.5)
    base = float(np.log(y.mean() / (1 - y.mean())))
    edges, bins = _binned(x)
    margin, rows = np.full(len(y), base), np.arange(len(y))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)  # within its level
        for depth in range(DEPTH):
            first, nodes = 2**depth - 1, 2**depth
            best, place, gain = best_cuts(bins, node, nodes, g, h)
            split = gain > 1e-9
            feature[t, first : first + nodes] = np.where(split, best, 0)
            cut[t, first : first + nodes] = [edges[j][b] if s and b < len(edges[j]) else np.inf for j, b, s in zip(best, place, split, strict=True)]
            node = 2 * node + (split[node] & (bins[rows, best[node]] > place[node]))
        value[t] = -RATE * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + PENALTY)
        margin = margin + value[t, node]
    return Forest(base, feature, cut, value)


def score(stats: DataFrame, forest: Forest, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `kept` with `score` from a frame with `statistics`."""

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(forest.score(x))], [*kept, "score"])

    schema = StructType([*stats.select(*kept).schema.fields, *StructType.fromDDL("score double").fields])
    return stats.select(F.col("statistics").alias("_s"), *kept).mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents at or above the threshold, with all their columns."""
    stats = written(statistics(docs.select("doc_id", "text")), "statistics")
    forest = fit(*training_sample(stats, labels))
    own = tuple(f"k_{c}" for c in docs.columns)  # so that no column of the documents clashes with the score's
    held = docs.select("text", *(F.col(c).alias(k) for c, k in zip(docs.columns, own, strict=True)))
    scored = score(statistics(held, own), forest, own)
    return scored.where(F.col("score") >= THRESHOLD).select(*(F.col(k).alias(c) for c, k in zip(docs.columns, own, strict=True)))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, whether it was held out of learning, and the decision."""
    stats = written(statistics(table(spark, sf_dir, "documents")), "statistics")
    scored = score(stats, fit(*training_sample(stats, table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op12_quality": op12_quality}
#: Boosted trees can't be written in SQL; tests hold cuts, trees and scores against plain Python and a held-out fold.
ORACLE_SQL: dict[str, str] = {}
