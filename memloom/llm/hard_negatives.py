"""Hard negatives by a norm-bucketed search of exact integer inner products.

Candidates are sorted by the length of their quantised vector, floor(256 * x), longest first, and packed into buckets of
bounded size. By Cauchy and Schwarz no score of an anchor in a bucket exceeds the product of the anchor's length and
the bucket's longest one. Positives (the first rows of the anchor's label) are searched in the longest buckets first; the
last score found then says how far down the buckets can hold a better one, and only those are read. Each positive opens
a window of scores, and a negative is one of the first rows of another label inside it: buckets out of reach of all lower
limits of an anchor are never shipped to it, and inside a task a bucket is skipped for every anchor whose limits and running
k-th scores lie above its bound.

Anchors are a stated query set: chunks of them meet groups of buckets; one (chunk, group) is one bounded task. Labels are
a column of the buckets, so a frequent label is spread like any other. Only a window's k best rows leave a task.

Sizes. A product of lengths below 2^53 makes every partial sum exact in double precision, so short vectors are multiplied
as matrices. Longer ones (any finite value takes part) are in buckets of their own, are never skipped, and are multiplied as
whole numbers of any size. Scores beyond a long are given as the largest or least one, but compared by their true value.

Defined cases: rows with a null label, null id, null vector or a null or non-finite component take no part. Shorter vectors
count as filled up with zeros. Rows of an anchor's own id are neither its positives nor its negatives; of several rows
with an anchor's id the smallest (vector, then label) asks. Repeated candidates count each, so a repeated positive opens a
window each time. Negative positive scores open an empty window. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bit_sliced import LARGEST, _order_key, quantised
from .common import table, written

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Rows of a bucket, buckets of a group and anchors of a chunk, about; together they bound a task's memory.
BUCKET_ROWS, GROUP, CHUNK_ANCHORS = 4096, 8, 128
#: Vectors below this length multiply exactly in double precision.
SHORT = 2.0**26
#: Buckets whose lengths the driver knows, evenly spaced; slack of a bound for rounding.
MARKS, SLACK = 1000, 1 + 1e-9

FOUND = "anchor_id long, place int, positive_id long, positive_score long, vec_id long, score long, key binary, about double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, `x` (array of double) and `norm` (of the quantised vector) of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = vectors.where("embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    fit = fit.where(F.forall("x", lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))))
    whole = F.transform("x", lambda v: F.when(F.abs(v) < 2.0**44, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE))
    return fit.withColumn("norm", F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, v: s + v * v)))


def _padded(rows: list, dim: int, kind) -> np.ndarray:
    out = np.zeros((len(rows), dim), kind)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def build_index(fit: DataFrame) -> tuple[DataFrame, int]:
    """Buckets, numbered from the longest vectors down, and their number: `longest`, ids, labels and vectors packed."""
    size = BUCKET_ROWS

    def pack(part: int, order: int, held: list) -> dict:
        ids, labels, xs, norms = zip(*held, strict=True)
        dim, wide = max(map(len, xs)), norms[0] >= SHORT
        x = _padded(xs, dim, float)
        data = x if wide else np.floor(SCALE * x).astype(np.int32)
        return {"part": part, "place": order, "longest": float("inf") if wide else norms[0], "dim": dim, "wide": wide, "ids": np.array(ids, np.int64).tobytes(), "labels": np.array(labels, np.int64).tobytes(), "x": data.tobytes()}

    def build(batches):
        held, part, order = [], 0, 0
        for pdf in batches:
            out = []
            for part, *row in zip(pdf["part"], pdf["vec_id"], pdf["label"], pdf["x"], pdf["norm"], strict=True):
                if held and (len(held) >= size or (held[0][3] >= SHORT) != (row[3] >= SHORT)):
                    out.append(pack(part, order, held))
                    held, order = [], order + 1
                held.append(row)
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([pack(part, order, held)])

    parts = max(1, -(-fit.count() // (4 * size)))
    ordered = [F.desc("norm"), F.col("vec_id"), F.col("label")]
    dealt = fit.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered).select(F.spark_partition_id().alias("part"), "vec_id", "label", "x", "norm")
    packed = written(dealt.mapInPandas(build, "part int, place long, longest double, dim int, wide boolean, ids binary, labels binary, x binary"), "norm-buckets")
    counts = sorted((r["part"], r["n"]) for r in packed.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    if not counts:
        return packed.withColumn("bucket", F.lit(0).cast("long")), 0
    first = F.broadcast(fit.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "part int, first long"))
    return packed.join(first, "part").withColumn("bucket", F.col("first") + F.col("place")), starts[-1]


def _last(index: DataFrame, buckets: int, need: Column) -> Column:
    """The last bucket that may hold a vector as long as `need`: from evenly spaced buckets, rounded down the list."""
    step = -(-buckets // MARKS)
    marks = index.where(F.col("bucket") % step == 0).select("longest").orderBy(F.desc("longest")).collect()  # at most MARKS
    reached = F.size(F.filter(F.array(*(F.lit(r["longest"]) for r in marks)), lambda m: m * SLACK >= need))
    return F.least(F.lit(buckets - 1), F.lit(step) * reached - 1).cast("long")


def _true(score: int, key) -> int:
    return int(score) if key is None else int.from_bytes(key, "big") - (1 << 2200)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if score.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    at = np.arange(len(ids))
    if len(ids) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(ids) - k)[len(ids) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


class _Anchor:
    """An anchor's windows (lower limit, upper limit, best rows so far)."""

    def __init__(self, row, k: int, same: bool, low: int, high: int):
        self.id, self.label, self.norm, self.k, self.same = row["vec_id"], row["label"], row["norm"], k, same
        self.q = quantised(row["x"])
        if same:
            self.windows = [[0, None, None, -float("inf"), float("inf"), []]]
        else:
            scores = [(p["place"], p["vec_id"], p["score"], _true(p["score"], p["key"])) for p in row["positives"]]
            self.windows = [[place, i, shown, -(-low * s // 100), high * s // 100, []] for place, i, shown, s in scores]

    def limit(self) -> float:
        """The least score that could still be taken."""
        return min(max(w[3], w[5][-1][0]) if len(w[5]) == self.k else w[3] for w in self.windows)

    def reaches(self, longest: float) -> bool:
        return longest == float("inf") or self.norm * longest * SLACK >= self.limit()

    def take(self, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fit = (labels == self.label) & (ids != self.id) if self.same else (labels != self.label) & (ids != self.id)
        at = np.flatnonzero(fit & (score >= self.limit()))
        score, ids = score[at], ids[at]
        for w in self.windows:
            least = max(w[3], w[5][-1][0]) if len(w[5]) == self.k else w[3]
            inside = np.flatnonzero((score >= least) & (score <= w[4]))
            best = inside[_best(score[inside], ids[inside], self.k)]
            new = [(int(score[i]), int(ids[i])) for i in best]
            w[5] = sorted(w[5] + new, key=lambda p: (-p[0], p[1]))[: self.k]


def _search(index: DataFrame, asked: DataFrame, k: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """FOUND: the k best rows of every window of the anchors in the buckets `first` to `last` of each."""
    spark = index.sparkSession
    band = F.log2(F.col("last") - F.col("first") + 1).cast("int")
    counts = {r["band"]: r["n"] for r in asked.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}  # at most 64 bands
    if not counts:
        return spark.createDataFrame([], FOUND)
    chunks = F.create_map(*(F.lit(v) for b, n in counts.items() for v in (b, -(-n // CHUNK_ANCHORS))))
    dealt = asked.withColumn("band", band).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks[F.col("band")]))
    fields = ["vec_id", "label", "norm", "x"] + ([] if same else ["positives"])
    packed = dealt.groupBy("band", "chunk").agg(F.collect_list(F.struct(*fields)).alias("anchors"), F.min("first").alias("first"), F.max("last").alias("last"))
    # A unit is a chunk and a group of buckets, strided so that each group begins with long ones.
    groups = F.ceil((F.col("last") - F.col("first") + 1) / GROUP)
    units = packed.select("band", "chunk", F.explode(F.sequence("first", "last")).alias("bucket"), groups.alias("groups")).withColumn("lane", F.col("bucket") % F.col("groups"))

    def search(key, pdf: pd.DataFrame) -> pd.DataFrame:
        anchors = [_Anchor(a, k, same, low, high) for a in pdf["anchors"].iloc[0]]
        dims = max((len(a.q) for a in anchors), default=0)
        short = np.array([a.norm < SHORT for a in anchors])
        narrow = _padded([a.q if s else [] for a, s in zip(anchors, short, strict=True)], dims, float)
        for r in pdf.sort_values("bucket").itertuples():
            ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
            near = [i for i, a in enumerate(anchors) if a.windows and a.reaches(r.longest)]
            if not near:
                continue
            dim = min(dims, r.dim)
            x = np.frombuffer(r.x, float if r.wide else np.int32).reshape(len(ids), r.dim)[:, :dim]
            fast = [] if r.wide else [i for i in near if short[i]]
            if fast:
                for i, s in zip(fast, narrow[fast, :dim] @ x.T.astype(float), strict=True):
                    anchors[i].take(s, ids, labels)
            slow = [i for i in near if r.wide or not short[i]]
            if slow:
                rows = np.array([quantised(v) if r.wide else [int(c) for c in v] for v in x.tolist()], object).reshape(len(ids), dim)
                for i in slow:
                    q = np.array((anchors[i].q + [0] * dim)[:dim], object)
                    anchors[i].take(rows @ q if dim else np.zeros(len(ids), object), ids, labels)
        out = [(a.id, place, p, shown, i, max(-LARGEST, min(LARGEST, s)), _order_key(s), float(max(-(2**1000), min(2**1000, s)))) for a in anchors for place, p, shown, _, _, best in a.windows for s, i in best]
        pdf = pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])
        return pdf.astype({"positive_id": "Int64", "positive_score": "Int64"})

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * sum(-(-n // CHUNK_ANCHORS) for n in counts.values()))
    met = units.join(index, "bucket").join(packed.select("band", "chunk", "anchors"), ["band", "chunk"])
    met = met.select("band", "chunk", "lane", "bucket", "longest", "wide", "dim", "ids", "labels", "x", "anchors").repartition(spread, "band", "chunk", "lane")
    return met.groupBy("band", "chunk", "lane").applyInPandas(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: the first negatives of every anchor and positive."""
    fit = usable(vectors)
    index, buckets = build_index(fit)
    one = F.min(F.struct("x", "label", "norm")).alias("r")
    anchors = written(fit.where(is_anchor).groupBy("vec_id").agg(one).select("vec_id", "r.label", "r.norm", "r.x"), "anchors")

    # Positives: the longest buckets first; then those that can reach the last score found.
    head = min(GROUP, buckets)
    asked = anchors.withColumn("first", F.lit(0).cast("long")).withColumn("last", F.lit(head - 1).cast("long"))
    best = written(_ranked(_search(index, asked.where(F.lit(buckets > 0)), positives, True), positives), "positives")
    if buckets > head:
        last_score = best.where(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("about").alias("least"))
        need = F.when((F.col("least") > 0) & (F.col("norm") > 0), F.col("least") / F.col("norm")).otherwise(0.0)
        rest = anchors.join(last_score, "vec_id", "left").withColumn("first", F.lit(head).cast("long")).withColumn("last", _last(index, buckets, need))
        more = _search(index, rest.where("last >= first").drop("least"), positives, True)
        best = written(_ranked(best.drop("rank").unionByName(more), positives), "positives")

    opened = best.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id"))
    opened = opened.agg(F.collect_list(F.struct(F.col("rank").alias("place"), "vec_id", "score", "key")).alias("positives"), F.min("about").alias("least"))
    asked = anchors.join(opened, "vec_id").withColumn("first", F.lit(0).cast("long"))
    if buckets:
        need = F.when(F.col("norm") > 0, F.col("least") * low / 100 / F.col("norm")).otherwise(0.0)
        asked = asked.withColumn("last", _last(index, buckets, need)).where("last >= first")
        found = _search(index, asked.drop("least"), negatives, False, low, high)
    else:
        found = fit.sparkSession.createDataFrame([], FOUND)
    return _ranked(found, negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 3 hard negatives for each of the 5 positives of each id divisible by 50, over all rows."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE_SQL = {
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0)::HUGEINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same
      QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id))::INT AS rank,
             s.vec_id AS negative_id, p.positive_score::BIGINT AS positive_score, s.score::BIGINT AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
}
