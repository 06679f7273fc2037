"""Embedding whitening by merged moments: count, mean and centred scatter of each partition, merged in a tree.

Vectors are quantised to whole numbers, floor(256 * c). Moments are taken over the distinct quantised vectors (found by a
grouping that combines before its shuffle, so copies cost nothing). Every partition reduces its vectors, batch by batch, to
their number, mean, exact sums and scatter about the mean; two such states are merged by Chan's formula, which adds the
outer product of the gap of their means, in treeReduce. The covariance is decomposed on the driver (a matrix of the vectors'
length, whatever the number of rows). A second pass merges the moments of the whitened vectors in the same way and reports
how far their covariance is from the identity.

Every row is then projected by a map. The exact squared deviation is computed in whole numbers.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; rows without id stay. Shorter
vectors count as filled up with zeros. Entries beyond a long, deviations beyond a long are given as the largest or least long.
A component without variance (below 1e-12 of the trace) has whitened and explained 0 and no part in identity_error,
which is 0 if none has variance. A component's sign makes its largest entry (the first of several) positive. Repeated rows
are returned each but fitted once; empty tables, or vectors without entries, give no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, COMPONENTS = 256, 4
#: Share of the trace below which an eigenvalue counts as none; largest entry whose sums and squares stay within a long.
NO_VARIANCE, SMALL = 1e-12, 2**40
LARGEST = 2**63 - 1

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """Number of vectors, exact sums, mean and scatter about the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        whole = x.dtype.kind == "i"
        small = not whole or abs(x).max(initial=0) < SMALL
        sums = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
        mean = (sums / len(x)).astype(float)
        gap = x - mean
        return Moments(len(x), [int(s) for s in sums] if whole else [], mean, gap.T @ gap)

    def merge(self, other: Moments) -> Moments:
        """Chan's formula for two disjoint sets."""
        n = self.n + other.n
        gap = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + gap * (other.n / n), scatter)


@dataclass
class Whitening:
    """The fitted map: n and sums of the fit list, components (columns), their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers."""
        most = max(map(abs, self.sums), default=0)
        if most < 2**62 and self.n * int(abs(x).max(initial=0)) < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list[int]:
        g = self.gaps(x)
        if float(np.square(g.astype(float)).sum(axis=1).max(initial=0)) < 2**62:
            return np.square(g.astype(np.int64)).sum(axis=1).tolist()
        return [min(LARGEST, sum(int(v) ** 2 for v in row)) for row in g.astype(object)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        some = self.values > 0
        out = np.zeros((len(x), len(self.values)))
        out[:, some] = (self.gaps(x) / self.n).astype(float) @ self.components[:, some] / np.sqrt(self.values[some])
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and `x`, whole numbers floor(256 * c), of the rows that remain."""
    whole = lambda c: F.when(c * SCALE >= 2.0**63, F.lit(LARGEST)).when(c * SCALE <= -(2.0**63), F.lit(-LARGEST)).otherwise(F.floor(c * SCALE))
    x = F.transform("embedding", lambda c: c.cast("double"))
    fit = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fit = fit.where(F.forall("x", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))))
    return fit.select("vec_id", F.transform("x", whole).alias("x"))


def _matrix(lists, dim: int) -> np.ndarray:
    lists = list(lists)
    if lists and all(len(v) == dim for v in lists):
        return np.array(lists, np.int64)
    out = np.zeros((len(lists), dim), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def moments(rows: DataFrame, values) -> Moments:
    """Merged moments of `values` (a function of a frame's batch) over all rows, of which there must be one."""

    def state(batches):
        held = None
        for pdf in batches:
            if len(pdf):
                new = Moments.of(values(pdf))
                held = held.merge(new) if held else new
        return held

    def partial(batches):
        if (held := state(batches)) is not None:
            yield pd.DataFrame({"state": [pickle.dumps(held)]})

    # Arrow batches become one state a partition; states are merged on the executors, level by level.
    states = rows.mapInPandas(partial, "state binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return states.treeReduce(lambda a, b: a.merge(b))


def fit(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """The whitening of the distinct vectors, and the error of its second pass."""
    if not dim:
        return None
    found = moments(distinct.select("x"), lambda pdf: _matrix(pdf["x"], dim))
    values, vectors = np.linalg.eigh(found.scatter / found.n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(found.scatter)) / found.n
    k = min(components, dim)
    values, vectors = np.where(values[:k] > NO_VARIANCE * trace, values[:k], 0.0), vectors[:, :k]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(k)] < 0, -1.0, 1.0)
    model = Whitening(found.n, found.sums, vectors, values, values / trace if trace > 0 else values)
    some = np.flatnonzero(values > 0)
    if not len(some):
        return model, 0.0
    seen = moments(distinct.select("x"), lambda pdf: model.whitened(_matrix(pdf["x"], dim))[:, some])
    return model, float(np.abs(seen.scatter / seen.n - np.eye(len(some))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """RESULT: for every remaining row its first components, with the fit's figures."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    distinct = written(rows.select("x").distinct(), "distinct-vectors")
    dim = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    fitted = fit(distinct, dim, components)
    if fitted is None:
        return spark.createDataFrame([], RESULT)
    model, error = fitted
    k = len(model.values)

    def project(batches):
        for pdf in batches:
            x = _matrix(pdf["x"], dim)
            m = len(x)
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"].astype("Int64").repeat(k).array,
                "component": np.tile(np.arange(1, k + 1), m),
                "n": model.n,
                "deviation": np.repeat(np.array(model.deviation(x), np.int64), k),
                "whitened": model.whitened(x).reshape(-1),
                "explained": np.tile(model.shares, m),
                "identity_error": error,
            })

    return rows.mapInPandas(project, RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates on the first 4 components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
#: Eigenvectors can't be written in SQL; tests hold the result against numpy over the whole table.
ORACLE_SQL: dict[str, str] = {}
