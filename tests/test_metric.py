"""Similarity joins by pivots against every pair: no pair within the radius is lost, most blocks out of reach are never built."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import consolidate as C
from memloom.operators import metric

from .test_operators import frame, memory


def vectors(spark, x, extra=()):
    rows = [(f"{i:05}", [float(c) for c in v], "a" if i % 3 else "b") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id string, embedding array<double>, g string")


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_no_pair_within_the_radius_is_lost(spark, monkeypatch, spread):
    monkeypatch.setattr(metric, "CELL_ROWS", 20)
    r = np.random.default_rng(6)
    x = r.normal(size=(12, 5))[r.integers(0, 12, 400)] + spread * r.normal(size=(400, 5))
    x[50:80] = x[50]  # copies
    odd = [("nan", [float("nan")] * 5, "a"), ("none", None, "a"), ("empty", [], "a"), ("short", [1.0, 0.0], "a"), ("short2", [1.0, 0.1], "a")]
    rows = vectors(spark, x, odd).withColumns({"asks": F.col("id") < "00300", "answers": F.col("id") >= "00100"})
    dealt = metric.blocks(rows, 0.3, ("g",), 16).persist()
    sizes = dealt.groupBy("g", "cell", "ring", "sub", "chunk", "asks").count().agg(F.max("count")).first()[0]
    assert sizes < 60  # about 16, dealt by digest
    key = ["g", "cell", "ring", "sub", "chunk"]
    met = {(a.id, a.b) for a in dealt.where("asks").join(dealt.where("NOT asks").withColumnRenamed("id", "b").drop("embedding", "asks"), key).collect()}
    ids = [f"{i:05}" for i in range(400)]
    for i in range(300):
        for j in range(100, 400):
            if (i % 3 == 0) == (j % 3 == 0) and np.linalg.norm(x[i] - x[j]) <= 0.3:
                assert (ids[i], ids[j]) in met
    assert not {i for p in met for i in p} & {"nan", "none", "empty", "short", "short2"}
    if spread < 0.1:  # clusters: most pairs never meet
        assert metric.compared(dealt, ("g",)) < 0.5 * 300 * 300
    dealt.unpersist()


def test_links_of_clustered_rows_and_a_hot_vector(spark, monkeypatch):
    """Against every pair, with one vector on a third of the rows; the share of pairs compared stays below one half."""
    monkeypatch.setattr(metric, "CELL_ROWS", 30)
    monkeypatch.setattr(C, "BLOCK_ROWS", 50)
    r = np.random.default_rng(3)
    x = r.normal(size=(20, 6))[r.integers(0, 20, 360)] + 0.03 * r.normal(size=(360, 6))
    x[::3] = x[0]
    x = x.astype(np.float32).astype(float)
    rows = [memory(f"{i:03}", embedding=[float(c) for c in v], category="user" if i % 2 else "other") for i, v in enumerate(x)]
    got = {(l.a, l.b): l.sim for l in C.similar_links(frame(spark, *rows), 0.82, 0.92).collect()}
    want = {}
    for i in range(360):
        sim = np.round(1 - np.linalg.norm(x - x[i], axis=1) / 2, 4)
        for j in np.lexsort((np.arange(360), -sim))[:6]:
            if i != j and sim[j] >= (0.82 if i % 2 == j % 2 else 0.92):
                want[f"{i:03}", f"{j:03}"] = sim[j]
    assert len(want) > 500 and got == pytest.approx(want)
    distinct = [row for i, row in enumerate(rows) if i % 3 or not i]
    dealt = metric.blocks(frame(spark, *distinct).select("id", "embedding", F.lit(True).alias("asks"), F.lit(True).alias("answers")), C.similar_radius(0.82, 0.92))
    assert metric.compared(dealt) < 0.5 * len(distinct) ** 2
    assert C.similar_links(frame(spark), 0.82, 0.92).count() == 0


def test_rows_without_near_pivots_are_dealt_in_tiles(spark):
    """Evenly spread vectors: each row is sent once a block, not to every cell."""
    x = np.random.default_rng(5).normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = vectors(spark, x).withColumns({"asks": F.lit(True), "answers": F.lit(True)})
    assert metric.blocks(rows, 0.36, block_rows=500, tile_rows=1000).count() <= 2 * 2 * 2000
    assert metric.blocks(rows, 0.36, ("g",), 500).count() <= 4000 * 3
