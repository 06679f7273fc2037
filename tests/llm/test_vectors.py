import math
import random

import numpy as np
from pyspark.sql import functions as F

from memloom.llm import bit_sliced, kmeans_tree

from .common import same_as_sql

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def table(spark, n=400, dim=8, hot=100):
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(dim)], 0, 1, 0.5) for i in range(n)]
    rows += [(n + i, [0.5] * dim, 0, 1, 0.5) for i in range(hot)]  # one vector many times
    odd = [None, [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(100_000 + 50 * i, v, 0, 1, 0.5) for i, v in enumerate(odd)] + [(None, [1.0] * dim, 0, 1, 0.5)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_bit_sliced_against_sql(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bit_sliced, "CHUNK_QUERIES", 4)
    df, _ = table(spark)
    good = df.where("vec_id IS NOT NULL")
    same_as_sql(bit_sliced.top_k(df, F.col("vec_id") % 50 == 0), bit_sliced.ORACLE_SQL["op8_bit_sliced_top_k"], embeddings=good)


def test_bit_sliced_small_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bit_sliced.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    # Every other row is a candidate: shorter vectors count as filled up with zeros.
    two = spark.createDataFrame([(0, [1.0, -2.0], 0, 1, 0.0), (7, [-0.001, 300.0], 0, 1, 0.0), (8, [1.0], 0, 1, 0.0)], SCHEMA)
    got = [tuple(r) for r in bit_sliced.top_k(two, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 256 * 256), (0, 2, 7, 256 * -1 + -512 * 76800)]


def test_bit_sliced_takes_every_finite_vector(spark, monkeypatch):
    """Components of 1e7 and 3e38 take part; scores beyond a long keep their order and are given as the largest or least."""
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 4)
    r = random.Random(9)
    size = lambda: r.choice([0.01, 1.0, 1e7, -1e7, 4e4, 3e38, -2e38, 1e20])
    rows = [(i, [float(np.float32(size() * r.random())) for _ in range(r.choice([3, 3, 3, 2]))], 0, 1, 0.0) for i in range(120)]
    rows += [(200, [1e7], 0, 1, 0.0), (201, [2.0], 0, 1, 0.0), (202, [3.0], 0, 1, 0.0)]
    got = {}
    for row in bit_sliced.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    q = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v, *_ in rows}
    most = 2**63 - 1
    for a in (0, 50, 100, 200):
        score = {b: sum(x * y for x, y in zip(q[a], q[b])) for b in q if b != a}
        want = sorted(score, key=lambda b: (-score[b], b))[:5]
        assert got[a] == [(b, max(-most, min(most, score[b]))) for b in want]


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 0, 1, 0.0), (0, [0.5, 0.0], 0, 1, 0.0), (1, [1.0, 1.0], 0, 1, 0.0), (1, [1.0, 1.0], 0, 1, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in bit_sliced.top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 128 * 256), (0, 2, 1, 128 * 256)]


def brute(rows, k):
    fit = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in fit:
        if q % 20 == 0:
            found = sorted((-float(np.cumsum(np.array(v) * np.array(w))[-1]), i) for i, w in fit if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def found(df, k=20):
    out = {}
    for r in kmeans_tree.search(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_tree_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF_SAMPLE", 32)
    monkeypatch.setattr(kmeans_tree, "BLOCK_ROWS", 30)
    monkeypatch.setattr(kmeans_tree, "CHUNK_QUERIES", 10)
    df, rows = table(spark)
    want, got = brute(rows, 20), found(df)
    assert got.keys() == want.keys()
    recall = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / len(want[q]) for q in want]
    assert sum(recall) / len(recall) >= 0.9
    scores = {(q, i): s for q, x in brute(rows, 10_000).items() for i, s in x}
    for q, x in got.items():
        assert len(x) == 20 and [i for i, _ in x] == [i for i, _ in sorted(x, key=lambda p: (-p[1], p[0]))]
        assert all(scores[q, i] == s for i, s in x)


def test_tree_small_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert kmeans_tree.search(df, F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, 1, 0.0), (1, [0.5, 9.0], 0, 1, 0.0), (2, [2.0], 0, 1, 0.0)], SCHEMA)
    assert found(few) == {0: [(2, 2.0), (1, 0.5)]}


def test_branches_are_split_and_leaves_skipped(spark, monkeypatch):
    """2,400 rows in clusters, upper levels from a sample, units of few rows: recall and the share of rows visited."""
    for name, value in (("SAMPLE_ROWS", 600), ("BRANCH_SAMPLE", 100), ("BRANCH_ROWS", 200), ("LEAF_SAMPLE", 8), ("BLOCK_ROWS", 100), ("CHUNK_QUERIES", 30)):
        monkeypatch.setattr(kmeans_tree, name, value)
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 12)) * 2
    x = (centres[r.integers(0, 40, 2400)] + r.normal(size=(2400, 12))).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0, 1, 0.0) for i, v in enumerate(x)]
    df, report = spark.createDataFrame(rows, SCHEMA), {}
    got = {}
    for row in kmeans_tree.search(df, F.col("vec_id") % 20 == 0, report=report).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    want = brute(rows, 20)
    recall = sum(len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()) / len(want)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert recall >= 0.95 and report["share"] < 0.4 and report["leaves"] > 200


def test_walk_visits_every_leaf_once():
    tree = kmeans_tree.fit_tree(np.random.default_rng(1).normal(size=(2000, 6)))
    order = list(tree.order(np.ones(6)))
    assert tree.leaves > 8 and sorted(order) == list(range(tree.leaves))
    assert len(kmeans_tree.fit_tree(np.ones((500, 3))).children) == 1  # all alike: one leaf
