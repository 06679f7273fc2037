import math
import random

import numpy as np
from pyspark.sql import functions as F

from memloom.llm import hard_negatives as op

from .common import same_as_sql

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"
SQL = op.ORACLE_SQL["op11_hard_negatives"]


def single(v):
    return [float(np.float32(x)) for x in v]


def relabelled(df):
    return df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def mined(df):
    return op.mine(relabelled(df), F.col("vec_id") % 50 == 0)


def small(monkeypatch):
    for name, value in (("BUCKET_ROWS", 16), ("GROUP", 2), ("CHUNK_ANCHORS", 3), ("MARKS", 7)):
        monkeypatch.setattr(op, name, value)


def vectors(spark, n=420, dim=6, seed=5):
    """Lengths over three orders of magnitude, a hot label, one vector many times, every odd row."""
    r = random.Random(seed)
    rows = [(i, single(r.gauss(0, 1) * 10 ** r.uniform(-2, 1) for _ in range(dim)), 3 if r.random() < 0.4 else r.randrange(10), 1, 0.5) for i in range(n)]
    rows += [(n + i, [0.5] * dim, i % 2, 1, 0.5) for i in range(80)]
    rows += [(10_000, [0.0] * dim, 3, 1, 0.5), (10_050, [1.0] * (dim - 2), 3, 1, 0.5), (10_051, [], 3, 1, 0.5)]
    odd = [None, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(20_000 + 50 * i, v, 1, 1, 0.5) for i, v in enumerate(odd)] + [(None, [1.0] * dim, 1, 1, 0.5), (30_000, [1.0] * dim, None, 1, 0.5)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_against_sql_over_many_buckets(spark, monkeypatch):
    small(monkeypatch)
    df, _ = vectors(spark)
    same_as_sql(mined(df), SQL, embeddings=df)


def test_unit_lengths_against_sql(spark, monkeypatch):
    """All rows equally long, so nothing can be skipped; one bucket and one chunk as in small tables."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, single(v), i % 3, 1, 0.0) for i, v in enumerate(x)], SCHEMA)
    same_as_sql(mined(df), SQL, embeddings=df)
    monkeypatch.setattr(op, "BUCKET_ROWS", 50)
    same_as_sql(mined(df), SQL, embeddings=df)


def test_long_lists_of_short_vectors_are_skipped(spark, monkeypatch):
    """The chunk's last bucket follows from the lower limits."""
    small(monkeypatch)
    rows = [(50 * i, single([3.0, 0.1 * i]), 0, 1, 0.0) for i in range(4)] + [(50 * i + 1, single([2.0, 0.2 * i]), i % 2, 1, 0.0) for i in range(40)]
    rows += [(100_001 + 50 * i, single([0.001 * (i % 9), 0.001]), 1, 1, 0.0) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    index, buckets = op.build_index(op.usable(df))
    last = spark.range(1).select(op._last(index, buckets, F.lit(100.0))).first()[0]
    assert buckets > 50 and last < 16
    assert spark.range(1).select(op._last(index, buckets, F.lit(1e9))).first()[0] == -1
    assert spark.range(1).select(op._last(index, buckets, F.lit(0.0))).first()[0] == buckets - 1
    same_as_sql(mined(df), SQL, embeddings=df)


def test_every_finite_vector(spark, monkeypatch):
    """Components up to 3e38: exact scores of any size, shown as the largest or least long."""
    small(monkeypatch)
    r = random.Random(9)
    size = lambda: r.choice([0.01, 1.0, 1e7, -1e7, 4e4, 3e38, -2e38, 1e20])
    rows = [(i, single(size() * r.random() for _ in range(r.choice([3, 3, 2]))), r.randrange(3), 1, 0.0) for i in range(151)]
    got = {}
    for row in mined(spark.createDataFrame(rows, SCHEMA)).orderBy("anchor_id", "positive_id", "rank").collect():
        got.setdefault((row.anchor_id, row.positive_id), []).append((row.negative_id, row.positive_score, row.negative_score))
    q = {i: [math.floor(256 * c) for c in v] for i, v, *_ in rows}
    label = {i: (lab + 1) % 10 if i % 7 == 0 else lab for i, _, lab, *_ in rows}
    shown = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    want = {}
    for a in (0, 50, 100, 150):
        score = {b: sum(x * y for x, y in zip(q[a], q[b])) for b in q if b != a}
        for p in sorted((b for b in score if label[b] == label[a]), key=lambda b: (-score[b], b))[:5]:
            fit = [b for b in score if label[b] != label[a] and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            found = sorted(fit, key=lambda b: (-score[b], b))[:3]
            if found:
                want[a, p] = [(b, shown(score[p]), shown(score[b])) for b in found]
    assert len(want) > 5 and got == want


def test_repeated_ids_and_empty(spark):
    rows = [(0, [1.0, 0.0], 1, 1, 0.0), (0, [0.5, 0.0], 2, 1, 0.0), (1, [1.0, 1.0], 3, 1, 0.0), (1, [1.0, 1.0], 3, 1, 0.0), (2, [0.75, 0.0], 4, 1, 0.0), (3, [0.75, 0.0], 5, 1, 0.0)]
    got = [tuple(r) for r in op.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()]
    assert got == []  # the smallest vector of id 0 asks, with label 2, which no other row has
    rows[1] = (0, [0.5, 0.0], 3, 1, 0.0)
    got = sorted(tuple(r) for r in op.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect())
    # A repeated positive opens a window each time.
    assert got == [(0, 1, 1, 2, 128 * 256, 128 * 192)] * 2 + [(0, 1, 2, 3, 128 * 256, 128 * 192)] * 2
    assert mined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mined(spark.createDataFrame([(0, None, 1, 1, 0.0)], SCHEMA)).count() == 0
    assert mined(spark.createDataFrame([(0, [1.0], 1, 1, 0.0)], SCHEMA)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
