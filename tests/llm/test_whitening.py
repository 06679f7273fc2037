import math

import numpy as np

from memloom.llm import whitening as op

SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 0.5) for i, v in rows], SCHEMA)


def test_merged_moments_equal_whole(spark):
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(1000, 5)) * 300 + 4000).astype(np.int64)
    parts = [op.Moments.of(p) for p in np.split(x, [1, 40, 41, 700])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    assert whole.n == 1000 and whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(whole.mean, x.mean(axis=0), rtol=1e-13)
    assert np.allclose(whole.scatter / 1000, np.cov(x.T, bias=True), rtol=1e-12)


def test_against_numpy_with_copies_and_odd_rows(spark):
    r = np.random.default_rng(7)
    x = (r.normal(size=(500, 7)) @ r.normal(size=(7, 7)) + 3).astype(np.float32)
    good = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, [0.25] * 7) for i in range(300)] + [(2000, [1.0, -0.0]), (None, [2.0] * 7)]
    odd = [(3000, None), (3001, [None] * 7), (3002, [float("nan")] * 7), (3003, [float("-inf")] + [0.0] * 6)]
    got = op.whiten(frame(spark, good + odd).repartition(7)).toPandas()
    q = {i: np.array([math.floor(256 * c) for c in v] + [0] * (7 - len(v))) for i, v in good}
    fitted = np.unique(np.array(list(q.values())), axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fitted.T.astype(float), bias=True))
    assert len(got) == 4 * len(good) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    for c in range(4):
        part = got[got["component"] == c + 1].set_index("vec_id")
        v, e = vectors[:, -1 - c], values[-1 - c]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(part["explained"], e / values.sum(), rtol=1e-9)
        for i, a in q.items():
            row = part[part.index.isna()].iloc[0] if i is None else part.loc[i]
            assert abs(row["whitened"] - (a - sums / n) @ v / math.sqrt(e)) < 1e-9
            assert row["deviation"] == sum(int(d) ** 2 for d in n * a - sums)


def test_large_entries(spark):
    """Deviations within a long are exact whatever the entries; beyond, the largest long is given."""
    rows = [(0, [2.0**44, 0.0]), (1, [-(2.0**44), 1.0]), (2, [3e38, 0.5])]
    got = {r.vec_id: r.deviation for r in op.whiten(frame(spark, rows)).where("component = 1").collect()}
    assert set(got.values()) == {op.LARGEST}
    model = op.Whitening(3, [2**61, 0], np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[2**61 // 3, 5], [2**61 // 3 - 1, 0]], np.int64)
    assert model.deviation(x) == [sum(int(3 * int(a) - s) ** 2 for a, s in zip(row, model.sums)) for row in x]


def test_no_variance_small_and_empty(spark):
    got = [tuple(r) for r in op.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).orderBy("vec_id", "component").collect()]
    assert got == [(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = [tuple(r) for r in op.whiten(frame(spark, [(1, [1.0, 0.0]), (2, [3.0, 0.0])])).orderBy("vec_id", "component").collect()]
    assert line == [(1, 1, 2, 512**2, -1.0, 1.0, 0.0), (1, 2, 2, 512**2, 0.0, 0.0, 0.0), (2, 1, 2, 512**2, 1.0, 1.0, 0.0), (2, 2, 2, 512**2, 0.0, 0.0, 0.0)]
    for rows in ([], [(1, None)], [(1, [])]):
        assert op.whiten(frame(spark, rows)).collect() == []
