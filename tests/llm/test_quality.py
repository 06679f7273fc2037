import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import quality as op

from .common import empty, frame, odd_texts, rows_of

LABELS = "doc_id long, quality int, toxic int"


def plain_cut(bins, g, h):
    """The best (gain, feature, bin) of one node by trying every cut."""
    worth = lambda at: g[at].sum() ** 2 / (h[at].sum() + op.PENALTY)
    best = (0.0, 0, 0)
    for j in range(bins.shape[1]):
        for b in range(op.BINS - 1):
            left = bins[:, j] <= b
            if min(h[left].sum(), h[~left].sum()) >= op.LEAST_CURVATURE:
                gain = worth(left) + worth(~left) - worth(np.ones(len(g), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, j, b)
    return best


def test_histogram_cuts_against_every_cut():
    r = np.random.default_rng(3)
    bins, node = r.integers(0, op.BINS, (200, 3)), r.integers(0, 2, 200)
    g = r.normal(size=200) + 0.5 * (bins[:, 1] > 20)
    h = r.uniform(0.05, 0.25, 200)
    feature, place, gain = op.best_cuts(bins, node, 2, g, h)
    for k in (0, 1):
        at = node == k
        want = plain_cut(bins[at], g[at], h[at])
        assert (feature[k], place[k]) == want[1:] and gain[k] == pytest.approx(want[0])


def test_flattened_trees_against_a_walk():
    r = np.random.default_rng(4)
    x = r.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = op.fit(x[:400], y[:400])
    got = forest.margin(x)
    for i in range(0, 800, 37):
        total = forest.base
        for feature, cut, value in zip(forest.feature, forest.cut, forest.value):
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if x[i, feature[k]] > cut[k] else 1)
            total += value[k - len(feature)]
        assert got[i] == pytest.approx(total)
    assert ((forest.score(x[400:]) > 0.5) == (y[400:] == 1)).mean() > 0.9


def corpus(spark, n=500):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(3, 80))]
        kind = i % 10
        bad = kind < 3
        text = [" ".join(x + "%%%" for x in w), " ".join(w).upper(), " | ".join(w[:2] * 20)][kind] if bad else " ".join(w).capitalize() + "."
        texts.append(text)
        labels.append((i, int(not bad), 0))
    return frame(spark, texts), spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0)], LABELS), labels


def scored(docs, labels):
    stats = op.statistics(docs)
    return rows_of(op.score(stats, op.fit(*op.training_sample(stats, labels))).withColumn("held_out", op.held_out()))


def test_held_out_accuracy(spark):
    docs, labels, plain = corpus(spark)
    got = scored(docs, labels)
    held = [(got[i].score, q) for i, q, _ in plain if got[i].held_out]
    assert len(held) > 60 and all(0 <= s <= 1 for s, _ in held)
    assert sum((s >= op.THRESHOLD) == (q == 1) for s, q in held) / len(held) >= 0.97


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels, _ = corpus(spark)
    flipped = labels.withColumn("quality", F.when(op.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = scored(docs, labels), scored(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), flipped)
    assert all(a[i].score == b[i].score for i in a)


def test_odd_texts_single_labels_and_empty_tables(spark):
    docs, (known, labels, plain) = frame(spark, odd_texts()), corpus(spark)
    one = lambda q: spark.createDataFrame([(i, q, 0) for i, *_ in plain], LABELS)
    for lab, want in ((spark.createDataFrame([], LABELS), 0.5), (one(1), 1.0), (one(0), 0.0)):
        assert {r.score for r in scored(docs, lab).values()} == {want}
    stats = op.statistics(known)
    forest = op.fit(*op.training_sample(stats, labels))
    got = op.score(op.statistics(docs), forest).collect()
    assert len(got) == len(odd_texts()) + 2
    by_id = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert by_id[0] == by_id[1] and by_id[5] == by_id[6] and by_id[7] == by_id[8]  # null as empty; copies alike
    assert op.score(op.statistics(empty(spark)), forest).count() == 0
    assert op.keep(empty(spark), labels).columns == docs.columns


def test_keep_drops_the_bad_only(spark):
    docs, labels, plain = corpus(spark)
    kept = {r.doc_id for r in op.keep(docs, labels).collect()}
    good = {i for i, q, _ in plain if q}
    assert len(good - kept) <= 2 and len(kept - good - {None}) <= 5


def test_statistics_by_hand():
    got = dict(zip(op.STATISTICS, op.statistics_of("AB ab\nAB ab\n9%")))
    assert got["bytes"] == pytest.approx(np.log1p(14)) and got["words"] == pytest.approx(np.log1p(5)) and got["lines"] == pytest.approx(np.log1p(3))
    assert got["upper"] == got["lower"] == pytest.approx(4 / 14) and got["digits"] == got["symbols"] == got["top_symbol"] == pytest.approx(1 / 14)
    assert got["distinct_words"] == pytest.approx(3 / 5) and got["top_word"] == pytest.approx(2 / 5) and got["upper_words"] == pytest.approx(2 / 5)
    assert got["repeated_lines"] == pytest.approx(1 / 3) and got["symbol_ends"] == pytest.approx(1 / 5) and got["repeated_pairs"] == pytest.approx(1 / 5)
    assert op.statistics_of("") == [0.0] * len(op.STATISTICS)
