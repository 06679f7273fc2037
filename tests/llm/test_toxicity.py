import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from memloom.llm import toxicity as op

from .common import empty, frame, odd_texts, rows_of

LABELS = "doc_id long, quality int, toxic int"


def test_marginals_against_all_paths():
    r = np.random.default_rng(4)
    chain = op.Chain({}, np.zeros(1), moves=r.normal(size=4))
    lengths = np.array([3, 0, 5, 1])
    u = r.normal(size=9)
    p, counts = chain.marginals(u, lengths, expected=True)
    start, want, moves = 0, [], np.zeros(4)
    for n in lengths:
        x, total = u[start : start + n], 0.0
        mass, tally = np.zeros(n), np.zeros(4)
        for path in itertools.product((0, 1), repeat=int(n)):
            s = sum(a * b for a, b in zip(path, x, strict=True)) + (path[0] * chain.moves[0] if n else 0)
            s += sum(chain.moves[2 * a + b] if (a, b) != (0, 0) else 0 for a, b in itertools.pairwise(path))
            w = np.exp(s)
            total += w
            mass += w * np.array(path)
            if n:
                tally[0] += w * path[0]
            for a, b in itertools.pairwise(path):
                if (a, b) != (0, 0):
                    tally[2 * a + b] += w
        want += list(mass / total)
        if n:
            moves += tally / total
        start += n
    assert np.allclose(p, want) and np.allclose(counts, moves)


def corpus(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 7))) for _ in range(400)]
    bad = ["idjot", "klown", "skum"]
    texts, labels = [], []
    for i in range(600):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(r.randint(2, 4) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad) if r.random() < 0.6 else "grubb" + r.choice(vocabulary))
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    return frame(spark, texts), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], LABELS), labels


def test_held_out_accuracy_and_offsets(spark):
    docs, labels, plain = corpus(spark)
    chain = op.fit(op.training_sample(docs, labels))
    scored = op.score(docs, chain, ("doc_id", "text")).withColumn("held_out", op.held_out()).where("doc_id IS NOT NULL").collect()
    toxic = {i: t for i, _, t in plain}
    held = [r for r in scored if r.held_out]
    right = sum((r.score >= op.THRESHOLD) == (toxic[r.doc_id] == 1) for r in held) / len(held)
    assert len(held) > 100 and right >= 0.95
    assert all(0 <= r.score <= 1 for r in scored)
    words = {r.text[s.start : s.end] for r in scored for s in r.spans}
    assert {"idjot", "klown", "skum"} <= {w for x in words for w in x.split()}


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels, _ = corpus(spark)
    flipped = labels.withColumn("toxic", F.when(op.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (rows_of(op.score(docs, op.fit(op.training_sample(docs, x)))) for x in (labels, flipped))
    assert all(abs(a[i].score - b[i].score) < 1e-9 for i in a)


def test_odd_texts_and_empty_tables(spark):
    docs = frame(spark, odd_texts())
    none = spark.createDataFrame([], LABELS)
    got = rows_of(op.score(docs, op.fit(op.training_sample(docs, none))))
    assert {r.score for r in got.values()} == {0.0}
    known, labels, _ = corpus(spark)
    chain = op.fit(op.training_sample(known, labels))
    got = rows_of(op.score(docs, chain))
    assert len(got) == len(odd_texts()) and got[0].score == got[1].score == got[2].score < op.THRESHOLD
    assert op.score(empty(spark), chain).count() == 0
    assert op.reject(docs, labels).columns == docs.columns


def test_offsets_are_code_points():
    text = "é🙂 bad worse ok bad"
    spans = op._spans(text.encode(), np.array([0.1, 0.9, 0.8, 0.1, 0.7]))
    assert [(text[s["start"] : s["end"]]) for s in spans] == ["bad worse", "bad"]
