import hashlib
import random

import numpy as np

from memloom.llm import suffix_dedup as op

from .common import empty, frame, odd_texts, rows_of, words


def brute(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for j, c in enumerate(covered) if c and (j == 0 or not covered[j - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())
    return out


def corpus():
    r = random.Random(2)
    passage = words(40, 11)
    line = words(13, 12)[:99]
    texts = odd_texts() + [words(50, 20 + i) + " " + passage[r.randrange(60) :] + " " + words(20, 60 + i) for i in range(12)]
    texts += [line + words(60, 80 + i) + line for i in range(6)]  # 99 shared bytes are too few
    texts += ["ab" * 400, "ab" * 90, words(200, 3)[:100], words(200, 3)[:99], words(200, 3)]
    texts += [words(30, 99 + i) + "é" * 60 for i in range(3)]
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    got = rows_of(op.dedup(frame(spark, texts), with_text=True))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute(texts)
    assert got[6].kept == "" and got[5].kept == texts[5]


def test_small_stretches_and_many_buckets(spark, monkeypatch):
    # worker processes import the module anew, so only the driver's parameters are lowered
    monkeypatch.setattr(op, "BUCKET_ANCHORS", 20)
    monkeypatch.setattr(op, "COMPARED_BYTES", 1000)
    monkeypatch.setattr(op, "BATCHES", 7)
    texts = corpus()
    got = rows_of(op.dedup(frame(spark, texts)))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute(texts)


def test_a_hot_line_meets_in_no_single_bucket(spark, monkeypatch):
    """80 bytes shared by 5,000 texts between other words, in some with a whole repeated window; also in rows without id."""
    r = random.Random(7)
    noise = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    line, tails = noise(80), [noise(30) for _ in range(5)]
    texts = [noise(110) + line + (tails[i % 5] if i % 10 == 0 else "") + noise(60) for i in range(5000)] + ["ab" * 200]
    want = brute(texts)
    for least in (4000, 3):
        monkeypatch.setattr(op, "HOT_LEAST", least)
        got = rows_of(op.dedup(frame(spark, texts)))
        assert {i: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for i, x in got.items()} == want
    assert sum(w[1] > 0 for w in want.values()) > 400


def test_rows_without_id_are_apart(spark):
    a, b = words(60, 1), words(60, 2)
    docs = spark.createDataFrame([(None, a + b), (None, a + b), (None, b), (1, a)], "doc_id long, text string")
    got = sorted((x.doc_id is None, x.n_bytes, x.n_removed) for x in op.dedup(docs).collect())
    n, m = len(a.encode()), len(b.encode())
    assert got[0] == (False, n, 0) and sum(g[2] for g in got) in (2 * (n + m), 2 * n + m)  # a goes from both copies, b from one of the texts


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = words(3000, 1).encode()
    data = np.frombuffer(text, np.uint8)
    cut = lambda: {(int(c), int(a + s), int(b + s)) for _, own, code, h, first, last, shift in op.runs([text]) for c, a, b, s in zip(code, first, last, shift, strict=True)}
    whole = cut()
    monkeypatch.setattr(op, "STRETCH_BITS", 11)
    parts = cut()
    windows = lambda runs: {(q, p) for q, a, b in runs for p in range(a, b + 1)}
    assert windows(whole) >= windows(parts) and {p for _, p in windows(parts)} == set(range(len(data) - 99))


def test_repeated_ids_and_empty(spark):
    docs = frame(spark, [words(100, 1), words(100, 2)])
    got = op.dedup(docs.unionAll(docs)).collect()  # the same place twice: nothing is earlier
    assert len(got) == 8 and {r.n_removed for r in got} == {0}
    assert op.dedup(empty(spark)).count() == 0


def test_batches_hold_every_row_once_and_their_filter_reaches_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(i, f"t{i}") for i in range(40)] + [(None, f"n{i}") for i in range(10)] + [(5, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    data = F.col("text").cast("binary")
    did = F.coalesce("doc_id", F.xxhash64(data).bitwiseAND(F.lit(op.NO_ID - 1)) + F.lit(op.NO_ID))
    docs = docs.select("doc_id", did.alias("did"), data.alias("data"))
    middle = sorted(r.did for r in docs.collect())[45]
    for cuts in ([10, 20], [10, middle], [], [-5, 100]):
        parts = [op.between(docs, a, b) for a, b in zip([None, *cuts], [*cuts, None])]
        found = [r.data for p in parts for r in p.collect()]
        assert sorted(found) == sorted(t.encode() for _, t in rows)
    plan = op.between(docs, 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,10), LessThanOrEqual(doc_id,20)" in plan
