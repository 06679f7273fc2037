import random
import re

import xxhash

from memloom.llm import simhash as op

from .common import DOCS, empty, frame, odd_texts, rows_of, words


def plain(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def expected(texts):
    fp = [plain(t) for t in texts]
    root = list(range(len(fp)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fp)):
            for j in range(len(fp)):
                if (fp[i] ^ fp[j]).bit_count() <= 3 and root[j] > root[i]:
                    root[j], changed = root[i], True
    return {i: (fp[i], root[i]) for i in range(len(fp))}


def near(text, r):
    w = text.split()
    w[r.randrange(len(w))] = "changed"
    return " ".join(w)


def corpus():
    r = random.Random(5)
    long = words(400, 7)
    return odd_texts() + [near(long, r) for _ in range(25)] + [long] * 10 + [words(60, 100 + i) for i in range(20)]


def test_against_brute_force(spark, monkeypatch):
    texts = corpus()
    want = expected(texts)
    for rows, block in ((8192, 256), (3, 2)):
        monkeypatch.setattr(op, "TILE_ROWS", rows)
        monkeypatch.setattr(op, "BLOCK", block)
        got = rows_of(op.components(frame(spark, texts)))
        assert {i: (r.fp % 2**64, r.component_id) for i, r in got.items()} == want


def test_near_dedup_keeps_one_of_each(spark):
    texts = corpus()
    docs = frame(spark, texts)
    kept = op.near_dedup(docs)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({root for _, root in expected(texts).values()}) and kept.columns == docs.columns
    assert kept.where("doc_id IS NULL").count() == 2
    assert op.near_dedup(docs.unionAll(docs)).where("doc_id IS NOT NULL").count() == len(ids)


def test_empty(spark):
    assert op.components(empty(spark)).count() == 0 and op.near_dedup(empty(spark)).count() == 0


def test_repeated_ids_keep_one_row_of_each_component(spark):
    a, b, c = words(80, 1), words(80, 2), words(80, 3)
    row = lambda i, t: (i, t, "en", "s", len(t or ""), 0.5, 7, "x", "y")
    kept = lambda *rows: sorted((r.doc_id, r.text or "") for r in op.near_dedup(frame(spark, []).unionAll(spark.createDataFrame([row(*x) for x in rows], DOCS))).collect() if r.doc_id is not None)
    assert kept((3, a), (5, a), (5, b)) == [(3, a), (5, b)]
    assert kept((5, a), (5, b), (5, c), (5, a), (5, None), (5, "")) == sorted([(5, a), (5, b), (5, c), (5, "")])
