import random

import corpus_pipeline
from pyspark.sql import functions as F

from memloom.llm import simhash, toxicity

from .common import DOCS, words


def tables(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_on_all_that_the_last_kept(spark, tmp_path):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        text = words(60, i) + (" skumm klown idjot" if i % 6 == 0 else "") + (f" mail a{i}@b.example.com" if i % 5 == 0 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text), None, None, None, None))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[1][1], "en", "s1", rows[1][4], None, None, None, None) for i in range(40)]
    r.shuffle(rows)
    sf = tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, stage(spark, kept, sf)
        if n < 4:
            assert kept.columns == docs.columns
            path = f"{sf}/stage{n}"
            kept.write.parquet(path)
            kept = spark.read.parquet(path)
        ids = {x.doc_id for x in kept.select("doc_id").collect()}
        if n == 0:
            assert ids == {x.doc_id for x in before.select("doc_id").collect()} - set(range(0, 240, 6))
        if n == 1:
            assert ids == {x.doc_id for x in simhash.components(before).where("doc_id = component_id").collect()} and not ids & set(range(1000, 1040))
        if n == 2:
            assert ids == {x.doc_id for x in before.select("doc_id").collect()} and kept.where("text LIKE '%@%'").count() == 0 and kept.where("text LIKE '%<EMAIL>%'").count() > 20
            assert kept.where("n_chars <> length(text)").count() == 0
        if n == 3:
            total = before.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
            assert total <= kept.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] <= total * 1.5
    assert kept.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, kept.collect()))


def test_odd_rows_against_plain_models(spark, tmp_path):
    """Null and very long texts, rows without id, repeated ids with equal and other texts: near copies, personal data and ids by brute force."""
    import hashlib
    import re

    import tiktoken

    from memloom.llm import bpe

    rows, labels = [], []
    for i in range(120):
        text = words(60, i) + (" skumm klown idjot" if i % 6 == 0 else "") + (f" mail a{i}@b.example.com" if i % 5 == 0 else "")
        rows.append((i, text, "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 6 == 0)))
    long = words(20_000, 900)
    rows += [(200, None, None, None), (201, "", "en", "s0"), (202, long, "en", "s1"), (203, long, "en", "s2"), (204, words(60, 1), "en", "s0"), (204, words(60, 901), "en", "s0"), (204, words(60, 901), "en", "s0")]
    rows += [(None, words(60, 902), "en", "s1"), (None, None, None, None)]
    rows = [(i, t, lang, source, len(t or ""), None, None, None, None) for i, t, lang, source in rows]
    sf = tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{n}")
        docs = spark.read.parquet(f"{sf}/stage{n}")
        frames.append([r.asDict() for r in docs.collect()])
    toxic, near, clean, mixed, encoded = frames
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    assert {key(r) for r in toxic} == {key({"doc_id": r[0], "text": r[1]}) for r in rows if not (r[0] is not None and r[0] < 120 and r[0] % 6 == 0)}
    # near copies: components of fingerprints within three bits; one row of the smallest id stays, and all without id
    fps = {simhash.fingerprint((r["text"] or "").encode()) for r in toxic}
    group = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {f: new if g == old else g for f, g in group.items()}
    least = {}
    for r in toxic:
        if r["doc_id"] is not None:
            g = group[simhash.fingerprint((r["text"] or "").encode())]
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == sorted(least.values())
    assert sum(r["doc_id"] is None for r in near) == 2 and {r["doc_id"] for r in near} >= {200, 202, 204} and not {r["doc_id"] for r in near} & {201, 203}
    # personal data: the same rows, addresses replaced
    want = sorted(((key(r)[:2], re.sub(r"\S+@\S+", "<EMAIL>", r["text"] or "")) for r in near), key=str)
    assert sorted(((key(r)[:2], r["text"] or "") for r in clean), key=str) == want
    assert {key(r) for r in mixed} <= {key(r) for r in clean}
    # ids: as the library gives them
    encoder = tiktoken.Encoding("ranks", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    told = sorted(((r["doc_id"], len(ids := encoder.encode_ordinary(r["text"] or "")), digest(" ".join(map(str, ids)).encode()), digest((r["text"] or "").encode())) for r in mixed), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encoded), key=str) == told


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0


def test_names_and_thresholds():
    assert len(corpus_pipeline.STAGES) == 5 and toxicity.THRESHOLD == 0.7 and corpus_pipeline.ORACLE_SQL is None
