"""Rows that share an id, very long urls, and the toxicity score against a plain walk over every document."""

import math
from collections import Counter

from pyspark.sql import functions as F

from memloom.llm import license_scan, pii, toxicity, url_filter

from .common import DOCS, words
from .test_toxicity import LABELS, corpus
from .test_url_filter import PAGES


def repeated(spark, *texts):
    """Each text under ids 1 and 2; the first one twice under id 1."""
    rows = [(i, t, "en", "s", 1, 0.5, 1, "f", "x") for i in (1, 2) for t in texts] + [(1, texts[0], "en", "s", 1, 0.5, 1, "f", "x")]
    return spark.createDataFrame(rows, DOCS)


def test_license_scan_judges_each_row(spark):
    got = Counter((r.doc_id, r.labels, r.n_base) for r in license_scan.scan(repeated(spark, "under the mit license", "all rights reserved")).collect())
    assert got == {(1, "mit", 0): 2, (2, "mit", 0): 1, (1, "reserved", 1): 1, (2, "reserved", 1): 1}


def test_pii_redacts_each_row(spark):
    got = Counter((r.doc_id, r.text) for r in pii.redact(repeated(spark, "mail a@b.cd now", "nothing")).collect())
    assert len(got) == 4 and sum(got.values()) == 5 and not any("@" in t for _, t in got)
    assert max(got.values()) == 2 and {t for i, t in got if i == 1} == {t for i, t in got if i == 2}


def test_toxicity_scores_each_row_and_learns_each_id_once(spark):
    docs, labels, _ = corpus(spark)
    twice = docs.unionByName(docs.where("doc_id < 100")).withColumn("lang", F.lit("zz"))
    chain, again = (toxicity.fit(toxicity.training_sample(d, labels.unionByName(labels.where("doc_id < 50")))) for d in (docs, twice))
    a = {r.doc_id: r.score for r in toxicity.score(docs, chain).where("doc_id IS NOT NULL").collect()}
    b = toxicity.score(twice, again).where("doc_id IS NOT NULL").collect()
    assert len(b) == len(a) + 100 and all(abs(a[r.doc_id] - r.score) < 1e-9 for r in b)


def plain_score(chain, text):
    """Forward and backward in plain Python, a segment after another isn't needed: texts are one sequence when scored."""
    found = [w for w in toxicity.WORD.findall((text or "").encode().lower())]
    start, a01, a10, a11 = map(math.exp, chain.moves)
    e = [math.exp(max(-30, min(30, chain.evidence(w)))) for w in found]
    forward, backward = [], [1.0] * len(e)
    for t, x in enumerate(e):
        r = forward[-1] if t else None
        forward.append(start * x if r is None else x * (a01 + r * a11) / (1 + r * a10))
    for t in range(len(e) - 2, -1, -1):
        x = e[t + 1] * backward[t + 1]
        backward[t] = (a10 + a11 * x) / (1 + a01 * x)
    p = [f * b / (1 + f * b) for f, b in zip(forward, backward, strict=True)]
    z = chain.document[0] + chain.document[1] * max(p, default=0.0) + chain.document[2] * math.log1p(sum(x for x in p if x >= 0.5))
    return 1 / (1 + math.exp(-z))


def test_toxicity_scores_against_a_plain_walk(spark):
    docs, labels, _ = corpus(spark)
    chain = toxicity.fit(toxicity.training_sample(docs, labels))
    more = docs.unionByName(spark.createDataFrame([(10_000, words(3000, 4) + " idjot", "en", "s", 1, 0.5, 1, "f", "x"), (10_001, "", "en", "s", 0, 0.5, 1, "f", "x")], DOCS))
    got = toxicity.score(more, chain, ("doc_id", "text")).collect()
    assert len(got) == more.count() and all(abs(r.score - plain_score(chain, r.text)) < 1e-9 for r in got)


def test_single_label_texts_and_ids_without_text(spark):
    none = spark.createDataFrame([(1, None, "en", "s", 0, 0.5, 1, "f", "x")] * 3, DOCS)
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert [r.score for r in toxicity.score(none, toxicity.fit(toxicity.training_sample(none, labels))).collect()] == [0.0] * 3


def test_long_and_repeated_urls(spark):
    long = "http://" + "a." * 50_000 + "com/en/" + "x/" * 100_000 + "?q"
    rows = [(1, long, None), (1, long, None), (1, "http://other.test/", None), (2, "http://net/de/" + "y" * 500_000, None)]
    got = Counter((r.page_id, r.rule, r.verdict, len(r.host), len(r.path)) for r in url_filter.judge(spark.createDataFrame([(*r, "h", "p", "r") for r in rows], PAGES)).collect())
    assert got == {(1, "com/en/", "block", 100_003, 200_004): 2, (1, None, "allow", 10, 1): 1, (2, "net/de/", "allow", 3, 500_004): 1}
