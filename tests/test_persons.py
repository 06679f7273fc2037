"""The entity queries with persons against a plain model on a small fixture."""

import re
from collections import Counter
from itertools import combinations

from memloom.functions import patterns as P
from memloom.plans import registry
from memloom.plans.views import view

TEXTS = [None, "", "Grace Hopper met Ayşe Yılmaz in Berlin; mail g@navy.mil", "grace hopper uses docker on 2024-01-02", "Grace Hopper again, Grace Hopper at Google", "xGrace Hopper is none, Mac Studio is a product", "Mehmet ile konuştum dün, Izmir'e gidiyorum; call +90 532 123 45 67 today", "sqlite-vec and sqlite, node.js, GitHub; 3 mart 2024 or 4 May 2023; ab dedi", *[f"filler number {i}" for i in range(28)]]


def model(rows):
    """(id, label, key) by Python's own expressions, independent of Spark's."""
    found = set()
    for id, text in rows:
        low = text.lower()
        found |= {(id, "place", w) for w in P.PLACES if w in low} | {(id, "org", w) for w in P.ORGANISATIONS if w in low}
        found |= {(id, "tech", w) for w in P.TECH if re.search(rf"\b{re.escape(w)}\b", low)}
        for label, expressions in (("person", [P.PERSON]), ("phone", [P.PHONE]), ("email", [P.EMAIL]), ("date", P.DATES), ("product", P.PRODUCTS)):
            found |= {(id, label, m.group(0).lower()) for e in expressions for m in re.finditer(e.replace("(?U)", ""), text)}
        for label, e in (("person", P.PERSON_CONTEXT), ("place", P.PLACE_CONTEXT)):
            found |= {(id, label, m.group(1).lower()) for m in re.finditer(e.replace("U", ""), text) if len(m.group(1)) > 2 and m.group(1)[0].isupper()}
    return found


def test_persons_are_in_all_four(spark, tmp_path):
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = model([(r.id, r.text) for r in view(spark, str(tmp_path), "memories").select("id", "text").collect()])
    assert ("12", "person", "ada lovelace") in want and ("2", "person", "ayşe yılmaz") in want and ("5", "person", "grace hopper") not in want
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.label, r.key) for r in run("q_entities_all")) == sorted(want)
    mentions = Counter((label, key) for _, label, key in want)
    assert {(r.label, r.key): r.mentions for r in run("q_entity_table_all")} == mentions
    pairs = Counter((i, a[1], b[1]) for i in {w[0] for w in want} for a, b in combinations(sorted(w[1:] for w in want if w[0] == i), 2))
    assert Counter((r.id, r.source_id, r.target_id) for r in run("q_cooccur_all")) == pairs
    lines = [r.line for r in run("q_highlights_all") if r.section == "Key Entities"]
    assert lines == [f"- **{key}** [{label}] — {n} mentions" for (label, key), n in sorted(mentions.items(), key=lambda x: (-x[1], x[0]))][:50]


def test_both_names_give_the_same(spark, tmp_path):
    spark.createDataFrame([(12, "x", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: {(r.label, r.key) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert run("q_entities_all") == run("q_entities") >= {("person", "ada lovelace")}
