"""Expressions are put only to texts that hold what a match must hold: the same answers as without that test."""

import re

from pyspark.sql import functions as F

from memloom.functions import hooks as H
from memloom.functions import patterns as P
from memloom.functions import routing as RT
from memloom.functions import text as T
from memloom.operators import graph as G

TEXTS = [
    None, "", " ", "We DECIDED to go", "undecided", "KARAR verildi", "yapalIm", "yapalım", "bugfix", "a bug.", "FIX it", "don't repeat", "dont  do  that", "HOW MANY\ttimes", "[CRON:x] y", "x [cron:", "heartbeat_ok",
    "user:  conversation info", "system: [queued x", "anlaştık", "ANLAŞTIK", "tercih", "let's do", "lets do it", "İstanbul ML", "karaṙ", "ȧ karar", "api-ai", "sqlite-vec", "xsqlite-vec y sqlite", "node.js", "nodexjs", "aié ai",
    "Ada Lovelace", "Ada  lovelace", "Ada Lovelace", "xAda Lovelace", "call 555 123 45 67", "(555)1234567 x", "5551234", "12 MAYIS 2024", "BUGÜN", "Ali dedi", "Ayşe'ye gittim", "iPad Pro", "text  ", "x \u0085", "\tx\n",
]
LISTS = [(H.CAPTURE_DECISIONS, "(?iU)"), (H.FEEDBACK, "(?iU)"), (H.CONFIRMATIONS, "(?iU)"), (H.TROUBLE, "(?iU)"), (H.COMPACTION_DECISIONS, "(?iU)"), (H.COMPACTION_ERRORS, "(?iU)"), (H.COMPACTION_PREFERENCES, "(?iU)"),
         (H.CAPTURE_CRON, "(?i)"), (H.CAPTURE_LOW_SIGNAL, "(?i)"), (H.COMPACTION_LOW_SIGNAL, "(?i)"), (RT.SELF_CORRECTIONS, "(?iU)"), (RT.RESULTS, "(?iU)"), (RT.LOW_SIGNAL_CAPTURE, "(?i)")]


def test_cues():
    assert T.cues([r"\bfailed?\b"]) == ["faile"] and T.cues([r"x\s*(?:deploy|push)\s+ettim"]) == ["ettim"] and T.cues(["abc", r"^\w*$"]) == []
    assert T.cues(["(?:yapalım|KARAR)(?:lar)?"]) == ["yapalim", "karar"]
    assert all(T.cues(e) for e, _ in LISTS)


def test_answers_stay(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    x, low, fold = F.col("text"), F.lower("text"), T.folded(F.col("text"))
    plain = lambda e: F.sort_array(G._found(low, rf"(?U)\b{re.escape(e)}\b"))
    pairs = [(T.any_match_in(x, fold, e, f), T.any_match(x, e, f)) for e, f in LISTS]
    pairs += [(F.coalesce(F.array_contains(G._whole_words(low, P.TECH), w), F.lit(False)), F.coalesce(F.size(plain(w)) > 0, F.lit(False))) for w in ("ai", "api", "sqlite", "sqlite-vec", "node.js", "ml")]
    pairs += [(F.array_join(G._found_if(F.coalesce(x, F.lit("")), F.coalesce(fold, F.lit("")), e), "|"), F.array_join(G._found(F.coalesce(x, F.lit("")), e), "|")) for e in P.DATES + P.PRODUCTS]
    pairs += [(T.trimmed(x), F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))]
    named = lambda label: F.array_join(F.transform(F.filter(G.text_entities(x), lambda e: e["label"] == label), lambda e: e["name"]), "|")
    distinct = lambda e, g: F.array_join(G._found(F.coalesce(x, F.lit("")), e, g), "|")
    pairs += [(F.when(distinct(P.PERSON, 1) != "", named("person")), F.when(distinct(P.PERSON, 1) != "", distinct(P.PERSON, 1))), (named("phone"), distinct(P.PHONE, 0))]
    for got, want in zip(rows.select(*[a.alias(f"c{i}") for i, (a, _) in enumerate(pairs)]).collect(), rows.select(*[b.alias(f"c{i}") for i, (_, b) in enumerate(pairs)]).collect(), strict=True):
        assert got == want


def test_a_route_is_worked_out_once(spark):
    from memloom.plans import registry

    plan = registry.queries()["q_route"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "Filter isnotnull(transform" not in plan
