"""Texts scanned by Arrow: the same answers as the expressions that take a pass a word."""

import pyarrow as pa
from pyspark.sql import functions as F

from memloom.functions import patterns as P
from memloom.functions import scan as SC
from memloom.functions import text as T
from memloom.operators import graph as G
from memloom.operators import retrieval as R

from .test_cues import TEXTS

MORE = [*TEXTS, "a b\x0bc\x1cd e", "Remember THE Plan. Will do, deploy ettim", "Mert Ayşe Çağ Öz İpek Šimon Ünal Ünal The This", "Paris Berlin Roma Oslo Kiev Wien", "ŞÖYLE  yapalım", "bence SıRa", "ok", "OK\n", "thanks!!  .", "123", "—…—", "word " * 151, "word " * 81,
        "slack DM from x: y", "say hello", "s̈ay ok", "Karar", "karaﬁ", "dİkkat", "x" * 30, "." * 30, "9" * 25 + "\n", "Cron job xy just completed", "conversatİon info \"conversation_label\""]


def test_importance_signs_against_expressions(spark):
    cued = (P.TURKISH_DECISIONS, P.CRON, P.CONVERSATION_SOURCES, P.SYSTEM_NOISE)
    rows = spark.createDataFrame([(t,) for t in MORE], "text string")
    x, low, fold = F.col("text"), F.lower(T.trimmed(F.col("text"))), T.folded(F.col("text"))
    names = F.size(F.array_except(F.array_distinct(F.regexp_extract_all(x, F.lit("[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}"), F.lit(0))), F.array(*map(F.lit, P.NOT_ENTITIES))))
    want = [F.regexp_count(x, F.lit(r"\S+")), F.least(names, F.when(x.isNotNull(), 5))]
    want += [T.any_of(low, w) for w in (P.DECISION_MARKERS, P.IMPORTANCE_MARKERS, P.TASK_MARKERS, P.OPS_MARKERS)] + [T.any_of(fold, T.cues(e)) for e in cued]
    signs = SC.importance_signs(x, F.lower(x), tuple(map(T.cues, cued)))
    got = rows.select(signs.alias("s")).select("s.words", "s.names", *[SC.bit(F.col("s.held"), i).alias(f"b{i}") for i in range(8)]).collect()
    for text, g, w in zip(MORE, got, rows.select(*[c.alias(f"c{i}") for i, c in enumerate(want)]).collect(), strict=True):
        assert tuple(g) == tuple(w), text


def test_trivial_texts(spark):
    rows = spark.createDataFrame([(t,) for t in MORE if t is not None], "text string")
    got = [r.i == 0.05 for r in rows.select(T.importance(F.col("text")).alias("i")).collect()]
    low = F.lower(T.trimmed(F.col("text")))
    assert got == [r.t for r in rows.select(T.any_match(low, P.TRIVIAL, "(?U)").alias("t")).collect()] and sum(got) > 5


def test_importance_takes_no_pass_a_word(spark):
    plan = spark.createDataFrame([("x",)], "text string").select(T.importance(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") < 30 and "regexp_extract_all" not in plan and "kesinlikle" not in plan


def test_a_slice_of_texts():
    texts = pa.array(["zero one", "two", None, "", "three four five", "six "]).slice(1, 4)
    assert SC._word_counts(texts).tolist() == [1, 0, 0, 3] and SC._few_names(texts).tolist() == [0, 0, 0, 0]


def test_scanned_entities_are_the_same(spark):
    more = ["BERLİN", "Berlin, berlin", "google meta", "Dedı Ali dedi", "Ali  DEDİ x", "Ayşe'ye gıttim", "docker, redis. api_key", "gptx gpt", "aİ", "ſtudio Mac ſtudio", "MAC  STUDİO", "İphone 12", "bu hafta", "geçen  yıl", "buhafta", "2024-01-02", "1.2.2024", "3 ſubat 2024", "3 ŞUBAT 2024", "a@b.de", "+49 555 123 4567", "1234567", "Ada\x1cLovelace", "Ada\x85Lovelace Byron"]
    rows = spark.createDataFrame([(str(i), 1.0, t) for i, t in enumerate([*MORE, *more])], "id string, created_at double, text string")
    want = rows.select("id", F.explode(G.text_entities(F.col("text"))).alias("e")).select("id", "e.*").collect()
    got = rows.select("id", F.explode(G.scanned_entities(F.col("text"))).alias("e")).select("id", "e.*").collect()
    assert got == want and {r.label for r in got} == {"person", "place", "org", "tech", "product", "date", "phone", "email"}


def test_entities_are_scanned_first(spark):
    rows = spark.createDataFrame([("1", 1.0, "x")], "id string, created_at double, text string")
    assert "ArrowEvalPython" in G.entities(rows)._jdf.queryExecution().executedPlan().toString()


def test_words_against_the_expression(spark):
    every = "".join(chr(c) + ("x " if c % 3 else "..") for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    texts = [t for t in MORE if t is not None] + ["a.b-c.-d..e .f g. -h- i.j", "", ".", "a", "aé.b", "x_y‿z a‍b ² ½ Ⓐ 𝒳𝒴 १२ ०.१", every]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    table = SC.point_table(SC.word_points(spark))
    want = [r.ws for r in rows.select(F.regexp_extract_all("text", F.lit(r"(?U)\w+(?:[.-]\w+)*"), F.lit(0)).alias("ws")).collect()]
    assert [SC.words_of(t, table) for t in texts] == want


def test_keyword_lane_takes_no_expression_a_word(spark, monkeypatch):
    plans = []

    def written(df, label, write=R.written):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(R, "written", written)
    rows = spark.createDataFrame([("1", "Alpha beta beta"), ("2", None), ("3", "beta gamma.delta")], "id string, text string")
    asks = spark.createDataFrame([(1, "beta alpha"), (2, "gamma.delta")], "query_id long, q string")
    found = R.bm25(rows, asks, 5)
    assert [(r.query_id, r.id, r["rank"]) for r in found.orderBy("query_id", "rank").collect()] == [(1, "1", 1), (1, "3", 2), (2, "3", 1)]
    assert [p.count("regexp_extract_all") for n, p in plans if n == "words"] == [0]
