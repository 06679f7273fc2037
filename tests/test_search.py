"""The whole search, its graph and type candidates, the merge of agents, recall by question, and what requests may ask."""

from pyspark.sql import functions as F

from memloom.operators import pinning as PN
from memloom.operators import requests as RQ
from memloom.operators import retrieval as R
from memloom.operators import solved as SV

from .test_operators import DAY, NOW, frame, memory

QUERIES = "query_id long, q string, vector array<float>"
EDGES = "source_id string, target_id string, confidence double, created_at double, context string"


def graph(spark, entities=(), edges=(), facts=()):
    return (
        spark.createDataFrame(list(entities), "id string, name string, mention_count long"),
        spark.createDataFrame(list(edges), EDGES),
        spark.createDataFrame(list(facts), "entity_id string, source_memory_id string, valid_from double"),
    )


def ids(df, query=1):
    return [r.id for r in df.where(F.col("query_id") == query).orderBy("rank").collect()]


def test_graph_leads_to_memories_without_a_keyword(spark):
    df = frame(spark, memory("m", text="They shipped the project last week"), memory("f", text="nothing alike"), memory("x", text="unrelated words"), memory("gone", text="They shipped it", deleted_at=1.0))
    known = graph(spark, [("1", "Alice", 3), ("2", "Bob", 1), ("3", "Malice", 9)], [("1", "2", 0.5, 1.0, "They shipped the project last week")], [("1", "f", 5.0), ("1", "gone", 6.0), ("2", None, 1.0)])
    asks = spark.createDataFrame([(1, 'What did "Alice" do?', None), (2, "nobody named here", None)], QUERIES)
    assert set(ids(R.search(df, asks, NOW, 5, graph=known))) == {"m", "f"} and ids(R.search(df, asks, NOW, 5)) == []
    got = [(r.query_id, r.id) for r in R.graph_candidates(df, asks, *known, 20).orderBy("id").collect()]
    assert got == [(1, "f"), (1, "gone"), (1, "m")]  # deleted rows fall out of the pool


def test_named_types_bring_their_best(spark):
    df = frame(spark, memory("l1", memory_type="lesson", text="aaa", importance=0.9), memory("l2", memory_type="lesson", text="bbb", lesson_status="resolved"), memory("r", memory_type="rule", text="ccc"), memory("p", memory_type="preference", text="ddd"))
    asks = spark.createDataFrame([(1, "any lessons or policy?", None), (2, "ders", None), (3, "rules", None)], QUERIES)
    got = {(r.query_id, r.id) for r in R.type_candidates(df, asks, 20).collect()}
    assert got == {(1, "l1"), (1, "r"), (2, "l1")}
    assert ids(R.search(df, asks, NOW, 5)) == ["l1", "r"] and ids(R.search(df, asks, NOW, 5, memory_type="rule")) == []


def test_scope_time_and_least_score(spark):
    rows = [memory(f"d{i}", text=f"docker note {i}", created_at=NOW - i * DAY, namespace="a" if i % 2 else "b") for i in range(8)]
    df, asks = frame(spark, *rows), spark.createDataFrame([(1, "docker", None)], QUERIES)
    assert set(ids(R.search(df, asks, NOW, 10))) == {f"d{i}" for i in range(8)}
    assert set(ids(R.search(df, asks, NOW, 10, namespace="a"))) == {"d1", "d3", "d5", "d7"}
    assert set(ids(R.search(df, asks, NOW, 10, time_range=(NOW - 3 * DAY, NOW - DAY)))) == {"d1", "d2", "d3"}
    assert ids(R.search(df, asks, NOW, 10, min_score=0.2)) == []
    assert len(ids(R.search(df, asks, NOW, 3, pre_limit=8))) == 3


def test_diversity_reads_whole_candidates(spark):
    tail = "alpha beta gamma"
    rows = [(1, "a", 0.03, 1, "alpha beta gamma"), (1, "b", 0.029, 2, "word " * 900 + tail), (1, "c", 0.028, 3, "delta epsilon zeta")]
    df = spark.createDataFrame(rows, "query_id long, id string, score double, rank int, text string")
    # b's own words beyond 4,000 characters are those of a: 3 of its 4 words overlap
    assert [r.id for r in R.mmr(df, 3).orderBy("place").collect()] == ["a", "c", "b"]


def test_agents_are_searched_apart_and_merged(spark):
    rows = [memory(f"{a}{i}", agent=a, text=f"docker {a} note {i}", created_at=NOW - i * DAY) for a in "xy" for i in range(3)] + [memory("z", agent="z", text="something else")]
    df, asks = frame(spark, *rows), spark.createDataFrame([(1, "docker note", None)], QUERIES)
    got = R.search_agents(df, asks, NOW, 4).orderBy("rank").collect()
    each = {a: ids(R.search(df.where(F.col("agent") == a), asks, NOW, 4, reranked=False)) for a in "xy"}
    assert [r.agent for r in got].count("x") == 2 and {r.id for r in got} == {*each["x"][:2], *each["y"][:2]}


def test_questions_recall_lessons_first(spark):
    df = frame(spark, memory("l", memory_type="lesson", text="nginx config lesson"), memory("g", text="nginx config note"), memory("o", text="other"))
    said = spark.createDataFrame([(1, "where is the nginx config?"), (2, "nginx config is nice today"), (3, None)], "query_id long, text string")
    got = [(r.query_id, r.place, r.part) for r in PN.message_recall(said, df, NOW, lesson_score=0.0, general_score=0.0).orderBy("place").collect()]
    assert got[0] == (1, 1, "lesson") and {g[0] for g in got} == {1} and len(got) == 3
    asked = spark.createDataFrame([(1, ["nginx", "port"]), (2, ["none"])], "query_id long, keywords array<string>")
    facts = spark.createDataFrame([("a", "nginx port 80", False), ("b", "nginx up", False), ("c", "port nginx", True), ("nginx", None, False)], "key string, claim string, stale boolean")
    assert [(r.key, r.hits) for r in PN.verified_facts_for(asked, facts).orderBy("place").collect()] == [("a", 2), ("b", 1)]


def test_requests(spark):
    rows = spark.createDataFrame([(1, "ok.ns", "all", "q", 5), (2, "Bad", "a b", "", 0), (3, None, None, "x" * 2001, 51), (4, "", "", None, None)], "i int, ns string, a string, q string, n int")
    got = {r.i: r.v for r in rows.select("i", RQ.violations(F.col("ns"), F.col("a"), F.col("q"), limit=F.col("n")).alias("v")).collect()}
    assert got == {1: [], 2: ["namespace", "agent", "query", "limit"], 3: ["query", "limit"], 4: ["query"]}
    keys = spark.createDataFrame([(None, "all"), ("bob", "all"), ("bob", " Bob"), ("bob", None), ("main", None), ("../x", "x")], "k string, a string")
    assert [r[0] for r in keys.select(RQ.permitted(F.col("k"), F.col("a"))).collect()] == [True, False, True, False, True, False]
    said = spark.createDataFrame([("b", i, None, "" if i % 2 else f"text {i}", f"content {i}") for i in range(250)] + [("c", 0, "user", "x" * 50_001, None), ("c", 1, "user", None, None), ("c", 2, "user", "y" * 5000, None)], "batch string, seq int, role string, text string, content string")
    kept = RQ.captured(said).collect()
    assert len(kept) == 201 and {len(r.text) for r in kept if r.batch == "c"} == {4000} and {r.text for r in kept if r.seq == 7} == {"content 7"}
    df = frame(spark, memory("1", text="docker one"), memory("2", text="docker docker"), *(memory(str(i), text="none") for i in range(3, 9)))
    left = RQ.forget_by_query(df, spark.createDataFrame([(1, "docker"), (2, "absent")], "query_id long, q string"))
    assert sorted(r.id for r in left.collect()) == ["1", "3", "4", "5", "6", "7", "8"]
    paged = frame(spark, *(memory(str(i), created_at=float(i // 2)) for i in range(6)))
    assert [r.id for r in RQ.page(paged, 2).collect()] == ["4", "5"] and [r.id for r in RQ.page(paged, 2, (2.0, "4"), paged.where("id = '2'")).collect()] == ["5", "3"]


def test_solved_problems(spark):
    df = spark.createDataFrame([("1", "Docker fails", "no space", "prune", ["disk"], 1.0), ("2", "Slow api", None, "cache", None, 2.0), ("3", None, None, None, None, 3.0)], "id string, title string, root_cause string, fix string, tags array<string>, created_at double")
    asks = spark.createDataFrame([(1, "DOCKER"), (1, "space"), (2, "disks"), (3, "api"), (4, "xyz")], "query_id long, keyword string")
    assert sorted((r.query_id, r.id, r.hits) for r in SV.search_solved(df, asks).collect()) == [(1, "1", 2), (2, "1", 1), (3, "2", 1)]
    assert sorted(map(tuple, SV.keyword_index(df).collect())) == [("api", "2"), ("disk", "1"), ("docker", "1"), ("fails", "1"), ("slow", "2")]


def test_rate_limit_in_batch_by_hand(spark):
    import datetime as dt

    from memloom.streaming import streams as ST

    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=s)) for k in (1, 2) for s in (0, 10, 20, 30, 60, 65, 70, 71)]
    got = {(r.key, (r.ts - t0).seconds): r.accepted for r in ST.accepted_in_batch(spark.createDataFrame(rows, "key long, ts timestamp"), 3, 60).collect()}
    # 0, 10, 20 fill the window; 30 is rejected; 60 frees 0; 70 frees 10; rejected ones are not recorded
    want = {0: True, 10: True, 20: True, 30: False, 60: True, 65: False, 70: True, 71: False}
    assert got == {(k, s): v for k in (1, 2) for s, v in want.items()}
