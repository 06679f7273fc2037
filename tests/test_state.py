"""Kept results, published batches, temporal phrases and intervals, incident rollups, facts that stay, what a session starts with."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memloom.functions import hooks as H
from memloom.operators import aggregates as A
from memloom.operators import bootstrap as B
from memloom.operators import graph as G
from memloom.operators import results as RS
from memloom.operators import retrieval as R
from memloom.operators import sessions as S
from memloom.sources import ledger, transcripts

from .test_operators import DAY, NOW, frame, memory
from .test_search import QUERIES

NOON = datetime(2024, 3, 31, 12)


def versions(spark, **agents):
    return spark.createDataFrame(list(agents.items()), "agent string, version long")


def test_results_run_out_and_follow_their_agents_version(spark):
    asked = spark.createDataFrame([(1, "k1", "a"), (2, "k2", "b"), (3, "k3", "a"), (4, "k1", "a")], "query_id long, key string, agent string")
    found = spark.createDataFrame([(1, "x", 0.5, 1), (1, "y", 0.4, 2), (2, "z", 0.3, 1)], "query_id long, id string, score double, rank int")
    at = versions(spark, a=1, b=1)
    table = RS.store(spark.createDataFrame([], RS.SCHEMA), found, asked.where("query_id < 4"), at, 0.0)
    hits = lambda t, v, now: [sorted((r.query_id, getattr(r, "pass"), r.rank, r.id) for r in x.collect()) if i == 0 else sorted(r.query_id for r in x.collect()) for i, x in enumerate(RS.look_up(asked, t, v, now))]
    all_found = [(1, 1, 1, "x"), (1, 1, 2, "y"), (2, 1, 1, "z"), (4, 1, 1, "x"), (4, 1, 2, "y")]
    assert hits(table, at, 100.0) == [all_found, []]  # query 3 has an entry without results; query 4 shares a key
    assert hits(table, at, RS.TTL) == [[], [1, 2, 3, 4]]
    assert hits(table, versions(spark, a=2, b=1), 100.0) == [[(2, 1, 1, "z")], [1, 3, 4]]
    again = spark.createDataFrame([(1, "y", 0.9, 1)], found.schema)
    table = RS.store(table, again, asked.where("query_id = 1"), at, 50.0, 2)
    assert hits(table, at, 100.0)[0] == [(1, 2, 1, "y"), (2, 1, 1, "z"), (4, 2, 1, "y")] and table.count() == 3
    assert RS.store(table, again.limit(0), asked.limit(0), at, 5000.0).count() == 0  # all have run out


def test_second_pass_fuses_two_orders(spark):
    rows = [(1, "a", 1, 0.1), (1, "b", 2, 0.9), (1, "c", 3, 0.5), (2, "d", 1, None)]
    got = [tuple(r) for r in RS.second_pass(spark.createDataFrame(rows, "query_id long, id string, rank int, second_score double"), 0.35, 2, 3).orderBy("query_id", "rank").collect()]
    score = lambda first, second=None: round(0.65 / (60 + first) + (0.35 / (60 + second) if second else 0), 8)
    assert got == [(1, "a", score(1, 2), 1), (1, "b", score(2, 1), 2), (1, "c", score(3), 3), (2, "d", score(1), 1)]
    heavy = RS.second_pass(spark.createDataFrame(rows, "query_id long, id string, rank int, second_score double"), 0.8, 2, 3)
    assert [r.id for r in heavy.where("query_id = 1").orderBy("rank").collect()] == ["b", "a", "c"]


BATCH = "id string, agent string, text string, updated_at double"


def contents(df):
    return sorted((r.agent, r.id, r.text) for r in df.collect())


def test_batches_are_published_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = lambda *rows: spark.createDataFrame(list(rows), BATCH)
    assert ledger.read(spark, path) is None
    ledger.apply_batch(path, batch(("1", "a", "one", 1.0), ("2", "b", "two", 1.0), (None, "a", "lost", 1.0)), 0)
    before = [("a", "1", "one"), ("b", "2", "two")]
    assert contents(ledger.read(spark, path)) == before
    second = batch(("1", "a", "newer", 3.0), ("1", "a", "new", 2.0), ("3", "c", "three", 1.0))
    reader = ledger.read(spark, path)
    with pytest.raises(RuntimeError):
        ledger.apply_batch(path, second, 1, fail_before_ledger=True)
    assert contents(ledger.read(spark, path)) == before  # written, not published
    ledger.apply_batch(path, second, 1)
    after = [("a", "1", "newer"), ("b", "2", "two"), ("c", "3", "three")]
    assert contents(ledger.read(spark, path)) == after and contents(reader) == before
    ledger.apply_batch(path, batch(("1", "a", "replayed", 9.0)), 1)
    ledger.apply_batch(path, batch(("2", "b", "replayed", 9.0)), 0)
    assert contents(ledger.read(spark, path)) == after and contents(ledger.read(spark, path, ["c"])) == [("c", "3", "three")]


def test_upserts_from_a_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("k", "a", f"v{i}", float(i)), (str(i), "b", "x", 0.0)], BATCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run, without its checkpoint, sends the same numbers again
        rows.writeStream.foreachBatch(ledger.upserts(str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start().awaitTermination(120)
    got = contents(ledger.read(spark, str(tmp_path / "t")))
    assert [g[1] for g in got] == ["k", "0", "1", "2"] and ledger.current(spark, str(tmp_path / "t"))[0] == 2


@pytest.mark.parametrize("text, days", [
    ("what about this week", (0, 7)), ("BU HAFTA ne oldu", (0, 7)), ("this month please", (0, 30)), ("bu ay", (0, 30)), ("last week", (-7, 0)), ("geçen ay", (-31, -1)),
    ("dün akşam", (-0.25, 0)), ("dün   akşam neler", (-0.25, 0)), ("bu sabah", (0.25, 0.5)), ("obur gun", (2, 3)), ("dündar", None), ("version 2", None), ("", None),
])
def test_temporal_phrases(spark, text, days):
    """At noon of March 31; a month before it is February 29."""
    start = datetime(2024, 3, 31).timestamp() - datetime(1970, 1, 1).timestamp()
    got = spark.createDataFrame([(text,), (None,)], "t string").select(H.temporal_interval(F.col("t"), NOON).alias("i")).collect()
    assert got[1].i is None
    want = None if days is None else (start + days[0] * DAY, start + days[1] * DAY - (0 if text == "bu sabah" else 1))
    assert (got[0].i and tuple(got[0].i)) == want
    literal = H.temporal_range(text, NOON)
    assert (literal and tuple((t - datetime(1970, 1, 1)).total_seconds() for t in literal)) == want


def test_intervals_against_every_pair(spark):
    rows = frame(spark, *[memory(str(i), created_at=NOW + i * 0.37 * DAY) for i in range(40)], memory("none", created_at=None))
    spans = [(1, NOW, NOW + DAY), (2, NOW + 0.37 * DAY, NOW + 0.37 * DAY), (3, NOW + 3 * DAY, NOW), (4, NOW - 99 * DAY, NOW + 99 * DAY), (5, None, None)]
    got = sorted((r.query_id, r.id) for r in R.in_intervals(rows, spark.createDataFrame(spans, "query_id long, start double, end double")).collect())
    assert got == sorted((q, str(i)) for q, a, b in spans[:4] for i in range(40) if a <= NOW + i * 0.37 * DAY <= b)


def test_recall_takes_each_querys_own_interval(spark):
    df = frame(spark, *[memory(f"d{i}", text=f"docker note {i}", created_at=NOW - i * DAY) for i in range(12)])
    asks = spark.createDataFrame([(1, "docker yesterday", None), (2, "what about docker?", None)], QUERIES)
    got = R.recall(df, asks, NOW, 20).collect()
    assert [r.id for r in got if r.query_id == 1] == ["d1"]
    assert len([r for r in got if r.query_id == 2]) == 12 and {r.triggered for r in got if r.query_id == 2} == {True}
    assert len(R.recall(df, asks, NOW, 20, max_tokens=1).where("query_id = 2").collect()) == 1


def test_incidents_by_type_and_cause(spark):
    rows = [("s", i, NOW - i * DAY, "t1" if i % 2 else "t2", None if i == 3 else "c") for i in range(10)] + [("q", 99, NOW, None, "c")]
    got = {(r.session_id, r.part, r.value): (r.total, r.recent) for r in A.incident_rollup(spark.createDataFrame(rows, "session_id string, incident_id long, ts double, type string, root_cause string"), NOW, 8).collect()}
    assert got == {("s", "all", None): (8, 7), ("s", "type", "t1"): (4, 3), ("s", "type", "t2"): (4, 4), ("s", "root cause", "c"): (7, 6), ("s", "root cause", None): (1, 1), ("q", "all", None): (1, 1), ("q", "type", None): (1, 1), ("q", "root cause", "c"): (1, 1)}


def test_facts_that_stay(spark):
    rows = [("a", f"{i:03}", NOW - i * 3600.0, None) for i in range(300)] + [("b", "old", NOW - 31 * DAY, None), ("b", "short", NOW - 100.0, 50.0)]
    got = S.kept_facts(spark.createDataFrame(rows, "agent string, key string, verified_at double, ttl double"), NOW).collect()
    assert {r.key for r in got if r.agent == "a"} == {f"{i:03}" for i in range(200)} and {r.key for r in got if r.agent == "a" and r.stale} == {f"{i:03}" for i in range(169, 200)}
    assert [(r.key, r.stale) for r in got if r.agent == "b"] == [("short", True)]


def test_containment_without_low_signal_lines(spark):
    noise = "[System Message] hi"
    df = frame(spark, memory("a", importance=0.9, text=f"use metric\n{noise}"), memory("b", importance=0.8, text="use metric"), memory("c", importance=0.7, text=noise), memory("d", importance=0.6, text="other"))
    ids = lambda **kw: [r.id for r in S.contained_dedup(df, **kw).orderBy("place").collect()]
    assert ids(stripped=True) == ["a", "d"]
    assert ids() == ["a", "d"]  # c is inside a


def test_notes_of_some_days(spark, tmp_path):
    for name in ("2024-01-02.md", "2024-01-02-more.md", "2024-01-01.md", "2023-12-31.md"):
        (tmp_path / name).write_text(name)
    got = sorted(r.name for r in transcripts.read_notes(spark, str(tmp_path), ("2024-01-02", "2024-01-01")).collect())
    assert got == ["2024-01-01", "2024-01-02", "2024-01-02-more"]


def test_session_tier_suffices_at_six(spark):
    """A namespace with six memories of its own takes no others; one with fewer falls back to the agent's, and to the main agent's below five."""
    rows = [memory(f"n{i}", agent="x", namespace="full", text=f"recent decisions number {i}") for i in range(6)]
    rows += [memory("w", agent="x", namespace="thin", text="recent summary"), memory("m", agent="main", namespace="z", text="recent context"), memory("y", agent="y", namespace="lone", text="recent work")]
    rows += [memory("l", agent="x", namespace="thin", memory_type="lesson", text="behavioral lessons matter"), memory("s", agent="x", namespace="pool", text="shared operational notes")]
    contexts = spark.createDataFrame([("full", "x", "full", []), ("thin", "x", "thin", ["pool", "full"]), ("lone", "y", "lone", [])], "context_id string, agent string, namespace string, shared array<string>")
    got = {}
    for r in B.bootstrap(frame(spark, *rows), contexts, B.word_recall).orderBy("place").collect():
        got.setdefault((r.context_id, r.section), []).append(r.id)
    assert sorted(got["full", "memories"]) == [f"n{i}" for i in range(6)]
    assert got["thin", "memories"][0] == "w" and set(got["thin", "memories"]) == {"w", *(f"n{i}" for i in range(6))}
    assert got["lone", "memories"] == ["y"] and got["lone", "main"] == ["m"] and ("thin", "main") not in got
    assert got["thin", "lessons"] == got["full", "lessons"] == ["l"] and got["thin", "shared"][0] == "s" and ("full", "shared") not in got
    whole = B.bootstrap(frame(spark, *rows), contexts, B.whole_recall(NOW)).where("section = 'memories' AND context_id = 'full'")
    assert sorted(r.id for r in whole.collect()) == [f"n{i}" for i in range(6)]


def test_knowledge_chain(spark):
    """Links and typed relations become edges that repeats strengthen; facts of exclusive relations meet conflicts in order of time."""
    df = frame(spark, memory("1", text="docker and redis", created_at=1.0), memory("2", text="redis with docker", created_at=2.0), memory("3", text="Ada lives in berlin", created_at=3.0), memory("4", text="gh status is open", created_at=4.0), memory("5", text="nothing"))
    edges, facts = G.knowledge(df)
    got = {(r.source_id, r.target_id, r.relation_type): (r.confidence, r.n, r.context) for r in edges.collect()}
    assert got["docker", "redis", "uses"] == (0.7, 2, "redis with docker")
    assert any(s == "ada" and t == "berlin" and r != "mentioned_with" for s, t, r in got)
    assert {(r.entity_id, r.object_value) for r in facts.where("active").collect()} >= {("github", "open")}
    assert all(r[2] in ("uses", "mentioned_with") for r in {(x.source_id, x.target_id, x.relation_type) for x in G.knowledge(df, relations=False)[0].collect()})
