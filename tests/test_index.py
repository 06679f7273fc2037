"""Postings of character runs, the kept index, point lookups beyond the broadcast bound, each agent's own candidates, and sessions without a shared folder."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from memloom.functions import hooks as H
from memloom.operators import graph as G
from memloom.operators import kept_index as K
from memloom.operators import postings as PO
from memloom.operators import retrieval as R
from memloom.operators import solved as SV
from memloom.plans import registry

from .test_operators import NOW, frame, memory
from .test_search import QUERIES, graph, ids


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, text string")


def terms(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "term string")


def pairs(df):
    return sorted((r.term, r.id) for r in df.select("term", "id").collect())


@pytest.mark.parametrize("bound", [10_000, 3])
def test_containing_against_every_pair(spark, monkeypatch, bound):
    """Terms of any length, signs of expressions, wide characters, repeated and empty ones; also where the runs are too many for a list."""
    monkeypatch.setattr(PO, "WANTED_RUNS", bound)
    r = random.Random(5)
    rows = [(str(i), "".join(r.choice("abç .*🙂\n") for _ in range(r.randint(0, 60)))) for i in range(120)]
    rows += [("null", None), ("empty", ""), ("long", "ab " * 20_000 + "needle")]
    words = ["a", "ab", "abç", "needle", "🙂", "a🙂b", ".*", "b .", "\n", "aaaa", "abab", "none of it", "a", "ab ab ab ab"]
    got = pairs(PO.containing(texts(spark, *rows), terms(spark, *words, "", None)))
    assert got == sorted((w, i) for w in set(words) for i, t in rows if t and w in t)
    assert PO.containing(texts(spark, *rows), terms(spark)).count() == 0 and PO.containing(texts(spark), terms(spark, "ab")).count() == 0


def test_containing_has_no_nested_loop(spark):
    df = PO.containing(texts(spark, ("1", "abc")), terms(spark, "ab"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    names = spark.createDataFrame([("1", "Alice"), ("2", "MALICE")], "id string, name string")
    asked = spark.createDataFrame([(1, "LIC"), (2, "al"), (3, "")], "query_id int, term string")
    df = G.match_names(asked, names)
    assert "NestedLoop" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    assert sorted((r.query_id, r.id) for r in df.collect()) == [(1, "1"), (1, "2"), (2, "1"), (2, "2")]


def test_words_are_found_inside_others(spark):
    df = frame(spark, memory("a", text="We REDEPLOYED it"), memory("b", text="nothing here"), memory("c", text="ananas banana anana"))
    asks = spark.createDataFrame([(1, "eploy", None), (2, "ana", None), (3, "no", None)], QUERIES)
    got = [(r.query_id, r.id) for r in R.bm25_substrings(df, asks, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a"), (2, "c")]  # words under three characters match nothing
    assert R.bm25(df, asks, 5).where("query_id = 1").count() == 0
    assert ids(R.search(df, asks, NOW, 5, substrings=True)) == ["a"] and ids(R.search(df, asks, NOW, 5)) == []
    places = spark.createDataFrame([("anana", "ana"), ("a\\Eb\\Eb", "\\Eb"), ("x", "ana")], "t string, w string").select(PO.occurrences(F.col("t"), F.col("w"))).collect()
    assert [r[0] for r in places] == [2, 2, 0]


def test_each_agent_keeps_its_substring_hits(spark):
    rows = [memory(f"y{i}", agent="y", text=f"redeployed deployer {i}") for i in range(5)] + [memory("x", agent="x", text="undeployed")]
    asks = spark.createDataFrame([(1, "deploy", None)], QUERIES)
    got = sorted((r.agent, r.rank) for r in R.bm25_substrings(frame(spark, *rows), asks, 2, by=("agent",)).collect())
    assert got == [("x", 1), ("y", 1), ("y", 2)]


def test_solved_problems_newest_first(spark):
    rows = [(str(i), f"docker outage {i}", "", "", ["net"], float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, title string, root_cause string, fix string, tags array<string>, created_at double")
    asks = spark.createDataFrame([(1, "DOCKER"), (1, "net"), (2, "networks")], "query_id long, keyword string")
    got = [(r.query_id, r.id, r.hits, r.place) for r in SV.search_solved(df, asks, 20).orderBy("query_id", "place").collect()]
    assert got == [(q, str(29 - i), 3 - q, i + 1) for q in (1, 2) for i in range(20)]


def test_point_lookups_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 10)
    df = frame(spark, *[memory(str(i)) for i in range(60)])
    assert R.by_ids(df, spark.range(50).select(F.col("id").cast("string"))).count() == 50


def test_search_stop_words_and_folded_copies(spark):
    one = lambda text: spark.range(1).select(H.search_tokens(F.lit(text))).first()[0]
    assert one("I had been at çok iyi yer a b") == ["iyi", "yer"]
    assert one("Çağrı evi, the ÇAĞRI's") == ["çağrı", "evi", "çağri's", "cagri", "cagri's"]


def test_each_agent_has_its_own_type_and_graph_candidates(spark):
    """An agent's only lesson, and its only fact of an entity, stay when another agent has 60 better ones."""
    rows = [memory(f"y{i}", agent="y", memory_type="lesson", importance=0.9, text="aaa") for i in range(60)]
    rows += [memory("xl", agent="x", memory_type="lesson", importance=0.2, text="bbb"), memory("xf", agent="x", text="ccc")]
    df = frame(spark, *rows)
    known = graph(spark, [("1", "Alice", 3)], [], [("1", f"y{i}", 9.0) for i in range(60)] + [("1", "xf", 1.0)])
    asks = spark.createDataFrame([(1, 'any lessons of "Alice"?', None)], QUERIES)
    own = graph(spark, [("1", "Alice", 3)], [], [("1", "xf", 1.0)])
    alone = set(ids(R.search(df.where("agent = 'x'"), asks, NOW, 5, graph=own)))
    both = {r.id for r in R.search(df, asks, NOW, 5, graph=known, by_agent=True).where("agent = 'x'").collect()}
    assert both == alone == {"xl", "xf"}
    assert {"xl", "xf"} & {r.id for r in R.search_agents(df, asks, NOW, 100, graph=known).collect()} == {"xl", "xf"}


def rebuilt(spark, rows, asks):
    return sorted(map(tuple, R.bm25(texts(spark, *rows.items()), asks, 5).collect()))


def test_kept_index_against_rebuilds(spark, tmp_path):
    r = random.Random(2)
    path, current = str(tmp_path / "index"), {}
    asks = spark.createDataFrame([(1, "alpha beta", None), (2, "gamma.delta omega", None), (3, "zzz", None)], QUERIES)
    assert K.search(spark, path, asks, 5).count() == 0
    line = lambda: " ".join(r.choice(["alpha", "Beta", "gamma.delta", "omega", "of"]) for _ in range(r.randint(0, 12)))
    for batch in range(5):
        changed = {str(r.randrange(60)): line() for _ in range(25 if batch else 50)}
        deleted = {str(r.randrange(80)) for _ in range(8 * batch)}
        K.apply_batch(path, texts(spark, *changed.items(), (None, "alpha")), spark.createDataFrame([(i,) for i in deleted], "id string"), buckets=8)
        current = {i: t for i, t in (current | changed).items() if i not in deleted}
        state = K.manifest(spark, path)
        assert state["n"] == len(current) and sorted(map(tuple, K.search(spark, path, asks, 5).collect())) == rebuilt(spark, current, asks)
    assert len(state["segments"]) < 5  # merged on the way
    K.merge(spark, path)
    assert len(K.manifest(spark, path)["segments"]) == 1 and sorted(map(tuple, K.search(spark, path, asks, 5).collect())) == rebuilt(spark, current, asks)


def test_kept_index_reads_only_its_buckets_and_ignores_broken_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    K.apply_batch(path, texts(spark, *[(str(i), f"word{i} other{i % 7}") for i in range(200)]))
    plan = K.lookup(spark, path, terms(spark, "word3"))._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan.split("PartitionFilters")[1] and "EqualTo(term,word3)" in plan
    # A batch that wrote its segment but no manifest is not seen, and the next one writes over it.
    lost = texts(spark, ("lost", "word3"))
    K._write_segment(path, K.manifest(spark, path)["version"] + 1, lost.selectExpr("0 AS bucket", "text AS term", "id", "1L AS tf", "1L AS dl"), lost.selectExpr("id", "1L AS dl"), lost.select("id"))
    assert [x.id for x in K.lookup(spark, path, terms(spark, "word3")).collect()] == ["3"]
    K.apply_batch(path, texts(spark, ("3", "new text")))
    assert K.lookup(spark, path, terms(spark, "word3")).count() == 0 and [x.id for x in K.lookup(spark, path, terms(spark, "text")).collect()] == ["3"]


def test_sessions_without_a_shared_folder(tmp_path):
    """A local session whose configuration names no folder gets one; checkpoint() and written tables both go there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "from memloom.session import *; s = local_session('t', '1', 1); assert s.conf.get('spark.checkpoint.dir', None) is None; shared_checkpoints(s); assert written(s.range(3).checkpoint(), 'x').count() == 3; assert work_path(s, 'a').startswith(shared_folder(s))"
    (tmp_path / "conf").mkdir()
    subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path / "conf")}, check=True, timeout=200)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_names_of_one_small_file_are_dealt(spark):
    """One split of names has many terms each: they are dealt by id."""
    plan = registry.queries()["q_match_names"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
