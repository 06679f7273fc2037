"""Operators on hand-made rows and against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from memloom.operators import aggregates as A
from memloom.operators import consolidate as C
from memloom.operators import graph as G
from memloom.operators import lifecycle as L
from memloom.operators import retrieval as R
from memloom.operators import sessions as S

NOW, DAY = 1_000_000_000.0, 86400.0
SCHEMA = "id string, n long, text string, category string, memory_type string, namespace string, agent string, source string, lesson_status string, importance double, strength double, pinned boolean, created_at double, last_accessed_at double, deleted_at double, embedding array<float>"


def memory(id, **kw):
    base = {"id": id, "n": 0, "text": f"text {id}", "category": "user", "memory_type": "fact", "namespace": "ns", "agent": "a", "source": "api", "lesson_status": None, "importance": 0.5, "strength": 1.0, "pinned": False, "created_at": NOW - DAY, "last_accessed_at": None, "deleted_at": None, "embedding": None}
    return tuple((base | kw).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_decay_bands(spark):
    idle = lambda d, **kw: memory(f"{d}{kw.get('memory_type', '')}", last_accessed_at=NOW - d * DAY, **kw)
    df = frame(spark, idle(1), idle(10), idle(30), idle(100), idle(1, memory_type="lesson"), idle(30, memory_type="lesson"), idle(100, memory_type="lesson"), idle(300, memory_type="lesson"), memory("pin", pinned=True, last_accessed_at=NOW - 100 * DAY), memory("low", strength=0.1, last_accessed_at=NOW - 200 * DAY))
    got = {r.id: round(r.strength, 4) for r in L.decay(df, NOW).collect()}
    assert got == {"1": 1.1, "10": 1.0, "30": round(1 - 0.07 * 1.5, 4), "100": 0.3, "1lesson": 1.1, "30lesson": 1.0, "100lesson": 0.98, "300lesson": 0.8, "pin": 1.0, "low": 0.3}


def test_garbage_archive_purge(spark):
    old = {"last_accessed_at": NOW - 100 * DAY, "strength": 0.2, "importance": 0.2}
    df = frame(spark, memory("go", **old), memory("pin", pinned=True, **old), memory("lesson", memory_type="lesson", **old), memory("rule", memory_type="rule", **old), memory("null", **(old | {"importance": None})), memory("fresh"))
    gone = lambda x: {r.id for r in x.where("deleted_at IS NOT NULL").collect()}
    assert gone(L.collect_garbage(df, NOW)) == {"go", "rule"}
    assert gone(L.archive_weak(df, NOW)) == {"go", "null"}
    assert L.purge_eligible(frame(spark, memory("x", deleted_at=NOW - 40 * DAY), memory("y", deleted_at=NOW)), NOW).first()[0] == 1


def test_compress_and_clean(spark):
    long = ". ".join(["This sentence has exactly forty-one chars"] * 40)
    df = frame(spark, memory("a", text=long, created_at=NOW - 8 * DAY), memory("pin", text=long, created_at=NOW - 8 * DAY, pinned=True), memory("vip", text=long, created_at=NOW - 8 * DAY, importance=0.9), memory("new", text=long), memory("w", text="[Subagent Context] x\n\nkeep this text", embedding=[1.0]))
    got = L.compress(df, NOW).collect()
    assert [r.id for r in got] == ["a"] and got[0].text.startswith("[compressed] This") and got[0].original_text == long
    clean = {r.id: r for r in L.clean_envelopes(df).collect()}
    assert clean["w"].text == "keep this text" and clean["w"].embedding is None


def test_dashboard_numbers(spark):
    df = frame(spark, memory("1", agent="main", source="hook", memory_type="lesson", strength=1.2, created_at=NOW - DAY), memory("2", agent="main", category="decision"), memory("3", agent="worker", source="hook", text="Conversation info (untrusted metadata) x"))
    rows = {r.agent: r for r in A.dashboard(df, NOW).collect()}
    assert (rows["main"].total, rows["main"].hook_7d, rows["main"].decisions, rows["worker"].hook) == (2, 1, 1, 1)
    h = A.health(df, NOW).first()
    assert (h.total, h.hook_pct, h.vectorless, h.noise, h.lesson_strength) == (3, 66.7, 3, 1, 1.2)


def test_audit_counts(spark):
    df = frame(spark, memory("1", text="same", embedding=[1.0]), memory("2", text="same", embedding=[1.0]), memory("3", memory_type="incident", embedding=[1.0]), memory("4", namespace=None, embedding=[1.0]), memory("5", text="api_key=abc123"), memory("6", deleted_at=1.0))
    a = A.audit(df).first()
    assert (a.total, a.scoped, a.vectorless, a.invalid_type, a.duplicate_groups, a.null_namespace) == (6, 5, 1, 1, 1, 1)
    assert A.secret_tally(df).where("pattern = 0").first().hits == 1


def test_scoped_search_finds_the_target(spark):
    rows = [memory(f"g{i:02}", namespace="global", embedding=[1.0, 0.0]) for i in range(30)] + [memory("t", namespace="target", embedding=[0.0, 1.0]), memory("zero", namespace="target", embedding=[0.0, 0.0]), memory("dim", namespace="target", embedding=[1.0])]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    df = frame(spark, *rows)
    assert [r.id for r in R.knn(R.scoped(df, "target"), q, 1, "cosine").collect()] == ["t"]
    assert R.knn(df.where("id = 't'"), q, 1, min_score=0.9).count() == 0


def test_fusion(spark):
    lanes = spark.createDataFrame([(1, d, lane, r) for lane, ids in (("x", "abc"), ("y", "bac")) for r, d in enumerate(ids, 1)], "query_id long, id string, lane string, rank int")
    got = {r.id: r.score for r in R.fuse(lanes, {"x": 0.5, "y": 0.5}).collect()}
    assert got["a"] == pytest.approx(0.5 / 61 + 0.5 / 62) and got["a"] == pytest.approx(got["b"]) and got["c"] == pytest.approx(1 / 63)


def test_budget(spark):
    rows = spark.createDataFrame([(1, i, "x" * 400) for i in (1, 2, 3)] + [(2, 1, "x" * 1000), (3, 1, "x" * 40), (3, 2, "x" * 4000), (3, 3, "x" * 4)], "query_id long, rank int, text string")
    assert sorted((r.query_id, r.rank) for r in R.within_budget(rows, 150).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_mmr_against_a_plain_loop(spark):
    r = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    rows = [(q, f"d{i}", 0.03 - i / 1000, i + 1, " ".join(r.sample(words, 4))) for q in (1, 2) for i in range(12)]
    want = []
    for q in (1, 2):
        pool = [x for x in rows if x[0] == q]
        chosen = [pool.pop(0)]
        while pool and len(chosen) < 5:
            far = lambda c: max(len(set(c[4].split()) & set(s[4].split())) / 4 for s in chosen)  # noqa: B023, E731
            best = max(pool, key=lambda c: 0.7 * c[2] - 0.3 * far(c))
            chosen.append(best)
            pool.remove(best)
        want += [(q, c[1], n) for n, c in enumerate(chosen, 1)]
    df = spark.createDataFrame(rows, "query_id long, id string, score double, rank int, text string")
    assert sorted((x.query_id, x.id, x.place) for x in R.mmr(df, 5).collect()) == sorted(want)


def test_merge_or_store(spark):
    old = frame(spark, memory("o", embedding=[1.0, 0.0], importance=0.4, text="old "))
    new = frame(spark, memory("n1", embedding=[1.0, 0.05], importance=0.9, text=" new"), memory("n2", embedding=[1.0, 0.0], category="other"), memory("n3", embedding=[1.0, 0.0], memory_type="lesson"), memory("n4"))
    got = {r.id: r for r in C.merge_or_store(old, new).collect()}
    assert set(got) == {"o", "n2", "n3", "n4"}
    assert got["o"].text == "old\n• new" and got["o"].importance == 0.9 and got["o"].strength == 1.2 and got["o"].merged == 1


def plain_merge(old, new, threshold):
    """Every arrival against every stored row."""
    stored = [dict(r, merged=0) for r in sorted(old, key=lambda r: (r["created_at"], r["id"]))]
    for r in sorted(new, key=lambda r: (r["created_at"], r["id"])):
        best, most = None, threshold
        for s in stored if r["embedding"] is not None and r["memory_type"] != "lesson" else []:
            if s["embedding"] is None or s["importance"] < 0.05 or (s["agent"], s["namespace"]) != (r["agent"], r["namespace"]) or len(s["embedding"]) != len(r["embedding"]):
                continue
            sim = 1 - float(np.sqrt(((np.array(s["embedding"]) - np.array(r["embedding"])) ** 2).sum())) / 2
            if sim > most or best is None and sim == most:
                best, most = s, sim
        if best is not None and best["category"] == r["category"]:
            best["text"] = best["text"].rstrip() + "\n• " + r["text"].strip()
            best["embedding"] = (np.array(best["embedding"]) + np.array(r["embedding"])) / 2
            best["importance"], best["strength"], best["merged"] = max(best["importance"], r["importance"]), min(best["strength"] + 0.2, 5.0), best["merged"] + 1
        else:
            stored.append(dict(r, merged=0))
    return stored


@pytest.mark.parametrize("seed", range(3))
def test_merge_or_store_against_every_pair(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "BLOCK_ROWS", 7)
    rng = random.Random(seed)
    names = SCHEMA.replace(",", " ").split()[::2]

    def some(id):
        centre = rng.choice([(1.0, 0.0, 0.0), (0.8, 0.4, 0.0), (0.0, 1.0, 0.0)])
        vector = rng.choice([None, [1.0, 0.0], [0.5, 0.5, 0.5], *[[float(np.float32(c + rng.gauss(0, 0.12))) for c in centre] for _ in range(7)]])
        return memory(id, embedding=vector, agent=rng.choice("ab"), namespace=rng.choice(["x", "y"]), category=rng.choice(["user", "user", "other"]), memory_type=rng.choice(["fact", "fact", "fact", "lesson", None]), importance=rng.choice([0.01, 0.3, 0.8]), strength=rng.choice([1.0, 4.9]), created_at=float(rng.randrange(20)), text=rng.choice(["t ", " u", "", "v\n"]) + id)

    old, new = [some(f"o{i}") for i in range(60)], [some(f"n{i}") for i in range(60)]
    want = {r["id"]: r for r in plain_merge([dict(zip(names, r)) for r in old], [dict(zip(names, r)) for r in new], 0.85)}
    got = {r.id: r for r in C.merge_or_store(frame(spark, *old), frame(spark, *new)).collect()}
    assert set(got) == set(want) and sum(r.merged for r in got.values()) > 10
    for id, r in got.items():
        w = want[id]
        assert (r.text, r.merged, r.importance, r.category) == (w["text"], w["merged"], w["importance"], w["category"])
        assert r.strength == pytest.approx(w["strength"])
        assert r.embedding is w["embedding"] or r.embedding == pytest.approx(list(w["embedding"]), abs=1e-6)


def test_merge_or_store_of_copies_and_empty_sides(spark):
    many = frame(spark, *[memory(f"n{i:03}", embedding=[1.0, 0.0], text=None if i == 0 else "x") for i in range(200)])
    nothing = many.limit(0)
    got = C.merge_or_store(nothing, many).collect()
    assert [(r.id, r.merged) for r in got] == [("n000", 199)] and got[0].text.count("x") == 199
    assert C.merge_or_store(many, nothing).count() == 200 and C.merge_or_store(nothing, nothing).count() == 0
    assert {r.text for r in C.merge_or_store(many.where("id < 'n002'"), nothing).collect()} == {None, "x"}


def test_consolidation(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 2)
    df = frame(spark, memory("a", embedding=[1.0, 0.0], importance=0.2, created_at=1.0), memory("b", embedding=[1.0, 0.1], importance=0.8, created_at=2.0), memory("c", embedding=[1.0, 0.2], created_at=3.0), memory("far", embedding=[-1.0, 0.0]), memory("pin", embedding=[1.0, 0.0], pinned=True))
    got = C.consolidate(df).collect()
    assert len(got) == 1 and (got[0].keeper, got[0].members, got[0].importance, got[0].strength) == ("b", 3, 0.8, 1.2)
    assert got[0].text == "text a\n• text b\n• text c" and got[0].embedding == pytest.approx([1.0, 0.1])


def test_conflicts(spark):
    rows = [(1, "e", "status", "up", 0.5, 1), (2, "e", "status", "down", 0.8, 2), (3, "e", "status", "UP", 0.7, 3), (4, "e", "status", "down", 0.1, 4), (5, "e", "uses", "x", 0.5, 5)]
    df = spark.createDataFrame(rows, "id long, entity_id string, relation_type string, object_value string, confidence double, valid_from int")
    got = {r.id: (r.active, r.closed_by, r.flagged) for r in G.fold_conflicts(df).collect()}
    assert got == {1: (False, 2, False), 2: (True, None, False), 3: (True, None, True), 4: (True, None, True), 5: (True, None, False)}


def test_conflicts_of_one_key_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["e", "e", "e", None]), "status", rng.choice(["a", "A", "b", "c", None]), rng.choice([None, *[x / 10 for x in range(11)]]), i) for i in range(400)]
    want = {}
    for entity in ("e", None):
        active = []
        for id, _, _, value, confidence, _ in (r for r in rows if r[1] == entity):
            want[id] = [True, None, False]
            for j, v, c in list(active):
                if (v or "").lower() == (value or "").lower():
                    continue
                if confidence is not None and c is not None and confidence > c + 0.2:
                    want[j][:2] = [False, id]
                    active.remove((j, v, c))
                    break
                want[id][2] = True
            active.append((id, value, confidence))
    df = spark.createDataFrame(rows, "id long, entity_id string, relation_type string, object_value string, confidence double, valid_from int")
    assert {r.id: [r.active, r.closed_by, r.flagged] for r in G.fold_conflicts(df).collect()} == want
    assert G.fold_conflicts(df.limit(0)).count() == 0


def test_entities_and_relations(spark):
    df = frame(spark, memory("1", text="Ayşe Yılmaz met Bob Stone in Berlin on 2024-01-02; mail a@b.co; Ayşe Yılmaz uses docker, not dockerx"))
    got = {(r.label, r.key) for r in G.entities(df).collect()}
    assert {("person", "ayşe yılmaz"), ("person", "bob stone"), ("place", "berlin"), ("date", "2024-01-02"), ("email", "a@b.co"), ("tech", "docker")} <= got
    pairs = G.cooccurrences(G.entities(df)).count()
    assert pairs == len(got) * (len(got) - 1) // 2
    # An object runs on over dots and spaces, up to its length: the expressions' own form.
    rel = G.typed_relations(frame(spark, memory("1", text="Ada lives in berlin"), memory("2", text="Bob works at Acme Corp"), memory("3", text="gh status is open"), memory("4", text="Node cluster depends on Redis stack\n"), memory("5", text="Scraper v1.2 and Ada online"))).collect()
    assert {(r.id, r.relation_type, r.subject, r.object) for r in rel} == {
        ("1", "lives_in", "Ada", "Berlin"), ("2", "works_at", "Bob", "Acme Corp"), ("3", "status", "GitHub", "open"), ("4", "depends_on", "Node cluster", "Redis stack"),
        ("5", "version_of", "Scraper", "1.2"), ("5", "status", "Ada", "online"), ("5", "has_state", "Ada", "online"),
    }


def test_chunks(spark):
    talk = [("user", "question one", 0), ("assistant", "answer one", 60), ("user", "orphan question", 120), ("user", "second question", 180), ("system", "ignored", 200), ("assistant", "x" * 5000, 240), ("user", "after a gap", 240 + 5 * 3600), ("assistant", "short", 240 + 10 * 3600), ("assistant", "ok", 240 + 10 * 3600)]
    df = spark.createDataFrame([("s", i, r, t, float(ts)) for i, (r, t, ts) in enumerate(talk)], "session_id string, seq int, role string, text string, ts double")
    got = [(r.role, r.island, len(r.text)) for r in S.chunks(df).orderBy("seq").collect()]
    assert [g[:2] for g in got] == [("qa_pair", 0), ("user", 0), ("qa_pair", 0), ("user", 1)] and got[2][2] == len("User: second question\nAssistant: ") + 3000
    assert S.first_of_each(S.chunks(df.unionAll(df.withColumn("session_id", F.lit("t"))))).count() == 4


def test_unproven_claims(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    claims = spark.createDataFrame([Row(session_id=1, claim_id=1, ts=t0, tools=["exec"], keywords=["git"]), Row(session_id=2, claim_id=2, ts=t0, tools=["exec"], keywords=["git"])])
    calls = spark.createDataFrame([Row(session_id=1, tool="exec", command="git push", ts=t0 - dt.timedelta(seconds=100)), Row(session_id=2, tool="exec", command="git push", ts=t0 - dt.timedelta(seconds=400))])
    assert [r.claim_id for r in S.unproven(claims, calls, 120).collect()] == [2]


def test_upsert_patch_forget(spark):
    base = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0)], "id string, v double, updated_at double")
    new = spark.createDataFrame([("b", 5.0, 2.0), ("b", 6.0, 3.0), ("c", 7.0, 1.0)], "id string, v double, updated_at double")
    assert {r.id: r.v for r in L.upsert(base, new).collect()} == {"a": 1.0, "b": 6.0, "c": 7.0}
    assert {r.id: r.v for r in L.forget(base, new).collect()} == {"a": 1.0}
    assert {r.id: r.v for r in L.patch(base, spark.createDataFrame([("a", None)], "id string, v double"), ["v"]).collect()} == {"a": 1.0, "b": 2.0}


def test_contained_texts_go(spark):
    rows = [memory("1", text="long text one", importance=0.9), memory("2", text="text", importance=0.8), memory("3", text="other", importance=0.7), memory("4", text="a long text one more", importance=0.6), memory("5", text="third", importance=0.5)]
    got = [r.id for r in S.contained_dedup(frame(spark, *rows)).orderBy("place").collect()]
    assert got == ["1", "3", "5"]


def test_hook_expressions(spark):
    from datetime import datetime

    from memloom.functions import hooks as H

    df = spark.createDataFrame([("I fixed the bug and `cannot run` it is not available now",), ("short",)], "t string")
    got = [[(c.type, c.direction) for c in r[0]] for r in df.select(H.claims(F.col("t"))).collect()]
    assert got == [[("feature_claim", "negative"), ("completion_claim", "positive")], []]
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(H.head_and_tail(F.lit("x" * 3000))).startswith("x" * 1200 + "\n...[truncated 1200 chars]...\n")
    assert one(H.is_question(F.lit("where is the config?"))) and not one(H.is_question(F.lit("nice weather today")))
    assert one(H.keywords(F.lit("Where is the Docker config, the docker port?"))) == ["docker", "config", "port"]
    assert one(H.tool_category(F.lit("git push origin"))) == "deployment" and one(H.tool_importance(F.lit("ls"), F.lit("permission denied"))) == 0.85
    assert one(H.files_mentioned(F.lit("see /etc/app/x.conf and /tmp/abcdefg"))) == ["/etc/app/x.conf"]
    assert one(H.search_tokens(F.lit("Çağrı ve the Çağrı evi"))) == ["çağrı", "evi", "cagri"]
    now = datetime(2024, 2, 10, 15)
    assert H.temporal_range("dün akşam ne oldu", now) == (datetime(2024, 2, 9, 18), datetime(2024, 2, 9, 23, 59, 59))
    assert H.temporal_range("what about last week", now)[0] == datetime(2024, 2, 3) and H.temporal_range("version 2", now) is None
    talk = spark.createDataFrame([("s", 1, "user", "this is great"), ("s", 2, "user", "ok"), ("t", 1, "user", "you are useless")], "session_id string, seq int, role string, text string")
    assert {r.session_id: r.mood for r in H.moods(talk).collect()} == {"s": "positive", "t": "frustrated"}
