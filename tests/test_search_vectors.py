"""A search whose vectors stand apart from the texts: the same rows, and texts that meet no vectors."""

import pytest

from memloom.operators import pinning as PN
from memloom.operators import retrieval as R
from memloom.plans import queries_recall as Q

COLUMNS = "id string, text string, embedding array<float>, agent string, namespace string, memory_type string, lesson_status string, created_at double, last_accessed_at double, strength double, importance double, deleted_at double"
ROWS = [
    (f"m{i}", f"common word{i % 5} rare{i % 11}", [float(i % 7), 1.0] if i % 3 else None, f"a{i % 2}", "en" if i % 4 else "tr", ("fact", "lesson", None)[i % 3], None, float(i), None, 1.0, 0.5, None if i % 9 else 1.0)
    for i in range(45)
]
ASKS = [(1, "common rare3 lesson", [3.0, 1.0]), (2, "word2 rare5", [0.0, 1.0]), (3, "rare7", None)]


@pytest.mark.parametrize("scope", [{}, {"namespace": "tr"}, {"memory_type": "lesson"}, {"by_agent": True}, {"substrings": True, "pre_limit": 12}])
def test_vectors_apart_give_the_same_rows(spark, scope):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    asks = spark.createDataFrame(ASKS, "query_id long, q string, vector array<float>")
    whole, apart = R.search(rows, asks, 50.0, 6, **scope), R.search(rows.drop("embedding"), asks, 50.0, 6, vectors=rows, **scope)
    assert whole.columns == apart.columns and len(whole.collect()) > 5
    assert sorted(map(str, whole.collect())) == sorted(map(str, apart.collect()))


def test_texts_beyond_the_ids_that_are_sent_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    asks = spark.createDataFrame(ASKS, "query_id long, q string, vector array<float>")
    want = sorted(map(str, R.search(rows, asks, 50.0, 6).collect()))
    monkeypatch.setattr(R, "SENT_IDS", 2)
    assert sorted(map(str, R.search(rows, asks, 50.0, 6).collect())) == want


@pytest.mark.parametrize("name", ["q_search", "q_message_recall"])
def test_texts_of_the_tables_are_not_joined_with_vectors(spark, monkeypatch, name):
    plans = []

    def written(df, label, write=R.written):
        if label in ("words", "entities"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    for module in (R, PN, Q):
        monkeypatch.setattr(module, "written", written)
    assert getattr(Q, name)(spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) >= 2 and not any("Join" in p for p in plans)


def test_entities_are_looked_through_once(spark, monkeypatch):
    plans = {}

    def written(df, label, write=R.written):
        plans.setdefault(label, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    for module in (R, Q):
        monkeypatch.setattr(module, "written", written)
    assert Q.q_search(spark, "/root/testdata/sf0.001").count() > 0
    runs = {label: sum(p.count("(?s)(?=(.{") for p in ps) for label, ps in plans.items()}
    assert runs["chosen"] > 0 and sum(runs.values()) == runs["chosen"]
