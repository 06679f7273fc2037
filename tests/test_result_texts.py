"""The second pass of kept results: what it ranks anew is sent to the texts, which aren't shuffled for it."""

import re

from memloom.plans import queries_state as QS


def test_texts_stay_where_they_are(spark, monkeypatch):
    plans = []

    def written(df, label, write=QS.written):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(QS, "written", written)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "150k")  # below the size of the documents
    try:
        QS.q_result_table(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = [p for n, p in plans if n == "results"][-1]
    assert "text" in plan and not re.search(r"SortMergeJoin \[id#", plan)
