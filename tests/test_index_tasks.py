"""What one task sorts when an index is written doesn't grow with the index, and a view of texts alone."""

import pytest

from memloom.operators import kept_index as K
from memloom.plans import views


@pytest.mark.parametrize("few", [0, 100])
def test_tasks_grow_with_the_postings(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(K, "TASK_POSTINGS", 50)
    monkeypatch.setattr(K, "BROADCAST_VOID", few)  # 0: what is void meets the postings by a shuffled join
    seen = []
    monkeypatch.setattr(K, "_tasks", lambda n, tasks=K._tasks: seen.append(n) or tasks(n))
    texts = {f"m{i}": f"common common word{i % 7} rare{i}" for i in range(200)}
    rows = spark.createDataFrame([*texts.items(), ("m0", "a lesser text"), ("null", None)], "id string, text string")
    K.apply_batch(str(tmp_path), rows)
    K.apply_batch(str(tmp_path), rows.where("id = 'm1'").selectExpr("id", "'common new' AS text"))
    terms = spark.createDataFrame([("common",), ("rare1",), ("word0",)], "term string")
    found = {(r.term, r.id): (r.tf, r.dl) for r in K.lookup(spark, str(tmp_path), terms).collect()}
    want = {("common", i): (2, 4) for i in texts} | {("word0", f"m{i}"): (1, 4) for i in range(0, 200, 7)} | {("common", "m1"): (1, 2)}
    assert found == want
    postings = spark.read.parquet(f"{tmp_path}/postings/seg=1")
    assert 600 in seen and postings.count() == 600 and len(postings.where("bucket = " + str(postings.where("term = 'common'").first()["bucket"])).inputFiles()) >= 4
    row = K.manifest(spark, str(tmp_path))
    assert (row["n"], row["terms"]) == (201, 199 * 4 + 2)


def test_texts_alone_are_joined_only_where_ids_repeat(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "de")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for ids, rows, joins in (([1, 3], 2, False), ([2, 2, 3], 3, True)):
        spark.createDataFrame([(i, [0.5]) for i in ids], "vec_id long, embedding array<float>").write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
        spark.catalog.clearCache()
        df, whole = views.view(spark, str(tmp_path), "texts"), views.view(spark, str(tmp_path), "memories")
        assert df.columns == [c for c in whole.columns if c != "embedding"] and df.count() == rows
        assert sorted(map(str, df.collect())) == sorted(map(str, whole.drop("embedding").collect()))
        assert ("Join" in df._jdf.queryExecution().optimizedPlan().toString()) is joins
