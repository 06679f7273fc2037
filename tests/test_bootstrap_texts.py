"""What a session starts with takes its texts from the rows recalled, which are read once."""

from memloom.operators import bootstrap as B

from .test_operators import frame, memory


def test_sections_read_no_memories_again(spark, tmp_path):
    frame(spark, *[memory(f"m{i}", text=f"recent decisions and configuration changes {i}") for i in range(8)]).write.parquet(str(tmp_path / "memories"))
    rows = spark.read.parquet(str(tmp_path / "memories"))
    contexts = rows.select("agent", "namespace").distinct().selectExpr("agent AS context_id", "agent", "namespace", "array('en') AS shared")
    contexts = spark.createDataFrame(contexts.collect(), contexts.schema)
    lines = B.bootstrap(rows, contexts, B.word_recall)
    assert lines.where("section = 'memories'").count() == 8
    assert not [f for f in lines.inputFiles() if str(tmp_path) in f]
