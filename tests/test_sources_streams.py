"""Files in and out, and streams against their batch twins."""

import json

from pyspark.sql import functions as F

from memloom.sources import transcripts, writers
from memloom.streaming import streams

from .test_operators import frame, memory


def session(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def message(role, content, ts):
    return {"type": "message", "timestamp": ts, "message": {"role": role, "content": content}}


def folder(tmp_path):
    session(tmp_path / "root/main/sessions/one.jsonl", message("user", "hello there", "2024-01-01T00:00:00Z"), "not json", "", {"type": "meta"}, message("assistant", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "bad time"), message("tool", "plain output", "2024-01-01T00:02:00Z"), message("tool", "docker restart failed", "2024-01-01T00:03:00Z"), message("assistant", [{"type": "tool_use", "text": "x"}], "2024-01-01T00:04:00Z"))
    session(tmp_path / "root/two.jsonl", message("user", "second", "2024-01-01T06:00:00Z"))
    return str(tmp_path / "root")


def test_read_sessions(spark, tmp_path):
    rows = {(r.session_id, r.seq): r for r in transcripts.read_sessions(spark, folder(tmp_path)).collect()}
    assert {k: v.text for k, v in rows.items()} == {("main:one", 0): "hello there", ("main:one", 4): "a\nb", ("main:one", 6): "docker restart failed", ("two", 0): "second"}
    assert rows["main:one", 4].ts == rows["main:one", 0].ts == 1704067200.0


def test_modified_files_only(spark, tmp_path):
    lines = transcripts.read_lines(spark, folder(tmp_path))
    state = lines.where("file LIKE '%one.jsonl'").select("file", "modified").distinct()
    left = transcripts.modified_since(lines, state).select("file").distinct().collect()
    assert len(left) == 1 and left[0].file.endswith("two.jsonl")


def test_imports_notes_and_documents(spark, tmp_path):
    stored = frame(spark, memory("a"))
    got = transcripts.new_imports(frame(spark, memory("a"), memory("b", text="first", created_at=1.0), memory("b", text="second", created_at=2.0), memory("c", text=" ")), stored).collect()
    assert [(r.id, r.text) for r in got] == [("b", "first")]
    (tmp_path / "day.md").write_text("note")
    (tmp_path / "transcript-1.md").write_text("no")
    (tmp_path / "facts.json").write_text('{\n"k": 1\n}')
    assert [tuple(r) for r in transcripts.read_notes(spark, str(tmp_path)).collect()] == [("day", "note")]
    assert transcripts.read_json_documents(spark, str(tmp_path / "facts.json"), "k int").first().k == 1


def test_sinks(spark, tmp_path):
    df = frame(spark, memory("a", agent="x"), memory("b", agent="y", deleted_at=1.0))
    writers.write_memories(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.where("agent = 'x'").count() == 1 and {r.agent for r in transcripts.agents(back).collect()} == {"x", "y"}
    writers.export_json(df, str(tmp_path / "j"))
    assert [r.id for r in spark.read.json(str(tmp_path / "j")).collect()] == ["a"]
    target = df.withColumn("source_session", F.lit(None).cast("string"))
    assert [r.id for r in writers.copy_shard(frame(spark, memory("a", agent="x"), memory("n", agent="x")), target, "x", "moved").collect()] == ["n"]
    talk = spark.createDataFrame([("s", 2, "assistant", "b"), ("s", 1, "user", "a")], "session_id string, seq int, role string, text string")
    assert writers.transcript_text(talk).first().text == "user: a\nassistant: b"


def run(spark, df, tmp_path, mode="append"):
    out = f"t{abs(hash(str(tmp_path))) % 10**8}"
    q = df.writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(out)


EVENTS = "event_id long, session_id long, event_type string, value double, ts timestamp"


def events(spark, tmp_path):
    rows = [(i, i % 3, "error" if i % 4 == 0 else "view", float(i), 1704067200 + 600 * i + (20_000 if i > 40 else 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, session_id long, event_type string, value double, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    return df, spark.readStream.schema(EVENTS).parquet(str(tmp_path / "ev"))


def test_session_stream(spark, tmp_path):
    folder(tmp_path)
    source = streams.sessions_source(spark, str(tmp_path / "root/*/sessions"))
    assert run(spark, source, tmp_path).where("role = 'user'").count() == 1


def test_windows_and_metrics_against_batch(spark, tmp_path):
    df, stream = events(spark, tmp_path)
    want = {tuple(r) for r in streams.session_windows(df).collect()}
    got = {tuple(r) for r in run(spark, streams.session_windows(stream), tmp_path).collect()}
    assert got and got <= want
    (tmp_path / "m").mkdir()
    got = {tuple(r) for r in run(spark, streams.request_metrics(stream), tmp_path / "m", "complete").collect()}
    assert got == {tuple(r) for r in streams.request_metrics(df).collect()}


def test_rate_limit_against_batch(spark, tmp_path):
    df, stream = events(spark, tmp_path)
    pick = lambda x: x.select(F.col("session_id").alias("key"), "ts")
    want = sorted(map(tuple, streams.accepted_in_batch(pick(df), 1, 3600).collect()))
    got = sorted(map(tuple, run(spark, streams.rate_limited(pick(stream), 1, 3600), tmp_path).collect()))
    assert got == want and {x[2] for x in got} == {True, False}


def test_scores_and_failures(spark, tmp_path):
    df, stream = events(spark, tmp_path)
    got = {r.session_id: (r.score, r.tier) for r in run(spark, streams.scores(stream), tmp_path, "update").collect()}
    assert got == {0: (5, "mandatory"), 1: (5, "mandatory"), 2: (5, "mandatory")}
    assert streams.failures(df).count() == 15
