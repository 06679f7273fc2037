"""Sources: JSON-lines session transcripts, shards, JSON documents, Markdown notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import sessions as S

ENTRY = "type string, timestamp string, message struct<role: string, content: string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of session files with file, modification time and position; blank lines go.

    `path` may be a folder or pattern (root/*/sessions/*.jsonl). A file's lines are numbered by their place, so
    a session stays in order whatever task reads it.
    """
    files = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("wholetext", "true").load(path)
    files = files.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    lines = files.select("file", "modified", F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))
    return lines.where(F.trim("line") != "")


def session_id(file: Column) -> Column:
    """S3: `agent:stem` under .../<agent>/sessions/, else the stem."""
    agent = F.regexp_extract(file, r"([^/]+)/sessions/[^/]+\.jsonl$", 1)
    stem = F.regexp_extract(file, r"([^/]+)\.jsonl$", 1)
    return F.when(agent != "", F.concat_ws(":", agent, stem)).otherwise(stem)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages (session_id, seq, role, text, content, ts, modified); malformed lines and tool calls are left out.

    A line without a readable time takes the last time before it in its session.
    """
    return parse(read_lines(spark, path))


def parse(lines: DataFrame) -> DataFrame:
    entry = F.from_json("line", ENTRY, {"mode": "PERMISSIVE"})
    rows = lines.select(session_id(F.col("file")).alias("session_id"), "seq", "modified", entry.alias("e")).where("e.type = 'message' AND e.message.role IS NOT NULL")
    rows = rows.select("session_id", "seq", "modified", F.col("e.message.role").alias("role"), F.coalesce("e.message.content", F.lit("")).alias("content"), F.unix_micros(F.try_to_timestamp("e.timestamp")).alias("_t"))
    text = S.flatten_content(F.col("content"))
    rows = rows.withColumn("text", text).where(~S.is_tool_call(F.col("role"), F.col("text"), F.col("content")))
    before = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("ts", F.last("_t", True).over(before) / 1e6).drop("_t")


def modified_since(files: DataFrame, state: DataFrame) -> DataFrame:
    """S6 in batch: lines of files that are new or newer than in the state (file, modified)."""
    known = state.select("file", F.col("modified").alias("_seen"))
    return files.join(known, "file", "left").where("_seen IS NULL OR modified > _seen").drop("_seen")


def agents(memories: DataFrame) -> DataFrame:
    """S7."""
    return memories.select("agent").distinct()


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON documents with a declared schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_notes(spark: SparkSession, path: str, days: tuple[str, ...] = ()) -> DataFrame:
    """Whole Markdown files whose name isn't a transcript's; `days` (YYYY-MM-DD) keeps the notes of those days, whose names begin with them."""
    notes = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(path)
    notes = notes.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.md$", 1).alias("name"), F.col("value").alias("text")).where(~F.lower("name").contains("transcript"))
    return notes.where(F.substring("name", 1, 10).isin(*days)) if days else notes


def new_imports(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """Import rows with a text whose id isn't stored; the first of repeated ids."""
    first = W.partitionBy("id").orderBy("created_at", "text")
    rows = arrivals.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return rows.join(stored.select("id"), "id", "left_anti")
