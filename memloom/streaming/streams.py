"""Structured Streaming forms of the stateful parts; each has a batch twin in operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import transcripts

SESSION_GAP, LATENESS = "4 hours", "4 hours"


def sessions_source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New session files only; the checkpoint remembers what was read. Lines as in transcripts.read_lines."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch).load(path)
    files = files.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    lines = files.select("file", "modified", F.posexplode(F.split("value", "\r?\n")).alias("seq", "line")).where(F.trim("line") != "")
    entry = F.from_json("line", transcripts.ENTRY)
    rows = lines.select(transcripts.session_id(F.col("file")).alias("session_id"), "seq", entry.alias("e")).where("e.type = 'message'")
    return rows.select("session_id", "seq", F.col("e.message.role").alias("role"), F.col("e.message.content").alias("content"), F.try_to_timestamp("e.timestamp").alias("ts"))


def session_windows(messages: DataFrame) -> DataFrame:
    """Sessions by gap, with late data up to the watermark."""
    return messages.withWatermark("ts", LATENESS).groupBy("session_id", F.session_window("ts", SESSION_GAP)).agg(F.count("*").alias("messages")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "messages")


def request_metrics(requests: DataFrame, width: str = "1 minute") -> DataFrame:
    """Counts and time by kind and minute."""
    return requests.withWatermark("ts", "10 minutes").groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def rate_limited(requests: DataFrame, most: int = 120, seconds: int = 60) -> DataFrame:
    """Key, ts, accepted as requests come in: a sliding window of accepted requests a key; rejected ones are not recorded.

    For streams that end, as the window of an idle key stays in the state; ordered.rate_limited goes by event time and lets idle keys go.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            out = []
            for t in pdf["ts"]:
                now = t.timestamp()
                kept = [x for x in kept if now - x < seconds]
                if ok := len(kept) < most:
                    kept.append(now)
                out.append(ok)
            yield pd.DataFrame({"key": key[0], "ts": pdf["ts"].to_numpy(), "accepted": out})
        state.update((kept,))

    return requests.groupBy("key").applyInPandasWithState(run, "key long, ts timestamp, accepted boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def accepted_in_batch(requests: DataFrame, most: int = 120, seconds: int = 60) -> DataFrame:
    """X3's batch twin: the same rule. Requests stream through in the order of key and time; only a window's accepted ones are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, deque()
        for pdf in batches:
            out = []
            for key, t in zip(pdf["key"], pdf["ts"], strict=True):
                if current != (key,):
                    current, kept = (key,), deque()
                now = t.timestamp()
                while kept and now - kept[0] >= seconds:
                    kept.popleft()
                if ok := len(kept) < most:
                    kept.append(now)
                out.append(ok)
            yield pdf[["key", "ts"]].assign(accepted=out)

    return requests.repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, "key long, ts timestamp, accepted boolean")


def scores(events: DataFrame, hours: int = 24) -> DataFrame:
    """Unproven claims of a session in the last day, with the tier that follows."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count = state.get[0] if state.exists else 0
        for pdf in batches:
            count += int((pdf["event_type"] == "error").sum())
        state.update((count,))
        state.setTimeoutDuration(hours * 3_600_000)
        yield pd.DataFrame({"session_id": [key[0]], "score": [count], "tier": ["mandatory" if count >= 5 else "warn" if count >= 3 else "none"]})

    return events.groupBy("session_id").applyInPandasWithState(run, "session_id long, score long, tier string", "count long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def failures(events: DataFrame) -> DataFrame:
    """Stateless capture of failed work."""
    return events.where("event_type = 'error'").select("event_id", "session_id", "ts", F.lit("failure").alias("category"))
