"""Counts, dashboards, audits and metrics over memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

DAY = 86400.0
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def type_of() -> Column:
    return F.coalesce("memory_type", F.lit("other"))


def has_envelope_noise() -> Column:
    """F9."""
    marks = ["%Conversation info (untrusted metadata)%", "%[Subagent Context]%", "%[System Message]%", "%ignore all previous%"]
    out = F.lit(False)
    for m in marks:
        out = out | F.ilike(F.col("text"), F.lit(m))
    return out


def counts_by(df: DataFrame, **keys: Column) -> DataFrame:
    """Rows by key."""
    return df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.count("*").alias("n"))


def dashboard(df: DataFrame, now: float) -> DataFrame:
    """A4, A5: a row an agent."""
    recent = F.col("created_at") >= now - 7 * DAY
    return df.where("deleted_at IS NULL").groupBy("agent").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("source") == "hook").alias("hook"),
        F.count_if(F.col("source") == "api").alias("api"),
        F.count_if((F.col("source") == "hook") & recent).alias("hook_7d"),
        F.count_if((F.col("source") == "api") & recent).alias("api_7d"),
        F.count_if(F.col("memory_type") == "lesson").alias("lessons"),
        F.count_if(F.col("category") == "decision").alias("decisions"),
    )


def health(df: DataFrame, now: float) -> DataFrame:
    """One row: shares, strength of lessons, rows without vector, noise."""
    recent = F.col("created_at") >= now - 7 * DAY
    hook, api = F.count_if((F.col("source") == "hook") & recent), F.count_if((F.col("source") == "api") & recent)
    share = F.round(F.coalesce(F.try_divide(100.0 * hook, hook + api), F.lit(0.0)), 1)
    return df.where("deleted_at IS NULL").agg(
        F.count("*").alias("total"),
        share.alias("hook_pct"),
        F.round(F.avg(F.when(F.col("memory_type") == "lesson", F.col("strength"))), 2).alias("lesson_strength"),
        F.count_if(F.col("embedding").isNull()).alias("vectorless"),
        F.count_if(has_envelope_noise()).alias("noise"),
    )


def lesson_metrics(df: DataFrame, now: float) -> DataFrame:
    """Lessons by state, deleted ones included."""
    status = F.coalesce("lesson_status", F.lit("active"))
    return df.where("memory_type = 'lesson'").agg(
        F.count("*").alias("total"),
        F.count_if(status == "active").alias("active"),
        F.count_if(status == "resolved").alias("resolved"),
        F.count_if(F.col("created_at") >= now - 7 * DAY).alias("recent_7d"),
        F.round(F.avg("importance"), 3).alias("avg_importance"),
    )


def lesson_tags(df: DataFrame, most: int = 20) -> DataFrame:
    """The commonest categories of lessons."""
    return df.where("memory_type = 'lesson'").groupBy(F.coalesce("category", F.lit("untagged")).alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def rollup_agents(df: DataFrame) -> DataFrame:
    """Totals by agent and over all (agent null)."""
    return df.rollup("agent").agg(F.count("*").alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.sum("importance").alias("importance")).withColumn("importance", F.round("importance", 4))


def audit(df: DataFrame) -> DataFrame:
    """A10: one row of quality counts."""
    kind = F.col("memory_type")
    live = df.where("deleted_at IS NULL")
    duplicates = live.groupBy("text").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_groups"))
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("deleted_at").isNull()).alias("scoped"),
        F.count_if(F.col("deleted_at").isNull() & (T.trimmed(F.col("text")) == "")).alias("blank"),
        F.count_if(F.col("deleted_at").isNull() & F.col("embedding").isNull()).alias("vectorless"),
        F.count_if(F.col("deleted_at").isNull() & kind.isNotNull() & ~kind.isin(P.MEMORY_TYPES)).alias("invalid_type"),
        F.count_if(F.col("deleted_at").isNull() & F.col("namespace").isNull()).alias("null_namespace"),
        F.count_if(F.col("deleted_at").isNull() & (F.length("text") > 8000)).alias("long_text"),
        F.count_if(F.col("deleted_at").isNull() & (F.length("text") < 20)).alias("short_text"),
    )
    return counts.join(F.broadcast(duplicates))  # one row each


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Texts that more than one live row has."""
    return df.where("deleted_at IS NULL").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("n").alias("first")).where("copies > 1")


def secret_tally(df: DataFrame) -> DataFrame:
    """Per secret pattern, matches and rows."""
    each = [F.struct(F.lit(i).alias("pattern"), F.regexp_count("text", F.lit(e)).alias("hits")) for i, (e, _) in enumerate(P.SECRETS)]
    rows = df.where("deleted_at IS NULL").select(F.explode(F.array(*each)).alias("x"))
    return rows.groupBy("x.pattern").agg(F.sum("x.hits").cast("long").alias("hits"), F.count_if(F.col("x.hits") > 0).alias("row_count"))


def secret_samples(df: DataFrame, most: int = 20) -> DataFrame:
    """Hashed ids of rows with secrets."""
    return df.where("deleted_at IS NULL").where(T.secret_count(F.col("text")) > 0).select(F.substring(F.sha2("id", 256), 1, 16).alias("hashed")).orderBy("hashed").limit(most)


def transitions(df: DataFrame) -> DataFrame:
    """old_type, new_type, n of reclassified rows."""
    return df.groupBy("old_type", "new_type").agg(F.count("*").alias("n"))


def role_totals(messages: DataFrame) -> DataFrame:
    """Messages, characters and estimated tokens by role."""
    return messages.groupBy("role").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


def latency_histogram(requests: DataFrame, *keys: str) -> DataFrame:
    """Cumulative buckets (count of durations up to the bound), sum and count."""
    buckets = [F.count_if(F.col("duration") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BUCKETS]
    return requests.groupBy(*keys).agg(*buckets, F.round(F.sum("duration"), 4).alias("total"), F.count("*").alias("n"))


def exposition(histogram: DataFrame, metric: str = "request_seconds") -> DataFrame:
    """One text line a bucket, in order."""
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(str(b)).alias("le"), F.col(f"le_{str(b).replace('.', '_')}").alias("v")) for i, b in enumerate(BUCKETS)))
    rows = histogram.select("event_type", F.explode(each).alias("x"))
    return rows.select("event_type", F.col("x.i").alias("i"), F.format_string(metric + '_bucket{type="%s",le="%s"} %d', "event_type", "x.le", "x.v").alias("line"))


def rates(df: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """Ratios of sums, two digits, zero where the whole is zero."""
    return df.agg(*(F.round(F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b)), F.lit(0.0)), 2).alias(k) for k, (a, b) in pairs.items()))


def incident_rollup(incidents: DataFrame, now: float, most: int = 100, days: float = 7) -> DataFrame:
    """session_id, part (all, type, root cause), value, total, recent: each session's last `most` incidents and those of the last `days`, in one pass.

    incidents: session_id, incident_id, ts (seconds), type, root_cause. A missing type or root cause has the value null.
    """
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("incident_id")))
    last = incidents.withColumn("_back", back).where(F.col("_back") <= most)
    sets = last.groupingSets([["session_id"], ["session_id", "type"], ["session_id", "root_cause"]], "session_id", "type", "root_cause")
    part = F.when(F.grouping("type") + F.grouping("root_cause") == 2, "all").when(F.grouping("type") == 0, "type").otherwise("root cause")
    rolled = sets.agg(part.alias("part"), F.count("*").alias("total"), F.count_if(F.lit(now) - F.col("ts") < days * 86400).alias("recent"))
    return rolled.select("session_id", "part", F.when(F.col("part") == "type", F.col("type")).when(F.col("part") == "root cause", F.col("root_cause")).alias("value"), "total", "recent")
