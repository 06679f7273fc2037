"""Sinks: partitioned tables, JSON and text exports, idempotent batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tasks that an agent's rows are dealt to, so that no agent is one task.
SPLITS = 8


def write_memories(df: DataFrame, path: str, mode: str = "append") -> None:
    """One atomic job; agents are folders of up to SPLITS files, types lie together for row-group skipping."""
    df.repartition("agent", F.pmod(F.xxhash64("id"), F.lit(SPLITS))).sortWithinPartitions("memory_type", "created_at").write.mode(mode).partitionBy("agent").parquet(path)


#: The columns of an export and their types.
EXPORT = {
    "id": "string", "text": "string", "category": "string", "importance": "double", "strength": "double", "source_session": "string", "namespace": "string", "memory_type": "string",
    "created_at": "double", "updated_at": "double", "last_accessed_at": "double", "deleted_at": "double", "pinned": "boolean", "source": "string", "trust_level": "string",
    "lesson_status": "string", "lesson_scope": "string", "resolved_at": "double",
}


def export_rows(df: DataFrame, with_deleted: bool = False) -> DataFrame:
    """F16: the columns of an export, importance rounded; columns that the frame lacks are null."""
    rows = df if with_deleted else df.where("deleted_at IS NULL")
    column = lambda c, t: F.round(c, 4).alias(c) if c == "importance" else F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)
    return rows.select(*(column(c, t) for c, t in EXPORT.items()))


def export_json(df: DataFrame, path: str, with_deleted: bool = False) -> None:
    """JSON lines ordered by creation."""
    rows = df if with_deleted else df.where("deleted_at IS NULL")
    rows.drop("embedding").orderBy("created_at", "id").write.mode("overwrite").json(path)


def copy_shard(source: DataFrame, target: DataFrame, agent: str, tag: str) -> DataFrame:
    """The source's rows of an agent that the target lacks, tagged; columns the source lacks are null."""
    rows = source.where(F.col("agent") == agent).join(target.select("id"), "id", "left_anti")
    tagged = rows.withColumn("source_session", F.concat_ws("|", F.lit(tag), F.col("source_session") if "source_session" in rows.columns else F.lit(None)))
    return target.limit(0).unionByName(tagged, allowMissingColumns=True)


def transcript_text(messages: DataFrame) -> DataFrame:
    """A text a session, messages in order."""
    line = F.format_string("%s: %s", "role", "text")
    parts = F.array_sort(F.collect_list(F.struct("seq", line.alias("l"))))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["l"]), "\n").alias("text"))


def highlights(rows: DataFrame, entities: DataFrame, now: float, days: int = 90, least_importance: float = 0.6, least_strength: float = 0.5) -> DataFrame:
    """Section, place, line: the best 200 memories of the days (at most 50 a category), then the 50 most mentioned entities. Halves round up."""
    strength = F.coalesce("strength", F.lit(1.0))
    top = rows.where(F.col("deleted_at").isNull() & (F.col("created_at") > now - days * 86400) & (F.col("importance") >= least_importance) & (strength >= least_strength))
    top = top.orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(200)
    place = F.row_number().over(W.partitionBy("section").orderBy(F.desc("importance"), F.desc("created_at"), "id"))
    flat = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    short = F.when(F.length(flat) > 300, F.concat(F.substring(flat, 1, 297), F.lit("..."))).otherwise(flat)
    when = F.date_format(F.timestamp_seconds("created_at"), "MM/dd HH:mm")
    line = F.format_string("- **[%s]** (imp:%.2f str:%.1f) %s", when, F.floor(F.col("importance") * 100 + 0.5) / 100, F.floor(strength * 10 + 0.5) / 10, short)
    memories = top.withColumn("section", F.coalesce("category", F.lit("other"))).withColumn("place", place).where("place <= 50").select("section", "place", line.alias("line"))
    best = entities.orderBy(F.desc("mentions"), "label", "key").limit(50).withColumn("place", F.row_number().over(W.orderBy(F.desc("mentions"), "label", "key")))
    named = best.select(F.lit("Key Entities").alias("section"), "place", F.format_string("- **%s** [%s] — %d mentions", "key", "label", "mentions").alias("line"))
    return memories.unionByName(named)


def workspace_export(rows: DataFrame, entities: DataFrame, now: float) -> DataFrame:
    """Part, place, id, line: the 100 most valued live memories, the 30 latest user messages of the week not among them, the 50 entities mentioned more than five times."""
    live = rows.where("deleted_at IS NULL")
    order = [F.desc("importance"), F.desc("strength"), F.asc("id")]
    top = live.where((F.col("importance") > 0.7) | (F.coalesce("strength", F.lit(1.0)) > 2)).orderBy(*order).limit(100)
    top = top.withColumn("place", F.row_number().over(W.orderBy(*order))).select("place", "id", "text")  # 100 rows
    user = live.where((F.col("category") == "user") & (F.col("created_at") > now - 7 * 86400)).orderBy(F.desc("created_at"), "id").limit(30)
    user = user.withColumn("place", F.row_number().over(W.orderBy(F.desc("created_at"), "id"))).select("place", "id", "text").join(top.select("id"), "id", "left_anti")
    known = entities.where("mentions > 5").orderBy(F.desc("mentions"), "label", "key").limit(50).withColumn("place", F.row_number().over(W.orderBy(F.desc("mentions"), "label", "key")))
    line = lambda n: F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, n).alias("line")
    parts = top.select(F.lit("top").alias("part"), "place", "id", line(400)).unionByName(user.select(F.lit("user").alias("part"), "place", "id", line(250))).where("line <> ''")
    return parts.unionByName(known.select(F.lit("entity").alias("part"), "place", F.concat("label", F.lit(":"), "key").alias("id"), F.col("mentions").cast("string").alias("line")))


def append_batches(path: str):
    """For foreachBatch: a batch is written once, to a folder of its own number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
