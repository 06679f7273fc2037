"""Table-to-table maintenance of memories: decay, collection, archiving, compression, clean-up. Pure functions of (table, now)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

DAY = 86400.0


def live(df: DataFrame) -> DataFrame:
    """F1."""
    return df.where(F.col("deleted_at").isNull())


def is_free() -> Column:
    return ~F.coalesce(F.col("pinned"), F.lit(False))


def idle_days(now: float) -> Column:
    return (F.lit(now) - F.coalesce("last_accessed_at", "created_at")) / DAY


def decay(df: DataFrame, now: float, floor: float = 0.3, lesson_floor: float = 0.8) -> DataFrame:
    """L1, L2: forgetting curve by time since the last access; lessons fade slower. Rows below a floor rise to it."""
    idle, s, imp = idle_days(now), F.coalesce("strength", F.lit(1.0)), F.coalesce("importance", F.lit(0.5))
    fresh = F.least(s + 0.1, F.lit(5.0))
    other = F.when(idle > 90, F.lit(floor)).when(idle <= 3, fresh).when(idle > 21, F.greatest(s - 0.07 * (1 + (1 - imp)), F.lit(floor))).otherwise(F.col("strength"))
    lesson = F.when(idle > 270, F.lit(lesson_floor)).when(idle <= 3, fresh).when(idle > 60, F.greatest(s - 0.02, F.lit(lesson_floor))).otherwise(F.col("strength"))
    touched = F.col("deleted_at").isNull() & is_free()
    is_lesson = F.coalesce(F.col("memory_type") == "lesson", F.lit(False))
    return df.withColumn("strength", F.when(touched, F.when(is_lesson, lesson).otherwise(other)).otherwise(F.col("strength")))


def collect_garbage(df: DataFrame, now: float, floor: float = 0.3) -> DataFrame:
    """L3: weak, unimportant, long idle rows are soft-deleted; null strength or importance never qualifies."""
    weak = (F.col("strength") <= floor) & (F.col("importance") <= 0.3) & (idle_days(now) > 60)
    kind = F.coalesce(F.col("memory_type") != "lesson", F.lit(True))
    hit = F.col("deleted_at").isNull() & is_free() & kind & F.coalesce(weak, F.lit(False))
    return df.withColumn("deleted_at", F.when(hit, F.lit(now)).otherwise(F.col("deleted_at")))


def purge_eligible(df: DataFrame, now: float, days: float = 30.0) -> DataFrame:
    """L4: purging is disabled; the number of rows it would take."""
    return df.agg(F.count_if(F.col("deleted_at") < now - days * DAY).alias("eligible"))


def archive_weak(df: DataFrame, now: float) -> DataFrame:
    """L5."""
    kind = ~F.coalesce(F.col("memory_type").isin("lesson", "rule"), F.lit(False))
    hit = F.col("deleted_at").isNull() & is_free() & kind & F.coalesce((F.col("strength") < 0.3) & (idle_days(now) > 30), F.lit(False))
    return df.withColumn("deleted_at", F.when(hit, F.lit(now)).otherwise(F.col("deleted_at")))


def compress(df: DataFrame, now: float, age_days: float = 7.0, min_chars: int = 100, most: int | None = 500) -> DataFrame:
    """The oldest long texts become summaries. Columns id, original_text, text (new). Text changes drop the vector."""
    old = (F.col("created_at") < now - age_days * DAY) & (F.length("text") > min_chars) & ~F.col("text").startswith("[compressed]")
    rows = live(df).where(is_free() & old)
    rows = rows.orderBy("created_at", "id").limit(most) if most else rows
    keep = F.when(F.coalesce("importance", F.lit(0.0)) == 0, F.lit(0.5)).otherwise(F.col("importance")) < 0.8
    return rows.where(keep).select("id", F.col("text").alias("original_text"), F.concat(F.lit("[compressed] "), T.summary(F.col("text"))).alias("text"))


def clean_envelopes(df: DataFrame) -> DataFrame:
    """Wrappers removed where that changes the text and leaves more than ten characters; the vector is dropped."""
    clean = T.strip_wrappers(F.col("text"))
    hit = F.col("deleted_at").isNull() & (clean != F.col("text")) & (F.length(clean) > 10)
    return df.withColumns({"text": F.when(hit, clean).otherwise(F.col("text")), "embedding": F.when(~hit, F.col("embedding"))})


def reclassify(df: DataFrame) -> DataFrame:
    """Id, old_type, new_type."""
    return live(df).select("id", F.coalesce("memory_type", F.lit("other")).alias("old_type"), T.memory_type(F.col("text")).alias("new_type"))


def cap_cron(df: DataFrame, cap: float = 0.3) -> DataFrame:
    """L9."""
    return df.withColumn("importance", F.when(T.any_match(F.col("text"), P.CRON, "(?i)") & (F.col("importance") > cap), F.lit(cap)).otherwise(F.col("importance")))


def escalate(df: DataFrame, least: int = 3) -> DataFrame:
    """Tags that at least `least` lessons share, with the start of their first three texts."""
    lessons = live(df).where("memory_type = 'lesson'").select("id", "created_at", F.col("text"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[tag=([^\]]+)\]"), F.lit(1)))).alias("tag"))
    place = W.partitionBy("tag").orderBy("created_at", "id")
    first = lessons.withColumn("r", F.row_number().over(place)).withColumn("n", F.count("*").over(W.partitionBy("tag")))
    first = first.where((F.col("r") <= 3) & (F.col("n") >= least))
    parts = F.array_sort(F.collect_list(F.struct("r", F.substring("text", 1, 80).alias("t"))))
    return first.groupBy("tag").agg(F.first("n").alias("lessons"), F.array_join(F.transform(parts, lambda x: x["t"]), " | ").alias("rule"))


def boost(df: DataFrame, hits: DataFrame, now: float) -> DataFrame:
    """Retrieved rows (hits: id) gain strength and are touched."""
    found = hits.select("id").distinct().withColumn("_hit", F.lit(True))
    out = df.join(found, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return out.withColumns({"strength": F.when(hit, F.least(F.coalesce("strength", F.lit(1.0)) + 0.3, F.lit(5.0))).otherwise(F.col("strength")), "last_accessed_at": F.when(hit, F.lit(now)).otherwise(F.col("last_accessed_at"))}).drop("_hit")


def upsert(base: DataFrame, updates: DataFrame, key: str | tuple[str, ...] = "id") -> DataFrame:
    """Updates replace base rows of their key; of several updates of a key the last by updated_at, of equal ones the greatest text."""
    keys = [key] if isinstance(key, str) else list(key)
    ties = [F.desc("text")] if "text" in updates.columns else []
    last = W.partitionBy(*keys).orderBy(F.desc("updated_at"), *ties)
    fresh = updates.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    return base.join(fresh, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def patch(base: DataFrame, updates: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Non-null values of the updates (one row a key) replace the base's."""
    new = updates.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = base.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def forget(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Hard delete."""
    return base.join(ids.select("id"), "id", "left_anti")


def pin(df: DataFrame, ids: list[str], value: bool = True) -> DataFrame:
    """W6."""
    return df.withColumn("pinned", F.when(F.col("id").isin(ids) & F.col("deleted_at").isNull(), F.lit(value)).otherwise(F.col("pinned")))
