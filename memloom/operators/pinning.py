"""Compositions over retrieval results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hooks as H
from ..session import written
from . import postings as PO
from . import retrieval as R
from .lifecycle import is_free


def pin_critical(memories: DataFrame, hits: DataFrame, least_importance: float = 0.7, most: int = 10) -> DataFrame:
    """Important rows among the first results of any query become pinned. hits: id, rank."""
    found = hits.where(F.col("rank") <= most).select("id").distinct().withColumn("_hit", F.lit(True))
    rows = memories.join(found, "id", "left")
    pinned = F.coalesce("_hit", F.lit(False)) & (F.col("importance") >= least_importance) & F.col("deleted_at").isNull() & is_free()
    return rows.withColumn("pinned", F.when(pinned, F.lit(True)).otherwise(F.col("pinned"))).drop("_hit")


def sections(results: DataFrame, order: list[str], most_chars: int = 20_000) -> DataFrame:
    """Results (query_id, section, rank, text) in the order of the sections, once a text start, until the first that overflows the budget."""
    place = F.coalesce(*[F.when(F.col("section") == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    rows = results.withColumn("_place", place)
    first = W.partitionBy("query_id", F.substring("text", 1, 120)).orderBy("_place", "rank")
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    run = W.partitionBy("query_id").orderBy("_place", "rank", "text").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("chars", F.sum(F.length("text")).over(run)).where(F.col("chars") <= most_chars).drop("_place")


def before_compaction(messages: DataFrame, most: int = 30, recent: int = 60, chars: int = 2000) -> DataFrame:
    """The best `most` of each session's last `recent` messages of user and assistant by compaction score, the earlier of equals first."""
    last = messages.withColumn("_back", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))).where(F.col("_back") <= recent)
    scored = last.where(F.col("role").isin("user", "assistant")).withColumn("score", H.compaction_score(F.col("text"))).where("score > 0")
    best = W.partitionBy("session_id").orderBy(F.desc("score"), "seq")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("session_id", "seq", "role", F.substring("text", 1, chars).alias("text"), "score", "place")


def verified_facts_for(questions: DataFrame, facts: DataFrame, most: int = 2) -> DataFrame:
    """query_id, key, hits: the verified facts (key, claim, stale) that hold most of a question's keywords (query_id, keywords)."""
    rows = facts.where(~F.col("stale")).select(F.col("key").alias("id"), F.lower(F.concat_ws(" ", "key", F.coalesce("claim", F.lit("")))).alias("text"))
    words = questions.select("query_id", F.explode(F.array_distinct("keywords")).alias("term"))
    hits = words.join(PO.containing(rows, words).select("term", F.col("id").alias("key")), "term").groupBy("query_id", "key").agg(F.count("*").alias("hits"))
    return R.top(hits.select("query_id", "key", "hits"), most, F.desc("hits"), F.asc("key"), name="place")


def message_recall(messages: DataFrame, memories: DataFrame, now: float, most: int = 3, lesson_score: float = 0.20, general_score: float = 0.25) -> DataFrame:
    """query_id, place, part, id: what a question in mid-conversation brings up: its lessons, then other memories, `most` in all.

    messages: query_id, text. Only questions are searched, by up to five keywords; the two searches have their own least scores.
    """
    asked = messages.where(H.is_question(F.col("text"))).select("query_id", F.array_join(H.keywords(F.col("text")), " ").alias("q"), F.lit(None).cast("array<float>").alias("vector")).where("q <> ''")
    asked = written(asked, "asked")
    lessons = R.search(memories, asked, now, most, lesson_score, memory_type="lesson").select("query_id", F.lit(0).alias("part"), "id", "rank")
    general = R.search(memories, asked, now, most, general_score).select("query_id", F.lit(1).alias("part"), "id", "rank")
    place = W.partitionBy("query_id").orderBy("part", "rank")
    return lessons.unionByName(general).withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select("query_id", "place", F.when(F.col("part") == 0, "lesson").otherwise("general").alias("part"), "id")
