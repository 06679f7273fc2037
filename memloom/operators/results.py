"""Search results kept as a keyed table (H9, X12) and refreshed by a second pass (H6).

stored: key, agent, version, pass, stored_at, expires_at, hits (array of rank, id, score). An entry holds for an hour, and only while
its agent's memories are at the version at which it was made; whoever writes memories raises the version, which is how a
cache is invalidated here: no entry has to be found or deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .requests import cache_key
from .retrieval import RRF_K, top

SCHEMA = "key string, agent string, version long, pass int, stored_at double, expires_at double, hits array<struct<rank: int, id: string, score: double>>"
TTL = 3600.0


def result_key(query: Column, agent: Column, limit: Column, min_score: Column, namespace: Column, memory_type: Column) -> Column:
    """T23 with the agent, the number of results and the least score."""
    return F.concat_ws("|", agent, cache_key(query, namespace, memory_type), limit.cast("string"), F.format_string("%.4f", min_score.cast("double")))


def valid(stored: DataFrame, versions: DataFrame, now: float) -> DataFrame:
    """Entries that have neither run out nor been made from earlier memories. versions: agent, version."""
    return stored.where(F.col("expires_at") > now).join(versions.select("agent", "version"), ["agent", "version"], "left_semi")


def look_up(asked: DataFrame, stored: DataFrame, versions: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Results of the queries that have an entry (query_id, pass, rank, id, score), and the queries that have none. asked: query_id, key, agent."""
    known = valid(stored, versions, now).select("key", "pass", "hits")
    found = asked.join(known, "key").select("query_id", "pass", F.inline("hits"))
    return found, asked.join(known.select("key"), "key", "left_anti")


def store(stored: DataFrame, found: DataFrame, asked: DataFrame, versions: DataFrame, now: float, number: int = 1, ttl: float = TTL) -> DataFrame:
    """The table with the results of a pass (query_id, rank, id, score) in place of what their keys had; entries that have run out go.

    Queries that share a key share an entry (that of the smallest query_id); a query without results is stored with none.
    """
    one = asked.groupBy("key").agg(F.min_by(F.struct("query_id", "agent"), "query_id").alias("q")).select("key", "q.query_id", "q.agent")
    hits = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "id", "score"))).alias("hits"))  # a query's bounded results
    empty = F.array().cast("array<struct<rank: int, id: string, score: double>>")
    new = one.join(hits, "query_id", "left").join(versions.select("agent", "version"), "agent")
    new = new.select("key", "agent", "version", F.lit(number).alias("pass"), F.lit(now).alias("stored_at"), F.lit(now + ttl).alias("expires_at"), F.coalesce("hits", empty).alias("hits"))
    return stored.where(F.col("expires_at") > now).join(new.select("key"), "key", "left_anti").unionByName(new)


def second_pass(results: DataFrame, weight: float = 0.35, top_k: int = 10, limit: int = 10) -> DataFrame:
    """H6: query_id, id, score, rank: the first `top_k` results ranked anew by another score and fused with the first order.

    results: query_id, id, rank and either second_score or q and text (then the share of the query's words ranks). Queries with
    fewer than two results keep theirs. Results without a second score keep the weight of their first rank only.
    """
    second = F.col("second_score") if "second_score" in results.columns else T.lexical_overlap(F.col("q"), F.col("text"))
    query = W.partitionBy("query_id")
    rows = results.where(F.col("rank") <= F.lit(max(limit, top_k))).withColumn("_s", F.when(F.col("rank") <= top_k, second))
    rows = rows.withColumn("_r", F.row_number().over(query.orderBy(F.desc_nulls_last("_s"), "rank")))
    fused = (1 - weight) / (RRF_K + F.col("rank")) + F.when(F.col("_s").isNotNull(), weight / (RRF_K + F.col("_r"))).otherwise(F.lit(0.0))
    rows = rows.select("query_id", "id", F.round(fused, 8).alias("score"), F.col("rank").alias("_first"))
    return top(rows, limit, F.desc("score"), F.asc("_first")).drop("_first")
