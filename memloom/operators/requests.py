"""What requests may ask: validation rules, agent scope, capture limits, cache keys, paging, forgetting by a hit, audit, verification flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval as R

# Formats and limits.
NAMESPACE = r"^[a-z0-9._-]{1,64}$"
AGENT = r"^[a-z0-9_-]{1,64}$"
AGENT_ID = r"^[a-z0-9][a-z0-9_-]{0,63}$"
LIMITS = {"limit": (1, 50), "min_score": (0.0, 1.0), "max_tokens": (100, 100_000), "importance": (0.0, 1.0)}
QUERY_CHARS, TEXT_CHARS, MESSAGES, KEPT_CHARS = 2000, 50_000, 200, 4000


def violations(namespace: Column, agent: Column, query: Column, **numbers: Column) -> Column:
    """names of the rules that a request breaks. Null and empty names pass; `all` is an agent here; null numbers pass."""
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    rules = [
        (named(namespace) & ~namespace.rlike(NAMESPACE), "namespace"),
        (named(agent) & (agent != "all") & ~agent.rlike(AGENT), "agent"),
        (~F.coalesce(F.length(query), F.lit(0)).between(1, QUERY_CHARS), "query"),
        *((~value.between(*LIMITS[name]), name) for name, value in numbers.items()),
    ]
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for broken, name in rules)))


def agent_key(agent: Column) -> Column:
    """the agent's key: main for none, else its trimmed lower-case name; null for `all` and for names that are none."""
    name = F.lower(T.trimmed(agent))
    key = F.when((F.coalesce(agent, F.lit("")) == "") | (agent == "main"), F.lit("main")).otherwise(name)
    return F.when((key != "all") & key.rlike(AGENT_ID), key)


def permitted(allowed: Column, agent: Column) -> Column:
    """whether a key for one agent (null: for all) may ask for this agent."""
    return allowed.isNull() | ((F.coalesce(agent, F.lit("")) != "all") & F.coalesce(agent_key(allowed) == agent_key(agent), F.lit(False)))


def visible(rows: DataFrame, allowed: str | None) -> DataFrame:
    """the rows that a key for one agent may see."""
    return rows if allowed is None else rows.where(F.col("agent") == agent_key(F.lit(allowed)))


def captured(messages: DataFrame) -> DataFrame:
    """The messages of a batch that are kept: the first 200, none above 50,000 characters, text or else content, wrappers stripped,
    injections defanged, low signal dropped, cut to 4,000 characters. messages: batch, seq, role, text, content."""
    order = W.partitionBy("batch").orderBy("seq")
    text = F.coalesce(F.nullif("text", F.lit("")), F.col("content"), F.lit(""))
    rows = messages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MESSAGES).drop("_n").withColumn("text", text).where(F.length("text") <= TEXT_CHARS)
    rows = rows.withColumn("text", T.trimmed(F.col("text"))).where(F.length("text") >= 3).withColumn("text", T.normalize(F.col("text")))
    return rows.where(~T.is_low_signal(F.col("text"))).select("batch", "seq", F.coalesce("role", F.lit("user")).alias("role"), F.substring("text", 1, KEPT_CHARS).alias("text"))


def cache_key(query: Column, namespace: Column, memory_type: Column) -> Column:
    """The normalised query with the filters that apply."""
    some = lambda c, tag: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(tag), c))
    return F.concat_ws(" | ", T.normalize_query(query), some(namespace, "ns:"), some(memory_type, "mt:"))


def forget_by_query(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """The memories without the first keyword hit of each query (query_id, q)."""
    found = R.bm25(R.searchable(memories), queries, 1).select("id").distinct()
    return memories.join(found, "id", "left_anti")


def page(rows: DataFrame, size: int, after: tuple[float, str] | None = None, without: DataFrame | None = None) -> DataFrame:
    """The next `size` rows, newest first, behind the row (created_at, id) and without some ids. A key, not an offset: nothing is read twice."""
    if after is not None:
        created_at, id = after
        rows = rows.where((F.col("created_at") < created_at) | ((F.col("created_at") == created_at) & (F.col("id") > id)))
    if without is not None:
        rows = rows.join(without.select("id"), "id", "left_anti")
    return rows.orderBy(F.desc("created_at"), "id").limit(size)


def audit_lines(requests: DataFrame) -> DataFrame:
    """request_id, line. requests: request_id, method, path, status, client, agent, seconds."""
    text = lambda c, empty: F.coalesce(F.col(c), F.lit(empty))
    line = F.format_string("method=%s path=%s status=%d ip=%s agent=%s elapsed_ms=%.1f", "method", "path", "status", text("client", "unknown"), text("agent", "-"), F.round(F.col("seconds") * 1000, 1))
    return requests.select("request_id", line.alias("line"))


def verification_pending(events: DataFrame) -> DataFrame:
    """session_id, pending, set_at: the last word on a session, set by an unproven claim and cleared by a proof. events: session_id, ts, event_id, kind (claim, proof)."""
    last = F.max_by(F.struct("kind", "ts"), F.struct("ts", "event_id"))
    state = events.where(F.col("kind").isin("claim", "proof")).groupBy("session_id").agg(last.alias("s"))
    return state.select("session_id", (F.col("s.kind") == "claim").alias("pending"), F.when(F.col("s.kind") == "claim", F.col("s.ts")).alias("set_at"))
