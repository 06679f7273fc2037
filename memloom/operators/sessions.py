"""Session transcripts: flattening, filtering, gaps, chunks, claims against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import routing as RT
from ..functions import text as T

CHUNK_CHARS, ANSWER_CHARS = 4000, 3000


def flatten_content(content: Column) -> Column:
    """Plain string, or the text blocks of a JSON list joined by newlines."""
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return T.trimmed(F.when(content.rlike(r"^\s*\["), F.coalesce(F.array_join(texts, "\n"), content)).otherwise(content))


def is_tool_call(role: Column, text: Column, content: Column) -> Column:
    """Tool output is skipped unless it matters; messages with tool blocks are skipped."""
    output = role.isin("tool", "function") & ~T.any_match(text, P.IMPORTANT_TOOL_OUTPUT, "(?i)")
    blocks = F.from_json(content, "array<struct<type: string>>")
    used = F.coalesce(F.exists(blocks, lambda b: b["type"].isin("tool_use", "tool_result")), F.lit(False))
    return F.coalesce(output, F.lit(False)) | (content.rlike(r"^\s*\[") & used & ~F.coalesce(role.isin("tool", "function"), F.lit(False)))


def islands(messages: DataFrame, gap_hours: float = 4.0) -> DataFrame:
    """Kept messages with `island`, the number of gaps above the limit so far."""
    order = W.partitionBy("session_id").orderBy("seq")
    kept = messages.where(~T.should_skip(F.col("text"), F.col("role")))
    gap = F.when(F.col("ts") - F.lag("ts").over(order) > gap_hours * 3600, 1).otherwise(0)
    return kept.withColumn("_gap", gap).withColumn("island", F.sum("_gap").over(order)).drop("_gap")


def chunks(messages: DataFrame, gap_hours: float = 4.0) -> DataFrame:
    """Question and answer pairs, lone questions, lone answers above 20 characters; id is T26."""
    order = W.partitionBy("session_id", "island").orderBy("seq")
    talk = islands(messages, gap_hours).where(F.col("role").isin("user", "assistant"))
    rows = talk.withColumns({"next_role": F.lead("role").over(order), "next_text": F.lead("text").over(order), "last_role": F.lag("role").over(order)})
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    paired = asks & F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    lone = answers & ~F.coalesce(F.col("last_role") == "user", F.lit(False)) & (F.length("text") > 20)
    pair = F.concat(F.lit("User: "), F.substring("text", 1, CHUNK_CHARS), F.lit("\nAssistant: "), F.substring("next_text", 1, ANSWER_CHARS))
    text = F.substring(F.when(paired, pair).otherwise(F.col("text")), 1, CHUNK_CHARS)
    kind = F.when(paired, "qa_pair").otherwise(F.col("role"))
    out = rows.where(asks | lone).select("session_id", "seq", "island", "ts", kind.alias("role"), text.alias("text"))
    return out.withColumn("id", T.chunk_id(F.col("text")))


def first_of_each(chunked: DataFrame) -> DataFrame:
    """V6: the first chunk of each id."""
    first = W.partitionBy("id").orderBy("ts", "session_id", "seq")
    return chunked.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def not_stored(chunked: DataFrame, stored: DataFrame) -> DataFrame:
    """J6."""
    return chunked.join(stored.select("id"), "id", "left_anti")


def to_memories(chunked: DataFrame) -> DataFrame:
    """Capture: normalised chunk with type, importance and category; low-signal ones go."""
    clean = chunked.withColumn("text", T.normalize(F.col("text"))).where(~T.is_low_signal(F.col("text")))
    kind = F.when(T.rule_confidence(F.col("text")).isNotNull() | T.has_safeword(F.col("text")), F.lit("rule")).otherwise(T.memory_type(F.col("text")))
    return clean.select("id", "session_id", "ts", F.col("role").alias("category"), "text", kind.alias("memory_type"), F.round(T.importance(F.col("text"), F.col("role")), 4).alias("importance"))


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n user and assistant messages of each session, commands dropped."""
    talk = messages.where(F.col("role").isin("user", "assistant") & ~F.col("text").startswith("/"))
    return talk.withColumn("back", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))).where(F.col("back") <= n)


def unproven(claims: DataFrame, calls: DataFrame, seconds: int) -> DataFrame:
    """Claims without a proving call in the same session within the window before them; claim ids are unique.

    claims: session_id, claim_id, ts, tools (array), keywords (array). calls: session_id, tool, command, ts.
    """
    # A window touches two stretches of its length at most, so a busy session is dealt by time, not held as one key.
    stretch = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / (seconds * 1_000_000))
    c = claims.withColumn("_s", F.explode(F.array(stretch("ts"), stretch("ts") - 1))).alias("c")
    x = calls.select("session_id", "tool", "command", "ts").withColumn("_s", stretch("ts")).alias("x")
    near = (F.col("x.ts") <= F.col("c.ts")) & (F.col("x.ts") >= F.col("c.ts") - F.make_dt_interval(secs=F.lit(seconds)))
    tool = F.array_contains("c.tools", F.col("x.tool"))
    key = (F.size("c.keywords") == 0) | F.exists("c.keywords", lambda k: F.contains(F.col("x.command"), k))
    same = (F.col("c.session_id") == F.col("x.session_id")) & (F.col("c._s") == F.col("x._s"))
    proven = c.join(x, same & near & tool & key, "left_semi").select("claim_id").distinct()
    return claims.join(proven, "claim_id", "left_anti").select(*claims.columns)


def recent_calls(calls: DataFrame, seconds: int = 300, most: int = 20) -> DataFrame:
    """X5 in batch: for each call, how many calls its session made in the window before it (at most the last `most` count)."""
    span = W.partitionBy("session_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return calls.select("event_id", "session_id", F.least(F.count("*").over(span), F.lit(most)).alias("recent"))


def prior_flag(messages: DataFrame, flag: Column) -> DataFrame:
    """Whether an earlier message of the session had the flag."""
    before = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return messages.withColumn("before", F.coalesce(F.max(flag).over(before), F.lit(False)))


def prefix_dedup(df: DataFrame, chars: int = 120) -> DataFrame:
    """V7: the first row of each text prefix."""
    first = W.partitionBy(F.substring("text", 1, chars)).orderBy("created_at", "id")
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def contained_dedup(df: DataFrame, most: int = 5, pool: int = 20, by: str = "agent", stripped: bool = False) -> DataFrame:
    """V8: per group, of its `pool` best rows greedily the best texts of which none contains another.

    stripped: texts are compared without their envelopes and low-signal lines, and those that then are of low signal go.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        texts = pdf.sort_values(["importance", "created_at", "id"], ascending=[False, False, True]).reset_index(drop=True)
        for i, t in enumerate(texts["text"]):
            if len(kept) < most and t and not any(t in texts.at[k, "text"] or texts.at[k, "text"] in t for k in kept):
                kept.append(i)
        out = texts.loc[kept, [by, "id"]].copy()
        out["place"] = range(1, len(kept) + 1)
        return out

    best = W.partitionBy(by).orderBy(F.desc("importance"), F.desc("created_at"), "id")
    rows = df.select(by, "id", "text", "importance", "created_at").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= pool).drop("_r")
    if stripped:
        rows = rows.withColumn("text", RT.without_low_signal(F.col("text"))).where(~RT.is_low_signal_recall(F.col("text")))
    return rows.groupBy(by).applyInPandas(run, f"{by} string, id string, place int")


def expired(df: DataFrame, now: float, expires: str, modified: str, days: float) -> DataFrame:
    """Rows past their expiry, or where that is null `days` after their change."""
    return df.where(F.coalesce(F.col(expires), F.col(modified) + days * 86400) < now)


def kept_facts(facts: DataFrame, now: float, most: int = 200, ttl: float = 7 * 86400, drop_days: float = 30, by: str = "agent") -> DataFrame:
    """Verified facts (`by`, key, verified_at, ttl in seconds) that stay: not beyond `drop_days`, the newest `most` of each workspace; adds `stale`, past the fact's own time."""
    young = facts.where(F.col("verified_at") >= now - drop_days * 86400)
    newest = young.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("verified_at"), "key"))).where(F.col("_r") <= most).drop("_r")
    return newest.withColumn("stale", F.lit(now) - F.col("verified_at") > F.coalesce("ttl", F.lit(ttl)))


def open_tasks(tasks: DataFrame, now: float, hours: float = 6.0, most: int = 5) -> DataFrame:
    """Tasks (agent, title, created_at, status) that are open: no repeat of a title within two hours, not expired, the last `most` of an agent."""
    ties = ["id"] if "id" in tasks.columns else []
    same = W.partitionBy("agent", "title").orderBy("created_at", *ties)
    fresh = tasks.withColumn("_before", F.lag("created_at").over(same)).where("_before IS NULL OR created_at - _before > 7200")
    live = fresh.where((F.col("status") == "open") & (F.col("created_at") >= now - hours * 3600)).drop("_before")
    return live.withColumn("_r", F.row_number().over(W.partitionBy("agent").orderBy(F.desc("created_at"), "title", *ties))).where(F.col("_r") <= most).drop("_r")
