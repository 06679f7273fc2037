"""What a session starts with (H13): tiers of recall with fall-backs, a budget for each section, for all contexts in one plan.

contexts: context_id, agent, namespace, shared (array of namespaces whose memories the workspace may see).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import routing as RT
from ..session import written
from . import retrieval as R
from . import sessions as S

# What is asked for, how many results, and the budgets in characters.
RECENT = ["recent decisions and configuration changes", "last conversation summary and active work", "credential updates, config file changes, environment variable modifications"]
DECISIONS, LESSONS, SHARED = "recent decisions, architectural choices, configuration changes", "behavioral lessons", "shared operational context and reusable decisions"
MAIN = "recent decisions and context for tasks"
EVENTS = [("config credential update config_change", 5), ("incident failure crash operational_event", 3), ("deploy release deployment", 3)]
LESSON_CHARS, MEMORY_CHARS, SHARED_CHARS = 3000, 8000, 2000
#: Memories of the session's own namespace that suffice, and memories below which the main agent's are added.
ENOUGH, FEW = 6, 5

Recall = Callable[[DataFrame, DataFrame, int, tuple[str, ...]], DataFrame]


def whole_recall(now: float) -> Recall:
    """search() for each value of `by`: query_id, `by`, id, rank. queries: query_id, q."""

    def recall(memories: DataFrame, queries: DataFrame, limit: int, by: tuple[str, ...]) -> DataFrame:
        asked = queries.withColumn("vector", F.lit(None).cast("array<float>"))
        return R.search(memories, asked, now, limit, by=by).select("query_id", *by, "id", "rank")

    return recall


def word_recall(memories: DataFrame, queries: DataFrame, limit: int, by: tuple[str, ...]) -> DataFrame:
    """The keyword lane alone, as whole_recall() has it."""
    return R.bm25(R.searchable(memories), queries, limit, by).select("query_id", *by, "id", "rank")


def _once(rows: DataFrame, *order: str) -> DataFrame:
    """Of a context's rows, without those of low signal, the first of each text start."""
    first = W.partitionBy("context_id", F.substring("text", 1, 120)).orderBy(*order)
    return rows.where(~RT.is_low_signal_recall(F.col("text"))).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def _lines(rows: DataFrame, section: str, line: Column, order: list[str], most: int | None = None, chars: int | None = None, quiet: bool = False) -> DataFrame:
    """The first `most` rows of a context as lines, up to the first that overflows the budget; rows of low signal count but give a line only if `quiet`."""
    place = F.row_number().over(W.partitionBy("context_id").orderBy(*order))
    out = rows.withColumn("place", place).where(F.col("place") <= most) if most else rows.withColumn("place", place)
    out = (out if quiet else out.where(~RT.is_low_signal_recall(F.col("text")))).withColumn("line", line)
    if chars:
        used = F.sum(F.length("line")).over(W.partitionBy("context_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
        out = out.withColumn("_used", used).where(F.col("_used") <= chars)
    return out.select("context_id", F.lit(section).alias("section"), "place", "id", "line")


def bootstrap(memories: DataFrame, contexts: DataFrame, recall: Recall, main: str = "main") -> DataFrame:
    """context_id, section, place, id, line.

    memories: the session's own namespace if it has six, else the agent's too; lessons: of the agent, the most important five of
    which none contains another; shared: five of the shared namespaces; main: three of the main agent's, for other agents with
    fewer than five memories; decisions: five that aren't among the memories; events: typed first, else any type.
    """
    ask = lambda *texts: memories.sparkSession.createDataFrame(list(enumerate(texts)), "query_id long, q string")
    said = lambda n, tail="": F.concat(F.lit("- "), F.substring("text", 1, n), tail if isinstance(tail, Column) else F.lit(tail))
    both = ("agent", "namespace")
    lessons = memories.where("memory_type = 'lesson' AND coalesce(lesson_status, 'active') = 'active'")
    asks = {
        "own": (memories, ask(*RECENT), 20, both), "wide": (memories, ask(*RECENT), 20, ("agent",)), "lessons": (lessons, ask(LESSONS), 20, ("agent",)), "shared": (memories, ask(SHARED), 6, both),
        "main": (memories.where(F.col("agent") == main), ask(MAIN), FEW, ("agent",)), "decided": (memories, ask(DECISIONS), 8, ("agent",)),
        "typed": (memories.where("coalesce(memory_type, 'other') = 'other'"), ask(*(q for q, _ in EVENTS)), 5, ("agent",)), "any": (memories, ask(*(q for q, _ in EVENTS)), 5, ("agent",)),
    }
    hits = {name: written(recall(*a), f"recall-{name}") for name, a in asks.items()}  # bounded results of each agent or namespace
    recalled = R.by_ids(memories.select("id", "agent", "text", "category", "importance", "created_at"), _union([h.select("id") for h in hits.values()]).distinct())
    recalled = written(recalled, "recalled")  # texts are read once, not shuffled for each section
    texts = recalled.select("id", "text", "category")
    own = contexts.where("namespace <> 'default'").join(hits["own"], list(both)).select("context_id", "id", F.lit(0).alias("tier"), "query_id", "rank")
    wide = contexts.join(hits["wide"], "agent").select("context_id", "id", F.lit(1).alias("tier"), "query_id", "rank")
    found = _once(own.unionByName(wide).join(texts, "id"), "tier", "query_id", "rank", "id")
    found = found.withColumn("_own", F.count_if(F.col("tier") == 0).over(W.partitionBy("context_id"))).where((F.col("tier") == 0) | (F.col("_own") < ENOUGH))
    label = F.coalesce(F.concat(F.lit(" ["), F.col("category"), F.lit("]")), F.lit(""))
    parts = [_lines(found, "memories", said(300, label), ["tier", "query_id", "rank", "id"], chars=MEMORY_CHARS)]

    best = hits["lessons"].select("id").join(recalled.select("id", "agent", "text", "importance", "created_at"), "id")
    kept = contexts.join(S.contained_dedup(best, stripped=True).withColumnRenamed("place", "_order"), "agent").join(texts, "id")
    parts.append(_lines(kept.withColumn("text", RT.without_low_signal(F.col("text"))), "lessons", said(400), ["_order"], chars=LESSON_CHARS))

    seen = contexts.select("context_id", F.col("agent").alias("_agent"), F.posexplode("shared").alias("_order", "namespace"))
    shared = seen.join(hits["shared"].withColumnRenamed("agent", "_agent"), ["_agent", "namespace"]).join(texts, "id")
    parts.append(_lines(_once(shared, "_order", "rank", "id"), "shared", said(220, F.concat(F.lit(" ["), F.col("namespace"), F.lit("]"))), ["_order", "rank", "id"], 5, SHARED_CHARS))

    counts = found.groupBy("context_id").agg(F.count("*").alias("_n"))
    poor = contexts.where(F.col("agent") != main).join(counts, "context_id", "left").where(F.coalesce("_n", F.lit(0)) < FEW).select("context_id")
    first = hits["main"].select("id", "rank").join(texts, "id")
    parts.append(_lines(poor.withColumn("agent", F.lit(main)).join(first.withColumn("agent", F.lit(main)), "agent"), "main", said(200, " [from main]"), ["rank", "id"], 3, SHARED_CHARS))

    decided = contexts.join(hits["decided"], "agent").join(texts, "id").withColumn("_start", F.substring("text", 1, 100))
    known = found.select("context_id", F.substring("text", 1, 100).alias("_start"))
    parts.append(_lines(decided.join(known, ["context_id", "_start"], "left_anti"), "decisions", said(250), ["rank", "id"], 5))

    most = F.element_at(F.array(*(F.lit(n) for _, n in EVENTS)), (F.col("query_id") + 1).cast("int"))
    typed, any_type = (hits[name].where(F.col("rank") <= most) for name in ("typed", "any"))
    others = any_type.join(typed.select("agent", "query_id").distinct(), ["agent", "query_id"], "left_anti")
    events = contexts.join(typed.unionByName(others), "agent").join(texts, "id")
    return _union(parts).unionByName(_lines(events, "events", said(300), ["query_id", "rank", "id"], quiet=True))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
