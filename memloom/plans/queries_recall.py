"""Queries over the driver's tables, fourth part: the whole search, requests, solved problems, single expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import hooks as H
from ..functions import patterns as P
from ..functions import text as T
from ..operators import graph as G
from ..operators import pinning as PN
from ..operators import requests as RQ
from ..operators import retrieval as R
from ..operators import sessions as S
from ..operators import solved as SV
from ..session import table, written
from . import sqltext as Q
from .queries import memories, query, texts
from .queries_more import _ASKED, _ENTITIES, _STOP, _bm25, asked, both_queries
from .views import NOW, view


def graph_of(s, d):
    """Entities, their links and the facts behind them, from the memories' own texts."""
    m = texts(s, d)
    found = written(G.entities(m).withColumn("entity_id", F.concat_ws(":", "label", "key")), "entities")
    nodes = found.groupBy("entity_id").agg(F.min("name").alias("name"), F.count("*").alias("mention_count")).withColumnRenamed("entity_id", "id")
    links = G.cooccurrences(found.withColumn("key", F.col("entity_id"))).select("id", "source_id", "target_id", F.lit(0.5).alias("confidence"), "created_at")
    links = links.join(m.select("id", F.substring("text", 1, 200).alias("context")), "id").drop("id")
    facts = found.where(F.crc32("id") % 3 == 0).select("entity_id", F.col("id").alias("source_memory_id"), F.col("created_at").alias("valid_from"))
    return written(nodes, "nodes"), written(links, "links"), facts


@query()
def q_search(s, d):
    """H1 whole: H2, H3, F7, R6, H5, R7 (every 20th item of the benchmark, its text followed by words that name a type and an entity; held by tests)."""
    asks = both_queries(s, d).withColumn("q", F.concat("q", F.when(F.col("query_id") % 40 == 0, ' lesson of "Ada Lovelace"').otherwise(" prefer Berlin")))
    return R.search(texts(s, d), written(asks, "asks"), NOW, min_score=0.001, graph=graph_of(s, d), pre_limit=15, vectors=memories(s, d))


@query()
def q_search_agents(s, d):
    """H7: all lanes of each agent, one rerank after the merge (held by tests)."""
    return R.search_agents(texts(s, d), both_queries(s, d), NOW, vectors=memories(s, d))


@query(f"""{_ENTITIES}, f AS (SELECT label || ':' || key AS entity_id, id, created_at FROM ent WHERE id::BIGINT % 3 = 0)
  SELECT entity_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id) AS rank FROM f) WHERE rank <= 40""")
def q_fact_memories(s, d):
    """Every entity with the memories behind its latest facts."""
    found = G.entities(memories(s, d)).withColumn("entity_id", F.concat_ws(":", "label", "key"))
    facts = found.where(F.col("id").cast("long") % 3 == 0).select("entity_id", F.col("id").alias("source_memory_id"), F.col("created_at").alias("valid_from"))
    return R.fact_memories(found.select(F.lit(0).alias("query_id"), "entity_id").distinct(), facts, 40).select("entity_id", "id", "rank")


def _names(kind: str) -> str:
    return f"regexp_matches(' ' || lower(q) || ' ', '[^a-zçğıöşü0-9](?:{'|'.join(P.TYPE_KEYWORDS[kind])})[^a-zçğıöşü0-9]')"


@query(rf""", q AS (SELECT item_id AS query_id, text || CASE item_id % 3 WHEN 0 THEN ' any lessons on the policy' WHEN 1 THEN ' what do I prefer' ELSE '' END AS q FROM benchmark),
  k AS ({" UNION ALL ".join(f"SELECT query_id, '{k}' AS kind FROM q WHERE {_names(k)}" for k in P.TYPE_KEYWORDS)}),
  b AS (SELECT memory_type AS kind, id, row_number() OVER (PARTITION BY memory_type ORDER BY importance DESC, created_at DESC, id) AS r FROM memories WHERE deleted_at IS NULL AND importance >= 0.05 AND (memory_type <> 'lesson' OR lesson_status = 'active'))
  SELECT DISTINCT query_id, id FROM k JOIN b USING (kind) WHERE r <= 40""")
def q_type_candidates(s, d):
    """H3 by the types that a query names: every benchmark text, two of three with words that name some."""
    n = F.col("item_id")
    named = F.when(n % 3 == 0, " any lessons on the policy").when(n % 3 == 1, " what do I prefer").otherwise("")
    return R.type_candidates(memories(s, d), table(s, d, "benchmark").select(n.alias("query_id"), F.concat("text", named).alias("q")), 40)


@query(f", {_ASKED}, {_bm25(1)} SELECT id FROM memories WHERE id NOT IN (SELECT id FROM kw)")
def q_forget_by_query(s, d):
    """W5 by the first keyword hit."""
    return RQ.forget_by_query(memories(s, d), asked(s, d)).select("id")


@query("""SELECT id, regexp_matches(ns, '^[a-z0-9._-]{1,64}$') OR ns = '' AS namespace_ok, regexp_matches(ag, '^[a-z0-9_-]{1,64}$') AS agent_ok, length(text) BETWEEN 1 AND 2000 AS query_ok, importance <= 1 AND n % 101 <= 50 AND n % 101 >= 1 AS numbers_ok,
  CASE WHEN n % 5 = 0 THEN true WHEN n % 5 = 1 THEN false ELSE agent = 'agent-1' END AS permitted
  FROM (SELECT *, CASE WHEN n % 2 = 0 THEN namespace ELSE upper(namespace) END AS ns, CASE WHEN n % 3 = 0 THEN 'a b' ELSE agent END AS ag FROM memories)""")
def q_validation(s, d):
    """F13, F15."""
    n = F.col("n")
    namespace, agent = F.when(n % 2 == 0, F.col("namespace")).otherwise(F.upper("namespace")), F.when(n % 3 == 0, "a b").otherwise(F.col("agent"))
    broken = RQ.violations(namespace, agent, F.col("text"), importance=F.col("importance"), limit=n % 101)
    ok = lambda *rules: ~F.arrays_overlap("b", F.array(*map(F.lit, rules)))
    allowed = F.when(n % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit(" Agent-1"))
    rows = memories(s, d).select("id", broken.alias("b"), RQ.permitted(allowed, F.when(n % 5 == 1, "all").otherwise(F.col("agent"))).alias("permitted"))
    return rows.select("id", ok("namespace").alias("namespace_ok"), ok("agent").alias("agent_ok"), ok("query").alias("query_ok"), ok("importance", "limit").alias("numbers_ok"), "permitted")


@query(rf"""SELECT n, substr(CASE WHEN n % 2 = 0 THEN {Q.trimmed("text")} ELSE 'content ' || n END, 1, 4000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY n) AS r, {Q.trimmed("text")} AS c FROM memories WHERE n % 16 NOT IN (9, 13))
  WHERE r <= 200 AND (n % 2 = 1 OR (length(text) <= 50000 AND NOT (length(c) < 3 OR {Q.any_match('c', P.LOW_SIGNAL)})))""")
def q_capture_batches(s, d):
    """Memories as messages, a batch an agent; odd ones have content instead of text (markers that T2 would change are left out)."""
    n = F.col("n")
    rows = memories(s, d).where(~(n % 16).isin(9, 13)).select(F.col("agent").alias("batch"), n.alias("seq"), F.lit(None).cast("string").alias("role"), F.when(n % 2 == 0, F.col("text")).otherwise("").alias("text"), F.concat(F.lit("content "), n.cast("string")).alias("content"))
    return RQ.captured(rows).select(F.col("seq").alias("n"), "text")


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[?!.,;:]+$', '')) || CASE WHEN n % 2 = 0 THEN ' | ns:' || namespace ELSE '' END || coalesce(' | mt:' || memory_type, '') AS key FROM memories""")
def q_cache_keys(s, d):
    """T23."""
    return memories(s, d).select("id", RQ.cache_key(F.col("text"), F.when(F.col("n") % 2 == 0, F.col("namespace")), F.col("memory_type")).alias("key"))


@query(f"SELECT id FROM memories WHERE deleted_at IS NULL AND embedding IS NULL AND n % 7 <> 3 AND (created_at < {NOW} - 1e6 OR (created_at = {NOW} - 1e6 AND id > '5')) ORDER BY created_at DESC, id LIMIT 100")
def q_page(s, d):
    """A page by key, some ids left out."""
    m = memories(s, d)
    return RQ.page(m.where("deleted_at IS NULL AND embedding IS NULL"), 100, (NOW - 1e6, "5"), m.where("n % 7 = 3")).select("id")


@query("""SELECT event_id AS request_id, printf('method=POST path=/v1/%s status=%d ip=unknown agent=%s elapsed_ms=%.1f', event_type, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END, tool, round(abs(value) * 1000, 1)) AS line FROM calls""", ("calls",))
def q_audit_lines(s, d):
    """X14."""
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    rows = view(s, d, "calls").select(F.col("event_id").alias("request_id"), F.lit("POST").alias("method"), F.concat(F.lit("/v1/"), "event_type").alias("path"), status.alias("status"), F.lit(None).cast("string").alias("client"), F.col("tool").alias("agent"), F.abs("value").alias("seconds"))
    return RQ.audit_lines(rows)


@query("""SELECT session_id, kind = 'claim' AS pending FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT *, CASE tool WHEN 'claim' THEN 'claim' WHEN 'exec' THEN 'proof' END AS kind FROM calls) WHERE kind IS NOT NULL) WHERE r = 1""", ("calls",))
def q_verification_pending(s, d):
    """X7."""
    kind = F.when(F.col("tool") == "claim", "claim").when(F.col("tool") == "exec", "proof")
    return RQ.verification_pending(view(s, d, "calls").withColumn("kind", kind)).select("session_id", "pending")


def problems(s, d):
    return texts(s, d).select("id", F.concat_ws(" ", "category", "namespace", "source").alias("title"), F.col("agent").alias("root_cause"), F.col("text").alias("fix"), F.array(F.lower("source"), F.coalesce("memory_type", F.lit("none"))).alias("tags"), "created_at")


@query("SELECT keyword, count(*) AS n, min(id) AS first FROM (SELECT DISTINCT id, unnest([category, namespace, source, coalesce(memory_type, 'none')]) AS keyword FROM memories) GROUP BY 1")
def q_keyword_index(s, d):
    """K8: postings of tags and title words, counted (underscores go with the signs)."""
    return SV.keyword_index(problems(s, d).withColumn("title", F.replace("title", F.lit("_"), F.lit("-")))).groupBy(F.when(F.col("keyword") == "qa-pair", "qa_pair").otherwise(F.col("keyword")).alias("keyword")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(rf""", w AS (SELECT query_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id AS query_id, string_split_regex(lower(regexp_replace(text, '[?!.,;:''\x22()\[\]{{}}]', ' ', 'g')), '\s+') AS ws FROM benchmark WHERE item_id % 20 = 0)),
  f AS (SELECT query_id, w, min(i) AS i FROM w WHERE length(w) > 2 AND NOT list_contains({_STOP}, w) GROUP BY 1, 2),
  k AS (SELECT query_id, w AS kw FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM f) WHERE r <= 5 UNION ALL SELECT -1, unnest(['docker', 'lesson', 'hooks'])),
  h AS (SELECT query_id, id, any_value(created_at) AS created_at, count(*) AS hits FROM memories, k
    WHERE contains(lower(category || ' ' || namespace || ' ' || source || ' ' || agent || ' ' || text || ' ' || source || ' ' || coalesce(memory_type, 'none')), kw) OR len(list_filter([source, coalesce(memory_type, 'none'), replace(category, '_', ''), namespace], lambda x: contains(x, kw) OR contains(kw, x))) > 0 GROUP BY 1, 2)
  SELECT query_id, id, hits, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS place FROM h) WHERE place <= 20""")
def q_search_solved(s, d):
    """K7: the newest 20 for the keywords of every 20th benchmark text, and for three common words."""
    asks = asked(s, d).select("query_id", F.explode(H.keywords(F.col("q"))).alias("keyword"))
    words = s.createDataFrame([(-1, w) for w in ("docker", "lesson", "hooks")], "query_id long, keyword string")
    return SV.search_solved(problems(s, d), asks.unionByName(words), 20)


@query(f"""SELECT session_id, seq, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seq) AS place FROM (
  SELECT session_id, seq, role, CASE WHEN length(text) < 15 OR {Q.any_match('text', H.COMPACTION_LOW_SIGNAL)} THEN 0 ELSE least(1.0::DOUBLE, CASE WHEN {Q.any_match('text', H.COMPACTION_DECISIONS)} THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END
    + CASE WHEN {Q.any_match('text', H.COMPACTION_ERRORS)} THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN {Q.any_match('text', H.COMPACTION_PREFERENCES)} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(text) > 100 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN length(text) > 300 THEN 0.05::DOUBLE ELSE 0 END) END AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM messages) WHERE back <= 60) WHERE role IN ('user', 'assistant') AND score > 0) WHERE place <= 30""", ("messages",))
def q_before_compaction(s, d):
    """R14."""
    return PN.before_compaction(view(s, d, "messages")).select("session_id", "seq", "place")


@query()
def q_message_recall(s, d):
    """Every 20th memory as a message (least scores on the scale of fused ranks; held by tests)."""
    asks = texts(s, d).where("n % 20 = 0").select(F.col("n").alias("query_id"), F.concat("text", F.lit(" where is the config?")).alias("text"))
    return PN.message_recall(asks, texts(s, d), NOW, lesson_score=0.001, general_score=0.002)


_STOPS = "[" + ", ".join(f"'{w}'" for w in H.SEARCH_STOP_WORDS) + "]"


@query(rf"""SELECT id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text) || ' ' || translate(lower(text), 'çğıöşü', 'cgiosu'), '[\p{{L}}\p{{N}}_\x27]+')), lambda w: length(w) > 1 AND NOT list_contains({_STOPS}, w))), ' ') AS tokens FROM memories""")
def q_search_tokens(s, d):
    """T19 (without lemmas): words of the text and of its folded copy."""
    return memories(s, d).select("id", F.array_join(F.array_sort(H.search_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"SELECT id FROM memories WHERE created_at BETWEEN {NOW} - 7 * 86400 AND {NOW} - 1")
def q_temporal(s, d):
    """The memories of last week."""
    start, end = H.temporal_range("what did we do last week", datetime(2024, 2, 1, 12))
    seconds = lambda t: (t - datetime(1970, 1, 1)).total_seconds()
    return memories(s, d).where(F.col("created_at").between(seconds(start), seconds(end))).select("id")


@query(r""", c AS (SELECT n, CASE WHEN n % 2 = 0 THEN text ELSE 'part one' || chr(10) || 'part two' END AS flat, n % 6 = 1 AS tool_use FROM memories)
  SELECT n, md5(regexp_replace(flat, '^\s+|\s+$', '', 'g')) AS flat, tool_use OR (n % 3 = 0 AND NOT regexp_matches(flat, 'systemctl\s+(restart|stop|start|enable|disable)|docker\s+(compose|build|push|up|down|restart|stop)|git\s+(push|merge|tag|commit)|(?:^|[^\p{L}\p{M}\p{N}_])(deploy|migrate|backup|restore|error|fail|crash|killed|SIGKILL|OOM|denied)(?:$|[^\p{L}\p{M}\p{N}_])|apt(?:-get)?\s+(install|upgrade|remove)|npm\s+(publish|install|update)|pip3?\s+install|ufw\s+(allow|deny|enable|disable)|certbot', 'i')) AS skipped FROM c WHERE NOT starts_with(flat, '[')""")
def q_flatten(s, d):
    """String contents and lists of blocks; tool output and tool calls (texts that start with a bracket, which would be lists, are left out)."""
    n = F.col("n")
    blocks = F.concat(F.lit('[{"type": "text", "text": "part one"}, {"type": "'), F.when(n % 6 == 1, "tool_use").otherwise("image"), F.lit('"}, {"type": "text", "text": "part two"}]'))
    content = F.when(n % 2 == 0, F.col("text")).otherwise(blocks)
    rows = memories(s, d).where((n % 2 == 1) | ~F.col("text").startswith("[")).select("n", content.alias("content"), F.when(n % 3 == 0, "tool").otherwise("assistant").alias("role"))
    rows = rows.withColumn("flat", S.flatten_content(F.col("content")))
    return rows.select("n", F.md5("flat").alias("flat"), S.is_tool_call(F.col("role"), F.col("flat"), F.col("content")).alias("skipped"))


@query(r"""SELECT id, len(regexp_extract_all(text, '(?i)(?:- \[ \]|TODO|bekliyor|kalan|unfinished|remaining)[^\n]{5,80}')) AS todo, len(list_filter(list_distinct(regexp_extract_all(text, '/(?:opt|root|home|etc|var|tmp)/[^\s\])\x22'',]{5,80}')), lambda x: regexp_matches(x, '\.\w{1,5}$'))) AS files FROM memories""")
def q_unfinished(s, d):
    """Unfinished work and files mentioned."""
    x = F.col("text")
    return memories(s, d).select("id", F.size(H.unfinished(x)).cast("long").alias("todo"), F.size(H.files_mentioned(x)).cast("long").alias("files"))


@query("SELECT id, category, deleted_at FROM memories WHERE n % 50 = 0")
def q_by_id(s, d):
    """Point lookups, of every 50th id."""
    m = memories(s, d)
    return R.by_ids(m, m.where("n % 50 = 0").select("id")).select("id", "category", "deleted_at")
