"""Queries over the driver's tables, fifth part: substring search, kept tables, intervals, state, sessions' context."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import hooks as H
from ..functions import routing as RT
from ..operators import aggregates as A
from ..operators import bootstrap as B
from ..operators import kept_index as K
from ..operators import results as RS
from ..operators import retrieval as R
from ..operators import sessions as S
from ..session import table, work_path, written
from ..sources import ledger as LG
from ..streaming import ordered as O
from . import sqltext as Q
from .queries import memories, query, texts
from .queries_more import _ASKED, _SEARCHABLE, _WORD, _bm25, asked
from .views import NOW, view

# A word's places in a text, overlaps counted: by cutting the text at it, or, where the word overlaps itself, place by place.
_OVERLAPS = "len(list_filter(range(1, length(w)), lambda i: substr(w, 1, length(w) - i) = substr(w, i + 1))) > 0"
_PLACES = f"CASE WHEN {_OVERLAPS} THEN len(list_filter(range(1, length(t) - length(w) + 2), lambda i: substr(t, i, length(w)) = w)) ELSE (length(t) - length(replace(t, w, ''))) // length(w) END"


@query(rf""", {_ASKED}, tok AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '{_WORD}')) AS w FROM qt) WHERE length(w) >= 3),
    doc AS (SELECT id, lower(text) AS t, greatest(length(lower(text)) - 2, 0) AS dl FROM memories WHERE {_SEARCHABLE}),
    tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM doc),
    tf AS (SELECT id, dl, w, {_PLACES} AS tf FROM doc JOIN (SELECT DISTINCT w FROM tok) ON contains(t, w)),
    df AS (SELECT w, count(*) AS df FROM tf GROUP BY w)
    SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl))), 6) AS score
      FROM tf JOIN df USING (w) JOIN tok USING (w), tot GROUP BY query_id, id)) WHERE rank <= 10""")
def q_trigram(s, d):
    """K2, K3: words found anywhere in a text, by postings of character runs."""
    return R.bm25_substrings(R.searchable(texts(s, d)), asked(s, d), 10)


@query(f", {_ASKED}, {_bm25(10, 'n % 7 <> 3')} SELECT query_id, id, score, rank::INT AS rank FROM kw")
def q_index_merge(s, d):
    """K6: a kept index after three batches (first texts, changed and new ones, deletions) and the merges that they bring, against a rebuild."""
    m = texts(s, d).select("id", "n", "text")
    path = work_path(s, "kept-index")
    K.apply_batch(path, m.where("n % 3 < 2").select("id", F.when(F.col("n") % 5 == 0, F.concat(F.lit("earlier words "), "text")).otherwise(F.col("text")).alias("text")))
    K.apply_batch(path, m.where("n % 3 = 2 OR n % 5 = 0").select("id", "text"))
    K.apply_batch(path, m.where("n % 1000 = 1").select("id", "text"), m.where("n % 7 = 3").select("id"))
    return K.search(s, path, asked(s, d), 10)


# --- State by event time: batch twins of the streams ------------------------------------------------------------------


def events(s, d, kinds: dict[str, str]):
    """Tool calls as events: session_id, event_id, ts, kind (by their type)."""
    kind = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in kinds.items()), F.lit("other"))
    return view(s, d, "calls").select("session_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))


def plain_ts(s, d, df, *columns):
    """Times in the type that the tables have."""
    kind = dict(view(s, d, "calls").dtypes)["ts"]
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


@query("""SELECT session_id, event_id, ts, score, CASE WHEN score >= 5 THEN 'mandatory' WHEN score >= 3 THEN 'warn' ELSE 'none' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY session_id, i ORDER BY ts, event_id) AS score FROM (
  SELECT *, sum(g) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) > INTERVAL 24 HOURS THEN 1 ELSE 0 END AS g FROM calls WHERE event_type = 'error')))""", ("calls",))
def s_scores(s, d):
    """X6's batch twin: the score after each unproven claim, which a day without one ends."""
    return plain_ts(s, d, O.scores_in_batch(events(s, d, {"error": "unproven"})), "ts")


@query("""SELECT session_id, event_id, ts, kind = 'claim' AS pending FROM (SELECT *, coalesce(lag(kind) OVER w = 'claim' AND ts - lag(ts) OVER w <= INTERVAL 24 HOURS, false) AS held FROM (
  SELECT session_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'claim' ELSE 'proof' END AS kind FROM calls WHERE event_type IN ('signup', 'click')) WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) WHERE (kind = 'claim') <> held""", ("calls",))
def s_pending(s, d):
    """X7's batch twin: where verification becomes pending, and where a proof ends it."""
    return plain_ts(s, d, O.pending_in_batch(events(s, d, {"signup": "claim", "click": "proof"})), "ts")


@query("""SELECT session_id, event_id, ts AS started, before AS compacted FROM (SELECT *, lag(event_type) OVER w AS last, lag(ts) OVER w AS before FROM calls WHERE event_type IN ('purchase', 'view') WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
  WHERE event_type = 'view' AND last = 'purchase' AND ts - before < INTERVAL 48 HOURS""", ("calls",))
def s_recoveries(s, d):
    """X8's batch twin: the first start after a compaction recovers, once (within 48 hours here: the table's events are days apart)."""
    return plain_ts(s, d, O.recoveries_in_batch(events(s, d, {"purchase": "compaction", "view": "start"}), 48), "started", "compacted")


# --- Intervals, rollups, kept results, published batches --------------------------------------------------------------

_NOON = datetime(2024, 1, 25, 12)
_PHRASES = [*H.DAY_PHRASES, *H.RANGE_PHRASES, "next century"]
# Days from 2024-01-25 00:00 on; an evening and a morning have hours.
_SPANS = (
    [("evvelsi gün", -2, -1), ("evvelsi gun", -2, -1), ("öbür gün", 2, 3), ("obur gun", 2, 3), ("dün akşam", -0.25, 0), ("dun aksam", -0.25, 0)]
    + [(p, -1, 0) for p in ("dün", "dun", "yesterday")] + [(p, 0, 1) for p in ("bugün", "bugun", "today")] + [(p, 1, 2) for p in ("yarın", "yarin", "tomorrow")]
    + [(p, -7, 0) for p in ("geçen hafta", "gecen hafta", "last week")] + [(p, -31, -1) for p in ("geçen ay", "gecen ay", "last month")]
    + [(p, 0, 7) for p in ("bu hafta", "this week")] + [(p, 0, 30) for p in ("bu ay", "this month")]
)
_VALUES = ", ".join([f"('{p}', 1706140800::DOUBLE + {a} * 86400::DOUBLE, 1706140800::DOUBLE + {b} * 86400::DOUBLE - 1)" for p, a, b in _SPANS] + ["('bu sabah', 1706162400::DOUBLE, 1706184000::DOUBLE)"])
_LIST = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + "]"


@query(f""", spans(phrase, a, b) AS (VALUES {_VALUES}), q AS (SELECT item_id AS query_id, {_LIST}[item_id % {len(_PHRASES)} + 1] AS phrase FROM benchmark)
  SELECT query_id, id, place::INT AS place, n FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS place, count(*) OVER (PARTITION BY query_id) AS n
    FROM q JOIN spans USING (phrase) JOIN memories ON created_at BETWEEN a AND b) WHERE place <= 10""")
def q_temporal_recall(s, d):
    """Every benchmark text with one of the 26 phrases (or one that is none): the newest memories of its interval, and how many there are."""
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("item_id") % len(_PHRASES) + 1).cast("int"))
    asks = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "text", phrase, F.lit("notes")).alias("q"))
    spans = asks.select("query_id", H.temporal_interval(F.col("q"), _NOON).alias("t")).where("t IS NOT NULL").select("query_id", "t.*")
    met = R.in_intervals(memories(s, d).select("id", "created_at"), spans)
    counts = met.groupBy("query_id").agg(F.count("*").alias("n"))
    return R.top(met, 10, F.desc("created_at"), F.asc("id"), name="place").join(counts, "query_id").select("query_id", "id", "place", "n")


@query()
def q_recall(s, d):
    """Whole searches within their interval, cut to a budget (held by tests)."""
    asks = table(s, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" what did we decide last month?")).alias("q"), F.lit(None).cast("array<float>").alias("vector"))
    return R.recall(memories(s, d), asks, NOW, max_tokens=2000).select("query_id", "id", "score", "rank", "triggered")


@query("""SELECT session_id, CASE WHEN grouping(event_type) = 0 THEN 'type' WHEN grouping(tool) = 0 THEN 'root cause' ELSE 'all' END AS part, CASE WHEN grouping(event_type) = 0 THEN event_type WHEN grouping(tool) = 0 THEN tool END AS value,
  count(*) AS total, count(*) FILTER (TIMESTAMP '2024-01-31 00:00:00' - ts < INTERVAL 7 DAYS) AS recent
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS back FROM calls) WHERE back <= 100 GROUP BY GROUPING SETS ((session_id), (session_id, event_type), (session_id, tool))""", ("calls",))
def q_incident_rollup(s, d):
    """The last 100 incidents of a session: all, by type, by root cause, each with those of seven days."""
    calls = view(s, d, "calls").select("session_id", F.col("event_id").alias("incident_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_type").alias("type"), F.col("tool").alias("root_cause"))
    return A.incident_rollup(calls, 1706659200.0)


@query(f"""SELECT agent, id AS key, stale FROM (SELECT agent, id, {NOW} - created_at > CASE WHEN n % 3 = 0 THEN 604800 ELSE (n % 10) * 86400 END AS stale, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, id) AS r
  FROM memories WHERE created_at >= {NOW} - 30 * 86400) WHERE r <= 200""")
def q_kept_facts(s, d):
    """Verified facts that stay, the newest 200 of each agent, and which are stale."""
    ttl = F.when(F.col("n") % 3 != 0, (F.col("n") % 10) * 86400)
    return S.kept_facts(memories(s, d).select("agent", F.col("id").alias("key"), F.col("created_at").alias("verified_at"), ttl.alias("ttl")), NOW).select("agent", "key", "stale")


_AGENT = "'agent-' || (query_id // 20 % 4)"
_OVERLAP = r"""list_filter(list_distinct(regexp_extract_all(lower(q), '[\p{L}\p{M}\p{N}_]+')), lambda x: length(x) >= 3) AS a, list_filter(list_distinct(regexp_extract_all(lower(text[1:4000]), '[\p{L}\p{M}\p{N}_]+')), lambda x: length(x) >= 3) AS b"""


@query(f""", {_ASKED.replace("WHERE item_id % 20 = 0", "")}, {_bm25(10)}, st AS (SELECT query_id, query_id % 3 < 2 AND {_AGENT} <> 'agent-1' AND query_id % 5 <> 4 AS known FROM qt),
  tk AS (SELECT kw.*, {_OVERLAP} FROM kw JOIN qt USING (query_id) JOIN memories USING (id)),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END DESC, rank) AS r FROM tk),
  z AS (SELECT query_id, id, rank, score AS first_score, round(0.65::DOUBLE / (60 + rank) + 0.35::DOUBLE / (60 + r), 8) AS score FROM o)
  SELECT query_id, 1::INT AS pass, id, rank::INT AS rank, first_score AS score FROM z JOIN st USING (query_id) WHERE known
  UNION ALL SELECT query_id, 2::INT, id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank))::INT, score FROM z JOIN st USING (query_id) WHERE NOT known""")
def q_result_table(s, d):
    """Results stored for some benchmark texts, part of them run out or from before their agent's last change; the others are searched, passed a second time and stored."""
    m, n = R.searchable(texts(s, d)), F.col("query_id")
    asks = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    agent = F.concat(F.lit("agent-"), F.floor(n / 20) % 4)
    asks = asks.withColumn("agent", agent).withColumn("key", RS.result_key(F.concat_ws(" ", "q", n.cast("string")), agent, F.lit(10), F.lit(0.0), F.lit(None).cast("string"), F.lit(None).cast("string")))
    before, after = (s.createDataFrame([(f"agent-{i}", 1 + (i == 1) * later) for i in range(4)], "agent string, version long") for later in (0, 1))
    first = written(R.bm25(m, asks.select("query_id", "q"), 10), "first-pass")
    stored = s.createDataFrame([], RS.SCHEMA)
    for part, age in ((n % 3 == 2, 4000.0), (n % 3 < 2, 1000.0)):  # the older part has run out by NOW
        stored = RS.store(stored, first.where(part), asks.where(part & (n % 5 != 4)), before, NOW - age)
    stored = written(stored, "results")
    asked = asks.select("query_id", "key", "agent")
    _, misses = RS.look_up(asked, stored, after, NOW)
    missed = written(first.join(misses.select("query_id"), "query_id"), "missed")  # of known size: a small one is sent to the texts, which stay where they are
    again = missed.join(m.select("id", "text"), "id").join(asks.select("query_id", "q"), "query_id")
    stored = written(RS.store(stored, RS.second_pass(again), misses, after, NOW, 2), "results")
    return RS.look_up(asked, stored, after, NOW + 60)[0].select("query_id", "pass", "id", "rank", "score")


@query("""SELECT agent, id, CASE WHEN n % 2 = 0 THEN 'second ' || category WHEN n % 3 = 0 THEN category ELSE 'third' END AS category FROM memories WHERE n % 3 = 0 OR n % 2 = 0 OR n % 5 = 1""")
def q_ledger(s, d):
    """Three batches of upserts, the second one stopped before its ledger and run again, the first one replayed."""
    path = work_path(s, "ledger")
    m = memories(s, d).select("id", "n", "agent", "category", "text", F.col("created_at").alias("updated_at"))
    first = m.where("n % 3 = 0").drop("n")
    second = m.where("n % 2 = 0").drop("n").withColumn("category", F.concat(F.lit("second "), "category"))
    third = m.where("n % 5 = 1 AND n % 2 = 1 AND n % 3 <> 0").drop("n").withColumn("category", F.lit("third"))
    LG.apply_batch(path, first, 0)
    try:
        LG.apply_batch(path, second, 1, fail_before_ledger=True)
    except RuntimeError:
        LG.apply_batch(path, second, 1)
    LG.apply_batch(path, third, 2)
    LG.apply_batch(path, first, 0)
    return LG.read(s, path).select("agent", "id", "category")


# --- What a session starts with ----------------------------------------------------------------------------------------


def _lane(name: str, texts: list[str], k: int, by: str, where: str = "true") -> str:
    """The keyword lane for each value of `by`, as CTEs that end in `name` (by, query_id, id, rank)."""
    asks = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    return rf"""{name}_t AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '{_WORD}')) AS w FROM (VALUES {asks}) v(query_id, q)) WHERE length(w) >= 3),
    {name}_d AS (SELECT {by}, id, regexp_extract_all(lower(text), '{_WORD}') AS ws FROM memories WHERE {_SEARCHABLE} AND {where}),
    {name}_n AS (SELECT {by}, count(*) AS n, avg(len(ws)) AS avgdl FROM {name}_d GROUP BY ALL),
    {name}_f AS (SELECT {by}, id, dl, w, count(*) AS tf FROM (SELECT {by}, id, len(ws) AS dl, unnest(ws) AS w FROM {name}_d) WHERE w IN (SELECT w FROM {name}_t) GROUP BY ALL),
    {name}_c AS (SELECT {by}, w, count(*) AS df FROM {name}_f GROUP BY ALL),
    {name} AS (SELECT {by}, query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {by} ORDER BY score DESC, id) AS rank FROM (
      SELECT query_id, {by}, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl))), 6) AS score
      FROM {name}_f JOIN {name}_c USING ({by}, w) JOIN {name}_n USING ({by}) JOIN {name}_t USING (w) GROUP BY ALL)) WHERE rank <= {k})"""


_QUIET = f"({Q.any_match('text', RT.CRON_NOISE)} OR {Q.any_match('text', RT.LOW_SIGNAL_RECALL)} OR text = '')"
_BARE = r"regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_EVENTS = [q for q, _ in B.EVENTS]


@query(rf""", ctx AS (SELECT DISTINCT agent || '/' || namespace AS context_id, agent, namespace, CASE namespace WHEN 'de' THEN ['fr', 'en'] ELSE ['de', 'en'] END AS shared FROM memories),
  {_lane('own', B.RECENT, 20, 'agent, namespace')}, {_lane('wide', B.RECENT, 20, 'agent')}, {_lane('les', [B.LESSONS], 20, 'agent', "memory_type = 'lesson' AND lesson_status = 'active'")},
  {_lane('sha', [B.SHARED], 6, 'agent, namespace')}, {_lane('mai', [B.MAIN], 5, 'agent', "agent = 'agent-0'")}, {_lane('dec', [B.DECISIONS], 8, 'agent')}, {_lane('typ', _EVENTS, 5, 'agent', "coalesce(memory_type, 'other') = 'other'")}, {_lane('oth', _EVENTS, 5, 'agent')},
  hit AS (SELECT context_id, id, 0 AS tier, query_id, rank FROM ctx JOIN own USING (agent, namespace) UNION ALL SELECT context_id, id, 1, query_id, rank FROM ctx JOIN wide USING (agent)),
  one AS (SELECT * FROM (SELECT hit.*, text, category, row_number() OVER (PARTITION BY context_id, substr(text, 1, 120) ORDER BY tier, query_id, rank, id) AS r FROM hit JOIN memories USING (id) WHERE NOT {_QUIET}) WHERE r = 1),
  mem AS (SELECT * FROM (SELECT *, count(*) FILTER (tier = 0) OVER (PARTITION BY context_id) AS o FROM one) WHERE tier = 0 OR o < 6),
  raw AS (
    SELECT context_id, 'memories' AS section, row_number() OVER (PARTITION BY context_id ORDER BY tier, query_id, rank, id) AS place, id, '- ' || substr(text, 1, 300) || coalesce(' [' || category || ']', '') AS line, 8000 AS most FROM mem
    UNION ALL SELECT context_id, 'lessons', place, id, '- ' || substr(bare, 1, 400), 3000 FROM ctx JOIN (
      SELECT agent, unnest(kept).id AS id, unnest(kept).bare AS bare, generate_subscripts(kept, 1) AS place FROM (SELECT agent, list_reduce(list([{{'id': id, 'bare': bare}}] ORDER BY importance DESC, created_at DESC, id),
        lambda a, x: CASE WHEN len(a) >= 5 OR len(list_filter(a, lambda y: contains(y.bare, x[1].bare) OR contains(x[1].bare, y.bare))) > 0 THEN a ELSE list_concat(a, x) END) AS kept
        FROM (SELECT m.*, {_BARE} AS bare FROM les JOIN memories m USING (id) WHERE NOT {_QUIET}) GROUP BY agent)) USING (agent)
    UNION ALL SELECT context_id, 'shared', p, id, '- ' || substr(text, 1, 220) || ' [' || ns || ']', 2000 FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY o, rank, id) AS p FROM (
      SELECT *, row_number() OVER (PARTITION BY context_id, substr(text, 1, 120) ORDER BY o, rank, id) AS r FROM (SELECT context_id, agent, unnest(shared) AS ns, generate_subscripts(shared, 1) AS o FROM ctx) c
      JOIN (SELECT agent, namespace AS ns, id, rank FROM sha) USING (agent, ns) JOIN (SELECT id, text FROM memories) USING (id) WHERE NOT {_QUIET}) WHERE r = 1) WHERE p <= 5
    UNION ALL SELECT context_id, 'main', rank, id, '- ' || substr(text, 1, 200) || ' [from main]', 2000 FROM (SELECT context_id FROM ctx WHERE agent <> 'agent-0' AND (SELECT count(*) FROM mem WHERE mem.context_id = ctx.context_id) < 5), (SELECT id, row_number() OVER (ORDER BY rank) AS rank, text FROM mai JOIN memories USING (id)) WHERE rank <= 3 AND NOT {_QUIET}
    UNION ALL SELECT context_id, 'decisions', p, id, '- ' || substr(text, 1, 250), 1000000 FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY rank, id) AS p FROM (SELECT context_id, dec.id, rank, text FROM ctx JOIN dec USING (agent) JOIN memories m ON m.id = dec.id) x
      WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.context_id = x.context_id AND substr(mem.text, 1, 100) = substr(x.text, 1, 100))) WHERE p <= 5 AND NOT {_QUIET}
    UNION ALL SELECT context_id, 'events', row_number() OVER (PARTITION BY context_id ORDER BY query_id, rank, id), id, '- ' || substr(text, 1, 300), 1000000 FROM ctx JOIN (SELECT agent, query_id, id, rank FROM (SELECT * FROM typ UNION ALL SELECT * FROM oth WHERE NOT EXISTS (SELECT 1 FROM typ WHERE typ.agent = oth.agent AND typ.query_id = oth.query_id AND typ.rank <= CASE WHEN oth.query_id = 0 THEN 5 ELSE 3 END))
      WHERE rank <= CASE WHEN query_id = 0 THEN 5 ELSE 3 END) USING (agent) JOIN (SELECT id, text FROM memories) USING (id))
  SELECT context_id, section, place::INT AS place, id, md5(line) AS line FROM (SELECT *, sum(length(line)) OVER (PARTITION BY context_id, section ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM raw) WHERE used <= most AND line <> '- '""")
def q_bootstrap(s, d):
    """Sections of every agent and namespace, by the keyword lane (whole_recall() takes the whole search)."""
    m = texts(s, d)
    other = F.when(F.col("namespace") == "de", F.array(F.lit("fr"), F.lit("en"))).otherwise(F.array(F.lit("de"), F.lit("en")))
    contexts = m.select("agent", "namespace").distinct().select(F.concat_ws("/", "agent", "namespace").alias("context_id"), "agent", "namespace", other.alias("shared"))
    lines = B.bootstrap(m, written(contexts, "contexts"), B.word_recall, "agent-0")
    return lines.withColumn("line", F.md5("line"))
