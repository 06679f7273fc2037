"""Queries over the driver's tables: one function an operator or composition, with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import consolidate as C
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..operators import sessions as S
from ..session import table
from . import sqltext as Q
from .views import NOW, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ("memories",)):
    def register(f):
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return f

    return register


def memories(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "memories")


def texts(s, d):
    """The memories without the column of their vectors."""
    return view(s, d, "texts")


# --- Aggregates and audits -------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS live, count(DISTINCT agent) AS agents, count(embedding) AS with_vector FROM memories")
def q_stats(s, d):
    """A1."""
    return memories(s, d).agg(F.count("*").alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_distinct("agent").alias("agents"), F.count("embedding").alias("with_vector"))


@query("SELECT category, count(*) AS n FROM memories GROUP BY 1")
def q_by_category(s, d):
    """A2."""
    return A.counts_by(memories(s, d), category=F.col("category"))


@query("SELECT coalesce(memory_type, 'other') AS kind, count(*) AS n FROM memories WHERE deleted_at IS NULL GROUP BY 1")
def q_by_type(s, d):
    """A3."""
    return A.counts_by(L.live(memories(s, d)), kind=A.type_of())


@query("SELECT namespace, coalesce(memory_type, 'other') AS kind, count(*) AS n FROM memories GROUP BY 1, 2")
def q_type_dist(s, d):
    """A11."""
    return A.counts_by(memories(s, d), namespace=F.col("namespace"), kind=A.type_of())


@query(f"""SELECT agent, count(*) AS total, count(*) FILTER (source = 'hook') AS hook, count(*) FILTER (source = 'api') AS api,
  count(*) FILTER (source = 'hook' AND created_at >= {NOW} - 7 * 86400) AS hook_7d, count(*) FILTER (source = 'api' AND created_at >= {NOW} - 7 * 86400) AS api_7d,
  count(*) FILTER (memory_type = 'lesson') AS lessons, count(*) FILTER (category = 'decision') AS decisions FROM memories WHERE deleted_at IS NULL GROUP BY agent""")
def q_dashboard_agents(s, d):
    """A4, A5."""
    return A.dashboard(memories(s, d), NOW)


@query(f"""SELECT total, round(CASE WHEN h + a = 0 THEN 0 ELSE 100.0::DOUBLE * h / (h + a) END, 1)::DOUBLE AS hook_pct, lesson_strength, vectorless, noise FROM (
  SELECT count(*) AS total, count(*) FILTER (source = 'hook' AND created_at >= {NOW} - 7 * 86400) AS h, count(*) FILTER (source = 'api' AND created_at >= {NOW} - 7 * 86400) AS a,
  round(avg(strength) FILTER (memory_type = 'lesson'), 2) AS lesson_strength, count(*) FILTER (embedding IS NULL) AS vectorless,
  count(*) FILTER (text ILIKE '%Conversation info (untrusted metadata)%' OR text ILIKE '%[Subagent Context]%' OR text ILIKE '%[System Message]%' OR text ILIKE '%ignore all previous%') AS noise
  FROM memories WHERE deleted_at IS NULL)""")
def q_capture_health(s, d):
    """A6, A7, F9."""
    return A.health(memories(s, d), NOW)


@query(f"""SELECT count(*) AS total, count(*) FILTER (coalesce(lesson_status, 'active') = 'active') AS active, count(*) FILTER (coalesce(lesson_status, 'active') = 'resolved') AS resolved,
  count(*) FILTER (created_at >= {NOW} - 7 * 86400) AS recent_7d, round(avg(importance), 3) AS avg_importance FROM memories WHERE memory_type = 'lesson'""")
def q_lesson_metrics(s, d):
    """A8."""
    return A.lesson_metrics(memories(s, d), NOW)


@query("SELECT coalesce(category, 'untagged') AS tag, count(*) AS n FROM memories WHERE memory_type = 'lesson' GROUP BY 1 ORDER BY n DESC, tag LIMIT 20")
def q_lesson_tags(s, d):
    """A top-k report."""
    return A.lesson_tags(memories(s, d))


@query("SELECT agent, count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS live, round(sum(importance), 4) AS importance FROM memories GROUP BY ROLLUP (agent)")
def q_rollup_agents(s, d):
    """A13."""
    return A.rollup_agents(memories(s, d))


@query(f"""SELECT *, (SELECT count(*) FROM (SELECT text FROM memories WHERE deleted_at IS NULL GROUP BY text HAVING count(*) > 1)) AS duplicate_groups FROM (
  SELECT count(*) AS total, count(*) FILTER (l) AS scoped, count(*) FILTER (l AND {Q.trimmed('text')} = '') AS blank, count(*) FILTER (l AND embedding IS NULL) AS vectorless,
  count(*) FILTER (l AND memory_type NOT IN ('fact', 'preference', 'rule', 'conversation', 'lesson', 'other')) AS invalid_type, count(*) FILTER (l AND namespace IS NULL) AS null_namespace,
  count(*) FILTER (l AND length(text) > 8000) AS long_text, count(*) FILTER (l AND length(text) < 20) AS short_text FROM (SELECT *, deleted_at IS NULL AS l FROM memories))""")
def q_audit(s, d):
    """A10."""
    return A.audit(memories(s, d))


@query("SELECT md5(text) AS digest, count(*) AS copies, min(n) AS first FROM memories WHERE deleted_at IS NULL GROUP BY text HAVING count(*) > 1")
def q_dup_groups(s, d):
    """V10."""
    return A.duplicate_groups(memories(s, d))


_SECRET_SQL = " UNION ALL ".join(f"SELECT {i} AS pattern, sum(h)::BIGINT AS hits, count(*) FILTER (h > 0) AS row_count FROM (SELECT len(regexp_extract_all(text, '{e.replace(chr(39), chr(39) * 2)}')) AS h FROM memories WHERE deleted_at IS NULL)" for i, (e, _) in enumerate(P.SECRETS))


@query(_SECRET_SQL)
def q_secret_tally(s, d):
    """A12."""
    return A.secret_tally(memories(s, d))


@query("SELECT substr(sha256(id), 1, 16) AS hashed FROM memories WHERE deleted_at IS NULL AND (" + " OR ".join(f"regexp_matches(text, '{e.replace(chr(39), chr(39) * 2)}')" for e, _ in P.SECRETS) + ") ORDER BY 1 LIMIT 20")
def q_secret_samples(s, d):
    """A sampling report."""
    return A.secret_samples(memories(s, d))


@query("SELECT role, count(*) AS messages, sum(length(text))::BIGINT AS chars, sum(greatest(1, floor(length(text) / 4)))::BIGINT AS tokens FROM messages GROUP BY role", ("messages",))
def q_role_totals(s, d):
    """A16, T35."""
    return A.role_totals(view(s, d, "messages"))


_LE = ", ".join(f"count(*) FILTER (duration <= {b}) AS le_{str(b).replace('.', '_')}" for b in A.BUCKETS)


@query(f"SELECT event_type, {_LE}, round(sum(duration), 4) AS total, count(*) AS n FROM (SELECT event_type, value / 10 AS duration FROM calls) GROUP BY 1", ("calls",))
def q_latency_hist(s, d):
    """A17, A18."""
    return A.latency_histogram(view(s, d, "calls").select("event_type", (F.col("value") / 10).alias("duration")), "event_type")


@query(" UNION ALL ".join(f"SELECT event_type, {i} AS i, format('request_seconds_bucket{{{{type=\"{{}}\",le=\"{b}\"}}}} {{}}', event_type, count(*) FILTER (value / 10 <= {b})) AS line FROM calls GROUP BY event_type" for i, b in enumerate(A.BUCKETS)), ("calls",))
def q_exposition(s, d):
    """A19."""
    return A.exposition(q_latency_hist(s, d))


@query("""SELECT round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::DOUBLE / count(*), 2) AS error_rate, round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 2) AS done_rate FROM calls""", ("calls",))
def q_rates(s, d):
    """A21."""
    one = lambda t: (F.col("event_type") == t).cast("int").alias(t)
    return A.rates(view(s, d, "calls").select(one("error"), one("purchase"), one("view"), F.lit(1).alias("any")), error_rate=("error", "any"), done_rate=("purchase", "view"))


# --- Life cycle ------------------------------------------------------------------------------------------------------

_IDLE = f"(({NOW} - coalesce(last_accessed_at, created_at)) / 86400)"
_OTHER = f"CASE WHEN {_IDLE} > 90 THEN 0.3::DOUBLE WHEN {_IDLE} <= 3 THEN least(coalesce(strength, 1) + 0.1::DOUBLE, 5) WHEN {_IDLE} > 21 THEN greatest(coalesce(strength, 1) - 0.07::DOUBLE * (1 + (1 - coalesce(importance, 0.5))), 0.3::DOUBLE) ELSE strength END"
_LESSON = f"CASE WHEN {_IDLE} > 270 THEN 0.8::DOUBLE WHEN {_IDLE} <= 3 THEN least(coalesce(strength, 1) + 0.1::DOUBLE, 5) WHEN {_IDLE} > 60 THEN greatest(coalesce(strength, 1) - 0.02::DOUBLE, 0.8::DOUBLE) ELSE strength END"
_DECAYED = f"CASE WHEN deleted_at IS NOT NULL OR pinned THEN strength WHEN coalesce(memory_type = 'lesson', false) THEN {_LESSON} ELSE {_OTHER} END"


@query(f"SELECT id, round({_DECAYED}, 6) AS strength FROM memories")
def q_decay(s, d):
    """L1, L2."""
    return L.decay(memories(s, d), NOW).select("id", F.round("strength", 6).alias("strength"))


@query(f"SELECT id, deleted_at FROM (SELECT id, CASE WHEN deleted_at IS NULL AND NOT pinned AND coalesce(memory_type <> 'lesson', true) AND coalesce({_DECAYED} <= 0.3 AND importance <= 0.3 AND {_IDLE} > 60, false) THEN {NOW}::DOUBLE ELSE deleted_at END AS deleted_at FROM memories)")
def q_gc(s, d):
    """L3 after L1, W12."""
    return L.collect_garbage(L.decay(memories(s, d), NOW), NOW).select("id", "deleted_at")


@query(f"SELECT count(*) FILTER (deleted_at < {NOW} - 0.5 * 86400) AS eligible FROM memories")
def q_purge_eligible(s, d):
    """L4."""
    return L.purge_eligible(memories(s, d), NOW, 0.5)


@query(f"SELECT id, CASE WHEN deleted_at IS NULL AND NOT pinned AND NOT coalesce(memory_type IN ('lesson', 'rule'), false) AND strength < 0.3 AND {_IDLE} > 30 THEN {NOW}::DOUBLE ELSE deleted_at END AS deleted_at FROM memories")
def q_archive(s, d):
    """L5."""
    return L.archive_weak(memories(s, d), NOW).select("id", "deleted_at")


_SUMMARY = r"""list_reduce(list_prepend({'t': '', 'o': false}, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]\s+|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: {'t': x, 'o': false})),
  lambda a, x: {'t': CASE WHEN a.t = '' THEN x.t WHEN length(a.t) + length(x.t) < 300 AND NOT a.o THEN a.t || '. ' || x.t ELSE a.t END, 'o': a.o OR (a.t <> '' AND NOT (length(a.t) + length(x.t) < 300))}).t"""


@query(f"""SELECT id, text AS original_text, '[compressed] ' || {_SUMMARY} AS text FROM memories
  WHERE deleted_at IS NULL AND NOT pinned AND created_at < {NOW} - 7 * 86400 AND length(text) > 100 AND NOT starts_with(text, '[compressed]') AND (CASE WHEN importance = 0 THEN 0.5 ELSE importance END) < 0.8""")
def q_compress(s, d):
    """All candidates, not only the oldest 500."""
    return L.compress(memories(s, d), NOW, most=None)


def _stripped(text: str) -> str:
    """T1 in RE2's terms: what a look ahead only sees is taken and put back."""
    for e in P.WRAPPERS:
        flags = "".join(f for f in "ims" if f in e[: e.index(")")])
        body, back = e[e.index(")") + 1 :].replace("'", "''"), ""
        if "(?=" in body:
            body, back = body.replace(r"(?=\n\n|$)", r"(\n\n|$)"), r"\1"
        text = f"regexp_replace({text}, '{body}', '{back}', 'g{flags}')"
    return Q.trimmed(f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"""SELECT id, CASE WHEN deleted_at IS NULL AND length(c) > 10 THEN c ELSE t END AS text, embedding IS NULL OR (deleted_at IS NULL AND length(c) > 10) AS vectorless
  FROM (SELECT *, {_stripped("replace(t, chr(13) || chr(10), chr(10))")} AS c FROM (SELECT *, '[Subagent Context] internal' || chr(10) || chr(10) || text AS t FROM memories))""")
def q_envelope(s, d):
    """L7, T1."""
    wrapped = memories(s, d).withColumn("text", F.concat(F.lit("[Subagent Context] internal\n\n"), "text"))
    return L.clean_envelopes(wrapped).select("id", "text", F.col("embedding").isNull().alias("vectorless"))


@query(f"SELECT id, CASE WHEN {Q.any_match('text', P.CRON)} AND importance > 0.3 THEN 0.3::DOUBLE ELSE importance END AS importance FROM memories")
def q_rescore_cron(s, d):
    """L9."""
    return L.cap_cron(memories(s, d)).select("id", "importance")


@query(r"""SELECT tag, max(c) AS lessons, string_agg(substr(text, 1, 80), ' | ' ORDER BY r) AS rule FROM (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY created_at, id) AS r, count(*) OVER (PARTITION BY tag) AS c FROM (
    SELECT id, created_at, '[tag=' || namespace || '] ' || text AS text, namespace AS tag FROM memories WHERE deleted_at IS NULL AND memory_type = 'lesson')) WHERE r <= 3 AND c >= 3 GROUP BY tag""")
def q_escalation(s, d):
    """L12."""
    tagged = memories(s, d).withColumn("text", F.concat(F.lit("[tag="), "namespace", F.lit("] "), "text"))
    return L.escalate(tagged)


@query(f"SELECT id, round(CASE WHEN n % 9 = 0 THEN least(coalesce(strength, 1) + 0.3::DOUBLE, 5) ELSE strength END, 6) AS strength, CASE WHEN n % 9 = 0 THEN {NOW}::DOUBLE ELSE last_accessed_at END AS last_accessed_at FROM memories")
def q_boost(s, d):
    """W7."""
    m = memories(s, d)
    return L.boost(m, m.where("n % 9 = 0"), NOW).select("id", F.round("strength", 6).alias("strength"), "last_accessed_at")


@query("SELECT id, CASE WHEN n % 4 = 0 THEN 'new' ELSE category END AS category FROM memories UNION ALL SELECT 'x' || id, 'new' FROM memories WHERE n % 10 = 3")
def q_upsert(s, d):
    """W1, W2, S9."""
    m = memories(s, d).select("id", "n", "category", F.col("created_at").alias("updated_at"))
    fresh = m.where("n % 4 = 0").withColumn("category", F.lit("new"))
    stale = fresh.withColumns({"category": F.lit("old"), "updated_at": F.col("updated_at") - 1})
    added = m.where("n % 10 = 3").withColumns({"id": F.concat(F.lit("x"), "id"), "category": F.lit("new")})
    return L.upsert(m, fresh.unionByName(stale).unionByName(added)).select("id", "category")


@query("SELECT id, CASE WHEN n % 6 = 0 AND category <> 'user' THEN 'patched' ELSE category END AS category, importance FROM memories")
def q_patch(s, d):
    """W3."""
    m = memories(s, d)
    new = m.where("n % 6 = 0").select("id", F.when(F.col("category") != "user", F.lit("patched")).alias("category"), F.lit(None).cast("double").alias("importance"))
    return L.patch(m, new, ["category", "importance"]).select("id", "category", "importance")


@query("SELECT id FROM memories WHERE NOT (n % 8 = 1)")
def q_forget(s, d):
    """W4, W5."""
    m = memories(s, d)
    return L.forget(m, m.where("n % 8 = 1")).select("id")


# --- Scalars ---------------------------------------------------------------------------------------------------------

_C = "c"
_OPERATIONAL = " OR ".join([
    Q.any_match(_C, P.DECISION),
    f"({Q.any_match(_C, P.INCIDENT_VERBS)} AND {Q.any_match(_C, P.INCIDENT_NOUNS)})",
    f"({Q.any_match(_C, P.CONFIG_VERBS)} AND {Q.any_match(_C, P.CONFIG_NOUNS)})",
    f"({Q.any_match(_C, P.OPS_VERBS)} AND {Q.any_match(_C, P.OPS_NOUNS)} AND NOT ({Q.any_match(_C, P.OBSERVATION)} OR ({Q.any_match(_C, [P.QUESTION_PARTICLE], 'c')} AND NOT contains(c, '?')) OR ends_with(c, '?')))",
    Q.any_match(_C, P.DEPLOYMENT),
    Q.any_match(_C, P.VERIFICATION),
])
_RULE = rf"(len(regexp_extract_all(c, '\S+')) <= 50 AND NOT {Q.any_match(_C, P.NOT_RULES)} AND ({Q.any_match(_C, P.TURKISH_RULES)} OR {Q.any_match(_C, P.ENGLISH_RULES)}))"
_TYPE = f"""CASE WHEN c = '' THEN 'conversation' WHEN {Q.whole_word(_C, P.LESSON)} THEN 'lesson' WHEN {_OPERATIONAL} THEN 'other'
  WHEN {_RULE} OR {Q.any_match(_C, P.SAFEWORDS)} THEN 'rule' WHEN {Q.any_match(_C, [P.NAME], 'c')} OR {Q.whole_word(_C, P.FACTUAL)} THEN 'fact'
  WHEN {Q.whole_word(_C, P.PREFERENCE)} THEN 'preference' ELSE 'conversation' END"""
_TRIMMED = f"(SELECT id, text, coalesce(memory_type, 'other') AS old_type, deleted_at, category, {Q.trimmed('text')} AS c FROM memories)"


@query(f"SELECT id, {_TYPE} AS memory_type FROM {_TRIMMED}")
def q_classify(s, d):
    """T6-T12."""
    return memories(s, d).select("id", T.memory_type(F.col("text")).alias("memory_type"))


@query(f"SELECT old_type, new_type, count(*) AS n FROM (SELECT old_type, {_TYPE} AS new_type FROM {_TRIMMED} WHERE deleted_at IS NULL) GROUP BY 1, 2")
def q_transitions(s, d):
    """L8, A15."""
    return A.transitions(L.reclassify(memories(s, d)))


_LOW = "lower(c)"
_NOT_ENTITIES = "[" + ", ".join(f"'{w}'" for w in P.NOT_ENTITIES) + "]"
_POINTS = " + ".join([
    "0.35::DOUBLE",
    f"CASE WHEN {Q.any_match('text', P.CONVERSATION_SOURCES)} THEN 0.15::DOUBLE ELSE 0 END",
    "CASE WHEN contains(text, '?') AND length(text) > 10 THEN 0.05::DOUBLE ELSE 0 END",
    f"CASE WHEN {Q.any_of(_LOW, P.IMPORTANCE_MARKERS)} THEN 0.25::DOUBLE ELSE 0 END",
    f"CASE WHEN {Q.any_of(_LOW, P.DECISION_MARKERS)} THEN 0.2::DOUBLE ELSE 0 END",
    f"CASE WHEN {Q.any_match(_LOW, P.TURKISH_DECISIONS, 'c')} THEN 0.2::DOUBLE ELSE 0 END",
    f"CASE WHEN {Q.any_of(_LOW, P.TASK_MARKERS)} THEN 0.15::DOUBLE ELSE 0 END",
    f"CASE WHEN {Q.any_of(_LOW, P.OPS_MARKERS)} THEN 0.2::DOUBLE ELSE 0 END",
    f"least(0.1::DOUBLE, 0.02::DOUBLE * len(list_filter(list_distinct(regexp_extract_all(text, '[A-ZÇĞİÖŞÜ][a-zçğıöşü]{{2,}}')), lambda w: NOT list_contains({_NOT_ENTITIES}, w))))",
    r"CASE WHEN len(regexp_extract_all(text, '\S+')) > 150 THEN 0.08::DOUBLE WHEN len(regexp_extract_all(text, '\S+')) > 80 THEN 0.04::DOUBLE WHEN len(regexp_extract_all(text, '\S+')) < 8 THEN -0.05::DOUBLE ELSE 0 END",
    "CASE category WHEN 'user' THEN 0.05::DOUBLE WHEN 'qa_pair' THEN 0.08::DOUBLE ELSE 0 END",
])
_IMPORTANCE = f"""SELECT id, round(CASE WHEN {Q.any_match(_LOW, P.TRIVIAL, 'c')} THEN 0.05::DOUBLE WHEN {Q.any_match(_LOW, P.SYSTEM_NOISE)} THEN 0.1::DOUBLE
  ELSE greatest(0.05::DOUBLE, least(1.0::DOUBLE, CASE WHEN {Q.any_match('text', P.CRON)} THEN least(points, 0.3::DOUBLE)
    WHEN {Q.any_of(_LOW, P.DECISION_MARKERS)} OR {Q.any_match(_LOW, P.TURKISH_DECISIONS, 'c')} THEN greatest(points, 0.7::DOUBLE) ELSE points END)) END, 4) AS importance
  FROM (SELECT *, {_POINTS} AS points FROM {_TRIMMED})"""


@query(_IMPORTANCE)
def q_importance(s, d):
    """T13, T16."""
    return texts(s, d).select("id", F.round(T.importance(F.col("text"), F.col("category")), 4).alias("importance"))


@query(f"SELECT id, CASE WHEN importance > 0.85 THEN 'HIGH' WHEN importance >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM ({_IMPORTANCE.replace(_TRIMMED, '{T}')})".replace("{T}", _TRIMMED))
def q_tier(s, d):
    """T15."""
    return q_importance(s, d).select("id", T.confidence_tier(F.col("importance")).alias("tier"))


_GENERIC = ", ".join(f"'{w}'" for w in P.GENERIC)


@query(rf"""SELECT session_id, seq, NOT ({Q.any_match('c', P.NOT_TRIGGERS)} OR length(c) < 3 OR lower(c) IN ({_GENERIC}) OR (length(c) <= 4 AND NOT regexp_matches(c, '\p{{L}}')))
  AND ({Q.any_match('lower(c)', P.TURKISH_TRIGGERS + P.ENGLISH_TRIGGERS)} OR (contains(text, '?') AND length(text) > 10) OR {Q.any_match('lower(c)', P.PAST_TENSE)}) AS recall FROM (SELECT *, {Q.trimmed('text')} AS c FROM messages)""", ("messages",))
def q_trigger(s, d):
    """T14."""
    return view(s, d, "messages").select("session_id", "seq", T.should_recall(F.col("text")).alias("recall"))


@query(f"SELECT session_id, seq, (length(c) < 3 OR {Q.any_match('c', P.LOW_SIGNAL)}) AS low_signal, (length(c) < 3 OR starts_with(c, 'HEARTBEAT_OK') OR starts_with(c, 'NO_REPLY') OR role = 'system' OR {Q.any_match('c', P.NOISE)}) AS skipped FROM (SELECT *, {Q.trimmed('text')} AS c FROM messages)", ("messages",))
def q_signal(s, d):
    """T4, T5."""
    return view(s, d, "messages").select("session_id", "seq", T.is_low_signal(F.col("text")).alias("low_signal"), T.should_skip(F.col("text"), F.col("role")).alias("skipped"))


def _sanitized(text: str) -> str:
    clean = text
    for e in P.INJECTIONS:
        clean = f"regexp_replace({clean}, '{e.replace(chr(92) + 'b', '').replace(chr(39), chr(39) * 2)}', '[REDACTED]', 'gi')"
    return f"CASE WHEN {clean} <> {text} THEN '[SANITIZED] ' || {clean} ELSE {text} END"


@query(f"SELECT id, {_sanitized('text')} AS text FROM memories")
def q_sanitize(s, d):
    """T2 (boundaries of three patterns are left out of the twin; the tables hold no such case)."""
    return memories(s, d).select("id", T.sanitize(F.col("text")).alias("text"))


_REDACTED = "text"
for _e, _r in P.SECRETS:
    _sql_replacement = _r.replace("$1", "\\1")
    _REDACTED = f"regexp_replace({_REDACTED}, '{_e.replace(chr(39), chr(39) * 2)}', '{_sql_replacement}', 'g')"


@query(f"SELECT id, {_REDACTED} AS text FROM memories")
def q_redact_secrets(s, d):
    """T36."""
    return memories(s, d).select("id", T.redact_secrets(F.col("text")).alias("text"))


@query(r"""SELECT item_id, translate(text, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU') AS folded, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[?!.,;:]+$', '')) AS normal,
  substr(md5(text), 1, 16) AS chunk, greatest(1, floor(length(text) / 4))::INT AS tokens FROM benchmark""", ())
def q_scalars(s, d):
    """T17, T26, T35, K4."""
    x = F.col("text")
    return table(s, d, "benchmark").select("item_id", T.ascii_fold(x).alias("folded"), T.normalize_query(x).alias("normal"), T.chunk_id(x).alias("chunk"), T.estimate_tokens(x).alias("tokens"))



