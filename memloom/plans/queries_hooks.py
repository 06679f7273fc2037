"""Queries over the driver's tables, third part: routing, checks, plugin screens, session names, recall output, highlights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hooks as H
from ..functions import routing as RT
from ..operators import graph as G
from ..sources import writers
from . import sqltext as Q
from .queries import memories, query
from .queries_more import _ENTITIES, _sum_case, all_entities
from .views import NOW, view

_SCORE = f"""round(CASE WHEN length(text) < 10 OR {Q.any_match('text', H.CAPTURE_CRON)} OR {Q.any_match('text', H.CAPTURE_LOW_SIGNAL)} THEN 0 ELSE least(1.0::DOUBLE,
  CASE WHEN {Q.any_match('text', H.CAPTURE_DECISIONS)} THEN 0.9::DOUBLE WHEN {Q.any_match('text', H.FEEDBACK)} THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END
  + {_sum_case(('length(text) > 80', 0.05), ('length(text) > 200', 0.05), ('length(text) > 30 AND ' + Q.any_match('text', H.CONFIRMATIONS), 0.1), (Q.any_match('text', H.TROUBLE), 0.1))}) END, 4)::DOUBLE"""
_CLASSES = f"""SELECT *, {_SCORE} AS score, {Q.any_match('text', RT.FEEDBACK)} AS feedback, {Q.any_match('text', H.CAPTURE_DECISIONS)} AS decides, {Q.any_match('text', RT.SELF_CORRECTIONS)} AS corrects,
  {Q.any_match('text', RT.RESULTS)} AS result, text = '' OR starts_with(text, '/') OR {Q.any_match('text', H.CAPTURE_CRON)} OR {Q.any_match('text', RT.LOW_SIGNAL_CAPTURE)} AS dropped
  FROM (SELECT *, {Q.trimmed('text')} AS c FROM (SELECT id, text, CASE WHEN n % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM memories))"""


@query(f""", k AS ({_CLASSES}), r AS (SELECT id, score, decides, CASE WHEN dropped THEN NULL WHEN role = 'user' THEN CASE WHEN feedback THEN 'f' WHEN decides THEN 'd' WHEN length(text) > 15 AND score >= 0.3 THEN 'u' END
  WHEN length(text) > 30 AND corrects THEN 's' WHEN length(text) >= 60 AND (decides OR length(text) >= 80 OR result) THEN 'a' END AS w FROM k)
  SELECT id, CASE w WHEN 'f' THEN 'lesson' WHEN 's' THEN 'lesson' WHEN 'd' THEN 'decision' WHEN 'u' THEN 'user' ELSE 'assistant' END AS category,
  CASE w WHEN 'f' THEN 0.95::DOUBLE WHEN 'd' THEN 0.9::DOUBLE WHEN 's' THEN 0.85::DOUBLE WHEN 'u' THEN score ELSE CASE WHEN decides THEN 0.85::DOUBLE ELSE greatest(0.45::DOUBLE, score) END END AS importance FROM r WHERE w IS NOT NULL""")
def q_route(s, d):
    """Memories in turn as a user's and an agent's messages."""
    role = F.when(F.col("n") % 2 == 0, "user").otherwise("assistant")
    kept = F.array_compact(F.array(RT.route(role, F.col("text"))))  # exploded, not filtered: a filter would work it out a second time
    return memories(s, d).select("id", F.explode(kept).alias("r")).select("id", "r.category", "r.importance")


_FILES = rf"list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(t, '{RT.FILE_NAME}'), regexp_extract_all(t, '{RT.DOT_FILE}', 1))), lambda f: regexp_matches(f, '{RT.KNOWN_FILE}')))"


@query(f"SELECT id, claimed, array_to_string(files, ' ') AS files FROM (SELECT id, (n % 7)::INT AS claimed, {_FILES} AS files FROM (SELECT id, n, 'Updated ' || n % 7 || ' files: a/b.py, .env ' || text AS t FROM memories)) WHERE claimed > 0 AND len(files) BETWEEN 1 AND claimed - 1")
def q_propagation(s, d):
    """A claim of up to six files in front of every text, whose own file names count."""
    claim = F.concat(F.lit("Updated "), (F.col("n") % 7).cast("string"), F.lit(" files: a/b.py, .env "), "text")
    found = memories(s, d).select("id", RT.propagation(claim).alias("p")).where("p IS NOT NULL")
    return found.select("id", "p.claimed", F.array_join(F.array_sort("p.files"), " ").alias("files"))


@query("""SELECT event_id, CASE tool WHEN 'exec' THEN 'service_check-unit-' || session_id || '-service' WHEN 'read' THEN 'feature_check-key-' || event_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE '-' || session_id END ELSE 'tool_check-tool' || event_id % 97 END AS key,
  CASE tool WHEN 'exec' THEN 'unit-' || session_id || '.service' WHEN 'read' THEN 'key_' || event_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE '.' || session_id END ELSE 'tool' || event_id % 97 END || CASE WHEN value > 50 THEN ' not found/not available' ELSE ' exists/is available' END
  || CASE tool WHEN 'exec' THEN ' (verified by service_check)' WHEN 'read' THEN ' (verified by feature_check)' ELSE ' (verified by tool_check)' END AS claim, NOT (value > 50) AS found FROM calls WHERE tool IN ('exec', 'read', 'write')""", ("calls",))
def q_verified_facts(s, d):
    """Checks of the events' own services, keys and tools; large values stand for output that found nothing."""
    n, user = F.col("event_id").cast("string"), F.col("session_id").cast("string")
    key = F.concat(F.lit("grep -rn key_"), n, F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("."), user)), F.lit(" src"))
    command = F.when(F.col("tool") == "exec", F.concat(F.lit("systemctl status unit-"), user, F.lit(".service"))).when(F.col("tool") == "read", key)
    command = command.when(F.col("tool") == "write", F.concat(F.lit("which tool"), (F.col("event_id") % 97).cast("string"))).otherwise("ls")
    output = F.when(F.col("value") > 50, "no such file").otherwise(F.concat(F.lit("fine: "), F.col("value").cast("string")))
    rows = view(s, d, "calls").select("event_id", RT.verified_fact(command, output).alias("f"))
    return rows.where("f IS NOT NULL").select("event_id", "f.key", "f.claim", "f.found")


_SKIPPED = "(" + " OR ".join(f"regexp_matches(text, '{Q.re2(e)}', '{'i' if e.startswith('(?i)') else 'c'}')" for e in RT.SKIPPED) + ")"
_INJECTED = Q.any_match(r"regexp_replace(c, '\s+', ' ', 'g')", RT.SCREENED, "is")


@query(f"""SELECT id, {_INJECTED} AS injected, length(text) BETWEEN 15 AND 2000 AND NOT {_INJECTED} AND NOT {_SKIPPED} AND ({Q.any_match('text', RT.CAPTURES)} OR (length(text) > 80 AND NOT starts_with(text, '```'))) AS captures,
  length(text) >= 15 AND NOT {_SKIPPED} AND {Q.any_match('text', RT.RECALLS)} AS recalls,
  md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped
  FROM (SELECT *, {Q.trimmed('text')} AS c FROM memories)""")
def q_plugin(s, d):
    """T46."""
    x = F.col("text")
    return memories(s, d).select("id", RT.looks_injected(x).alias("injected"), RT.plugin_captures(x).alias("captures"), RT.plugin_recalls(x).alias("recalls"), F.md5(RT.escaped(x)).alias("escaped"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'named' WHEN event_id % 3 = 1 THEN tool WHEN event_id % 2 = 0 THEN 'side' ELSE 'main' END AS agent,
  CASE WHEN event_id % 3 = 1 THEN 'session-' || substr(sha1('agent:' || tool || ':' || session_id), 1, 16) ELSE 'default' END AS namespace FROM calls""", ("calls",))
def q_session_names(s, d):
    """T47."""
    n = F.col("event_id")
    key = F.when(n % 3 == 1, F.concat(F.lit("Agent:"), "tool", F.lit(":"), F.col("session_id").cast("string"))).otherwise("")
    folder = F.when(n % 2 == 0, "/home/x/workspace-side").otherwise("/home/x/workspace")
    return view(s, d, "calls").select("event_id", RT.agent_of(F.when(n % 3 == 0, " Named "), key, folder).alias("agent"), RT.session_namespace(key).alias("namespace"))


_TRANSCRIPTS = "(" + " OR ".join("regexp_matches(text, '{}')".format("(?" + e[2:].replace("'", "''")) for e in RT.TRANSCRIPT) + ")"


@query(f"SELECT id, {Q.any_match('text', RT.CRON_NOISE)} OR {Q.any_match('text', RT.LOW_SIGNAL_RECALL)} OR text = '' AS low_signal, {_TRANSCRIPTS} AS transcript FROM memories")
def q_recall_output(s, d):
    """T48."""
    return memories(s, d).select("id", RT.is_low_signal_recall(F.col("text")).alias("low_signal"), RT.is_transcript(F.col("text")).alias("transcript"))


@query("""SELECT event_id, event_type <> 'error' AS valid, CASE WHEN event_type = 'error' THEN 'schedule' ELSE '' END AS errors,
  concat_ws(',', CASE WHEN event_type = 'view' THEN 'interval' END, CASE WHEN event_id % 4 = 0 THEN 'no timeout' END, CASE WHEN event_id % 4 = 1 THEN 'zero timeout' END, CASE WHEN event_id % 4 = 3 THEN 'long timeout' END) AS warnings,
  CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'health' WHEN 2 THEN 'maintenance' ELSE 'intelligence' END AS tier FROM calls""", ("calls",))
def q_jobs(s, d):
    """Events as scheduled jobs."""
    kind = F.when(F.col("event_type") == "view", "every").when(F.col("event_type") != "error", "cron")
    timeout = F.element_at(F.array(F.lit(None).cast("int"), F.lit(0), F.lit(200), F.lit(3600)), (F.col("event_id") % 4 + 1).cast("int"))
    check = RT.job_check(F.lit("job"), kind, F.lit("0 * * * *"), F.lit(60_000), F.lit(True), F.lit("isolated"), timeout, F.lit("announce"), F.lit(None).cast("string"))
    return view(s, d, "calls").select("event_id", check.alias("c")).select("event_id", "c.valid", F.array_join("c.errors", ",").alias("errors"), F.array_join("c.warnings", ",").alias("warnings"), "c.tier")


_HIGHLIGHTS = f"""{_ENTITIES}, b AS (SELECT * FROM memories WHERE deleted_at IS NULL AND created_at > {NOW} - 90 * 86400 AND importance >= 0.6 AND strength >= 0.5 ORDER BY importance DESC, created_at DESC, id LIMIT 200),
  p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY importance DESC, created_at DESC, id) AS place, trim(replace(text, chr(10), ' '), ' ') AS flat FROM b),
  e AS (SELECT key, label, count(*) AS mentions FROM ent GROUP BY 1, 2)
  SELECT category AS section, place::INT AS place, printf('- **[%s]** (imp:%.2f str:%.1f) %s', strftime(make_timestamp((created_at * 1000000)::BIGINT), '%m/%d %H:%M'), floor(importance * 100 + 0.5::DOUBLE) / 100, floor(strength * 10 + 0.5::DOUBLE) / 10, CASE WHEN length(flat) > 300 THEN substr(flat, 1, 297) || '...' ELSE flat END) AS line FROM p WHERE place <= 50
  UNION ALL SELECT 'Key Entities', place::INT, '- **' || key || '** [' || label || '] — ' || mentions || ' mentions' FROM (SELECT *, row_number() OVER (ORDER BY mentions DESC, label, key) AS place FROM e) WHERE place <= 50"""


@query(_HIGHLIGHTS)
def q_highlights(s, d):
    """A top-k report with its entity section."""
    return writers.highlights(memories(s, d), G.entity_table(all_entities(s, d)), NOW)


@query(_HIGHLIGHTS)
def q_highlights_all(s, d):
    """The same as q_highlights (kept under its earlier name)."""
    m = memories(s, d)
    return writers.highlights(m, G.entity_table(G.entities(m)), NOW)
