"""Column expressions for what agents keep of a message: routing, verified facts, plugin screens, session names, recall output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hooks as H
from . import text as T

# Feedback tags, feedback and self-correction markers.
FEEDBACK_TAGS = {
    "verification": [r"neden\s*(?:doğrulamadın|kontrol\s*etmedin|bakmadın)", r"\bverify\b", r"doğrula", r"kontrol\s*et", r"bak\s*(?:kaynak|koda|dosyaya)", r"tekrar\s*(?:oku|bak|kontrol)", r"check\s*again", r"look\s*at\s*the\s*source"],
    "fabrication": [r"\bfabrication\b", r"yanlış\s*(?:bilgi|söyledin|anladın)", r"uydur(?:ma|dun)", r"hayır\s*öyle\s*değil", r"that'?s\s*(?:wrong|incorrect|not\s*(?:right|true))", r"actually,?\s*(?:that'?s|it'?s|you'?re)\s*(?:wrong|incorrect|not)", r"no\s*that'?s\s*not"],
    "premature_suggestion": [r"öner(?:i|im)", r"premature\s*suggestion", r"too\s*early\s*to\s*suggest"],
    "did_not_read_code": [r"kodu\s*(?:okumadın|incelemedin)", r"did\s*not\s*read\s*code", r"read\s*the\s*code\s*first"],
    "context_loss": [r"ne\s*yapmaya\s*çalış(?:ıyordun|tın)", r"context\s*(?:loss|kaybı)", r"az\s*önce\s*(?:söyledim|anlattım|konuştuk)", r"daha\s*(?:yeni|demin)\s*(?:söyledim|konuştuk)", r"we\s*just\s*(?:talked|discussed)"],
}
FEEDBACK = H.FEEDBACK
SELF_CORRECTIONS = [r"yanılmışım", r"pardon,?\s*(?:yanlış|hata)", r"düzeltiyorum", r"hatalıydım", r"yanlış\s*söyledim", r"I\s*was\s*wrong", r"my\s*mistake", r"I\s*(?:was\s*)?incorrect", r"let\s*me\s*correct", r"I\s*(?:should\s*have|need\s*to)\s*(?:check|verify|look)"]
RESULTS = [r"\b(?:plan|next steps?|todo|aksiyon|yapılacak|fix|result|sonuç|tamamlandı|done|verified)\b"]
LOW_SIGNAL_CAPTURE = H.CAPTURE_LOW_SIGNAL
# Claimed counts and file names.
CLAIMED_FILES = [
    r"(\d+)\s*(?:dosya|file|location|yer)\s*(?:güncellen|update|değiştir|changed|modified)",
    r"(?:update[ds]?|güncellen|değiştir|changed|modified)\s*(?:in\s+)?(\d+)\s*(?:dosya|file|location|yer)",
]
FILE_NAME, DOT_FILE = r"[\w/.-]+\.\w{1,10}", r"(?i)(?:^|\s|,|:)(\.env(?:\.\w+)?)\b"
KNOWN_FILE = r"(?i)\.(?:env|conf|json|yaml|yml|toml|py|js|ts|sh|service|cfg|ini)$|^\.env(?:\.\w+)?$"
# Commands that verify something (T42) as (type, expression with the subject as its group).
CHECKS = [
    ("feature_check", r"(?i)\bgrep\s+(?:-[rnilw]+\s+)*['\x22]?(\S+)['\x22]?"),
    ("file_check", r"(?i)\bfind\s+\S+\s+.*-name\s+['\x22]?(\S+)['\x22]?"),
    ("service_check", r"(?i)\bcurl\s+.*(?:health|status|ping|version)()"),
    ("service_check", r"(?i)\bsystemctl\s+(?:--user\s+)?status\s+(\S+)"),
    ("tool_check", r"(?i)\b(?:which|dpkg\s+-l|command\s+-v)\s+(\S+)"),
]
NOTHING_FOUND = r"(?i)no such file|not found|command not found|no matches|error|usage:"
# The plugin's screens.
SCREENED = [r"ignore (?:all|any|previous|above|prior) instructions", r"do not follow (?:the )?(?:system|developer)", r"system prompt", r"developer message", r"<\s*(?:system|assistant|developer|tool|function|relevant-memories)\b", r"\b(?:run|execute|call|invoke)\b.{0,40}\b(?:tool|command)\b"]
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
SKIPPED = [r"(?i)^HEARTBEAT", r"(?i)^\[cron:", r"^NO_REPLY$", r"^/[A-Za-z0-9_]+", r"(?i)A new session was started", r"(?i)Pre-compaction memory flush"]
CAPTURES = [r"\b(?:remember|hatırla|kaydet|note|not al)\b", r"\b(?:karar|decided|decision|agreed|anlaştık|yapalım)\b", r"\b(?:prefer|tercih|always|her zaman|never|asla)\b", r"\b(?:important|önemli|critical|kritik)\b", r"\b(?:rule|kural|policy|politika)\b"]
RECALLS = [
    r"\b(?:hatırla|remember|recall|daha önce|earlier|previously|geçen sefer|last time)\b", r"\b(?:karar|decision|kararlaştır|agreed|anlaştık)\b",
    r"\b(?:ne yapmıştık|what did we|nerede kaldık|where were we)\b", r"\b(?:tercih|preference|always|her zaman|never|asla)\b",
    r"\b(?:config|credential|deploy|push|commit|migration)\b", r"\b(?:lesson|ders|kural|rule|öğren)\b",
    r"\b(?:durum|status|ne oldu|what happened|sorun|problem|issue|bug)\b", r"\?",
]
ASSIGNED = r"(?i)\b(api[_-]?key|token|secret|password|passwd|pwd)\s*[:=]\s*[^\s,;]+"
BEARER, SECRET_KEY = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}", r"\bsk-[A-Za-z0-9_-]{12,}"
# The channel's envelope.
ENVELOPE = r"^System:\s*\[\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}(?::\d{2})?\s+GMT[+-]\d+\]\s*Slack message(?:\s+edited)?\s+in\s+#\S+(?:\s+from\s+[^:]+)?[.:]\s*"
PREAMBLE = r"(?i)^\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}\s+GMT[+-]\d+\]\s*\S+ runtime context \(internal\):[\s\S]*?(?=\n\n|$)"
# Recall output.
CRON_NOISE = [r"^\[cron:", r"steward-engage", r"steward-post", r"/steward-"]
LOW_SIGNAL_RECALL = [
    r"A new session was started via /new or /reset", r"\[Subagent Context\]", r"Conversation info \(untrusted metadata\)", r"^User:\s*Conversation info",
    r"\[System Message\]", r"\[Queued announce messages while agent was busy\]", r"^✅\s*Subagent\s+.+\s+finished", r"\bA cron job\b",
    r"\bA subagent task\b", r"^System:\s*\[System Message\]", r"^System:\s*\[(?:Queued|Internal|Subagent)\b",
]
TRANSCRIPT = [r"(?m)^# Session:", r"(?m)^- \*\*Session Key\*\*:", r"(?m)^## Conversation Summary$", r"(?im)^user:\s*System:\s*\[", r"(?im)^assistant:\s*\[\[reply_to_current\]\]"]
# Scheduled jobs.
TIERS, DELIVERIES = ["health", "maintenance", "intelligence"], ["announce", "channel", "dm", "none"]
LEAST_INTERVAL_MS, MOST_TIMEOUT_S = 1_800_000, 1800


def feedback_tags(text: Column) -> Column:
    """Tags in the order of the list; feedback without a tag counts as verification."""
    return T.bound(T.folded(text), lambda low: _feedback_tags(text, low))


def _feedback_tags(text: Column, low: Column) -> Column:
    tags = F.array_compact(F.array(*(F.when(T.any_match_in(text, low, e), F.lit(tag)) for tag, e in FEEDBACK_TAGS.items())))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("verification")))


def route(role: Column, text: Column) -> Column:
    """Struct (category, importance, prefix) under which a message is kept; null if it is dropped."""
    return T.bound(T.folded(text), lambda low: _route(role, text, low))


def _route(role: Column, text: Column, low: Column) -> Column:
    kept = lambda category, importance, prefix="": F.struct(F.lit(category).alias("category"), F.round(importance, 4).alias("importance"), (prefix if isinstance(prefix, Column) else F.lit(prefix)).alias("prefix"))
    dropped = text.isNull() | (text == "") | text.startswith("/") | T.any_match_in(text, low, H.CAPTURE_CRON, "(?i)") | T.any_match_in(text, low, LOW_SIGNAL_CAPTURE, "(?i)")
    decides, score, n = T.any_match_in(text, low, H.CAPTURE_DECISIONS), H._capture_score(text, low), F.length(text)
    tags = F.array_join(F.transform(_feedback_tags(text, low), lambda t: F.concat(F.lit("[tag="), t, F.lit("]"))), "")
    user = (
        F.when(T.any_match_in(text, low, FEEDBACK), kept("lesson", F.lit(0.95), F.concat(F.lit("[Feedback]"), tags, F.lit(" "))))
        .when(decides, kept("decision", F.lit(0.9), "[Decision] "))
        .when((n > 15) & (score >= 0.3), kept("user", score))
    )
    worth = (n >= 60) & (decides | (n >= 80) | T.any_match_in(text, low, RESULTS))
    assistant = F.when((n > 30) & T.any_match_in(text, low, SELF_CORRECTIONS), kept("lesson", F.lit(0.85), "[Self-Correction] ")).when(
        worth, kept("assistant", F.when(decides, F.lit(0.85)).otherwise(F.greatest(F.lit(0.45), score)))
    )
    return F.when(dropped, F.lit(None)).when(role == "user", user).when(role == "assistant", assistant)


def propagation(text: Column) -> Column:
    """Struct (claimed, files) of a message that claims more changed files than it names; null otherwise."""
    claimed = F.coalesce(*(F.regexp_extract(text, "(?iU)" + e, 1).try_cast("int") for e in CLAIMED_FILES))
    names = F.array_union(F.regexp_extract_all(text, F.lit(FILE_NAME), F.lit(0)), F.regexp_extract_all(text, F.lit(DOT_FILE), F.lit(1)))
    files = F.filter(names, lambda f: f.rlike(KNOWN_FILE))
    return F.when((claimed > 0) & (F.size(files) > 0) & (F.size(files) < claimed), F.struct(claimed.alias("claimed"), files.alias("files")))


def verified_fact(command: Column, output: Column) -> Column:
    """Struct (key, claim, found) of the first check that the command makes; the output itself is never kept. A closing quote stays with the subject."""
    found = ~output.rlike(NOTHING_FOUND)
    facts = []
    for kind, e in CHECKS:
        named = F.regexp_extract(command, e, 1)
        subject = F.when(named == "", F.substring(command, 1, 60)).otherwise(named)
        slug = F.lower(F.regexp_replace(F.regexp_replace(subject, r"[^A-Za-z0-9]+", "-"), r"^-|-$", ""))
        claim = F.concat(subject, F.when(found, " exists/is available").otherwise(" not found/not available"), F.lit(f" (verified by {kind})"))
        facts.append(F.when(command.rlike(e), F.struct(F.concat(F.lit(f"{kind}-"), F.substring(slug, 1, 50)).alias("key"), claim.alias("claim"), found.alias("found"))))
    return F.when((command != "") & (output != ""), F.coalesce(*facts))


def looks_injected(text: Column) -> Column:
    """The recall screen, which is stricter than the one at ingestion."""
    return T.any_match(F.regexp_replace(T.trimmed(text), r"\s+", " "), SCREENED)


def escaped(text: Column) -> Column:
    """The five characters of mark-up as entities; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for char, entity in ENTITIES.items():
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def plugin_captures(text: Column) -> Column:
    """A user's text of 15 to 2,000 characters that is clean and either says so or is long enough."""
    n = F.length(text)
    wanted = T.any_match(text, CAPTURES) | ((n > 80) & ~text.startswith("```"))
    return F.coalesce((n >= 15) & (n <= 2000) & ~looks_injected(text) & ~T.any_match(text, SKIPPED, "") & wanted, F.lit(False))


def plugin_recalls(text: Column) -> Column:
    """T46."""
    return F.coalesce((F.length(text) >= 15) & ~T.any_match(text, SKIPPED, "") & T.any_match(text, RECALLS), F.lit(False))


def compact(text: Column, most: int = 1200) -> Column:
    """Secrets redacted, white space folded, cut with an ellipsis."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), ASSIGNED, "$1=<redacted>")
    out = F.regexp_replace(F.regexp_replace(out, BEARER, "Bearer=<redacted>"), SECRET_KEY, "sk=<redacted>")
    out = F.regexp_replace(T.trimmed(out), r"\s+", " ")
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("..."))).otherwise(out)


def without_envelope(text: Column) -> Column:
    """The channel's header and the runtime's preamble removed."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)" + ENVELOPE, ""), PREAMBLE, "")


def agent_of(agent: Column, session_key: Column, workspace: Column) -> Column:
    """The agent named, else the second part of an `agent:name:...` key, else the workspace folder's suffix, else main."""
    named = F.nullif(F.lower(T.trimmed(agent)), F.lit(""))
    parts = F.filter(F.split(F.lower(T.trimmed(session_key)), ":"), lambda p: p != "")
    keyed = F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "agent"), F.get(parts, F.lit(1)))
    folder = F.nullif(F.regexp_extract(F.coalesce(workspace, F.lit("")), r"(?:^|/)workspace-([^/]*)/?$", 1), F.lit(""))
    return F.coalesce(named, keyed, folder, F.lit("main"))


def session_namespace(session_key: Column) -> Column:
    """`session-` and the first 16 hex digits of the key's SHA-1; `default` without a key."""
    key = F.lower(T.trimmed(session_key))
    return F.when(key == "", F.lit("default")).otherwise(F.concat(F.lit("session-"), F.substring(F.sha1(key), 1, 16)))


def is_low_signal_recall(text: Column) -> Column:
    """T48."""
    return text.isNull() | (text == "") | T.any_match(text, CRON_NOISE, "(?i)") | T.any_match(text, LOW_SIGNAL_RECALL, "(?i)")


def without_low_signal(text: Column) -> Column:
    """Envelopes, metadata blocks and low-signal lines removed, runs of newlines collapsed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "(?im)" + ENVELOPE, "")
    out = F.regexp_replace(out, r"(?i)Conversation info \(untrusted metadata\):\s*```json[\s\S]*?```", "")
    lines = F.filter(F.split(out, "\n"), lambda line: ~T.any_match(line, LOW_SIGNAL_RECALL, "(?i)"))
    return T.trimmed(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def is_transcript(text: Column) -> Column:
    """T48."""
    return T.any_match(F.coalesce(text, F.lit("")), TRANSCRIPT, "")


def job_check(name: Column, kind: Column, expr: Column, every_ms: Column, has_payload: Column, target: Column, timeout_s: Column, delivery: Column, tier: Column) -> Column:
    """Struct (valid, errors, warnings, tier) of a scheduled job; a null `kind` is a missing schedule."""
    said = lambda *rules: F.array_compact(F.array(*(F.when(cond, F.lit(word)) for cond, word in rules)))
    errors = said(
        (T.trimmed(name) == "", "name"),
        (kind.isNull(), "schedule"),
        ((kind == "cron") & (F.coalesce(expr, F.lit("")) == ""), "cron expression"),
        (~has_payload, "payload"),
    )
    warnings = said(
        ((kind == "every") & (F.coalesce(every_ms, F.lit(0)) < LEAST_INTERVAL_MS), "interval"),
        (F.coalesce(target, F.lit("")) == "", "session target"),
        (timeout_s.isNull(), "no timeout"),
        (timeout_s == 0, "zero timeout"),
        (timeout_s > MOST_TIMEOUT_S, "long timeout"),
        (F.coalesce(delivery, F.lit("")) == "", "no delivery"),
        ((delivery != "") & ~delivery.isin(DELIVERIES), "unknown delivery"),
    )
    inferred = F.when(timeout_s < 180, "health").when(timeout_s <= 300, "maintenance").when(timeout_s.isNotNull(), "intelligence").otherwise("unknown")
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"), F.when(tier.isin(TIERS), tier).otherwise(inferred).alias("tier"))
