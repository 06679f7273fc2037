"""Column expressions for what agents' event hooks decide: capture scores, claims, questions, tool output, temporal phrases."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as T

# Capture (T37), compaction (T40); what names the system itself is left out.
CAPTURE_CRON = [
    r"^\[cron:",
    r"steward-engage",
    r"steward-post",
    r"/steward-",
    r"HEARTBEAT_OK",
]
CAPTURE_DECISIONS = [
    r"\bkarar\b",
    r"yapalım",
    r"yapacağız",
    r"\btamam\b",
    r"anlaştık",
    r"\bdecided\b",
    r"\blet'?s do\b",
]
CAPTURE_LOW_SIGNAL = [
    r"A new session was started via /new or /reset",
    r"Conversation info \(untrusted metadata\)",
    r"\[Subagent Context\]",
    r"^User:\s*Conversation info",
    r"\[System Message\]",
    r"\[Queued announce messages while agent was busy\]",
    r"\bA cron job\b",
    r"\bA subagent task\b",
    r"^System:\s*\[System Message\]",
    r"^System:\s*\[(?:Queued|Internal|Subagent)\b",
    r"(?:system\s+(?:health|watchdog)\s+alert|DOCKER\s+HEALTHY\s+COUNT)",
]
FEEDBACK = [
    r"kaç\s*kere\s*(?:dedim|söyledim)",
    r"neden\s*(?:doğrulamadın|kontrol\s*etmedin|bakmadın)",
    r"bir\s*daha\s*yapma",
    r"hata\s*(?:yaptın|yapıyorsun|tekrar)",
    r"yanlış\s*(?:yaptın|bilgi|söyledin|anladın)",
    r"\bfabrication\b",
    r"güven(?:i|ini)?\s*(?:kaybett|sarsar|kırıl)",
    r"sürekli\s*(?:aynı|böyle|yanlış)",
    r"aa\s*(?:zaten\s*)?varmış",
    r"don'?t\s*(?:repeat|do\s*that|make\s*that)",
    r"never\s*again",
    r"wrong\s*(?:again|info)",
    r"how\s*many\s*times",
    r"hayır\s*öyle\s*değil",
    r"tekrar\s*oku",
    r"bak\s*(?:kaynak|koda|dosyaya)",
    r"(?:neden|niye)\s*kontrol\s*etmedin",
    r"that'?s\s*(?:wrong|incorrect|not\s*right)",
    r"check\s*(?:again|the\s*source|the\s*code)",
    r"no\s*that'?s\s*not",
    r"look\s*at\s*the\s*(?:source|code|file)",
]
CONFIRMATIONS = [r"\b(evet|hayır|tamam|onaylıyorum|hayır yapma|yes|no|confirmed|approved)\b"]
TROUBLE = [r"\b(hata|bug|fix|düzelt|sorun|problem|error)\b"]
COMPACTION_LOW_SIGNAL = [
    r"A new session was started via /new or /reset",
    r"Conversation info \(untrusted metadata\)",
    r"\[Subagent Context\]",
    r"\[System Message\]",
    r"\[Queued announce messages while agent was busy\]",
    r"^\[cron:",
    r"steward-engage",
    r"HEARTBEAT_OK",
    r"^System:\s*\[(?:Queued|Internal|Subagent)\b",
    r"A cron job",
    r"A subagent task",
]
COMPACTION_DECISIONS = [r"\bkarar\b", r"yapalım", r"yapacağız", r"anlaştık", r"\bdecided\b", r"\blet'?s do\b", r"\bagree\b", r"onaylıyorum", r"\bapproved?\b"]
COMPACTION_ERRORS = [r"\bhata\b", r"\bbug\b", r"\bfix\b", r"\bsorun\b", r"\berror\b", r"\bfailed?\b", r"\bcrash\b"]
COMPACTION_PREFERENCES = [r"\bterci[hk]\b", r"\bprefer\b", r"\bher zaman\b", r"\basla\b", r"\balways\b", r"\bnever\b"]
# Claims (T43) as (type, direction, expression).
CLAIMS = [
    ("feature_claim", "negative", r"(?:destekle(?:miyor|nmez|nmedi)|mevcut\s+değil|bulunmuyor)"),
    ("feature_claim", "negative", r"(?:özellik|feature|endpoint|config|service|hook|plugin|api|port|komut)\s+(?:\w+\s+)?yok\b"),
    ("feature_claim", "negative", r"(?:aktif\s+değil|devre\s+dışı|kullanılamaz)\b"),
    ("feature_claim", "negative", r"(?:not\s+support(?:ed)?|doesn'?t\s+(?:have|support|exist|include))"),
    ("feature_claim", "negative", r"(?:not\s+available|not\s+(?:possible|implemented|enabled))"),
    ("feature_claim", "negative", r"(?:there\s+is\s+no|there\s+are\s+no|no\s+(?:support|way)\s+for)"),
    ("feature_claim", "negative", r"(?:cannot|can'?t\s+(?:do|handle|use|run))"),
    ("completion_claim", "positive", r"(?:düzelttim|güncelledim|tamamlandı|hallettim|ekledim)"),
    ("completion_claim", "positive", r"(?:fix(?:le)?dim|deploy\s+ettim|push\s+ettim|commit\s+ettim)"),
    ("completion_claim", "positive", r"(?:I\s+(?:fixed|updated|completed|resolved|patched|deployed|pushed))"),
    ("completion_claim", "positive", r"(?:has\s+been\s+(?:fixed|updated|resolved|deployed|patched))"),
    ("completion_claim", "positive", r"(?:successfully\s+(?:updated|deployed|fixed|patched|completed))"),
    ("config_claim", "config", r"\b[0-9a-f]{32,64}\b"),
    ("credential_claim", "config", r"(?:password|şifre|parola)\s*(?:is|=|:)\s*\S+"),
    ("credential_claim", "config", r"(?:token|api[_-]?key|secret)\s*(?:is|=|:)\s*\S+"),
]
COMMIT_NEARBY = r"(?:commit|sha|hash|ref|merge|cherry)"
SHORT_REPLIES = [
    (r"^(?:evet|hayır|tamam|ok|yes|no|done|✅|👍)\s*$", "(?iu)"),
    (r"^HEARTBEAT", "(?iu)"),
    (r"^NO_REPLY$", ""),
]
# Questions.
TURKISH_QUESTIONS = [
    r"(?:var\s+mı|mevcut\s+mu|destekl(?:iyor|eniyor)\s+mu|çalışıyor\s+mu|aktif\s+mi|açık\s+mı)",
    r"(?:yapabiliyor\s+mu|kullanıyor\s+mu|kullanılabili(?:r|yor)\s+mu)",
    r"(?:nerede|nedir|nasıl|ne\s+zaman|hangi)",
    r"(?:biliyor\s+mu|hatırlıyor\s+mu)",
    r"(?:ne\s+(?:durumda|halde)|durumu\s+ne)",
]
ENGLISH_QUESTIONS = [
    r"(?:does\s+\w+\s+(?:support|have|include|provide|offer))",
    r"(?:is\s+\w+\s+(?:running|active|enabled|supported|available|working))",
    r"(?:can\s+\w+\s+(?:do|handle|process|run|use))",
    r"(?:where\s+is|what\s+is|how\s+(?:does|do|to|is))",
    r"(?:do\s+we\s+have|are\s+there\s+any)",
]
SPECIFIC = [
    r"(?:MCP|hook|plugin|endpoint|API|config|service|cron|database|port)",
    r"(?:Slack|Telegram|Signal|Docker|systemd|nginx)",
    r"(?:feature|özellik|capability|destekle|support)",
    r"(?:password|şifre|credential|secret|key|token)",
    r"(?:fleet|steward|dashboard|monitor)",
]
NOT_ASKED = [
    r"^(?:evet|hayır|tamam|ok|yes|no)\s*$",
    r"^\s*$",
    r"^HEARTBEAT",
    r"^\[cron:",
]
STOP_WORDS = ["bir", "bu", "şu", "o", "ve", "ile", "için", "mi", "mu", "mı", "mü", "var", "yok", "ne", "nasıl", "nerede", "neden", "hangi", "kaç", "the", "a", "an", "is", "are", "does", "do", "have", "has", "can", "what", "where", "how", "when", "which", "who", "in", "on", "at", "to", "for", "with", "from", "by", "of", "it", "this", "that", "we", "you", "they", "our", "your", "my", "its", "mevcut", "destekliyor", "çalışıyor", "kullanıyor", "aktif", "running", "working", "supported", "enabled", "available"]
# Words that searches leave out.
SEARCH_STOP_WORDS = [
    "ve", "bir", "bu", "da", "de", "ile", "için", "icin", "o", "çok", "cok",
    "gibi", "var", "yok", "ne", "ben", "sen", "biz", "siz", "onlar", "ama",
    "ki", "mi", "mu", "mı", "mü", "ya", "hem", "daha", "en", "her",
    "şu", "su", "şey", "sey", "olan", "olarak", "oldu", "olur", "olmuş",
    "bunu", "buna", "bunun", "şunu", "sunu", "onun", "ona",
    "benim", "senin", "bizim", "sizin", "onların", "ise", "kadar",
    "sonra", "önce", "once", "ayrıca", "ayrica", "fakat",
    "üzere", "uzere", "göre", "gore", "bile",
    "ancak", "dolayı", "dolayi", "rağmen", "ragmen", "çünkü", "cunku",
    "eğer", "eger", "hatta", "üstelik", "ustelik",
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "can", "to", "of",
    "in", "for", "on", "with", "at", "by", "from", "it", "this",
    "that", "and", "or", "but", "if", "not", "so", "very",
]
# Mood and unfinished work.
FRUSTRATED = [r"sinirlendim|kızdığım|aptal|neden yapmadın|neden yapmıyorsun|tekrar mı|yine mi|frustrated|annoyed|useless"]
POSITIVE = [r"tamam güzel|harika|süper|mükemmel|great|perfect|awesome|güzel olmuş"]
UNFINISHED = r"(?i)(?:- \[ \]|TODO|bekliyor|kalan|unfinished|remaining)[^\n]{5,80}"
FILES = r"/(?:opt|root|home|etc|var|tmp)/[^\s\])\x22',]{5,80}"


def capture_score(text: Column) -> Column:
    """T37."""
    return T.bound(T.folded(text), lambda low: _capture_score(text, low))


def _capture_score(text: Column, low: Column) -> Column:
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    base = F.when(T.any_match_in(text, low, CAPTURE_DECISIONS), F.lit(0.9)).when(T.any_match_in(text, low, FEEDBACK), F.lit(0.85)).otherwise(F.lit(0.45))
    n = F.length(text)
    score = base + add(n > 80, 0.05) + add(n > 200, 0.05) + add((n > 30) & T.any_match_in(text, low, CONFIRMATIONS), 0.10) + add(T.any_match_in(text, low, TROUBLE), 0.10)
    dropped = (n < 10) | T.any_match_in(text, low, CAPTURE_CRON, "(?i)") | T.any_match_in(text, low, CAPTURE_LOW_SIGNAL, "(?i)")
    return F.when(dropped, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def compaction_score(text: Column, least_chars: int = 15) -> Column:
    """T40."""
    return T.bound(T.folded(text), lambda low: _compaction_score(text, low, least_chars))


def _compaction_score(text: Column, low: Column, least_chars: int) -> Column:
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    score = F.when(T.any_match_in(text, low, COMPACTION_DECISIONS), F.lit(0.9)).otherwise(F.lit(0.4)) + add(T.any_match_in(text, low, COMPACTION_ERRORS), 0.15)
    score = score + add(T.any_match_in(text, low, COMPACTION_PREFERENCES), 0.2) + add(F.length(text) > 100, 0.05) + add(F.length(text) > 300, 0.05)
    return F.when((F.length(text) < least_chars) | T.any_match_in(text, low, COMPACTION_LOW_SIGNAL, "(?i)"), F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def _around(text: Column, at: Column, match: Column, chars: int) -> Column:
    """The match with some characters to each side."""
    start = F.greatest(F.lit(1), at - chars)
    return F.substr(text, start, at + F.length(match) + chars - start)


def _claim_of(claim, kind: str, direction: str):
    return lambda hit: claim(hit, kind, direction)


def claims(text: Column) -> Column:
    """Array of (type, direction, match, context), code left out. Short replies claim nothing, nor do hex digits near a word for commits.

    The context is the match with 50 characters to each side; a configuration claim's match and context are its first 40 and 80.
    """
    without_code = F.regexp_replace(F.regexp_replace(text, r"```[\s\S]*?```", " "), r"`[^`]+`", " ")

    def told(clean: Column) -> Column:
        def claim(hit: Column, kind: str, direction: str) -> Column:
            at = F.instr(clean, hit)
            match, context = hit, T.trimmed(_around(clean, at, hit, 50))
            fits = hit != ""
            if direction == "config":
                match, context = F.substring(hit, 1, 40), F.substring(hit, 1, 80)
            if kind == "config_claim":
                fits = fits & ~_around(clean, at, hit, 30).rlike("(?i)" + COMMIT_NEARBY)
            return F.when(fits, F.struct(F.lit(kind).alias("type"), F.lit(direction).alias("direction"), match.alias("match"), context.alias("context")))

        each = [T.bound(F.regexp_extract(clean, "(?iU)(" + e + ")", 1), _claim_of(claim, kind, direction)) for kind, direction, e in CLAIMS]
        return F.filter(F.array(*each), lambda x: x.isNotNull())

    short = F.coalesce(*(F.when(T.trimmed(text).rlike(flags + e), F.lit(True)) for e, flags in SHORT_REPLIES), F.lit(False))
    found = T.bound(without_code, told)
    return F.when((F.length(text) >= 20) & ~short, found).otherwise(F.slice(found, 1, 0))


def is_question(text: Column) -> Column:
    """T45."""
    asks = T.any_match(text, TURKISH_QUESTIONS) | T.any_match(text, ENGLISH_QUESTIONS) | (F.contains(text, F.lit("?")) & T.any_match(text, SPECIFIC))
    return (F.length(text) >= 8) & ~T.any_match(text, NOT_ASKED) & asks


def keywords(text: Column, most: int = 5) -> Column:
    """The first distinct words beyond two characters that are no stop words."""
    words = F.split(F.lower(F.regexp_replace(text, r"[?!.,;:'\x22()\[\]{}]", " ")), r"\s+")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def tool_category(command: Column) -> Column:
    """T41."""
    return (
        F.when(command.rlike(r"(?i)(?:sed\s+-i|cp|mv|rm|edit|write)\s.*(?:\.env|\.conf|\.service|config)"), F.lit("config_change"))
        .when(command.rlike(r"(?i)systemctl\s+(?:restart|stop|start|enable|disable)"), F.lit("operational_event"))
        .when(command.rlike(r"(?i)docker\s+(?:compose\s+)?(?:up|down|restart|stop|start|build)"), F.lit("operational_event"))
        .when(command.rlike(r"(?i)git\s+push|npm\s+publish"), F.lit("deployment"))
        .when(command.rlike(r"(?i)ufw\s+(?:allow|deny|enable|disable)|iptables|certbot"), F.lit("operational_event"))
    )


def tool_importance(command: Column, output: Column) -> Column:
    """The last kind that fits sets the value, errors lift it."""
    c = F.lower(command)
    kind = (
        F.when(c.rlike(r"ufw|iptables|certbot|chmod|chown"), F.lit(0.80))
        .when(c.rlike(r"git\s+(push|merge|tag)"), F.lit(0.80))
        .when(c.rlike(r"\.env|\.conf|\.service|config"), F.lit(0.75))
        .when(c.rlike(r"deploy|push|publish|release"), F.lit(0.90))
        .when(c.rlike(r"systemctl|service\s|docker"), F.lit(0.80))
        .otherwise(F.lit(0.50))
    )
    return F.when(output.rlike(r"(?i)error|fail|denied|crash|killed|refused"), F.greatest(kind, F.lit(0.85))).otherwise(kind)


def head_and_tail(text: Column, most: int = 2000, head: int = 1200, tail: int = 600) -> Column:
    """Long output keeps its ends."""
    middle = F.format_string("\n...[truncated %d chars]...\n", F.length(text) - head - tail)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), middle, F.right(text, F.lit(tail)))).otherwise(text)


def unfinished(text: Column) -> Column:
    """T44."""
    return F.transform(F.regexp_extract_all(text, F.lit(UNFINISHED), F.lit(0)), lambda x: F.substring(T.trimmed(x), 1, 150))


def files_mentioned(text: Column) -> Column:
    """Paths with an extension."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(FILES), F.lit(0))), lambda x: x.rlike(r"\.\w{1,5}$"))


def moods(messages: DataFrame) -> DataFrame:
    """session_id, mood of the last three user messages."""
    last = messages.where("role = 'user'").withColumn("_r", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))).where("_r <= 3")
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    both = last.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("t"))
    mood = F.when(T.any_match(F.col("t"), FRUSTRATED), "frustrated").when(T.any_match(F.col("t"), POSITIVE), "positive").otherwise("neutral")
    return both.select("session_id", mood.alias("mood"))


# Temporal phrases and keywords (T20), in the order in which they are looked for.
DAY_PHRASES = [
    "evvelsi gün", "evvelsi gun", "dün akşam", "dun aksam", "öbür gün", "obur gun", "bu sabah",
    "dün", "dun", "bugün", "bugun", "yarın", "yarin", "yesterday", "today", "tomorrow",
]
RANGE_PHRASES = ["geçen hafta", "gecen hafta", "geçen ay", "gecen ay", "last week", "last month", "bu hafta", "this week", "bu ay", "this month"]


def temporal_phrases(now: datetime) -> list[tuple[str, bool, datetime, datetime]]:
    """(phrase, whether it must stand alone, start, end) at a moment; longer phrases of days first, then ranges.

    A range of 7 or 30 days begins a week or a calendar month ago, or, for the current one, today.
    """
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    whole = lambda n: (day + timedelta(days=n), day + timedelta(days=n + 1, seconds=-1))
    evening, morning = (day - timedelta(hours=6), day - timedelta(seconds=1)), (day + timedelta(hours=6), day + timedelta(hours=12))
    ahead = {"evvelsi": -2, "öbür": 2, "obur": 2, "dün": -1, "dun": -1, "bugün": 0, "bugun": 0, "yarın": 1, "yarin": 1, "yesterday": -1, "today": 0, "tomorrow": 1}
    special = {"dün akşam": evening, "dun aksam": evening, "bu sabah": morning}
    days = [(p, True, *(special.get(p) or whole(ahead[p.split()[0]]))) for p in DAY_PHRASES]
    first = day.replace(day=1) - timedelta(days=1)
    month_ago = first.replace(day=min(first.day, day.day))
    begins = lambda p: day if p.startswith(("bu", "this")) else (month_ago if p.endswith((" ay", "month")) else day - timedelta(days=7))
    length = lambda p: timedelta(days=30 if p.endswith((" ay", "month")) else 7, seconds=-1)
    return days + [(p, False, begins(p), begins(p) + length(p)) for p in RANGE_PHRASES]


def temporal_range(text: str, now: datetime) -> tuple[datetime, datetime] | None:
    """Start and end of the first temporal phrase of a text."""
    low = text.lower()
    padded = f" {' '.join(low.split())} "
    return next(((a, b) for p, alone, a, b in temporal_phrases(now) if (f" {p} " in padded if alone else p in low)), None)


def temporal_interval(text: Column, now: datetime) -> Column:
    """Struct (start, end) in seconds of the first temporal phrase of each text; null if it has none."""
    seconds = lambda t: (t - datetime(1970, 1, 1)).total_seconds()

    def found(low: Column, padded: Column) -> Column:
        each = [(F.contains(padded, F.lit(f" {p} ")) if alone else F.contains(low, F.lit(p)), a, b) for p, alone, a, b in temporal_phrases(now)]
        return F.coalesce(*(F.when(held, F.struct(F.lit(seconds(a)).alias("start"), F.lit(seconds(b)).alias("end"))) for held, a, b in each))

    return T.bound(F.lower(text), lambda low: T.bound(F.concat(F.lit(" "), F.regexp_replace(low, r"(?U)\s+", " "), F.lit(" ")), lambda padded: found(low, padded)))


def search_tokens(text: Column, distinct: bool = True) -> Column:
    """Words of the lower-cased text, then of its folded copy, beyond one character and without stop words (lemmas need a library that is absent)."""
    low = F.lower(text)
    words = F.regexp_extract_all(F.concat_ws(" ", low, T.ascii_fold(low)), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(SEARCH_STOP_WORDS))
    return F.array_distinct(kept) if distinct else kept
