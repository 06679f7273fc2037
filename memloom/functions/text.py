"""Column expressions over memory texts: cleaning, classification, scoring, extraction. All JVM-side."""

from __future__ import annotations

import re
import re._parser as parser
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import scan as SC


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def folded(text: Column) -> Column:
    """The text as case-insensitive matching sees it: lower case, dotless i as i, long s as s, without the dot that lower-casing leaves behind."""
    low = F.lower(text)
    for old, new in (("ı", "i"), ("ſ", "s"), ("\u0307", "")):
        low = F.replace(low, F.lit(old), F.lit(new))
    return low


def fold_expression(e: str) -> str:
    """An expression that matches folded texts where the given one matches whatever the case."""
    return re.sub(r"\\.|[^\\]+", lambda m: m[0] if m[0][0] == "\\" else m[0].lower().replace("ı", "i").replace("\u0307", ""), e, flags=re.S)


def _literal(e: str) -> str | None:
    """The text that an expression stands for, if it is a plain one."""
    plain = re.sub(r"\\([^A-Za-z0-9])", r"\1", e)
    return plain if re.fullmatch(r"(?:[^\\.^$*+?{}\[\]|()]|\\[^A-Za-z0-9])+", e) else None


def closing(e: str, start: int = 0) -> int:
    """Place of the bracket that closes the one at `start`."""
    depth, i, inside = 0, start, False
    while i < len(e):
        if e[i] == "\\":
            i += 1
        elif inside:
            inside = e[i] != "]"
        elif e[i] == "[":
            inside = True
        elif e[i] == "(":
            depth += 1
        elif e[i] == ")":
            depth -= 1
            if not depth:
                return i
        i += 1
    raise ValueError(e)


def _spread(e: str) -> list[str]:
    """(?:a|b)c as ac and bc, so that alternatives can be told by how they begin."""
    if not e.startswith("(?:"):
        return [e]
    end = closing(e)
    body, rest = e[3:end], e[end + 1 :]
    if re.search(r"[(\[\\]", body) or rest[:1] in ("?", "*", "+", "{"):
        return [e]
    return [alternative + rest for alternative in body.split("|")]


def _joined(expressions: list[str]) -> str:
    """One alternation for a test of existence: alternatives behind a word boundary or a word share that, others their first letter."""
    groups: dict[str, list[str]] = defaultdict(list)
    for e in (x for e in expressions for x in _spread(e)):
        if e.startswith(r"\b"):
            groups[r"\b"].append(e[2:])
        elif e.startswith(r"\w+\s+"):
            groups[r"\w\s+"].append(e[6:])
        elif len(e) > 1 and e[0].isalpha() and e[1] not in "?*+{|":
            groups[e[0]].append(e[1:])
        else:
            groups[""].append(e)
    return "|".join(f"{head}(?:{'|'.join(tails)})" if head else "|".join(tails) for head, tails in groups.items())


def cues(expressions: list[str]) -> list[str]:
    """Folded texts one of which every text holds that an expression matches, the longest that can be told; none if some expression has none."""

    def least(words: list[str] | None) -> int:
        return min(map(len, words)) if words else 0

    def of(sequence) -> list[str] | None:
        best, run = None, ""
        for op, value in [*sequence, (None, None)]:
            if op is parser.LITERAL:
                run += chr(value)
                continue
            found = None
            if op is parser.SUBPATTERN:
                found = of(value[-1])
            elif op is parser.BRANCH:
                each = [of(b) for b in value[1]]
                found = [w for ws in each for w in ws] if all(each) else None
            elif op is parser.MAX_REPEAT and value[0]:
                found = of(value[2])
            best, run = max(best, [run] if run else None, found, key=least), ""
        return best

    each = [of(parser.parse(e)) for e in expressions]
    fold = lambda w: w.lower().replace("ı", "i").replace("ſ", "s").replace("\u0307", "")
    return list(dict.fromkeys(fold(w) for ws in each for w in ws)) if all(each) else []


def any_match_in(text: Column, low: Column, expressions: list[str], flags: str = "(?iU)") -> Column:
    """any_match() of a text, put only to those whose folded form holds what a match must hold."""
    return F.when(any_of(low, cues(expressions)), any_match(text, expressions, flags)).otherwise(F.lit(False))


def matches(low: Column, expressions: list[str], whole_words: bool = False) -> Column:
    """Whether one of the case-insensitive expressions matches the folded text: plain ones are substrings, the rest is one alternation.

    A trailing run of word characters changes nothing for a test, so it is left out.
    """
    each = [re.sub(r"\\w\*$", "", fold_expression(e)) for e in expressions]
    tested = lambda es, test: F.when(any_of(low, held), test).otherwise(F.lit(False)) if (held := cues(es)) else test
    if whole_words:
        return tested(each, F.coalesce(low.rlike(rf"(?dU)\b(?:{'|'.join(each)})\b"), F.lit(False)))
    words = [w for e in each if (w := _literal(e)) is not None]
    rest = [e for e in each if _literal(e) is None]
    test = tested(rest, F.coalesce(low.rlike("(?dU)" + _joined(rest)), F.lit(False))) if rest else F.lit(False)
    return any_of(low, words) | test if words else test


def any_match(text: Column, expressions: list[str], flags: str = "(?iU)") -> Column:
    return F.coalesce(text.rlike(flags + "|".join(f"(?:{e})" for e in expressions)), F.lit(False))


def any_of(text: Column, words: list[str]) -> Column:
    """True if one of the words is a substring; words that hold another one say nothing more."""
    words = [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(True)) for w in words], F.lit(False))


def trimmed(text: Column) -> Column:
    base = F.coalesce(text, F.lit(""))
    edges = F.concat(F.substring(base, 1, 1), F.substring(base, -1, 1))
    return F.when(edges.rlike(r"[\s\u0085\u2028\u2029]"), F.regexp_replace(base, r"^\s+|\s+$", "")).otherwise(base)


def chunk_id(text: Column) -> Column:
    """First 16 hex digits of the text's MD5."""
    return F.substring(F.md5(text), 1, 16)


def estimate_tokens(text: Column) -> Column:
    """Characters / 4, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def strip_wrappers(text: Column) -> Column:
    """Transport wrappers removed, runs of newlines collapsed; trimmed only where something changed."""
    base = F.coalesce(text, F.lit(""))
    clean = F.replace(base, F.lit("\r\n"), F.lit("\n"))
    for e in P.WRAPPERS:
        clean = F.regexp_replace(clean, e, "")
    changed = clean != base
    clean = F.regexp_replace(clean, r"\n{3,}", "\n\n")
    return F.when(changed, trimmed(clean)).otherwise(clean)


def sanitize(text: Column) -> Column:
    """Injection phrases redacted, the text then marked."""
    clean = text
    for e in P.INJECTIONS:
        clean = F.regexp_replace(clean, "(?i)" + e, "[REDACTED]")
    return F.when(any_match(text, P.INJECTIONS, "(?i)"), F.concat(F.lit("[SANITIZED] "), clean)).otherwise(text)


def normalize(text: Column) -> Column:
    """T3."""
    return sanitize(strip_wrappers(text))


def is_low_signal(text: Column) -> Column:
    """T4."""
    clean = trimmed(text)
    return (F.length(clean) < 3) | any_match(clean, P.LOW_SIGNAL, "(?i)")


def should_skip(text: Column, role: Column) -> Column:
    """T5."""
    clean = trimmed(text)
    starts = F.coalesce(*[F.when(clean.startswith(p), F.lit(True)) for p in P.SKIP_PREFIXES], F.lit(False))
    return (F.length(clean) < 3) | starts | F.coalesce(role == "system", F.lit(False)) | any_match(clean, P.NOISE, "(?i)")


def is_config_change(text: Column) -> Column:
    """T7."""
    return bound(folded(text), _config_change)


def is_observation(text: Column) -> Column:
    return bound(folded(text), lambda low: _observation(low, text))


def is_operation(text: Column) -> Column:
    """T8."""
    return bound(folded(text), lambda low: _operation(low, text))


def is_incident(text: Column) -> Column:
    """T9."""
    return bound(folded(text), _incident)


def is_deployment(text: Column) -> Column:
    """T10."""
    return bound(folded(text), lambda low: matches(low, P.DEPLOYMENT))


def is_verification(text: Column) -> Column:
    """T11."""
    return bound(folded(text), lambda low: matches(low, P.VERIFICATION))


def _config_change(low: Column) -> Column:
    return matches(low, P.CONFIG_VERBS) & matches(low, P.CONFIG_NOUNS)


def _observation(low: Column, text: Column) -> Column:
    clean = F.regexp_replace(text, r"\s+$", "")
    particle = text.rlike(P.QUESTION_PARTICLE) & ~F.contains(text, F.lit("?"))
    return matches(low, P.OBSERVATION) | particle | clean.endswith("?")


def _operation(low: Column, text: Column) -> Column:
    return matches(low, P.OPS_VERBS) & matches(low, P.OPS_NOUNS) & ~_observation(low, text)


def _incident(low: Column) -> Column:
    return matches(low, P.INCIDENT_VERBS) & matches(low, P.INCIDENT_NOUNS)


def has_safeword(text: Column) -> Column:
    return any_match(text, P.SAFEWORDS)


def rule_confidence(text: Column) -> Column:
    """Confidence that a text is a directive; null if it is none."""
    return bound(trimmed(text), lambda clean: bound(folded(clean), lambda low: _rule(low, clean)))


def _rule(low: Column, clean: Column) -> Column:
    """Long texts are told by their size first: 50 words and what lies between them."""
    few = F.regexp_count(clean, F.lit(r"(?U)\S+")) <= 50
    found = F.when(matches(low, P.TURKISH_RULES), F.lit(0.92)).when(matches(low, P.ENGLISH_RULES), F.lit(0.90))
    return F.when(few & ~matches(low, P.NOT_RULES), found)


def memory_type(text: Column) -> Column:
    """Lesson, then operational (other), rule, fact, preference, conversation."""

    def told(c: Column, low: Column) -> Column:
        operational = matches(low, P.DECISION) | _incident(low) | _config_change(low) | _operation(low, c) | matches(low, P.DEPLOYMENT) | matches(low, P.VERIFICATION)
        return (
            F.when(c == "", F.lit("conversation"))
            .when(matches(low, P.LESSON, whole_words=True), F.lit("lesson"))
            .when(operational, F.lit("other"))
            .when(_rule(low, c).isNotNull() | matches(low, P.SAFEWORDS), F.lit("rule"))
            .when(c.rlike(P.NAME) | matches(low, P.FACTUAL, whole_words=True), F.lit("fact"))
            .when(matches(low, P.PREFERENCE, whole_words=True), F.lit("preference"))
            .otherwise(F.lit("conversation"))
        )

    return bound(trimmed(text), lambda c: bound(folded(c), lambda low: told(c, low)))


def normalize_type(kind: Column) -> Column:
    """T25."""
    clean = F.lower(F.trim(kind))
    return F.when(clean.isin(P.MEMORY_TYPES), clean).otherwise(F.lit("other"))


def is_cron(text: Column) -> Column:
    return matches(folded(text), P.CRON)


def importance(text: Column, role: Column | None = None, source: Column | None = None) -> Column:
    """Base 0.35 with markers, caps for cron output, a floor for decisions, within [0.05, 1]."""
    role = F.lit("") if role is None else F.coalesce(role, F.lit(""))
    source = F.lit("") if source is None else F.coalesce(source, F.lit(""))
    low = lambda text: F.lower(trimmed(text))
    cued = tuple(map(cues, (P.TURKISH_DECISIONS, P.CRON, P.CONVERSATION_SOURCES, P.SYSTEM_NOISE)))
    signs = SC.importance_signs(text, F.lower(text), cued)
    return bound(signs, lambda found: bound(low(text), lambda low: _points(text, low, found, role, source)))


def _points(text: Column, low: Column, found: Column, role: Column, source: Column) -> Column:
    """`found`: SC.importance_signs(); expressions are put only to texts that hold what a match must hold."""
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    holds = lambda i: SC.bit(found["held"], i)
    if_held = lambda i, test: F.when(holds(i), test).otherwise(F.lit(False))
    agreed = if_held(4, low.rlike("(?dU)" + _joined(P.TURKISH_DECISIONS)))
    cron = if_held(5, bound(folded(text), lambda fold: matches(fold, P.CRON))) | (source == "cron")
    label = F.contains(folded(text), F.lit("conversation info")) & any_match(text, P.CONVERSATION_SOURCES[1:], "(?i)")
    talk = if_held(6, bound(folded(text), lambda fold: matches(fold, P.CONVERSATION_SOURCES[:1])) | label) | source.isin("slack-dm", "whatsapp")
    score = F.lit(0.35) + add(talk, 0.15) + add(F.contains(text, F.lit("?")) & (F.length(text) > 10), 0.05)
    score = score + add(holds(1), 0.25) + add(holds(0), 0.20)
    grow = lambda score, agreed: score + add(agreed, 0.20) + add(holds(2), 0.15) + add(holds(3), 0.20) + F.least(F.lit(0.10), found["names"] * 0.02)
    size = lambda words: F.when(words > 150, F.lit(0.08)).when(words > 80, F.lit(0.04)).when(words < 8, F.lit(-0.05)).otherwise(F.lit(0.0))
    rest = lambda score: score + size(found["words"]) + add(role == "user", 0.05) + add(role == "qa_pair", 0.08)
    kept = lambda x, agreed: F.when(cron, F.least(x, F.lit(0.30))).when(holds(0) | agreed, F.greatest(x, F.lit(0.70))).otherwise(x)
    capped = bound(agreed, lambda agreed: bound(rest(grow(score, agreed)), lambda x: kept(x, agreed)))
    # a letter behind the 20th character leaves none of the trivial forms
    trivial = F.when(F.substring(low, 21, 20).rlike(r"\p{L}"), F.lit(False)).otherwise(any_match(low, P.TRIVIAL, "(?U)"))
    noise = F.when(trivial, F.lit(0.05)).when(if_held(7, matches(low, P.SYSTEM_NOISE)), F.lit(0.10))
    return F.coalesce(noise, F.greatest(F.lit(0.05), F.least(F.lit(1.0), capped)))


def should_recall(text: Column) -> Column:
    """Whether a message asks for a look into memory."""
    return bound(trimmed(text), lambda clean: bound(folded(clean), lambda low: _asks(text, clean, low)))


def _asks(text: Column, clean: Column, low: Column) -> Column:
    symbols = (F.length(clean) <= 4) & ~clean.rlike(r"\p{L}")
    never = any_match(clean, P.NOT_TRIGGERS) | (F.length(clean) < 3) | F.lower(clean).isin(P.GENERIC) | symbols
    asks = matches(low, P.TURKISH_TRIGGERS) | matches(low, P.ENGLISH_TRIGGERS) | (F.contains(text, F.lit("?")) & (F.length(text) > 10)) | matches(low, P.PAST_TENSE)
    return ~never & asks


def confidence_tier(score: Column) -> Column:
    """T15."""
    return F.when(score > 0.85, F.lit("HIGH")).when(score >= 0.60, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def ascii_fold(text: Column) -> Column:
    """T17."""
    return F.translate(text, "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")


def normalize_query(text: Column) -> Column:
    """K4."""
    flat = F.regexp_replace(trimmed(F.lower(text)), r"\s+", " ")
    return F.trim(F.regexp_replace(flat, r"[?!.,;:]+$", ""))


def query_tokens(text: Column) -> Column:
    """K1: distinct lower-cased words of a query, dots and hyphens inside kept."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+(?:[.-]\w+)*"), F.lit(0)))


def rerank_tokens(text: Column) -> Column:
    """K5: distinct words of at least three characters."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))), lambda t: F.length(t) >= 3)


def lexical_overlap(query: Column, text: Column) -> Column:
    """K5: share of the query's tokens in the first 4000 characters."""
    q, d = rerank_tokens(query), rerank_tokens(F.substring(text, 1, 4000))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(F.lit(0.0))


def query_entities(text: Column) -> Column:
    """Quoted phrases, then capitalised spans of up to three words."""
    quoted = F.regexp_extract_all(text, F.lit("[\"“”']([^\"“”']{2,80})[\"“”']"), F.lit(1))
    spans = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-ZÇĞİÖŞÜ][\w.-]*(?:\s+[A-ZÇĞİÖŞÜ][\w.-]*){0,2}\b"), F.lit(0))
    clean = F.transform(F.concat(quoted, spans), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s\"'“”‘’.:,;!?()\[\]{}]+|[\s\"'“”‘’.:,;!?()\[\]{}]+$", ""), r"\s+", " "))
    return F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 2))


def type_intent(text: Column) -> Column:
    """Memory type named by the query: lesson before rule before preference."""
    low = F.lower(text)
    edge = "[a-zçğıöşü0-9]"
    named = lambda kind: low.rlike(f"(?<!{edge})(?:{'|'.join(P.TYPE_KEYWORDS[kind])})(?!{edge})")
    return F.when(named("lesson"), F.lit("lesson")).when(named("rule"), F.lit("rule")).when(named("preference"), F.lit("preference"))


def redact_secrets(text: Column) -> Column:
    """T36."""
    for expression, replacement in P.SECRETS:
        text = F.regexp_replace(text, expression, replacement)
    return text


def secret_count(text: Column) -> Column:
    """Matches of the secret patterns."""
    return sum((F.regexp_count(text, F.lit(e)) for e, _ in P.SECRETS), F.lit(0))


def summary(text: Column, limit: int = 300) -> Column:
    """Leading sentences up to `limit` characters, the first one whole."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?]\s+|\n"), trimmed), lambda s: s != "")

    def add(acc, s):
        fits = F.length(acc["text"]) + F.length(s) < limit
        grown = F.when(acc["text"] == "", s).when(fits & ~acc["over"], F.concat(acc["text"], F.lit(". "), s)).otherwise(acc["text"])
        return F.struct(grown.alias("text"), (acc["over"] | ((acc["text"] != "") & ~fits)).alias("over"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("over"))
    return F.aggregate(sentences, start, add, lambda acc: acc["text"])


def resolve_alias(name: Column) -> Column:
    """Canonical form of an informal name, else the name.

    Names of three characters and more also count if a ratio of 80 ties them to an informal one. With keys of two or three
    characters that is a name with one character more.
    """
    low = F.lower(F.trim(name))
    pairs = F.create_map(*(F.lit(x) for pair in P.ALIASES.items() for x in pair))
    near = [F.when(low.rlike("^(?s)(?:" + "|".join(f"{re.escape(k[:i])}.{re.escape(k[i:])}" for i in range(len(k) + 1)) + ")$"), F.lit(full)) for k, full in P.ALIASES.items()]
    return F.coalesce(F.try_element_at(pairs, low), *near, name)
