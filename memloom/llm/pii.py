"""Personal data: pattern spans, checksum validation and context words, in DataFrame functions only.

Per kind, a regular expression proposes leftmost non-overlapping spans. Cards must pass Luhn, IBANs their country's
length and mod 97, IP parts must be at most 255, phones have 10 to 15 digits, a bare social security number counts only
beside a context word. Nearby context words raise a span's score. The kinds email, ip, card and phone are the base; iban
and ssn are added by the method.

Spark has no function for the places of all matches. They follow from the pieces between the matches (split by the same
expression): a match starts after all earlier pieces and matches. Lengths are in code points.

The expressions are written so that Java's matcher needs neither recursion nor quadratic time on long runs: possessive
repeats where no character could be given back, and a start only where a run starts (or at the end of the match before).

Null texts count as empty: no spans, the digest of the empty string, an empty list. Very long texts are searched whole;
spans of one start are in the order of the kinds; empty tables give no rows. Null ids and repeated rows are kept each as
they are. Extra columns are ignored, redact() carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,26}",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
}
#: A character without which there is no match: a cheap test before the expression.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Whole words (or their plurals) near a span.
CONTEXT = {
    "email": "e?mail|contact|write|reach",
    "ip": "ip|host|server|addresse?",
    "card": "card|credit|visa|payment|mastercard",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
#: Score by pattern (and checksum) alone, and what a context word adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.2}
CONTEXT_BONUS, CONTEXT_CHARS, LEAST_SCORE = 0.2, 40, 0.4
# Lengths of IBANs by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

MATCH = "array<struct<s: int, e: int, m: string>>"
SPANS = "array<struct<s: int, k: int, kind: string, e: int, score: double>>"


def located(text: Column, pattern: str, matches: Column) -> Column:
    """The matches with start and end (exclusive), in code points from 0."""

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        out = F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))))
        return F.struct(end.alias("at"), out.cast(MATCH).alias("out"))

    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("p"), matches.alias("m"))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(MATCH).alias("out")), step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN without spaces has remainder 1."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(acc, i):
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 65, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        bare = F.replace(m, F.lit(" "), F.lit(""))
        lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
        return F.coalesce(F.try_element_at(lengths, F.substr(bare, F.lit(1), F.lit(2))) == F.length(bare), F.lit(False)) & mod97(bare)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, scored by the words before and behind them."""
    word = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{CONTEXT[kind]})s?(?:$|[^\p{{L}}\p{{N}}_])"

    def span(x):
        before = F.lower(F.substr(text, F.greatest(F.lit(1), x["s"] + 1 - CONTEXT_CHARS), F.least(F.lit(CONTEXT_CHARS), x["s"])))
        behind = F.lower(F.substr(text, x["e"] + 1, F.lit(CONTEXT_CHARS)))
        score = F.lit(SCORES[kind]) + F.when(before.rlike(word) | behind.rlike(word), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e"), score.alias("score"))

    places = located(text, PATTERNS[kind], F.col(f"_{kind}"))
    spans = F.transform(F.filter(places, lambda x: _valid(kind, x["m"])), span)
    return (spans if kind in BASE_KINDS else F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)).cast(SPANS)


def _of(kind: str) -> Column:
    return F.filter("spans", lambda x: x["kind"] == kind)


def find(docs: DataFrame) -> DataFrame:
    """The documents with `spans`: structs of start `s`, kind number `k`, `kind`, end `e` and `score`, by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    digit = text.rlike("[0-9]")
    out = docs.withColumn("_digit", digit)
    for kind in KINDS:
        may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        may = may if kind == "email" else may & F.col("_digit")
        out = out.withColumn(f"_{kind}", F.when(may, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none))
    found = [F.when(F.size(f"_{kind}") > 0, _spans(text, kind)).otherwise(F.array().cast(SPANS)) for kind in KINDS]
    some = F.size(F.concat(*(F.col(f"_{kind}") for kind in KINDS))) > 0
    spans = F.when(some, F.array_sort(F.concat(*found))).otherwise(F.array().cast(SPANS))
    return out.withColumn("spans", spans).drop("_digit", *(f"_{kind}" for kind in KINDS))


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span of the text replaced by its kind in angle brackets; overlapping spans by the first's."""
    text = F.col("text")

    def step(acc, x):
        part = F.array(F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        parts = F.when(x["s"] >= acc["at"], F.concat(acc["parts"], part)).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), parts.alias("parts"))

    rest = lambda acc: F.array_join(F.concat(acc["parts"], F.array(F.substr(text, acc["at"] + 1))), "")
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), step, rest)
    own = [F.col(f"k_{c}").alias(c) if c != "text" else F.when(F.size("spans") > 0, clean).otherwise(text).alias("text") for c in docs.columns]
    return find(docs.select("text", *(F.col(c).alias(f"k_{c}") for c in docs.columns if c != "text"))).select(*own)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the base kinds, all spans."""
    spans = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(_of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = rendered(F.filter("spans", lambda x: x["k"] < len(BASE_KINDS)))
    scores = F.array_join(F.transform("spans", lambda x: F.format_string("%.1f", x["score"])), ",")
    return spans.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"), scores.alias("scores"))


# Plain forms of the patterns for RE2, which needs no guard against long runs.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,26}",
}


def _sql() -> str:
    """One branch a kind: pieces and matches, lists summed to places, then the checks. ssn needs a look at both sides, which RE2 lacks; its matches are tested in the test suite."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * substr(reverse({digits}), i, 1)::INT) // 10 + (2 * substr(reverse({digits}), i, 1)::INT) % 10 ELSE substr(reverse({digits}), i, 1)::INT END)) % 10 = 0"
    bare = "replace(m, ' ', '')"
    number = f"list_aggregate(list_transform(range(1, length({bare}) + 1), lambda i: CASE WHEN substr(substr({bare}, 5) || substr({bare}, 1, 4), i, 1) ~ '[0-9]' THEN substr(substr({bare}, 5) || substr({bare}, 1, 4), i, 1) ELSE (ascii(substr(substr({bare}, 5) || substr({bare}, 1, 4), i, 1)) - 55)::VARCHAR END), 'string_agg', '')"
    remainder = f"list_reduce(list_prepend(0, list_transform(string_split({number}, ''), lambda c: c::INT)), lambda a, b: (a * 10 + b) % 97) = 1"
    lengths = " OR ".join(f"(m[1:2] = '{c}' AND length({bare}) = {n})" for c, n in IBAN_LENGTHS.items())
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"({lengths}) AND {remainder}",
    }
    branches = []
    for k, kind in enumerate(KINDS[:5]):
        p = _SQL_PATTERNS[kind]
        word = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{CONTEXT[kind]})s?(?:$|[^\p{{L}}\p{{N}}_])"
        near = f"regexp_matches(lower(substr(text, greatest(1, s + 1 - {CONTEXT_CHARS}), least({CONTEXT_CHARS}, s))), '{word}') OR regexp_matches(lower(substr(text, s + length(m) + 1, {CONTEXT_CHARS})), '{word}')"
        branches.append(f"""SELECT rid, {k} AS k, '{kind}' AS kind, s, s + length(m) AS e, {SCORES[kind]} + CASE WHEN {near} THEN {CONTEXT_BONUS} ELSE 0 END AS score FROM (
  SELECT rid, text, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT rid, text, ps, ms, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT rid, text, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM d) WHERE len(ms) > 0)) WHERE {checks[kind]}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({' UNION ALL '.join(branches)})
SELECT any_value(doc_id) AS doc_id, {counts},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans, coalesce(string_agg(printf('%.1f', score::DOUBLE), ',' ORDER BY s, k), '') AS scores
FROM d LEFT JOIN x USING (rid) GROUP BY rid"""


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL = {"op6_pii": _sql()}
