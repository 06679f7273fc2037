"""URL filters: list rules, and trust and distrust spread over the graph of hosts, in DataFrame functions only.

A list rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins. Where no rule
fits, the host decides. Trusted seeds are the hosts with allowed pages, blocked seeds those with blocked pages, each by
the share of its pages. Trust spreads along the links between hosts (personalised PageRank), distrust against them: who
links to blocked hosts is distrusted. Both are scaled so that a host without links keeps its seed value. A host is
blocked if its distrust reaches THRESHOLD and exceeds its trust.

Links are counted once a (host, host) pair before they are joined, so pages of a hot host, and links of a hub, fold in
each task before any shuffle; a round is one join on the source host and one combined sum, written to the shared
folder. Without links between hosts there are no rounds.

Null urls and urls without :// have empty host and path, no rule and are allowed. Null html has no links. Repeated
pages count each, ties of trust and distrust allow. Very long urls are judged whole; empty tables give no rows. Null ids
are kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# The list's rules.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hosts of absolute links.
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\x22'](?:[a-z][a-z0-9+.-]*:)?//([^/?#\x22'\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the longest fitting rule and its verdict; null if none fits."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        own = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        fits.append(F.when(own, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    linked = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))
    pairs = pages.select(split_url(F.col("url"))[0].alias("src"), F.explode(linked).alias("dst"))
    return pairs.where("src != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, value: seeds (host, seed) spread along links (src, dst, share), scaled so that without links value = seed."""
    value = seeds.select("host", F.col("seed").alias("value"))
    for _ in range(rounds):
        given = links.join(value.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("value") * F.col("share")).alias("got"))
        value = written(seeds.join(given, "host", "left").select("host", (F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("value")), "spread")
    return value


def host_verdicts(judged: DataFrame, links: DataFrame) -> DataFrame:
    """host, trust, distrust of the hosts of `judged` pages and of the hosts they link to."""
    own = judged.where("host != ''").groupBy("host").agg((F.count_if(F.col("r.verdict") == "allow") / F.count("*")).alias("trusted"), (F.count_if(F.col("r.verdict") == "block") / F.count("*")).alias("blocked"))
    ends = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host"))).distinct()
    hosts = written(own.join(ends, "host", "full").select("host", F.coalesce("trusted", F.lit(0.0)).alias("trusted"), F.coalesce("blocked", F.lit(0.0)).alias("blocked")), "hosts")
    if links.isEmpty():
        return hosts.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    given = links.groupBy("src").agg(F.sum("n").alias("all"))
    taken = links.groupBy("dst").agg(F.sum("n").alias("all"))
    along = links.join(given, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
    against = links.join(taken, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share"))
    trust = spread(hosts.select("host", F.col("trusted").alias("seed")), along).withColumnRenamed("value", "trust")
    distrust = spread(hosts.select("host", F.col("blocked").alias("seed")), against).withColumnRenamed("value", "distrust")
    return trust.join(distrust, "host")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", matched_rule(F.col("host"), F.col("path"), rules))
    links = written(host_links(pages.select("url", "html")), "links")
    bad = host_verdicts(judged, links).where((F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("method"))
    verdict = F.coalesce("r.verdict", "method", F.lit("allow"))
    return judged.join(bad, "host", "left").select("page_id", "host", "path", "r.rule", verdict.alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    cases = {"rule": [], "verdict": []}
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        own = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN"
        cases["rule"].append(f"{own} '{rule}'")
        cases["verdict"].append(f"{own} '{verdict}'")
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    url, link = PARTS.replace("'", "''"), LINK.replace("'", "''")
    ctes = [
        f"p AS (SELECT page_id, {lower(f'''regexp_extract(coalesce(url, ''), '{url}', 1)''')} AS host, regexp_extract(coalesce(url, ''), '{url}', 2) AS path, html FROM pages)",
        f"j AS (SELECT page_id, host, path, CASE {' '.join(cases['rule'])} END AS rule, CASE {' '.join(cases['verdict'])} END AS listed FROM p)",
        f"l AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {lower('unnest(h)')} AS dst FROM (SELECT host, regexp_extract_all(coalesce(html, ''), '{link}', 1) AS h FROM p)) WHERE src <> '' AND src <> dst GROUP BY ALL)",
        "o AS (SELECT host, count(*) FILTER (listed = 'allow') / count(*) AS trusted, count(*) FILTER (listed = 'block') / count(*) AS blocked FROM j WHERE host <> '' GROUP BY host)",
        "h AS (SELECT host, coalesce(trusted, 0) AS trusted, coalesce(blocked, 0) AS blocked FROM o FULL JOIN (SELECT src AS host FROM l UNION SELECT dst FROM l) USING (host))",
        "t0 AS (SELECT host, trusted AS v FROM h)",
        "d0 AS (SELECT host, blocked AS v FROM h)",
    ]
    for k in range(ROUNDS):
        ctes.append(f"t{k + 1} AS (SELECT h.host, trusted + {DAMPING} * coalesce(g, 0) AS v FROM h LEFT JOIN (SELECT dst AS host, sum(v * n / a) AS g FROM l JOIN t{k} ON src = host JOIN (SELECT src AS s, sum(n) AS a FROM l GROUP BY 1) ON s = src GROUP BY 1) x ON x.host = h.host)")
        ctes.append(f"d{k + 1} AS (SELECT h.host, blocked + {DAMPING} * coalesce(g, 0) AS v FROM h LEFT JOIN (SELECT src AS host, sum(v * n / a) AS g FROM l JOIN d{k} ON dst = host JOIN (SELECT dst AS s, sum(n) AS a FROM l GROUP BY 1) ON s = dst GROUP BY 1) x ON x.host = h.host)")
    return f"""WITH {', '.join(ctes)}
SELECT page_id, host, path, rule, coalesce(listed, CASE WHEN d.v >= {THRESHOLD} AND d.v > t.v THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN t{ROUNDS} t USING (host) LEFT JOIN d{ROUNDS} d USING (host)"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE_SQL = {"op1_url_filter": _sql()}
