"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Targets: sources in code-point order (null last) get the weights 5, 2, 1, repeating; they share 150 % of all words
by weight, none above twice its own words, what is cut off is shared again by weight (water-filling).

Queue: each source's documents, shuffled by a digest of their id, are served for as many passes as the cap allows
(two). A document's virtual finish time is the number of its source's words served up to its end, divided by the
source's target. All entries are ordered globally by finish time and cut where the total budget is spent, so each
source ends near its target and any prefix of the order has the target proportions.

Both running sums (within a source, and over the global order) are two-level: sums of small ranges first, a running
sum over those, then running sums inside each range. So a source with a third of all rows, or the global order, is
never one window partition; rows of one range are about ROWS_A_RANGE.

Null texts have size 0. Size 0 gets one entry and takes no words. Null ids, repeated rows: each row is an entry of its
own, ties of the digest go by id and size; equal rows share what they take arbitrarily but the multiset of results is
the same each run. Null sources form one source. An empty table gives no rows. Extra columns are carried by mix() if named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
#: Aimed-at rows of one window partition.
ROWS_A_RANGE = 4096
#: The table of sources is sent to every executor only up to so many rows.
BROADCAST_SOURCES = 10_000

#: Not a space, tab, line feed, vertical tab, form feed or carriage return.
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """The documents with `_size` (words), `_src` (source, null last) and `_dig` (shuffle order)."""
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(SIZE_PATTERN)))
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.withColumns({"_size": size.cast("long"), "_src": key, "_dig": digest})


def targets(sized: DataFrame) -> DataFrame:
    """One row a source: `_src`, `_rows`, `source_size`, `target`, and the totals `_n` (rows) and `_total` (words).

    A source is full if its cap is below its share of what the sources of a smaller cap-to-weight ratio leave; the
    comparison is in whole numbers, so it doesn't depend on rounding. The frame has a row a source, not a document.
    """
    per = sized.groupBy("_src").agg(F.count("*").alias("_rows"), F.sum("_size").alias("source_size"))
    place = (F.row_number().over(W.orderBy("_src")) - 1) % len(WEIGHTS)
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1).cast("long"))
    per = per.withColumn("_cap", F.col("source_size") * CAP)
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_src")
    everything = W.partitionBy(F.lit(1))
    per = per.withColumns({
        "_n": F.sum("_rows").over(everything),
        "_total": F.sum("source_size").over(everything),
        "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_weight_left": F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    budget2 = F.col("_total") * int(2 * BUDGET)
    per = per.withColumn("_full", 2 * F.col("_cap") * F.col("_weight_left") <= F.col("_w") * (budget2 - 2 * F.col("_before")))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything)
    full_caps = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0))
    share = F.col("_w") * (budget2 - 2 * full_caps) / (2 * open_weight)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))
    return per.select("_src", "_rows", "_n", "_total", "source_size", target.alias("target"))


def served(docs: DataFrame, kept: list[str]) -> DataFrame:
    """Every document with its source's figures and `_served`: the source's words up to its end, in shuffled order."""
    sized = sizes(docs).select(*(F.col(c).alias(f"k_{c}") for c in kept), "_size", "_src", "_dig", F.col("doc_id").alias("_id"))
    per_source = written(targets(sizes(docs.select("doc_id", "text", "source"))), "targets")
    few = per_source.count() <= BROADCAST_SOURCES  # beyond that, a shuffled join whose hot sources Spark splits
    sized = sized.join(F.broadcast(per_source) if few else per_source, "_src")
    lead = F.conv(F.substring("_dig", 1, 7), 16, 10).cast("long")
    sized = sized.withColumn("_range", F.floor(lead * F.ceil(F.col("_rows") / ROWS_A_RANGE) / F.lit(16**7)).cast("long"))
    sums = sized.groupBy("_src", "_range").agg(F.sum("_size").alias("_s"))
    earlier = F.sum("_s").over(W.partitionBy("_src").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("_src", "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    inside = W.partitionBy("_src", "_range").orderBy("_dig", "_id", "_size").rowsBetween(W.unboundedPreceding, 0)
    sized = sized.repartition("_src", "_range")
    sized = sized.withColumn("_inside", F.sum("_size").over(inside)).join(sums, ["_src", "_range"])
    return sized.withColumn("_served", F.col("_inside") + F.col("_earlier")).drop("_inside", "_earlier", "_range", "_rows")


def _entry(k) -> Column:
    """Place of the row's entry of pass `k` in the global order."""
    at = (F.col("_served") + k * F.col("source_size")) / F.col("target")
    return F.struct(F.when(F.col("target") > 0, at).otherwise(F.lit(0.0)).alias("finish"), F.col("_src"), F.col("_dig"), F.col("_id"), F.col("_size"), F.lit(k).alias("k"))


def _entries() -> Column:
    every = F.array(*(_entry(k) for k in range(CAP)))
    return F.when(F.col("_size") > 0, every).otherwise(F.slice(every, 1, 1))


def cut(queue: DataFrame):
    """The first entry beyond the budget in the global order (None: all fit).

    Entries are summed by range of finish times; only the range in which the budget ends is then ordered.
    """
    slot = F.floor(F.col("e.finish") * F.greatest(F.lit(1), F.ceil(F.col("_n") * CAP / ROWS_A_RANGE))).cast("long")
    entries = queue.select("_n", "_total", F.explode(_entries()).alias("e")).select("e", slot.alias("slot"), F.floor(F.col("_total") * BUDGET).cast("long").alias("budget"))
    sums = entries.groupBy("slot").agg(F.sum("e._size").alias("s"), F.first("budget").alias("budget"))
    upto = F.sum("s").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    last = sums.withColumn("upto", upto).where("upto > budget").orderBy("slot").select("slot", (F.col("upto") - F.col("s")).alias("before")).first()
    if last is None:
        return None
    running = F.sum("e._size").over(W.partitionBy("slot").orderBy("e").rowsBetween(W.unboundedPreceding, 0)) + last["before"]
    over = entries.where(F.col("slot") == last["slot"]).withColumn("upto", running).where("upto > budget")
    return over.agg(F.min("e").alias("e")).first()["e"]


def decided(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The queue's rows (columns `kept` with k_ in front) with `_copies`, the times that the mix holds the row."""
    queue = written(served(docs, kept), "queue")
    end = cut(queue)
    if end is None:
        return queue.withColumn("_copies", F.size(_entries()))
    source = F.struct(F.lit(end["_src"]["none"]).alias("none"), F.lit(end["_src"]["name"]).alias("name"))
    limit = F.struct(F.lit(end["finish"]).alias("finish"), source.alias("_src"), F.lit(end["_dig"]).alias("_dig"), F.lit(end["_id"]).cast(queue.schema["_id"].dataType).alias("_id"), F.lit(end["_size"]).cast("long").alias("_size"), F.lit(end["k"]).alias("k"))
    return queue.withColumn("_copies", F.size(F.filter(_entries(), lambda e: e < limit)))


def mix(docs: DataFrame, kept: list[str]) -> DataFrame:
    """Columns `kept` of the documents with `size`, `source_size`, `target`, `copies` (times the mix holds the row) and `taken` (words)."""
    own = [F.col(f"k_{c}").alias(c) for c in kept]
    return decided(docs, kept).select(*own, F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    rows = decided(docs, docs.columns).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*(F.col(f"k_{c}").alias(c) for c in docs.columns))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"), ["doc_id"]).drop("copies")


QUERIES = {"op7_mix_sources": op7_mix_sources}
ORACLE_SQL = {
    "op7_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS dig FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left FROM w),
g AS (SELECT *, 2 * cap * weight_left <= w * (3 * total - 2 * before) AS is_full FROM f),
t AS (SELECT source, source_size, total, CASE WHEN is_full THEN cap::DOUBLE ELSE
        (w * (3 * total - 2 * coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)::BIGINT)) / (2 * (sum(CASE WHEN NOT is_full THEN w END) OVER ())::BIGINT) END AS target FROM g),
q AS (SELECT d.doc_id, d.source, d.size, d.dig, t.source_size, t.target, t.total,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.dig, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS served
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, row_number() OVER () AS id FROM q),
e AS (SELECT r.*, k, CASE WHEN target > 0 THEN (served + k * source_size) / target ELSE 0 END AS finish FROM r, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, dig, doc_id NULLS FIRST, size, k ROWS UNBOUNDED PRECEDING) AS spent FROM e)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       coalesce(sum(CASE WHEN spent <= floor(total * 1.5) THEN size END), 0)::BIGINT AS taken FROM o GROUP BY id"""
}
