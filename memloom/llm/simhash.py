"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints with exclusive-or and bit counts.

A fingerprint sums the XXH64 bits of a text's 3-word shingles. Equal fingerprints are folded first, so a group of
copies of any size is one row. Distinct fingerprints are dealt into tiles by the population counts of their two
halves (and split by a digest beyond TILE_ROWS rows). Two fingerprints within the radius differ by at most the radius
in the sum of the two counts' differences, so only tile pairs that near are compared, each pair in one bounded task;
inside it, rows sorted by their quarters' counts let blocks be skipped the same way. The comparison is exact:
no link within the radius is lost. A task gives back a spanning forest of its links instead of all pairs, so a dense
group leaves it in a number of rows linear in its size; components follow from the forests.

Null and word-less texts have fingerprint zero and are linked like any other. Null ids: such rows have a fingerprint
and stand in no one's way (a component's id is the smallest non-null id, null if there is none). Repeated rows are
kept each. A very long text is one row like any other, its shingles counted in portions; empty tables give no rows. Extra
columns are ignored by components(), carried by near_dedup().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, table, written

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Distinct fingerprints of a tile, about, and rows of a block inside a task.
TILE_ROWS, BLOCK = 8192, 256


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and split at the six ASCII white-space bytes
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends[min(SHINGLE, n) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], np.uint64)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        bits += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `kept` and `fp` (the fingerprint's bits as a signed long)."""
    schema = docs.select(*kept).schema.add("fp", "long")

    def run(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], [*kept, "fp"])

    return docs.select(F.col("text").cast("string").alias("_t"), *kept).mapInArrow(run, schema)


def _forest(links_a: np.ndarray, links_b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between rows 0..n-1."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(links_a.tolist(), links_b.tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """Spanning forest (pairs of fingerprints) of the links inside tile `a`, or between `a` and `b`."""

    def sorted_by_counts(x):
        counts = np.bitwise_count(x.view("<u2").reshape(-1, 4)).astype(np.int16)
        order = np.lexsort(counts.T[::-1])
        return x[order], counts[order]

    def ranges(counts):
        cut = range(0, len(counts), BLOCK)
        return np.array([counts[i : i + BLOCK].min(0) for i in cut]), np.array([counts[i : i + BLOCK].max(0) for i in cut])

    same = b is None
    a, count_a = sorted_by_counts(a)
    b, count_b = (a, count_a) if same else sorted_by_counts(b)
    (low_a, high_a), (low_b, high_b) = ranges(count_a), ranges(count_b)
    kept = []
    for i in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            x, y = a[i * BLOCK : (i + 1) * BLOCK], b[j * BLOCK : (j + 1) * BLOCK]
            u, v = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if same and i == j:
                u, v = u[u < v], v[u < v]
            if len(u):
                kept += [(x[p], y[q - len(x)]) for p, q in _forest(u, v + len(x), len(x) + len(y))] if not (same and i == j) else [(x[p], x[q]) for p, q in _forest(u, v, len(x))]
    if not kept:
        return np.zeros((0, 2), np.uint64)
    pairs = np.array(kept, np.uint64)
    nodes, flat = np.unique(pairs, return_inverse=True)
    flat = flat.reshape(-1, 2)
    return np.array([(nodes[p], nodes[q]) for p, q in _forest(flat[:, 0], flat[:, 1], len(nodes))], np.uint64)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect exactly what all links within the radius connect, between distinct fingerprints `fp`.

    A tile is one row with its fingerprints packed; only such rows travel to the tile pairs.
    """
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    high = F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")
    rows = distinct.select("fp", high.alias("hi"), (F.bit_count("fp") - high).cast("int").alias("lo"))
    tiles = rows.groupBy("hi", "lo").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles"))  # at most 33 x 33 rows
    rows = rows.join(F.broadcast(tiles), ["hi", "lo"])
    rows = rows.withColumn("t", F.pmod(F.xxhash64("fp"), "tiles").cast("int")).repartition(spread, "hi", "lo", "t")
    packed = rows.groupBy("hi", "lo", "t", "tiles").agg(F.collect_list("fp").alias("fps"))  # about TILE_ROWS numbers
    # A tile meets itself and each later tile (by hi, lo, t) near enough; `left` tells the two sides of a pair apart.
    later = [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1) if i + abs(j) <= radius and (i, j) >= (0, 0)]
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in later)))
    other = tiles.select(F.col("hi").alias("h2"), F.col("lo").alias("l2"), F.col("tiles").alias("n2"))
    own = packed.withColumn("d", step).withColumns({"h2": F.col("hi") + F.col("d.i"), "l2": F.col("lo") + F.col("d.j")}).join(F.broadcast(other), ["h2", "l2"])
    left = own.withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1))).where("d.i > 0 OR d.j > 0 OR t2 >= t")
    left = left.select("hi", "lo", "t", "h2", "l2", "t2", "fps", F.lit(True).alias("left"))
    back = packed.withColumn("d", step).select(F.col("hi").alias("h2"), F.col("lo").alias("l2"), F.col("t").alias("t2"), (F.col("hi") - F.col("d.i")).alias("hi"), (F.col("lo") - F.col("d.j")).alias("lo"), "d", "fps")
    back = back.join(F.broadcast(tiles), ["hi", "lo"]).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("d.i > 0 OR d.j > 0 OR t2 > t")
    right = back.select("hi", "lo", "t", "h2", "l2", "t2", "fps", F.lit(False).alias("left"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {bool(s): np.asarray(f, np.int64).view(np.uint64) for s, f in zip(pdf["left"], pdf["fps"], strict=True)}
        first = pdf.iloc[0]
        itself = (first["hi"], first["lo"], first["t"]) == (first["h2"], first["l2"], first["t2"])
        found = tile_links(side[True], None if itself else side[False], radius) if True in side and (itself or False in side) else np.zeros((0, 2), np.uint64)
        return pd.DataFrame(found.view(np.int64), columns=["a", "b"])

    key = ["hi", "lo", "t", "h2", "l2", "t2"]
    return left.unionByName(right).repartition(spread, *key).groupBy(*key).applyInPandas(compare, "a long, b long")


def components(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `kept`, `fp` and `component_id`: the smallest doc_id reachable over links (equal fingerprints included)."""
    return rooted(docs, kept).drop("_root")


def rooted(docs: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """components() and `_root`, the component's own key: components may share their smallest doc_id if ids repeat."""
    own = written(fingerprints(docs, tuple(dict.fromkeys([*kept, "doc_id"]))), "fingerprints")
    folded = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(folded.select("fp")))
    placed = folded.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("_root", F.coalesce("root", "fp"))
    least = placed.groupBy("_root").agg(F.min("least").alias("component_id"))
    of = placed.join(least, "_root").select("fp", "component_id", "_root")
    return own.join(of, "fp")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents, one of each component (one of the smallest id, whatever other rows hold that id) and all without id.

    Rows are told apart by id and digest of the text; null and empty texts have the same fingerprint and share one. Of rows
    alike in both the one stays that comes first by the other columns (maps, which have no order, don't count).
    """
    names = docs.columns
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    leaders = rooted(keyed.select("doc_id", "text", "_key"), ("doc_id", "_key")).where("doc_id = component_id")
    leaders = leaders.groupBy("_root", "doc_id").agg(F.min("_key").alias("_key")).select("doc_id", "_key")
    order = W.partitionBy("doc_id", "_key").orderBy(*(c for c, kind in docs.dtypes if c != "doc_id" and "map<" not in kind), "_key")
    kept = keyed.join(leaders, ["doc_id", "_key"], "left_semi").withColumn("_place_of_copy", F.row_number().over(order)).where("_place_of_copy = 1")
    return kept.select(*names).unionByName(docs.where("doc_id IS NULL"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
