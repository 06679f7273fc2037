"""Exact top-k by integer inner product over a bit-sliced index.

Vectors are quantised to whole numbers, floor(256 * x). Rows are dealt by a digest of their id into blocks of bounded
size; a block's index holds, for each attribute and bit, one bitmap over its rows. For a query, the slices of each
attribute, shifted by the bits of the query's component (complemented for a negative one), are summed by carry-save
adders on bitmaps into the slices of the score. The best rows are then chosen from the most significant slice
downward; rows that tie at the boundary share one score exactly and are resolved by the smaller id.

Every query meets every block (a stated query set against all rows, in blocks): the packed queries of a chunk are
copied to the blocks, never rows to queries, and each (block, chunk) is one bounded task. Only k rows of a query and
block leave it; ranks over the blocks come last.

Sizes. Components below NARROW in size give scores that fit a long. Larger ones (any finite value takes part) have
blocks of their own with as many slices as their numbers need; bits and sums are then whole numbers of any size. Scores
beyond a long are given as the largest or least one (+-(2^63 - 1)), but ranked by their true value.

Defined cases: vectors that are null, hold null or non-finite components or have no id take no part. Shorter vectors
count as filled up with zeros. Rows of the query's own id are no candidates; of several rows with a query's id the
smallest vector asks. Repeated candidates count each. An empty vector scores 0 everywhere. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SCALE, K = 256, 5
#: Rows of a block and queries of a chunk, about; both bound a task's memory.
BLOCK_ROWS, CHUNK_QUERIES = 8192, 256
#: Components below this size and vectors of at most so many of them have scores within a long.
NARROW, NARROW_SIZE = 2.0**15, 2**15
LARGEST = 2**63 - 1

INDEX = "dim int, wide boolean, block long, ids binary, least array<string>, bits int, slices binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, `x` (array of double), `dim` and `wide` of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fit = fit.where(F.forall("x", lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))))
    wide = F.exists("x", lambda v: F.abs(v) >= NARROW) | (F.size("x") > NARROW_SIZE)
    return fit.select("vec_id", "x", F.size("x").alias("dim"), wide.alias("wide"))


def quantised(x: list[float]) -> list[int]:
    """Whole numbers floor(256 * x) of any size."""
    return [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(SCALE * v) for v in x]


def _pack(flags: np.ndarray) -> np.ndarray:
    """Bitmaps (64-bit words) of 0/1 rows."""
    wide = -(-flags.shape[-1] // 64) * 64
    padded = np.zeros((*flags.shape[:-1], wide), np.uint8)
    padded[..., : flags.shape[-1]] = flags
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def _bits_of(numbers: list[int], bits: int) -> np.ndarray:
    """Bits (the least first) x numbers."""
    size = -(-bits // 8)
    raw = np.frombuffer(b"".join(n.to_bytes(size, "little") for n in numbers), np.uint8).reshape(len(numbers), size)
    return np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].T


def build_index(rows: DataFrame) -> DataFrame:
    """One row a block: sorted ids, the attributes' minima and their slices above those."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        dim, wide, block = key
        if wide:
            columns = list(zip(*(quantised(x) for x in pdf["x"]), strict=True))
            least = [min(c) for c in columns]
            bits = max(1, max((max(c) - m for c, m in zip(columns, least, strict=True)), default=0).bit_length())
            slices = [_pack(_bits_of([v - m for v in c], bits)) for c, m in zip(columns, least, strict=True)]
        else:
            x = np.floor(SCALE * np.array(pdf["x"].tolist(), float).reshape(len(pdf), dim)).astype(np.int64).T
            least = x.min(axis=1, initial=2**62)
            x = x - least[:, None]
            bits = max(1, int(x.max(initial=0)).bit_length())
            slices = np.stack([_pack(((x >> b) & 1).astype(np.uint8)) for b in range(bits)], axis=1)  # attribute, bit, word
        raw = b"".join(s.tobytes() for s in slices)
        return pd.DataFrame({"dim": [dim], "wide": [wide], "block": [block], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "least": [[str(m) for m in least]], "bits": [bits], "slices": [raw]})

    return rows.groupBy("dim", "wide", "block").applyInPandas(build, INDEX)


def add_slices(levels: dict[int, np.ndarray], words: int) -> list[np.ndarray]:
    """Score slices from bitmaps by weight: levels[w] holds those that count 2^w. Carry-save adders, then the rest."""
    out, w = [], 0
    while levels:
        x = levels.pop(w, np.zeros((0, words), np.uint64))
        while len(x) > 1:
            if len(x) == 2:
                carry, x = (x[0] & x[1])[None], (x[0] ^ x[1])[None]
            else:
                n = len(x) // 3 * 3
                a, b, c = x[0:n:3], x[1:n:3], x[2:n:3]
                half = a ^ b
                carry, x = (a & b) | (c & half), np.concatenate([half ^ c, x[n:]])
            levels[w + 1] = np.concatenate([levels[w + 1], carry]) if w + 1 in levels else carry
        out.append(x[0] if len(x) else np.zeros(words, np.uint64))
        w += 1
    return out


def top_rows(score: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows: certain ones from the top slice down, ties of the boundary by place."""
    count = lambda m: int(np.bitwise_count(m).sum())
    places = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    sure, tied = np.zeros_like(alive), alive
    for s in reversed(score):
        ahead = sure | (tied & s)
        n = count(ahead)
        if n >= k:
            tied = tied & s
        else:
            sure, tied = ahead, tied & ~s
        if n == k:
            return places(sure | tied)
    return np.concatenate([at := places(sure), places(tied)[: k - len(at)]])


def search_block(ids: np.ndarray, least: list[int], slices: np.ndarray, queries: list[tuple[int, list[int]]], k: int):
    """For each query (id, components): places of its best rows and their scores, whole numbers of any size."""
    dims, bits, words = slices.shape
    both = np.concatenate([slices.reshape(dims * bits, words), ~slices.reshape(dims * bits, words)])
    full = (1 << bits) - 1
    everyone = _pack(np.ones(len(ids), np.uint8))
    for query_id, q in queries:
        q = (q + [0] * dims)[:dims]
        sizes = [abs(v) for v in q]
        most = max(sizes, default=0).bit_length()
        set_bits = _bits_of(sizes, most) if most else np.zeros((0, dims), np.uint8)
        side = np.array([dims * bits if v < 0 else 0 for v in q], np.int64)
        by_weight: dict[int, list] = {}
        for t in range(most):
            j = np.flatnonzero(set_bits[t])
            first = j * bits + side[j]
            for b in range(bits):
                by_weight.setdefault(t + b, []).append(first + b)
        score = add_slices({w: both[np.concatenate(at)] for w, at in by_weight.items()}, words)
        base = sum(v * m for v, m in zip(q, least, strict=True)) - full * sum(-v for v in q if v < 0)
        own = np.searchsorted(ids, [query_id, query_id + 1])
        alive = everyone
        if own[0] < own[1]:
            mine = np.zeros(len(ids), np.uint8)
            mine[own[0] : own[1]] = 1
            alive = everyone & ~_pack(mine)
        at = top_rows(score, alive, k)
        found = np.array([(s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) for s in score], bool).reshape(len(score), len(at))
        yield at, [base + sum(1 << w for w in np.flatnonzero(found[:, i]).tolist()) for i in range(len(at))]


def _order_key(score: int) -> bytes | None:
    """Bytes in the order of the scores that a long can't hold; none for the others."""
    return None if abs(score) < LARGEST else (score + (1 << 2200)).to_bytes(276, "big")


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query."""
    spark = vectors.sparkSession
    fit = usable(vectors)
    kinds = fit.groupBy("dim", "wide").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    digest = F.xxhash64("vec_id")
    index = build_index(fit.join(F.broadcast(kinds) if kinds.limit(1001).count() <= 1000 else kinds, ["dim", "wide"]).select("dim", "wide", "vec_id", "x", F.pmod(digest, "blocks").alias("block")))
    asked = fit.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    chunks = max(1, -(-asked.count() // CHUNK_QUERIES))
    packed = asked.groupBy(F.pmod(digest, F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("vec_id", "x")).alias("queries"))
    # A unit is a block and a chunk: every block once for each chunk of the stated queries.
    units = kinds.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    units = units.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    key = ["dim", "wide", "block", "chunk"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            ids, least = np.frombuffer(r.ids, np.int64), [int(m) for m in r.least]
            slices = np.frombuffer(r.slices, np.uint64).reshape(len(least), r.bits, -1) if len(least) else np.zeros((0, r.bits, -(-len(ids) // 64)), np.uint64)
            queries = [(q["vec_id"], quantised(q["x"])) for q in r.queries]
            for (query_id, _), (at, scores) in zip(queries, search_block(ids, least, slices, queries, k), strict=True):
                out += [(query_id, i, max(-LARGEST, min(LARGEST, s)), _order_key(s)) for i, s in zip(ids[at].tolist(), scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "key"])

    # One hash partition for every two units or so (a stated number, so that small units aren't put together again).
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * chunks)
    met = units.join(index, ["dim", "wide", "block"]).join(packed, "chunk").repartition(spread, *key)
    best = met.groupBy(*key).applyInPandas(search, "query_id long, vec_id long, score long, key binary")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for each id divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op8_bit_sliced_top_k": op8_bit_sliced_top_k}
ORACLE_SQL = {
    "op8_bit_sliced_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, greatest(-9223372036854775807, least(9223372036854775807, coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
