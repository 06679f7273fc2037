"""Blocks for similarity joins by distance: pivots and triangle inequalities leave out what is out of reach.

Every vector lies in the cell of its nearest pivot, in a ring of one radius' width around it. A vector that asks for all others
within the radius r has to meet a cell only if it is no more than 2 r nearer to its own pivot than to that cell's (what lies
beyond the middle between both is out of reach), and of that cell only the rings between its distance to the pivot minus and
plus r. Rings are cut into blocks of bounded size by a digest, and those who ask into chunks; a block and a chunk are one task's
work. Pivots are a bounded sample; whatever they are, no pair within the radius is lost.

Vectors that are spread evenly have no cells out of reach: each would be sent to every cell. A bounded sample tells this beforehand;
then all rows of one length are one cell of large blocks, which sends a row once a block and no more pairs than all meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows that a pivot stands for and most pivots for one length of vectors.
CELL_ROWS, MOST_PIVOTS = 64, 512
#: Vectors of one length that tell whether cells pay; cells are left when more than this share of pairs meet, or a row goes to this many times more blocks.
PROBES, MOST_SHARE, MOST_COPIES = 1024, 0.5, 8
#: Rings up to so many rows are sent to every task.
FEW_RINGS = 100_000
SLACK = 1 + 1e-6


def finite(rows: DataFrame) -> DataFrame:
    """Rows with a vector of finite components."""
    return rows.where(F.size("embedding") > 0).where(F.forall("embedding", lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))))


def _pivots(rows: DataFrame, radius: float, tile_rows: int) -> dict[int, np.ndarray] | None:
    """By length of vector, its pivots: those of the least digests; none at all if cells don't pay (see PROBES)."""
    out, met, every, sent, tiles = {}, 0.0, 0.0, 0.0, 0.0
    for dim, n in rows.groupBy(F.size("embedding")).count().collect():  # one row a length
        most = min(MOST_PIVOTS, -(-n // CELL_ROWS))
        few = rows.where(F.size("embedding") == dim).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(most + PROBES).collect()
        few = np.array([r["embedding"] for r in few], float)
        out[dim], probes = few[:most], few[most:]
        if not len(probes):
            continue
        d = np.stack([np.sqrt(((probes - v) ** 2).sum(axis=1)) for v in out[dim]], axis=1)
        cell, ring = d.argmin(axis=1), np.floor(d.min(axis=1) / radius)
        t = d[:, cell]
        meet = (t - d.min(axis=1)[:, None] <= 2 * radius) & (ring[None] >= np.floor(np.maximum(0, t - radius) / radius)) & (ring[None] * radius <= t + radius)
        _, block = np.unique(np.stack([cell, ring]), axis=1, return_index=True)
        met, every = met + meet.mean() * n * n, every + float(n) * n
        sent, tiles = sent + meet[:, block].sum(axis=1).mean() * n, tiles + 2.0 * n * -(-n // tile_rows)
    return None if met > MOST_SHARE * every or sent > MOST_COPIES * tiles else out


def _distances(vectors: pd.Series, pivots: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For each length: places of its vectors, the number of its first cell and all distances to its pivots."""
    lengths, first = vectors.str.len().to_numpy(), 0
    for dim, p in sorted(pivots.items()):
        at = np.flatnonzero(lengths == dim)
        if len(at):
            x = np.array(vectors.iloc[at].tolist(), float)
            yield at, first, np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in p], axis=1)
        first += len(p)


def blocks(rows: DataFrame, radius: float, by: tuple[str, ...] = (), block_rows: int = 4096, tile_rows: int | None = None) -> DataFrame:
    """rows (id, embedding, asks, answers, `by`) dealt into groups (`by`, cell, ring, sub, chunk): in one of them every row that asks
    meets every row that answers within the radius, and has the same `by`; `asks` then says on which side a row stands.

    Blocks and chunks have about block_rows, or tile_rows (by default as many) where cells don't pay. Ids are unique. Null, empty and non-finite vectors take no part; vectors of different lengths never meet.
    """
    radius = radius * SLACK + 1e-9
    rows = finite(rows)
    width = max(radius, 1e-12)
    pivots = _pivots(rows, width, tile_rows or block_rows)
    block_rows = block_rows if pivots is not None else tile_rows or block_rows

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, gap = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            for at, first, d in _distances(pdf["embedding"], pivots):
                cell[at], gap[at] = first + d.argmin(axis=1), d.min(axis=1)
            yield pdf.assign(cell=cell, gap=gap, ring=np.floor(gap / width).astype(np.int64))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, first, d in _distances(pdf["embedding"], pivots):
                row, cell = np.nonzero(d - d.min(axis=1, keepdims=True) <= 2 * radius)
                t = d[row, cell]
                rings = np.floor(np.maximum(0.0, t - radius) / width).astype(np.int64)[:, None] + np.arange(4)
                inside = rings * width <= (t + radius)[:, None]
                r, k = np.nonzero(inside)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[at[row[r]]], **{c: pdf[c].to_numpy()[at[row[r]]] for c in by}, "cell": first + cell[r], "ring": rings[r, k], "t": t[r]})

    kinds = dict(rows.dtypes)
    whole = rows.withColumns({"cell": F.size("embedding").cast("long"), "gap": F.lit(0.0), "ring": F.lit(0).cast("long")})
    placed = written(whole if pivots is None else rows.mapInPandas(place, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", cell long, gap double, ring long"), "cells")
    key = [*by, "cell", "ring"]
    few = lambda df, n: F.broadcast(df) if n <= FEW_RINGS else df
    rings = written(placed.where("answers").groupBy(*key).agg(F.ceil(F.count("*") / block_rows).alias("subs"), F.min("gap").alias("least"), F.max("gap").alias("most")), "rings")
    n = rings.count()
    asked = placed.where("asks").select("id", "embedding", *by)
    reached = ", ".join([f"id {kinds['id']}", *(f"{c} {kinds[c]}" for c in by), "cell long, ring long, t double"])
    asked = placed.where("asks").select("id", *key, F.lit(0.0).alias("t")) if pivots is None else asked.mapInPandas(reach, reached)
    met = written(asked.join(few(rings, n), key).where((F.col("t") - radius <= F.col("most")) & (F.col("t") + radius >= F.col("least"))).select("id", *key, "subs"), "reached")
    loads = few(met.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).alias("chunks"), F.first("subs").alias("subs")), n)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    columns = [c for c in rows.columns if c not in ("asks", "answers", *by)]
    slim = placed.drop(*by, "cell", "ring", "gap", "asks", "answers")
    asking = met.select("id", *key).join(loads, key).select("id", *key, own("chunks").alias("chunk"), every("subs").alias("sub")).hint("merge").join(slim, "id")  # met's files are far smaller than its rows: never sent whole
    answering = placed.where("answers").join(loads, key).select(*columns, *key, own("subs").alias("sub"), every("chunks").alias("chunk"))
    both = asking.select(*columns, *key, "sub", "chunk", F.lit(True).alias("asks"))
    return both.unionByName(answering.withColumn("asks", F.lit(False)))


def compared(dealt: DataFrame, by: tuple[str, ...] = ()) -> int:
    """How many pairs the groups hold."""
    each = dealt.groupBy(*by, "cell", "ring", "sub", "chunk").agg((F.count_if("asks") * F.count_if(~F.col("asks"))).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
