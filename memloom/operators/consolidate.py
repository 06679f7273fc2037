"""Merging similar memories: links between near vectors, components, merged rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_checkpoints, written
from . import metric
from .lifecycle import is_free, live

#: Rows of a block and of a chunk that meet in one task; rows compared at once.
BLOCK_ROWS = 4096
STEP_ROWS = 256


def candidates(df: DataFrame) -> DataFrame:
    """V5: live, unpinned rows with a vector that are neither lessons nor rules."""
    return live(df).where(is_free() & F.col("embedding").isNotNull() & ~F.coalesce(F.col("memory_type").isin("lesson", "rule"), F.lit(False)))


def similar_links(rows: DataFrame, same: float, other: float, neighbours: int = 6) -> DataFrame:
    """A, b, sim: links among each row's nearest (itself included), above the threshold of equal or differing category.

    A similarity join within the radius of the lower threshold, by pivots (see metric): exact, and blocks out of reach are never
    built. Equal vectors ask once and answer with their first ids, of which no row can have more among its nearest; so a vector that
    many rows share costs each of them only its links. The l2 form 1 - d / 2 of unit or other vectors is used throughout.
    """
    slim = metric.finite(rows.select("id", "category", "embedding"))
    first = slim.withColumn("_r", F.row_number().over(W.partitionBy("embedding").orderBy("id"))).where(F.col("_r") <= neighbours)
    vectors = first.groupBy("embedding").agg(F.min("id").alias("id"), F.sort_array(F.collect_list(F.struct("id", "category"))).alias("held"))
    vectors = written(vectors, "vectors")
    dealt = metric.blocks(vectors.withColumns({"asks": F.lit(True), "answers": F.lit(True)}), similar_radius(same, other), block_rows=BLOCK_ROWS, tile_rows=4 * BLOCK_ROWS)

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"key": [], "b": [], "sim": [], "category": []})
        x, y = np.array(a["embedding"].tolist(), float), np.array(b["embedding"].tolist(), float)
        keys = a["id"].to_numpy()
        times = b["held"].str.len().to_numpy()
        ids = np.array([h["id"] for held in b["held"] for h in held], object)
        kinds = np.array([h["category"] for held in b["held"] for h in held], object)
        start, place = np.cumsum(times) - times, np.empty(len(ids), np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        yy, reach = (y * y).sum(1), similar_radius(same, other)
        out = []
        for at in range(0, len(x), STEP_ROWS):
            part = x[at : at + STEP_ROWS]
            xx = (part * part).sum(1)
            d2 = part @ y.T
            d2 *= -2
            d2 += yy
            row, col = np.divmod(np.flatnonzero(d2 <= (reach * reach + 1e-9 * (1 + xx + yy.max()) - xx)[:, None]), len(y))
            sim = np.empty(len(row))
            for lo in range(0, len(row), 65536):  # what is near is compared again, by differences
                s = slice(lo, lo + 65536)
                sim[s] = np.round(1 - np.sqrt(((part[row[s]] - y[col[s]]) ** 2).sum(1)) / 2, 4)
            near = sim >= min(same, other)
            row, col, sim = row[near], col[near], sim[near]
            n = times[col]
            row, sim, j = np.repeat(row, n), np.repeat(sim, n), np.repeat(start[col] - np.cumsum(n) + n, n) + np.arange(n.sum())
            order = np.lexsort((place[j], -sim, row))
            row, sim, j = row[order], sim[order], j[order]
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
            first = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)])) < neighbours
            out.append(pd.DataFrame({"key": keys[at + row[first]], "b": ids[j[first]], "sim": sim[first], "category": kinds[j[first]]}))
        return pd.concat(out)

    pairs = dealt.groupBy("cell", "ring", "sub", "chunk").applyInPandas(nearest, "key string, b string, sim double, category string")
    best = pairs.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("sim"), "b"))).where(F.col("r") <= neighbours)
    members = slim.join(vectors.select("embedding", F.col("id").alias("key")), "embedding").select("key", F.col("id").alias("a"), F.col("category").alias("own"))
    met = members.join(best, "key").where(F.col("a") != F.col("b"))
    return met.where(F.col("sim") >= F.when(F.col("own") == F.col("category"), F.lit(same)).otherwise(F.lit(other))).select("a", "b", "sim")


def similar_radius(same: float, other: float) -> float:
    """The distance beyond which no rounded similarity reaches a threshold."""
    return 2 * (1 - min(same, other)) + 2e-4


def components(links: DataFrame, rounds: int = 30) -> DataFrame:
    """node, root: smallest id reachable. Label propagation with pointer jumping; each round cuts its lineage by checkpoint()."""
    shared_checkpoints(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint()
    for _ in range(rounds):
        seen = both.join(label.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        step = label.join(seen, "node").select("node", F.least("root", "r").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = step.join(jump, "root", "left").select("node", F.coalesce("up", "root").alias("root")).checkpoint()
        changed = new.join(label.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def neighbourhoods(links: DataFrame) -> DataFrame:
    """node, root: each row with the rows linked to it that have larger ids; components where these are pairs."""
    return links.select(F.least("a", "b").alias("root"), F.explode(F.array("a", "b")).alias("node")).distinct()


def merge_clusters(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """A row a component or neighbourhood: keeper, members, merged text, importance, strength, last access and mean vector (in doubles)."""
    own = rows.join(roots, rows["id"] == roots["node"]).select("root", "id", "text", "created_at", "importance", "strength", "last_accessed_at", "embedding")
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "id", "text")))
    keeper = F.max_by("id", F.struct(F.coalesce("importance", F.lit(0.0)), -F.col("created_at"), F.col("id")))
    merged = own.groupBy("root").agg(
        keeper.alias("keeper"), F.count("*").alias("members"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n• ").alias("text"),
        F.max(F.when(F.coalesce("importance", F.lit(0.0)) == 0, F.lit(0.5)).otherwise(F.col("importance"))).alias("importance"),
        F.least(F.max(F.coalesce("strength", F.lit(1.0))) + 0.2, F.lit(5.0)).alias("strength"), F.max("last_accessed_at").alias("last_accessed_at"),
    )
    mean = own.select("root", F.posexplode("embedding")).groupBy("root", "pos").agg(F.avg("col").alias("x"))
    mean = mean.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("embedding"))
    return merged.join(mean, "root")


def consolidate(df: DataFrame, same: float = 0.82, other: float = 0.92) -> DataFrame:
    """Merged rows of all components of at least two."""
    rows = candidates(df)
    return merge_clusters(rows, components(similar_links(rows, same, other)))


def _grouped(pdf: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Links that join all rows of the block whose arrivals lie within the radius of each other or of stored rows: a tree a component."""
    found: list[tuple[str, str]] = []
    size = pdf["embedding"].str.len()
    for _, part in pdf.groupby(size):
        a, b = part[part["asks"]], part[~part["asks"]]
        if not len(a) or not len(b):
            continue
        x, y = np.array(a["embedding"].tolist(), float), np.array(b["embedding"].tolist(), float)
        near = np.zeros((len(a), len(b)), bool)
        for at in range(0, len(a), 512):
            part_x = x[at : at + 512]
            near[at : at + 512] = (part_x * part_x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * part_x @ y.T <= radius * radius + 1e-6
        ids, others = a["id"].to_numpy(), b["id"].to_numpy()
        new_a, new_b = np.ones(len(a), bool), np.ones(len(b), bool)
        for start in range(len(a)):
            todo = [start] if new_a[start] else []
            new_a[start] = False
            while todo:
                reached = near[todo.pop()] & new_b
                new_b &= ~reached
                for j in np.flatnonzero(reached):
                    found.append((ids[start], others[j]))
                    more = near[:, j] & new_a
                    new_a &= ~more
                    todo.extend(np.flatnonzero(more))
                    found.extend((ids[start], ids[i]) for i in np.flatnonzero(more))
    return pd.DataFrame([f for f in found if f[0] != f[1]], columns=["a", "b"])


def possible_partners(rows: DataFrame, radius: float) -> DataFrame:
    """a, b: links whose components hold every two rows of an agent and namespace that merge_or_store could bring together.

    Arrivals meet the rows within the radius in bounded blocks by pivots (see metric); a block's links are a tree a component,
    not all pairs, so copies cost a link each.
    """
    asks = ~F.col("_old") & (F.coalesce("memory_type", F.lit("")) != "lesson")
    answers = asks | (F.coalesce("importance", F.lit(1.0)) >= 0.05)
    slim = rows.select(F.xxhash64(F.coalesce("agent", F.lit("")), F.coalesce("namespace", F.lit(""))).alias("g"), "id", "embedding", asks.alias("asks"), answers.alias("answers"))
    dealt = metric.blocks(slim.where("asks OR answers"), radius, ("g",), BLOCK_ROWS, 2 * BLOCK_ROWS)
    return dealt.groupBy("g", "cell", "ring", "sub", "chunk").applyInPandas(lambda pdf: _grouped(pdf, radius), "a string, b string")


def merge_or_store(existing: DataFrame, arrivals: DataFrame, threshold: float = 0.85) -> DataFrame:
    """V4: arrivals in order of (created_at, id) join the nearest row of their agent and namespace, or are stored.

    Columns id, agent, namespace, category, text, embedding, importance, strength, created_at, memory_type. Of equally near
    rows the first takes it: stored ones by (created_at, id), then arrivals as they came. Ids are unique over both inputs.

    A merge moves a row's vector halfway to the arrival, so it always lies within half the reach of the last one merged.
    Rows that no chain of steps of 1.5 times the reach connects thus never meet: only such components are folded in order,
    streamed by task, and the fold holds vectors, no texts. All other rows pass untouched. Texts are joined afterwards, by
    row. An empty side, null or empty vectors and null importance (kept as a partner) are fine; a null strength counts as 1.
    """
    reach = 2 * (1 - threshold)
    columns = ["id", "agent", "namespace", "category", "memory_type", "text", "embedding", "importance", "strength", "created_at"]
    both = existing.select(*columns, F.lit(True).alias("_old")).unionByName(arrivals.select(*columns, F.lit(False).alias("_old")))
    roots = components(possible_partners(both, 1.5 * reach))
    rooted = both.join(roots, both["id"] == roots["node"], "left").drop("node").withColumn("_tail", F.lit(None).cast("string"))
    schema = rooted.schema.add("_place", "long").add("_target", "long")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, vectors = None, {}
        for pdf in batches:
            place, target, vector, text, tail = [], [], [], [], []
            for r in pdf.itertuples(index=False, name=None):
                r = dict(zip(pdf.columns, r, strict=True))
                if current != (key := (r["agent"], r["namespace"], r["root"])):
                    current, vectors, n = key, {}, 0
                v = None if r["embedding"] is None or not len(r["embedding"]) else np.asarray(r["embedding"], float)
                mine, out = None if v is None else vectors.setdefault(len(v), _Stored(len(v))), None
                if mine and not r["_old"] and r["memory_type"] != "lesson":
                    out = mine.nearest(v, threshold, r["category"])
                if out is not None:
                    v = mine.move(out, v)
                    words = "\n• " + (r["text"] or "").strip()
                    at = mine.places[out]
                else:
                    words, at = r["text"], n
                    if mine and not (r["importance"] is not None and r["importance"] < 0.05):
                        mine.add(v, n, r["category"])
                place.append(n)
                target.append(at)
                vector.append(r["embedding"] if out is None else v)
                text.append(None if words is None else words.rstrip())
                tail.append(None if words is None else words[len(words.rstrip()) :])
                n += 1
            yield pdf.assign(embedding=vector, text=text, _tail=tail, _place=place, _target=target)

    key = ["agent", "namespace", "root"]
    together = rooted.where("root IS NOT NULL").repartition(*key).sortWithinPartitions(*key, F.desc("_old"), "created_at", "id").mapInPandas(fold, schema)
    first = lambda c: F.min_by(c, "_place").alias(c)
    pieces = F.array_sort(F.collect_list(F.struct("_place", "text")))
    merged = together.groupBy(*key, "_target").agg(
        *[first(c) for c in ("id", "category", "memory_type", "created_at")],
        F.concat(F.array_join(F.transform(pieces, lambda p: p["text"]), ""), F.max_by("_tail", "_place")).alias("text"),
        F.max_by("embedding", "_place").alias("embedding"), F.max("importance").alias("importance"), (F.count("*") - 1).cast("int").alias("merged"),
        F.min_by(F.coalesce("strength", F.lit(1.0)), "_place").alias("strength"),
    )
    merged = merged.withColumn("strength", F.when(F.col("merged") > 0, F.least(F.col("strength") + 0.2 * F.col("merged"), F.lit(5.0))).otherwise(F.col("strength")))
    alone = rooted.where("root IS NULL").select(*columns, F.lit(0).alias("merged"))
    return alone.unionByName(merged.select(*columns, "merged"))


class _Stored:
    """The vectors of one length that the rows stored so far hold, in the order in which they came."""

    def __init__(self, length: int):
        self.rows, self.n, self.places, self.categories = np.empty((16, length)), 0, [], []

    def add(self, v: np.ndarray, place: int, category: str) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.n] = v
        self.n += 1
        self.places.append(place)
        self.categories.append(category)

    def nearest(self, v: np.ndarray, threshold: float, category: str) -> int | None:
        if not self.n:
            return None
        sim = np.nan_to_num(1 - np.sqrt(((self.rows[: self.n] - v) ** 2).sum(1)) / 2, nan=-np.inf)
        best = int(sim.argmax())
        return best if sim[best] >= threshold and self.categories[best] == category else None

    def move(self, at: int, v: np.ndarray) -> np.ndarray:
        self.rows[at] = (self.rows[at] + v) / 2
        return self.rows[at].copy()
