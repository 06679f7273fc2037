"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree. Its upper levels are fitted on a bounded sample (SAMPLE_ROWS rows, by a digest of the id). If the table has
more rows, each branch is split further in Spark, on up to BRANCH_ROWS of its own rows, so the leaves grow in number
with the table up to some hundred for each of a bounded number of branches. Every row is indexed: it descends to the
nearest child down to a leaf. The tree is sent to the tasks; its size is bounded by those parameters and the dimension.

The walk. A node's priority is the inner product with its centroid and what its rows can add to that: SPREAD times
their distance from it, times the query's length (all of it would be a bound, but so loose that nothing is skipped);
inner nodes' spreads cover their children's. A query takes nodes from a priority queue and visits leaves in that order;
the priority of its last leaf is its cut. How many leaves it visits is calibrated: for up to CALIBRATION_QUERIES queries
the exact neighbours are found over all rows, and the visits are widened until the share of those neighbours inside the
visited leaves reaches TARGET_RECALL (all leaves, if need be).

The search. Leaves are packed in order into units of about BLOCK_ROWS rows (a larger leaf gets several, by the rows'
place). A query is sent to the units that hold a leaf it visits; there only the rows of leaves above its cut are
compared. A unit's rows are copied only if more than CHUNK_QUERIES queries come to it. Scores of what is found are inner
products in double precision on the original vectors, summed from the first component to the last.

Defined cases: vectors that are null, all zero, hold null or non-finite components or have no id take no part.
Shorter vectors count as filled up with zeros. Rows of the query's own id are no candidates; of several rows with a
query's id the smallest vector asks. Ties go to the smaller id. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

K = 20
SAMPLE_ROWS, BRANCHES, LEAF_SAMPLE, ITERATIONS = 8192, 8, 16, 8
#: Sample rows of a branch that is split further in Spark, and the rows it is split on.
BRANCH_SAMPLE, BRANCH_ROWS = 128, 4096
SPREAD = 0.3
CALIBRATION_QUERIES, TARGET_RECALL = 128, 0.955
BLOCK_ROWS, CHUNK_QUERIES = 4096, 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def matrix(arrays, dim: int) -> np.ndarray:
    """Rows of equal length, shorter ones filled up with zeros."""
    out = np.zeros((len(arrays), dim))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


@dataclass
class Tree:
    """Nodes by number: centroid, children (empty for a leaf), the leaf's number and the spread around the centroid."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def number_leaves(self) -> None:
        """Leaves get their numbers in the tree's order, so that neighbours have near ones."""
        self.leaf, n, todo = [-1] * len(self.children), 0, [0]
        while todo:
            node = todo.pop()
            if self.children[node]:
                todo += reversed(self.children[node])
            else:
                self.leaf[node], n = n, n + 1
        self.spread = np.zeros(len(self.children))

    def leaf_nodes(self) -> np.ndarray:
        """Node of each leaf."""
        out = np.zeros(self.leaves, np.int64)
        for node, leaf in enumerate(self.leaf):
            if leaf >= 0:
                out[leaf] = node
        return out

    def spread_out(self, radius: np.ndarray) -> None:
        """Spreads from the leaves' radii: a leaf's share of its radius; an inner node's covers its children's."""
        self.spread = np.zeros(len(self.children))
        self.spread[self.leaf_nodes()] = SPREAD * radius
        order, todo = [], [0]
        while todo:
            order.append(todo.pop())
            todo += self.children[order[-1]]
        for node in reversed(order):
            own = self.children[node]
            if own:
                self.spread[node] = (self.spread[own] + np.linalg.norm(self.centroids[own] - self.centroids[node], axis=1)).max()

    def priorities(self, q: np.ndarray) -> np.ndarray:
        """Priority of every node for a query (or a row of them for several)."""
        return q @ self.centroids.T + np.linalg.norm(q, axis=-1, keepdims=q.ndim > 1) * self.spread

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centroids[self.children[node]]
            near = (x[rows] @ c.T - (c * c).sum(1) / 2).argmax(1)
            todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def walk(self, q: np.ndarray):
        """Leaves with their priorities in the order of the best-bin-first walk."""
        priority = self.priorities(q).tolist()
        queue = [(-priority[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-priority[child], child))
            else:
                yield self.leaf[node], priority[node]

    def order(self, q: np.ndarray):
        return (leaf for leaf, _ in self.walk(q))

    def graft(self, node: int, other: Tree) -> None:
        """The other tree takes a leaf's place."""
        at = len(self.children)
        place = lambda i: node if i == 0 else at + i - 1
        self.children += [[]] * (len(other.children) - 1)
        for i, own in enumerate(other.children):
            self.children[place(i)] = [place(c) for c in own]
        self.centroids = np.concatenate([self.centroids, other.centroids[1:]])
        self.centroids[node] = other.centroids[0]


def fit_tree(sample: np.ndarray, leaf_sample: int | None = None, seed: int = 7) -> Tree:
    """Split by k-means into BRANCHES until `leaf_sample` (LEAF_SAMPLE) sample rows are left or the rows are all alike."""
    rng = np.random.default_rng(seed)
    least = LEAF_SAMPLE if leaf_sample is None else leaf_sample
    tree = Tree(np.zeros((0, sample.shape[1])), [], [])
    centroids = []

    def grow(x: np.ndarray) -> int:
        node = len(tree.children)
        centroids.append(x.mean(0))
        tree.children.append([])
        near = _kmeans(x, rng) if len(x) > max(least, BRANCHES) else np.zeros(len(x), int)
        parts = [x[near == i] for i in range(BRANCHES) if (near == i).any()]
        if len(parts) > 1:
            tree.children[node] = [grow(p) for p in parts]
        return node

    grow(sample)
    tree.centroids = np.array(centroids)
    tree.number_leaves()
    return tree


def _kmeans(x: np.ndarray, rng) -> np.ndarray:
    c = x[rng.choice(len(x), BRANCHES, replace=False)]
    for _ in range(ITERATIONS):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(BRANCHES)])
    return near


def _top(q, q_id, p, p_id, row, col, fast, k: int) -> pd.DataFrame:
    """The k best of the pairs (row of q, row of p) by their fast products; near-ties are summed anew, component by component."""
    own = p_id[col] == q_id[row]
    row, col, fast = row[~own], col[~own], fast[~own]
    order = np.lexsort((-fast, row))
    row, col, fast = row[order], col[order], fast[order]
    begin = np.searchsorted(row, row)
    last = np.minimum(begin + k - 1, np.searchsorted(row, row, side="right") - 1)
    near = fast >= (fast - 1e-9 * (1 + np.abs(fast)))[last] if len(row) else np.zeros(0, bool)
    row, col = row[near], col[near]
    exact = np.concatenate([np.cumsum(p[col[i : i + 8192]] * q[row[i : i + 8192]], axis=1)[:, -1] for i in range(0, len(row), 8192)] or [np.zeros(0)])
    order = np.lexsort((p_id[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pd.DataFrame({"query_id": q_id[row][top], "vec_id": p_id[col][top], "score": exact[top]})


def best(q: np.ndarray, q_id: np.ndarray, p: np.ndarray, p_id: np.ndarray, k: int, at_once: int = 256) -> pd.DataFrame:
    """The k largest inner products of each query with all rows, own id left out."""
    out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
    for start in range(0, len(q) if len(p) else 0, at_once):
        mine, ids = q[start : start + at_once], q_id[start : start + at_once]
        fast = mine @ p.T
        fast[p_id[None, :] == ids[:, None]] = -np.inf
        least = np.partition(fast, len(p) - k, axis=1)[:, len(p) - k] if len(p) > k else np.full(len(mine), -np.inf)
        slack = np.where(np.isfinite(least), 1e-9 * (1 + np.abs(least)), 0)
        row, col = np.nonzero((fast >= (least - slack)[:, None]) & (fast > -np.inf))
        out.append(_top(mine, ids, p, p_id, row, col, fast[row, col], k))
    return pd.concat(out)


def best_in_leaves(q: np.ndarray, q_id: np.ndarray, visits: np.ndarray, p: np.ndarray, p_id: np.ndarray, ends: np.ndarray, k: int, at_once: int = 256) -> pd.DataFrame:
    """The k largest inner products of each query with the rows of the leaves it visits (queries x leaves; rows lie leaf by leaf)."""
    out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
    starts = np.append(0, ends[:-1])
    for start in range(0, len(q), at_once):
        mine, ids, visit = q[start : start + at_once], q_id[start : start + at_once], visits[start : start + at_once]
        rows, cols, fast = [], [], []
        for leaf in np.flatnonzero(visit.any(0)).tolist():
            a, b, who = starts[leaf], ends[leaf], np.flatnonzero(visit[:, leaf])
            fast.append((mine[who] @ p[a:b].T).ravel())
            rows.append(np.repeat(who, b - a))
            cols.append(np.tile(np.arange(a, b), len(who)))
        if rows:
            out.append(_top(mine, ids, p, p_id, np.concatenate(rows), np.concatenate(cols), np.concatenate(fast), k))
    return pd.concat(out)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FOUND = "query_id long, vec_id long, score double"


def exact_top_k(indexed: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Brute force of a few queries (a bounded number, sent with the function) over all rows, batch by batch."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.sort_values("vec_id")
            out = best(q, ids, matrix(pdf["v"], q.shape[1]), pdf["vec_id"].to_numpy(), k)
            yield out.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return _ranked(indexed.select("vec_id", "v").mapInPandas(run, FOUND), k)


def calibrate(tree: Tree, indexed: DataFrame, sizes: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, target: float) -> tuple[int, float]:
    """Leaves to visit so that the mean share of exact neighbours in visited leaves reaches the target, and the share of all rows in them."""
    if not len(ids):
        return tree.leaves, 1.0
    near = exact_top_k(indexed, ids, q, k).join(indexed.select("vec_id", "leaf").distinct(), "vec_id").select("query_id", "leaf").toPandas()  # k rows a calibration query
    order = np.argsort(-tree.priorities(q)[:, tree.leaf_nodes()], axis=1, kind="stable")
    step = np.empty_like(order)
    np.put_along_axis(step, order, np.arange(1, tree.leaves + 1)[None].repeat(len(q), 0), 1)
    row = {int(i): n for n, i in enumerate(ids)}
    needed = pd.Series([int(step[row[i], leaf]) for i, leaf in zip(near["query_id"], near["leaf"], strict=True)], dtype=int)
    share = lambda m: (needed <= m).groupby(near["query_id"]).mean().mean()
    low, high = 1, tree.leaves  # the share rises with the visits
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if share(middle) >= target else (middle + 1, high)
    return low, float(sizes[order[:, :low]].sum(1).mean() / max(1, sizes.sum()))


def build_tree(rows: DataFrame, n: int, dim: int) -> Tree:
    """The upper levels from a sample, the lower ones of each branch from rows of that branch."""
    sample = rows.select("vec_id", "v").distinct()
    if n > SAMPLE_ROWS:
        digest = F.xxhash64("vec_id", F.lit("sample"))
        likely = F.pmod(digest, F.lit(1_000_000)) < int(min(1.0, 2 * SAMPLE_ROWS / n) * 1_000_000) + 1
        sample = sample.where(likely).orderBy(digest, "vec_id", "v").limit(SAMPLE_ROWS)
    x = matrix(sample.toPandas()["v"], dim)  # at most SAMPLE_ROWS rows
    tree = fit_tree(x[np.lexsort(x.T)], LEAF_SAMPLE if n <= SAMPLE_ROWS else BRANCH_SAMPLE)
    if n <= SAMPLE_ROWS:
        return tree

    def branch(batches):
        for pdf in batches:
            yield pdf.assign(branch=tree.assign(matrix(pdf["v"], dim)))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        own = matrix(pdf["v"], dim)
        return pd.DataFrame({"branch": [pdf["branch"].iloc[0]], "tree": [pickle.dumps(fit_tree(own[np.lexsort(own.T)]))]})

    first = W.partitionBy("branch").orderBy(F.xxhash64("vec_id", F.lit("branch")), "vec_id", "v")
    own = rows.mapInPandas(branch, "vec_id long, v array<double>, branch long").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= BRANCH_ROWS)
    parts = own.groupBy("branch").applyInPandas(split, "branch long, tree binary").orderBy("branch").collect()  # bounded trees of a bounded number of branches
    nodes = tree.leaf_nodes()
    for part in parts:
        tree.graft(int(nodes[part["branch"]]), pickle.loads(part["tree"]))
    tree.number_leaves()
    return tree


def search(vectors: DataFrame, is_query, k: int = K, target: float = TARGET_RECALL, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query. `report` receives leaves, visits and the share of rows visited."""
    rows = usable(vectors)
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = build_tree(rows, n, dim)
    nodes = tree.leaf_nodes()

    def index(batches):
        for pdf in batches:
            x = matrix(pdf["v"], dim)
            leaf = tree.assign(x)
            yield pdf.assign(leaf=leaf, far=np.linalg.norm(x - tree.centroids[nodes[leaf]], axis=1), place=np.arange(len(x)))

    indexed = written(rows.mapInPandas(index, "vec_id long, v array<double>, leaf long, far double, place long"), "ann-index")
    radius, sizes = np.zeros(tree.leaves), np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a leaf of the bounded tree
        radius[r["leaf"]], sizes[r["leaf"]] = r["far"], r["n"]
    tree.spread_out(radius)
    parts = np.maximum(1, -(-sizes // BLOCK_ROWS))
    before = np.cumsum(sizes) - sizes
    new = np.append(True, (before[1:] // BLOCK_ROWS != before[:-1] // BLOCK_ROWS) | (parts[1:] > 1) | (parts[:-1] > 1)) if len(sizes) else np.zeros(0, bool)
    unit_of = np.cumsum(np.where(new, np.append(1, parts[:-1]), 0)) - 1

    asked = indexed.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    few = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION_QUERIES).toPandas()
    visits, share = calibrate(tree, indexed, sizes, few["vec_id"].to_numpy(np.int64), matrix(few["v"], dim), k, target)
    if report is not None:
        report |= {"rows": n, "leaves": tree.leaves, "visits": visits, "share": share}

    def deal(batches):
        for pdf in batches:
            leaf = pdf["leaf"].to_numpy()
            yield pdf.assign(unit=unit_of[leaf] + pdf["place"].to_numpy() % parts[leaf])[["unit", "vec_id", "v", "leaf"]]

    def route(batches):
        for pdf in batches:
            out = []
            for i, v, own in zip(pdf["vec_id"], pdf["v"], pdf["own"], strict=True):
                held, cut, seen = 0, np.inf, set()
                for n, (leaf, priority) in enumerate(tree.walk(matrix([v], dim)[0])):
                    if n >= visits and held >= k + own:  # never short of k where the table has k
                        break
                    held, cut = held + sizes[leaf], min(cut, priority)
                    if sizes[leaf]:
                        seen.update(range(unit_of[leaf], unit_of[leaf] + parts[leaf]))
                out += [(u, i, v, cut) for u in sorted(seen)]
            yield pd.DataFrame(out, columns=["unit", "query_id", "q", "cut"])

    spark = vectors.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = written(asked.repartition(spread).mapInPandas(route, "unit long, query_id long, q array<double>, cut double"), "ann-routed")
    chunks = routed.groupBy("unit").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks"))
    points = indexed.mapInPandas(deal, "unit long, vec_id long, v array<double>, leaf long").join(chunks, "unit")
    points = points.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    routed = routed.join(chunks, "unit").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).drop("chunks")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["leaf", "vec_id"])
        leaves, counts = np.unique(left["leaf"].to_numpy(), return_counts=True)
        q = matrix(right["q"], dim)
        at = nodes[leaves]
        priority = q @ tree.centroids[at].T + np.linalg.norm(q, axis=1)[:, None] * tree.spread[at]
        cut = right["cut"].to_numpy()
        visit = priority >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None]
        return best_in_leaves(q, right["query_id"].to_numpy(np.int64), visit, matrix(left["v"], dim), left["vec_id"].to_numpy(np.int64), np.cumsum(counts), k)

    key = ["unit", "chunk"]
    found = points.repartition(spread, *key).groupBy(*key).cogroup(routed.repartition(spread, *key).groupBy(*key)).applyInPandas(meet, FOUND)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each id divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op3_kmeans_tree": op3_kmeans_tree}
ORACLE_SQL: dict[str, str] = {}
