"""Exact k-means by filtering balls of vectors through centroids.

A task turns each run of BLOCK vectors it reads into a metric tree: a node is a ball with its radius, count and integer sum, and its vectors lie
side by side. The trees are written once and every round reads them. A ball whose nearest centroid is nearer than any other by more than twice
the radius goes to it whole, by its count and sum; other balls are opened, and in leaves each vector is assigned exactly. A round shuffles one
row per task, centroid and dimension, and only the centroids pass through the driver.

Vectors, sums and squared distances are integers throughout; only the choice of balls uses floating point, with a margin that leaves every close case to the
leaves, so ties go to the smaller number as in a plain pass.

Defined cases: rows whose vector is null, has another number of components, or holds a null or non-finite one are left out, as are those with a component
of 131,072 or more in magnitude, whose squared distances need not fit a long. Repeated rows and repeated ids are vectors of their own. Ids that are null stay null and
come last among the starting centroids; equal hashes are ordered by the components. With fewer vectors than centroids each starts one. An empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm.common import cut, discard

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of one tree and of one leaf.
BLOCK, LEAF = 4096, 24
#: Components after scaling are below this in magnitude.
LARGEST = 1 << 27
TREE = "ids array<long>, points binary, first binary, stop binary, left binary, right binary, radius binary, sums binary"
#: Relative room for rounding in the choice of balls.
ROOM = 1e-9


def scaled(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """``id, x``: the usable rows, each component as the integer floor(scale * component)."""
    v = F.transform(F.col(vector_col), lambda c: F.lit(float(scale)) * c.cast("double"))
    usable = (F.size("v") == size) & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(usable).select("id", F.transform("v", lambda c: F.floor(c)).alias("x"))


def grow(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the points, and the nodes of their tree: first and stop place, children (-1 for leaves), radius and sum."""
    order = np.arange(len(points))
    first, stop, left, right, radius, sums = [0], [len(points)], [-1], [-1], [0.0], []
    node = 0
    while node < len(first):
        a, b = first[node], stop[node]
        inside = points[order[a:b]]
        total = inside.sum(axis=0)
        sums.append(total)
        away = np.sqrt(((inside - total / (b - a)) ** 2).sum(axis=1))
        radius[node] = away.max()
        # Equal points have radius zero up to rounding and are never opened further than one leaf.
        if b - a > LEAF and (inside != inside[0]).any():
            one = inside[away.argmax()]
            two = inside[((inside - one) ** 2).sum(axis=1).argmax()]
            along = (inside * (two - one).astype(float)).sum(axis=1)
            middle = a + (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, middle - a)]
            left[node], right[node] = len(first), len(first) + 1
            first += [a, middle]
            stop += [middle, b]
            left += [-1, -1]
            right += [-1, -1]
            radius += [0.0, 0.0]
        node += 1
    nodes = {"first": np.array(first, np.int32), "stop": np.array(stop, np.int32), "left": np.array(left, np.int32), "right": np.array(right, np.int32), "radius": np.array(radius), "sums": np.array(sums, np.int64)}
    return order, nodes


def plant(rows: DataFrame) -> DataFrame:
    """One row per tree over the rows ``id, x``, without a shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in it:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - n)
                waiting.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == BLOCK:
                    yield tree(waiting)
                    waiting, n = [], 0
        if n:
            yield tree(waiting)

    def tree(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = pa.concat_arrays([p.column(1) for p in parts])
        points = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.int64)
        order, nodes = grow(points)
        ids = pa.concat_arrays([p.column(0) for p in parts]).take(pa.array(order))
        columns = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in (points[order].astype(np.int32), *nodes.values()))]
        return pa.RecordBatch.from_arrays(columns, ["ids", "points", *nodes])

    return rows.mapInArrow(run, TREE)


class Tree:
    """A stored tree as arrays."""

    def __init__(self, row: dict, size: int) -> None:
        self.points = np.frombuffer(row["points"], np.int32).reshape(-1, size)
        self.first, self.stop, self.left, self.right = (np.frombuffer(row[k], np.int32) for k in ("first", "stop", "left", "right"))
        self.radius = np.frombuffer(row["radius"])
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, size)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes assigned whole, their centroids, places assigned one by one, their centroids)."""
        whole, whole_to, single, single_to = [], [], [], []
        front = np.zeros(1, np.int64)
        while len(front):
            middle = self.sums[front] / (self.stop[front] - self.first[front])[:, None]
            away = np.sqrt(((middle[:, None, :] - centroids[None].astype(float)) ** 2).sum(axis=2))
            best = away.argmin(axis=1)
            near = away[np.arange(len(front)), best]
            others = away.copy()
            others[np.arange(len(front)), best] = np.inf
            radius = self.radius[front]
            room = ROOM * (near + radius + np.abs(middle).max(axis=1) + np.abs(centroids).max() + 1)
            sure = others.min(axis=1) - near > 2 * radius + room
            whole.append(front[sure])
            whole_to.append(best[sure])
            rest = front[~sure]
            leaf = self.left[rest] < 0
            for node in rest[leaf]:
                at = np.arange(self.first[node], self.stop[node])
                single.append(at)
                single_to.append(np.argmin(distances(self.points[at], centroids), axis=1))
            front = np.concatenate((self.left[rest[~leaf]], self.right[rest[~leaf]])).astype(np.int64)
        return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in (whole, whole_to, single, single_to))


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per point."""
    points, size = points.astype(np.int64), centroids.shape[1]
    reach = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * size * reach * reach < 1 << 53:  # all terms are exact in doubles, so the fast product may be used
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)


def round_of(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the exact floor of the mean of each one's vectors; empty ones stay."""
    now, size = np.array(centroids, np.int64), len(centroids[0])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for batch in it:
            for row in batch.to_pylist():
                t = Tree(row, size)
                whole, whole_to, single, single_to = t.assign(now)
                np.add.at(sums, whole_to, t.sums[whole])
                np.add.at(counts, whole_to, (t.stop - t.first)[whole].astype(np.int64))
                np.add.at(sums, single_to, t.points[single].astype(np.int64))
                np.add.at(counts, single_to, 1)
        table = np.concatenate((sums, counts[:, None]), axis=1)
        cluster, dim = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(table[cluster, dim])], ["cluster", "dim", "total"])

    found = {(r.cluster, r.dim): r.total for r in trees.drop("ids").mapInArrow(run, "cluster int, dim int, total long").groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()}
    return [[found.get((c, d), 0) // n for d in range(size)] if (n := found.get((c, size))) else old for c, old in enumerate(centroids)]


def assigned(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    now, size = np.array(centroids, np.int64), len(centroids[0])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                t = Tree({name: row.column(name)[0].as_py() for name in row.schema.names if name != "ids"}, size)
                whole, whole_to, single, single_to = t.assign(now)
                cluster = np.zeros(len(t.points), np.int32)
                cluster[single] = single_to
                for node, c in zip(whole, whole_to, strict=True):
                    cluster[t.first[node] : t.stop[node]] = c
                gap = t.points.astype(np.int64) - now[cluster]
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), pa.array(cluster), pa.array((gap * gap).sum(axis=1))], ["id", "cluster", "distance"])

    return trees.mapInArrow(run, "id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``id, cluster, distance`` of every usable vector after ``rounds`` rounds, and the final centroids.

    The starting centroids are the vectors with the smallest SHA-256 of ``<seed>:<id>``. ``k`` and ``size`` bound what passes through the driver.
    """
    rows = scaled(vectors, id_col, vector_col, size, scale)
    start = F.when(F.col("id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    centroids = [list(r.x) for r in rows.orderBy(start.asc_nulls_last(), "x").select("x").limit(k).collect()]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "id long, cluster int, distance long"), []
    trees = cut(plant(rows))
    for _ in range(rounds):
        moved = round_of(trees, centroids)
        if moved == centroids:  # nothing moves any more, so the remaining rounds change nothing
            break
        centroids = moved
    found = cut(assigned(trees, centroids))
    discard(trees)
    return found, centroids


def digest(centroid: list[int]) -> str:
    """SHA-256 of a centroid's components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op11_ball_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings: 8 centroids, 10 rounds."""
    found, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    final = [(c, inertia.get(c, 0), sum(inertia.values()), digest(x)) for c, x in enumerate(centroids)]
    named = spark.createDataFrame(final, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
