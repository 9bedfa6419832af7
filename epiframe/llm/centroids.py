"""Centroid clustering (k-means) by ball-tree filtering, exact in integers.

Components are turned into integers, floor(SCALE * x).  Vectors are cut into
runs of ``TREE_ROWS`` inside a task; each gets a metric tree whose nodes hold
centre, radius, count and integer sum.  Trees are written once as a table and
read in every round.  A node passes on the centroids that can be nearest to any
of its vectors: by the triangle inequality those whose distance to the centre
is at most the least such distance plus twice the radius.  Where one is left
the whole ball is assigned to it by count and sum; otherwise its children are
visited, down to leaves, whose vectors are compared one by one.

A round sends the centroids to the tasks (k vectors) and gets count and sum of
each task's vectors for each centroid back, which Spark adds; k times width rows
reach the driver.  A lost executor costs its trees' work of one round.

The first centroids are the k vectors with the smallest SHA-256 of
``2:<id>`` (ties, as of repeated rows: smaller vector).  A round replaces
every centroid that has vectors by their componentwise floor(sum / count), and
empty ones stay.  Ties in distance go to the smaller number.

Vectors that are null, of another length, or hold null or non-finite components
take no part.  Rows without an id are clustered but are no first centroids.
Fewer than k vectors give fewer centroids, and none an empty result.
Distances are exact: in doubles while sums stay below 2**53, else in Python's
integers; one that is no 64-bit integer ends the job with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiframe.llm.staging import map_arrow, staged

SCALE = 256
K = 40
ROUNDS = 5
WIDTH = 64
LEAF = 64
TREE_ROWS = 16_384
#: Beyond this size of a component vectors stay out of trees and are compared in Python's integers.
LARGE = 1 << 20
TREES = "ids array<long>, large boolean, vectors array<long>, sums array<long>, radius array<double>, low array<int>, high array<int>, left array<int>, right array<int>"


def integers(column: str, width: int = WIDTH, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part.  Values beyond 64 bits become the nearest 64-bit integer."""
    v = F.col(column)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(v) == width) & usable, F.transform(v, lambda x: F.floor(x.cast("double") * float(scale))))


class Tree:
    """Nodes in the order of their making; ``order`` puts every node's vectors side by side, ``low:high``."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors, self.order = vectors, np.arange(len(vectors))
        self.sums, self.radius, self.low, self.high, self.left, self.right = [], [], [], [], [], []
        todo = [(0, len(vectors), -1, False)]
        while todo:
            lo, hi, parent, second = todo.pop()
            at = len(self.low)
            if parent >= 0:
                (self.right if second else self.left)[parent] = at
            part = vectors[self.order[lo:hi]]
            total = part.sum(axis=0)
            gaps = part - total / (hi - lo)
            far = np.sqrt((gaps**2).sum(axis=1))
            for name, x in (("sums", total), ("radius", far.max() * (1 + 1e-9)), ("low", lo), ("high", hi), ("left", -1), ("right", -1)):
                getattr(self, name).append(x)
            if hi - lo > leaf and far.max() > 0:
                one = part[far.argmax()]
                to_one = ((part - one) ** 2).sum(axis=1)
                other = part[to_one.argmax()]
                side = np.argsort(to_one - ((part - other) ** 2).sum(axis=1), kind="stable")
                self.order[lo:hi] = self.order[lo:hi][side]
                todo += [(lo, (lo + hi) // 2, at, False), ((lo + hi) // 2, hi, at, True)]
        self.vectors = vectors[self.order]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of ``centroids`` (ties: the first) and the squared distance, both exact."""
    if max(abs(int(x)) for a in (vectors, centroids) if a.size for x in (a.min(), a.max())) < LARGE:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        part = (c**2).sum(axis=1) - 2 * (v @ c.T)
        best = part.argmin(axis=1)
        return best, (part[np.arange(len(v)), best] + (v**2).sum(axis=1)).astype(np.int64)
    v, c = vectors.astype(object), centroids.astype(object)
    every = np.array([((v - z) ** 2).sum(axis=1) for z in c], dtype=object)
    best = np.array([min(range(len(c)), key=lambda i, n=n: every[i, n]) for n in range(len(v))], dtype=np.int64)
    return best, np.array([every[i, n] for n, i in enumerate(best)], dtype=object).astype(np.int64)


def balls(tree: dict, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, centroids that may be nearest to its vectors) of the nodes at which the walk ends."""
    points = centroids.astype(np.float64)
    walk = [(0, np.arange(len(points)))]
    while walk:
        at, near = walk.pop()
        centre = tree["sums"][at] / (tree["high"][at] - tree["low"][at])
        gap = np.sqrt(((points[near] - centre) ** 2).sum(axis=1))
        near = near[gap <= (gap.min() + 2 * tree["radius"][at]) * (1 + 1e-9) + 1e-6]
        if len(near) == 1 or tree["left"][at] < 0:
            yield at, near
        else:
            walk += [(tree["left"][at], near), (tree["right"][at], near)]


def _trees(width: int, rows: int):
    """(id, vector) -> one row for each tree; vectors with large components come as rows of their own kind, without a tree."""

    def made(ids: pa.Array, vectors: np.ndarray, large: bool) -> pa.RecordBatch:
        t = Tree(vectors) if not large else None
        order = t.order if t else np.arange(len(vectors))
        get = lambda name, kind: pa.array([np.asarray(getattr(t, name) if t else [], dtype=kind).ravel()])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), pa.array([large]), pa.array([vectors[order].ravel()]), get("sums", np.int64), get("radius", np.float64), *(get(x, np.int32) for x in ("low", "high", "left", "right"))],
            names=["ids", "large", "vectors", "sums", "radius", "low", "high", "left", "right"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}

        def out(large: bool) -> pa.RecordBatch:
            ids, vectors = pa.concat_arrays([i for i, _ in held[large]]), np.concatenate([v for _, v in held[large]])
            held[large] = []
            return made(ids, vectors, large)

        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            beyond = (vectors >= LARGE).any(axis=1) | (vectors <= -LARGE).any(axis=1)
            for large in (False, True):
                pick = np.flatnonzero(beyond == large)
                if len(pick):
                    held[large].append((batch.column(0).take(pa.array(pick)), vectors[pick]))
                if sum(len(v) for _, v in held[large]) >= rows:
                    yield out(large)
        for large in (False, True):
            if held[large]:
                yield out(large)

    return scan


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[dict]:
    """The rows of the table of trees, as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            tree = {name: x.as_py() if name == "large" else x.values if name == "ids" else x.values.to_numpy(zero_copy_only=False) for name, x in row.items()}
            yield tree | {name: tree[name].reshape(-1, width) for name in ("vectors", "sums")}


def _spans(tree: dict, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first row, end row, centroids that may be nearest, node or -1)."""
    if tree["large"]:
        yield 0, len(tree["vectors"]), np.arange(len(centroids)), -1
    else:
        for at, near in balls(tree, centroids):
            yield int(tree["low"][at]), int(tree["high"][at]), np.sort(near), at


def _sums(centroids: np.ndarray):
    """Trees -> (cluster, n, at, total): count and sum of a task's vectors by centroid and component; sums as decimal texts, which have no bound."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centroids.shape[1]
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=object)
        for tree in _rows(batches, width):
            own = np.zeros(centroids.shape, dtype=object if tree["large"] else np.int64)
            for lo, hi, near, at in _spans(tree, centroids):
                if len(near) == 1 and at >= 0:
                    count[near[0]] += hi - lo
                    own[near[0]] += tree["sums"][at]
                    continue
                part = tree["vectors"][lo:hi]
                best = near[nearest(part, centroids[near])[0]]
                count += np.bincount(best, minlength=len(centroids))
                np.add.at(own, best, part.astype(own.dtype))
            total += own.astype(object)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.repeat(count[used], width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array([str(x) for x in total[used].ravel()], pa.string())],
            names=["cluster", "n", "at", "total"],
        )

    return scan


def _assigned(centroids: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _rows(batches, centroids.shape[1]):
            cluster, distance = np.empty(len(tree["vectors"]), dtype=np.int32), np.empty(len(tree["vectors"]), dtype=np.int64)
            for lo, hi, near, _ in _spans(tree, centroids):
                best, distance[lo:hi] = nearest(tree["vectors"][lo:hi], centroids[near])
                cluster[lo:hi] = near[best]
            yield pa.RecordBatch.from_arrays([tree["ids"], pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return scan


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, rows: int = TREE_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector, written in the shared folder, and the final centroids; runs its rounds when called."""
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).cast("long").alias("id"), integers(vector_col, width, scale).alias("v")).where("v is not null")
    trees = staged(map_arrow(vectors, _trees(width, rows), TREES), "trees")
    first = vectors.where("id is not null").orderBy(F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256), "v").limit(k)
    now = np.array([r.v for r in first.collect()], dtype=np.int64).reshape(-1, width)
    if len(now):
        for _ in range(rounds):
            parts = map_arrow(trees, _sums(now), "cluster int, n long, at int, total string")
            found = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
            now = now.copy()
            for r in found.collect():
                now[r.cluster, r.at] = int(r.total) // r.n
        out = map_arrow(trees, _assigned(now), "id long, cluster int, distance long")
    else:
        out = spark.createDataFrame([], "id long, cluster int, distance long")
    return staged(out, "assigned"), now


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the sums of distances over the cluster and over all, and the SHA-256 of the centroid's components as decimal integers joined by commas."""
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    known = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster")
