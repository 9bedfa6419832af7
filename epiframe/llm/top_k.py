"""Exact top-k search by inner product: a ball tree for each shard, branch and bound.

Components are turned into integers, floor(SCALE * x), so scores are exact and
ties are real; ties go to the smaller id.  A shard is a run of vectors inside a
task, of at most twice ``SHARD_BYTES``; its ball tree is walked best node first, a node's upper bound for
a query being <q, centre> + |q| * radius, and queries whose bound is below
their current kth score leave the node.  The kth score is shared: from shard to
shard within a task, and into every task from a first look at ``PROBE``
candidates, which any task's bound may use because those are candidates too.

Queries go out in blocks of at most ``BLOCK`` vectors, one pass over all
candidates per block, so what is broadcast has a fixed bound.  Tasks return k
rows per query, of which a ranking window keeps the best k (Spark ranks within
tasks before it shuffles).

Vectors that are null, empty, or hold null or non-finite components, and rows
without an id take no part.  Only vectors of equal length are compared.
A query's own id is no candidate, so a repeated row with the same id is not
one either; repeated query rows count once, repeated candidates each count.
Sums are taken in doubles, exact while |score| < 2**53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epiframe.llm.staging import map_arrow, united

SCALE = 64
K = 20
LEAF = 512
SHARD_BYTES = 64 << 20
BLOCK = 16_384
PROBE = 4_096
GROUP = 1_024


def integer_vectors(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors (as doubles) of the usable rows of an Arrow list column, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)
    broken = ~np.isfinite(values) | flat.is_null().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(broken)])
    length = np.diff(offsets)
    good = ~column.is_null().to_numpy(zero_copy_only=False) & (length > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    out = {}
    for n in np.unique(length[good]):
        rows = np.flatnonzero(good & (length == n))
        out[int(n)] = rows, np.floor(SCALE * values[offsets[rows][:, None] + np.arange(n)])
    return out


class BallTree:
    """Nodes of (centre, radius, children or row range), split at the median of the widest direction."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.vectors = vectors
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        self._build(0, len(vectors), leaf)

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        at = len(self.nodes)
        part = self.vectors[self.order[lo:hi]]
        centre = part.mean(axis=0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
        self.nodes.append((centre, radius, lo, hi, -1, -1))
        if hi - lo > leaf and radius > 0:
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, axis], mid)]
            left = self._build(lo, lo + mid, leaf)
            right = self._build(lo + mid, hi, leaf)
            self.nodes[at] = (centre, radius, lo, hi, left, right)
        return at


class TopK:
    """The best k candidates of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors**2).sum(axis=1))
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Scores the candidates for the queries ``rows``; those at or above the kth score are merged."""
        score = self.vectors[rows] @ vectors.T
        score[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        near = score >= np.maximum(self.kth(rows), -1e300)[:, None]
        touched = np.flatnonzero(near.any(axis=1))
        if not len(touched):
            return
        if score.shape[1] > self.k:  # at most k of these can stay; equal scores at the edge are all kept
            edge = -np.partition(-score[touched], self.k - 1, axis=1)[:, self.k - 1]
            near[touched] &= score[touched] >= edge[:, None]
        for i in touched:
            r, pick = rows[i], near[i]
            s, c = np.concatenate([self.score[r], score[i, pick]]), np.concatenate([self.found[r], ids[pick]])
            best = np.lexsort((c, -s))[: self.k]
            self.score[r], self.found[r] = s[best], c[best]

    def search(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> int:
        """Branch and bound over one shard; the number of query-vector products made."""
        tree, made = BallTree(vectors, leaf), 0
        for lo in range(0, len(self.ids), GROUP):
            group = np.arange(lo, min(lo + GROUP, len(self.ids)))
            heap = [(-np.inf, 0, group)]
            while heap:
                _, at, rows = heapq.heappop(heap)
                centre, radius, a, b, left, right = tree.nodes[at]
                bounds = self.vectors[rows] @ centre + self.norm[rows] * radius
                keep = bounds * (1 + 1e-12) + 1e-6 >= self.kth(rows)
                rows = rows[keep]
                if not len(rows):
                    continue
                if left < 0:
                    pick = tree.order[a:b]
                    for c in range(0, len(pick), 4 * leaf):
                        part = pick[c : c + 4 * leaf]
                        self.offer(rows, ids[part], vectors[part])
                    made += len(rows) * (b - a)
                    continue
                for child in (left, right):
                    c, r = tree.nodes[child][:2]
                    heapq.heappush(heap, (-float((self.vectors[rows] @ c + self.norm[rows] * r).max()), child, rows))
        return made


def _search(block, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {n: TopK(ids, vectors, k, floor) for n, (ids, vectors, floor) in block.value.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in queries}

        def shard(n: int) -> None:
            if held[n]:
                ids, vectors = (np.concatenate(x) for x in zip(*held[n]))
                held[n] = []
                queries[n].search(ids, vectors)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for n, (rows, vectors) in integer_vectors(batch.column(1)).items():
                if n in queries:
                    size = max(1, SHARD_BYTES // (8 * n))
                    for lo in range(0, len(rows), size):
                        held[n].append((ids[rows[lo : lo + size]], vectors[lo : lo + size]))
                        if sum(len(x) for x, _ in held[n]) >= size:
                            shard(n)
        for n, q in queries.items():
            shard(n)
            keep = np.isfinite(q.score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q.ids, keep.sum(axis=1))), pa.array(q.found[keep]), pa.array(q.score[keep].astype(np.int64))],
                names=["query_id", "vec_id", "score"],
            )

    return scan


def _query_blocks(queries: DataFrame) -> Iterator[list]:
    block = []
    for row in queries.toLocalIterator():
        block.append((row.id, row.vector))
        if len(block) >= BLOCK:
            yield block
            block = []
    if block:
        yield block


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates."""
    spark = candidates.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null")
    pool = pick(candidates)
    schema = "query_id long, vec_id long, score long"
    probe = [(r.id, r.vector) for r in pool.limit(PROBE).toLocalIterator()]
    arrow = lambda rows: (np.array([i for i, _ in rows], np.int64), integer_vectors(pa.array([v for _, v in rows], pa.list_(pa.float64()))))
    probe_ids, probe_vectors = arrow(probe)

    def sent(rows: list) -> dict:
        """The block's queries by vector length, each with the kth score that the probe gives it."""
        ids, by_length = arrow(rows)
        out = {}
        for n, (at, vectors) in by_length.items():
            first = TopK(ids[at], vectors, k)
            if n in probe_vectors:
                where, seen = probe_vectors[n]
                for lo in range(0, len(at), GROUP):
                    first.offer(np.arange(lo, min(lo + GROUP, len(at))), probe_ids[where], seen)
            out[n] = ids[at], vectors, first.score[:, -1].copy()
        return out

    blocks = (spark.sparkContext.broadcast(sent(rows)) for rows in _query_blocks(pick(queries).dropDuplicates(["id"])))
    passes = ((map_arrow(pool, _search(b, k), schema), b) for b in blocks)
    parts = united(passes, spark.createDataFrame([], schema))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
