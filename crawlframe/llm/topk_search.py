"""Exact top-k search by inner product with multi-resolution segment statistics.

Components are first turned into directions of descending second moment of the block's queries, which leaves inner products
as they are and puts what tells most into the first segments. A vector is cut into segments; the means and deviations of its segments give a lower bound on its distance to another
vector, sum of m * ((mean - mean')^2 + (dev - dev')^2) over segments of m components, and with both norms an upper bound
on the inner product. Bounds are taken coarse to fine over a tile of queries and an Arrow batch; only pairs whose
bound reaches the query's k-th best score so far are scored exactly. Each task keeps its k best per query, and a window
picks the k best of all tasks.

Queries reach the executors in blocks of bounded size, each against all rows.

Defined cases: null vectors, vectors with null or non-finite components, and null ids take no part; a candidate with the
query's own id is the query itself; repeated query ids count once (least vector); only vectors of equal length meet; ties
go to the smaller id; an empty table gives no rows; other columns are ignored. Scores are exact integers; one beyond 64 bits
is an error. How much the bounds spare depends on the data: vectors that point evenly in all directions are nearly all scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
QUERY_EVERY = 50
#: Numbers of segments, coarse to fine, and bytes of queries sent to the executors at a time.
LEVELS = (4, 16, 32)
BLOCK_BYTES = 32_000_000
#: Queries that are bounded against a batch at a time, and the longest vectors for which directions are found.
QUERY_TILE = 512
ROTATE_COMPONENTS = 1024


def _edges(n: int, segments: int) -> list[int]:
    """Bounds of segments of n components: half of them hold one each of the first, which vary most, the others are even."""
    if segments >= n:
        return list(range(n + 1))
    single = segments // 2
    return [*range(single), *np.linspace(single, n, segments - single + 1).astype(int).tolist()]


def _features(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of segments: the dot product of two of these bounds that of the vectors."""
    out = []
    edges = _edges(x.shape[1], segments)
    for a, b in zip(edges, edges[1:], strict=False):
        part = x[:, a:b]
        if b - a == 1:
            out.append(part[:, 0])
            continue
        mean = part.mean(axis=1)
        out += [mean * (b - a) ** 0.5, np.sqrt(np.maximum(0, ((part - mean[:, None]) ** 2).sum(axis=1)))]
    return np.stack(out, axis=1)


def rotation(x: np.ndarray) -> np.ndarray | None:
    """Orthogonal directions of descending second moment; None where vectors are so long that finding them costs too much."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy() if 0 < x.shape[1] <= ROTATE_COMPONENTS else None


class QueryBlock:
    """Queries by length: ids, integer vectors, their rotation and their features from coarse to fine."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        self.by_length = {}
        for n in sorted({len(v) for v in vectors}):
            some = [i for i, v in enumerate(vectors) if len(v) == n]
            x = np.array([vectors[i] for i in some], np.int64).reshape(len(some), n)
            turn = rotation(x.astype(float))
            turned = x.astype(float) if turn is None else x.astype(float) @ turn
            self.by_length[n] = (np.array([ids[i] for i in some]), x, turn, [_features(turned, s) for s in LEVELS] if n else [])


class Best:
    """The k best (score, id) of each query of a block so far; ``scored`` counts pairs whose exact score was computed."""

    def __init__(self, block: QueryBlock, k: int):
        self.block, self.k, self.scored = block, k, 0
        self.found = {n: [[] for _ in q[0]] for n, q in block.by_length.items()}

    def _keep(self, n: int, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.k and scores.dtype != object:  # nothing below the k-th best of these rows
            ok = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[ok], scores[ok]
        best = self.found[n][q] + list(zip((-scores).tolist(), ids.tolist(), strict=True))
        self.found[n][q] = sorted(best)[: self.k]

    def _floors(self, n: int, tile: range) -> np.ndarray:
        return np.array([-float(f[-1][0]) if len(f) == self.k else -np.inf for f in (self.found[n][q] for q in tile)])

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows of integer vectors, against all queries of their length, a tile of queries at a time."""
        n = x.shape[1]
        if n not in self.block.by_length or not len(ids):
            return
        own, vectors, turn, features = self.block.by_length[n]
        if not n:
            for q in range(len(own)):
                self._keep(n, q, ids[ids != own[q]], np.zeros((ids != own[q]).sum()))
            return
        real = x.astype(float)
        turned = real if turn is None else real @ turn
        mine = [_features(turned, s) for s in LEVELS]
        norms = [float(np.sqrt((m * m).sum(axis=1)).max()) for m in (features[-1], mine[-1])]
        slack = 1e-6 + 1e-9 * (1 + norms[0]) * (1 + norms[1])
        # Sums below 2^53 are exact in doubles; larger ones are worked in Python's integers.
        small = float(np.abs(real).max()) * float(np.abs(vectors.astype(float)).max()) * n < 2**53
        rows, asked = (real, vectors.astype(float)) if small else (x.astype(object), vectors.astype(object))
        for first in range(0, len(own), QUERY_TILE):
            self._tile(range(first, min(first + QUERY_TILE, len(own))), ids, rows, asked, own, features, mine, slack)

    def _tile(self, tile: range, ids, rows, asked, own, features, mine, slack) -> None:
        n = asked.shape[1]
        at = slice(tile.start, tile.stop)
        bound = features[0][at] @ mine[0].T + slack

        def score(q: int, some: np.ndarray) -> None:
            some = some[ids[some] != own[q]]
            self._keep(n, q, ids[some], rows[some] @ asked[q])
            self.scored += len(some)

        floors = self._floors(n, tile)
        if len(ids) > 8 * self.k and np.isinf(floors).any():  # a first floor from the rows that look best
            for q, some in zip(tile, np.argpartition(-bound, 4 * self.k, axis=1)[:, : 4 * self.k], strict=True):
                score(q, some)
            floors = self._floors(n, tile)
            for q in tile:
                self.found[n][q] = []  # only the floor is kept: the rows come again below
        alive = bound >= floors[:, None]
        for mine_fine, fine in zip(mine[1:], features[1:], strict=True):
            for i in np.flatnonzero(alive.any(axis=1)).tolist():
                some = np.flatnonzero(alive[i])
                alive[i, some] = mine_fine[some] @ fine[tile[i]] + slack >= floors[i]
        for i in np.flatnonzero(alive.any(axis=1)).tolist():
            score(tile[i], np.flatnonzero(alive[i]))

    def rows(self) -> list[tuple[int, int, int]]:
        return [(int(q), i, int(-s)) for n, q_ in self.block.by_length.items() for q, f in zip(q_[0], self.found[n], strict=True) for s, i in f]


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, query_every: int = QUERY_EVERY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``.

    Components become floor(scale * x); queries are the rows whose id is divisible by query_every.
    """
    spark = vectors.sparkSession
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    queries = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = queries.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    found = None
    for b in range(n_blocks):
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).collect()
        block = spark.sparkContext.broadcast(QueryBlock([r[0] for r in some], [r[1] for r in some]))
        part = rows.mapInArrow(_search(block, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionAll(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block.value, k)
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, lengths = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for n in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == n)
                for a in range(0, len(of), 4096):
                    some = of[a : a + 4096]
                    best.add(ids[some], flat[starts[some][:, None] + np.arange(n)])
        rows = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return run
