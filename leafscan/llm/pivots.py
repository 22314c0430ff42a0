"""Exact top-k search by inner product with pivot-table elimination.

The distances of all vectors to a few dozen pivots are worked out once.  By the triangle inequality the largest
difference of two vectors' pivot distances is a lower bound of their distance, and with the norms it bounds
their inner product from above.  A query looks at candidates in the order of that bound and stops, exactly, when no
remaining bound reaches its k-th best score.

Candidates are dealt into parts of bounded size; every query goes to each part once (a stated query set against all
rows, in blocks) and streams past the part's pivot table in batches, so a task holds one part and one batch.  The parts' best
are merged by a window over the query, k rows from each part.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an id, take no part;
shorter vectors count as padded with zeros; every row counts by itself, as a candidate and as a query, also one that
repeats the id or the vector of another: only a query's own row is no candidate of it; fewer than k candidates: all of
them; components are taken as 64-bit integers and sums must fit them too (beyond 2^53 Python integers are used).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.llm.common import cut

PIVOTS = 32
K = 5
SCALE = 256.0
#: Candidates of a part at most, and at least where there are fewer parts than cores.
PART_ROWS, LEAST_ROWS = 131_072, 4_096
#: Queries of a batch, and the first candidates of a query that are evaluated together (twice as many each time).
BATCH, FIRST = 64, 256


def quantised(embedding: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component x, as a double, in whole numbers."""
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(embedding: Column) -> Column:
    """Whether a vector is neither null nor holds anything but finite numbers."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(odd, F.lit(True))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, padded to a width (or the longest, if that is more)."""
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def _wider(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if matrix.shape[1] < width else matrix


def _products(rows: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    """Inner products, in doubles where they are exact."""
    if small:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in rows], dtype=np.int64)


class Part:
    """The candidates of one part with their pivot table."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        width = max(vectors.shape[1], pivots.shape[1])
        self.rows, self.ids, self.vectors, self.pivots = rows, ids, _wider(vectors, width), _wider(pivots, width)
        self.floats = self.vectors.astype(np.float64)
        self.squares = (self.floats**2).sum(axis=1)
        self.table = self._distances(self.floats)

    def _distances(self, floats: np.ndarray) -> np.ndarray:
        pivots = self.pivots.astype(np.float64)
        squares = (floats**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * floats @ pivots.T
        return np.sqrt(np.maximum(squares, 0)).T.copy()

    def best(self, own: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
        """(query row, query id, candidate id, score) of each query's k best candidates here; ties to the smaller id."""
        width = max(self.vectors.shape[1], queries.shape[1])
        if width > self.vectors.shape[1]:
            self.__init__(self.rows, self.ids, _wider(self.vectors, width), self.pivots)
        queries = _wider(queries, width)
        floats = queries.astype(np.float64)
        distances, found = self._distances(floats), []
        squares = (floats**2).sum(axis=1)
        for row, (query_row, query_id) in enumerate(zip(own.tolist(), ids.tolist(), strict=True)):
            lower = np.zeros(len(self.ids))
            for pivot, mine in zip(self.table, distances[:, row], strict=True):
                np.maximum(lower, np.abs(pivot - mine), out=lower)
            sums = squares[row] + self.squares
            upper = (sums - lower**2) / 2 + 1e-6 + 1e-9 * sums  # room for rounding: bounds may only be too high
            small = bool((sums < 2**52).all())
            order = np.argsort(-upper, kind="stable")
            best: list[tuple[int, int]] = []
            at, step = 0, FIRST
            while at < len(order) and (len(best) < k or upper[order[at]] >= -best[-1][0]):
                some = order[at : at + step]
                some = some[self.rows[some] != query_row]
                rows = self.floats if small else self.vectors
                scores = _products(rows[some], queries[row], small)
                if len(best) == k:
                    near = scores >= -best[-1][0]
                    some, scores = some[near], scores[near]
                best = sorted([*best, *zip((-scores).tolist(), self.ids[some].tolist(), strict=True)])[:k]
                at, step = at + step, 2 * step
            found += [(query_row, query_id, vec_id, -score) for score, vec_id in best]
        return found


def _search(pivots: np.ndarray, k: int):
    """Over rows sorted by part, candidates before queries: the best of every query in every part."""

    def results(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, part = None, [], None
        for batch in batches:
            parts, query = batch.column("part").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if number != parts[a]:
                    number, held, part = parts[a], [], None
                own, ids = (batch.column(c).slice(a, b - a).to_numpy() for c in ("row", "vec_id"))
                rows = _matrix(batch.column("v").slice(a, b - a), pivots.shape[1])
                if not query[a]:
                    held.append((own, ids, rows))
                    continue
                if part is None and held:
                    width = max(h[2].shape[1] for h in held)
                    numbers, names = (np.concatenate([h[n] for h in held]) for n in (0, 1))
                    part, held = Part(numbers, names, np.concatenate([_wider(h[2], width) for h in held]), pivots), []
                if part is not None:
                    for at in range(0, len(ids), BATCH):
                        yield results(part.best(own[at : at + BATCH], ids[at : at + BATCH], rows[at : at + BATCH], k))

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = K, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score from ``vectors`` (vec_id, v: array of long)."""
    own = cut(vectors.where("vec_id is not null and v is not null").select("vec_id", "v"))
    own = own.withColumn("row", F.monotonically_increasing_id())  # the checkpoint keeps its partitions and their order
    n = own.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // PART_ROWS), min(-(-n // LEAST_ROWS), 2 * cores))
    chosen = own.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "row").limit(n_pivots).collect()
    width = max((len(r["v"]) for r in chosen), default=0)
    pivots = np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in chosen], np.int64).reshape(len(chosen), width)
    candidates = own.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("query"), "row", "vec_id", "v")
    queries = own.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("query"), "row", "vec_id", "v")
    dealt = candidates.unionByName(queries).repartition(parts, "part").sortWithinPartitions("part", "query", "row")
    best = dealt.mapInArrow(_search(pivots, k), "query_row long, query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
