"""Exact top-k inner-product search: columnar branch-and-bound over blocks of dimensions.

Candidates stay where they are read; queries travel, in waves of bounded size that every task gets as a broadcast. A task
lays its candidates out by dimension and lets scores grow dimension block by dimension block. What the remaining
dimensions can still add is at most the product of the remaining lengths (Cauchy-Schwarz); a candidate that cannot reach
the k-th best score so far, of this batch or of those before it, is dropped and the rest compacted. Each task gives k rows
a query, which are merged.

Components are whole numbers, held as doubles without loss. Sums below 2^52 are exact as they are; beyond, bounds are
widened by the largest rounding error and survivors are scored again in whole numbers of any size. A score of the result
that does not fit a long fails the query, as does a component of 2^480 and more.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without id;
vectors of another dimension than the query's are no candidates; ties go to the smaller id; every row is a candidate of
its own, also one that repeats another, but none for a query of its id; rows that repeat an id and vector are one query,
rows of one id with different vectors are a query each; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record, stored

#: Candidates laid out at once; bytes of the queries of a wave.
CANDIDATES, WAVE_BYTES = 4096, 8 << 20
#: Dimensions added at once.
STEP = 16
#: Components from this size on fail the query.
LARGEST = 2.0**480
_OUT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim and the vector as whole numbers floor(scale * x), without vectors that take no part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < math.inf))

    def whole(v):
        v = v.cast("double")
        # floor() gives a long; from 2^50 on there are no fractions
        out = F.when(F.abs(v) < 2.0**50, F.floor(F.lit(scale) * v).cast("double")).otherwise(F.lit(float(scale)) * v)
        return F.when(F.abs(v) >= LARGEST / scale, F.raise_error(F.lit("a component is too large for a score")).cast("double")).otherwise(out)

    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), F.transform(x, whole).alias("v"))


def exact(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of the columns of x with q, as whole numbers of any size."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 2**62:
        return (q.astype(np.int64) @ x.astype(np.int64)).tolist()
    b = [int(v) for v in q]
    return [sum(int(v) * w for v, w in zip(column, b, strict=True)) for column in x.T]


class Wave:
    """Some queries of one dimension, and the best candidates that each has met: whole-number scores with ids."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, step: int = STEP):
        self.numbers, self.ids, self.q, self.k = numbers, ids, v, k
        dim = v.shape[0]
        self.cuts = list(range(0, dim, step)) or [0]
        self.ends = [*self.cuts[1:], dim]
        self.left = self.mass(v)
        self.most = np.abs(v).max(0, initial=0)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def mass(self, v: np.ndarray) -> list[np.ndarray]:
        """The length of what is left of each vector from each cut on; the first of the whole."""
        squares = v * v
        return [np.sqrt(squares[c:].sum(0)) * (1 + 1e-12) for c in [0, *self.ends]]

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes in candidates; x is laid out by dimension."""
        k, dim = self.k, len(x)
        left, most = self.mass(x), float(np.abs(x).max(initial=0))
        for j, name in enumerate(self.ids):
            q, best = self.q[:, j], self.best[j]
            plain = most * self.most[j] * dim < 2**52
            # rounding of sums, of lengths and of their products; exact sums are whole numbers
            slack = 0.5 if plain else (dim + 4) * 2.0**-51 * self.left[0][j] * left[0]
            alive, score = np.flatnonzero(ids != name), np.zeros(len(ids))
            score = score[alive]
            least = float(best[-1][0]) if len(best) == k else -math.inf
            for n, (cut, end) in enumerate(zip(self.cuts, self.ends, strict=True)):
                score = score + q[cut:end] @ (x[cut:end] if len(alive) == x.shape[1] else x[cut:end, alive])
                more = self.left[n + 1][j] * left[n + 1][alive] + (slack if plain else slack[alive])
                bound = least - (0 if plain else abs(least) * 2.0**-52)
                if len(alive) > k:
                    low = score - more
                    bound = max(bound, np.partition(low, len(low) - k)[len(low) - k])
                keep = score + more >= bound
                if not keep.all():
                    alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
            if len(alive):
                told = np.rint(score).astype(np.int64).tolist() if plain else exact(x[:, alive], q)
                found = [*((-s, i) for s, i in best), *((-s, i) for s, i in zip(told, ids[alive].tolist(), strict=True))]
                self.best[j] = [(-s, i) for s, i in sorted(found)[:k]]

    def rows(self) -> pa.RecordBatch:
        found = [(n, q, i, s) for n, q, best in zip(self.numbers.tolist(), self.ids.tolist(), self.best, strict=True) for s, i in best]
        if any(not -(2**63) <= r[3] < 2**63 for r in found):
            raise OverflowError("a score does not fit a long")
        n, q, i, s = map(list, zip(*found, strict=True)) if found else ([], [], [], [])
        return record(_OUT, query=n, query_id=q, vec_id=i, score=s)


def _by_dimension(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, ids and vectors (laid out by dimension) of the rows of each dimension."""
    dims, ids = table.column("dim").to_numpy(), table.column("vec_id").to_numpy()
    for dim in np.unique(dims):
        of = np.flatnonzero(dims == dim)
        v = table.column("v").take(pa.array(of))
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        yield of, ids[of], np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False).reshape(len(of), dim).T)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, candidates: int = CANDIDATES, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all vectors but its own. Both inputs as of quantised()."""
    context = vectors.sparkSession.sparkContext
    size = queries.agg(F.sum(8 * F.col("dim") + 64)).first()[0] or 0
    waves = max(1, math.ceil(size / wave_bytes))
    asked = queries.distinct().withColumn("wave", F.pmod(F.xxhash64("vec_id", "v"), F.lit(waves)).cast("int"))
    if waves > 1:
        asked = stored(asked, "queries")
    if vectors.rdd.getNumPartitions() < context.defaultParallelism:  # a small table: spread the work
        vectors = vectors.repartition(context.defaultParallelism)
    parts = []
    for wave in range(waves):
        told = asked.where(F.col("wave") == wave).select("vec_id", "dim", "v").toArrow()  # about wave_bytes
        shared = context.broadcast([(of + (wave << 32), ids, v) for of, ids, v in _by_dimension(told)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = {v.shape[0]: Wave(numbers, ids, v, k) for numbers, ids, v in shared.value}
            for batch in batches:
                for at in range(0, batch.num_rows, candidates):
                    for _, ids, x in _by_dimension(batch.slice(at, candidates)):
                        if len(x) in of:
                            of[len(x)].meet(ids, x)
            for w in of.values():
                yield w.rows()

        found = vectors.mapInArrow(run, "query long, query_id long, vec_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(stored(found, "wave") if waves > 1 else found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_five(vectors: DataFrame) -> DataFrame:
    """The contract's rows."""
    whole = quantised(vectors)
    return search(whole, whole.where("vec_id % 50 = 0"), 5)
