"""Exact top-k search by distributed histogram selection.

Every pass scores all candidates against a block of queries. The first passes only count: each task counts its scores
in bins of the interval in which a query's k-th value must lie, Spark adds the counts, and the bin that holds the k-th
value becomes the next interval. When few candidates or one value are left, a last pass keeps what reaches the
interval, and ties go to the smaller id. A task sends at most k bins or rows for each query, as what lies below its
own k-th can't be among the best k: ties of any number cost nothing.

Scores are integers throughout. Where vectors are short enough for all sums to stay below 2^53, products of matrices of
doubles give them exactly; up to 2^62, products of 64-bit integers; beyond, Python's integers.

Queries are taken in blocks of at most `block` rows, whose matrix (block x dimensions) is all that is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256
#: Scores of a batch against a block are made for so many candidates at once.
ROWS = 2048
MOST = (1 << 63) - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and q = floor(scale * component) as doubles, which are whole numbers, of vectors without null or non-finite ones."""
    x = F.transform(F.col(vector_col), lambda v: F.lit(scale) * v.cast("double"))
    # from 2^53 on every double is a whole number
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(F.when(F.abs(v) < 2.0**53, v)).cast("double")).otherwise(v)
    good = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), x.alias("x")).filter(good).select("id", F.transform("x", whole).alias("q"))


def _matrices(batch: pa.RecordBatch):
    """(ids, matrix) of equally long vectors."""
    ids, q = batch.column(0), batch.column(1)
    n = np.diff(q.offsets.to_numpy())
    if not len(n):
        return
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        for at in range(0, len(rows), ROWS):
            some = pa.array(rows[at : at + ROWS])
            yield ids.take(some).to_pylist(), q.take(some).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)


def _integers(m: np.ndarray, kind: type) -> np.ndarray:
    return m if kind is np.float64 else m.astype(np.int64) if kind is np.int64 else np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape)


class _Block:
    """Queries of one block; of each, the interval [lo, hi) with its k-th value and the number of scores of hi or more."""

    def __init__(self, ids: list[int], vectors: list[list[float]], reach: int, k: int):
        """reach: an upper bound of every vector's length."""
        norm = [math.isqrt(sum(int(x) ** 2 for x in v)) + 1 for v in vectors]
        most = max(norm, default=0) * reach + 2
        self.kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 61 else object
        self.score = object if self.kind is object else np.int64
        self.ids, self.k = np.array(ids, dtype=np.int64), k
        self.dims = {d: np.flatnonzero([len(v) == d for v in vectors]) for d in {len(v) for v in vectors}}
        self.m = {d: _integers(np.array([vectors[i] for i in rows], dtype=np.float64).reshape(len(rows), d), self.kind) for d, rows in self.dims.items()}
        self.lo = np.array([-n * reach - 1 for n in norm], dtype=self.score)
        self.hi = -self.lo + 1
        self.done = np.zeros(len(ids), dtype=bool)

    def width(self) -> np.ndarray:
        return np.maximum(1, -((self.lo - self.hi) // BINS)).astype(self.score)

    def scores(self, ids: list, m: np.ndarray):
        """Numbers of queries, the scores (candidates x queries), and which of them are of a query's own row."""
        rows = self.dims.get(m.shape[1])
        if rows is None:
            return None, None, None
        s = (_integers(m, self.kind) @ self.m[m.shape[1]].T).astype(self.score)
        place, own = {int(x): j for j, x in enumerate(self.ids[rows])}, np.zeros(s.shape, dtype=bool)
        for i, x in enumerate(ids):
            if x in place:
                own[i, place[x]] = True
        return rows, s, own


def _count(block):
    def run(batches):
        b = block.value
        total, width = np.zeros((len(b.ids), BINS + 1), dtype=np.int64), b.width()
        for batch in batches:
            for ids, m in _matrices(batch):
                rows, s, own = b.scores(ids, m)
                if rows is None:
                    continue
                at = (s - b.lo[rows]) // width[rows]
                ok = (at >= 0).astype(bool) & ~own & ~b.done[rows]
                at = np.minimum(at, BINS)  # the last column: what lies above the interval
                flat = (np.arange(len(rows))[None, :] * (BINS + 1) + np.where(ok, at, 0).astype(np.int64))[ok]
                total[rows] += np.bincount(flat, minlength=len(rows) * (BINS + 1)).reshape(len(rows), BINS + 1)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total  # in higher bins
        q, at = np.nonzero((total > 0) & (above < b.k))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(at, pa.int64()), pa.array(total[q, at], pa.int64())], ["q", "bin", "n"])

    return run


def _keep(block):
    def run(batches):
        b = block.value
        best: dict[int, tuple] = {}  # of each query: scores and ids of its best k here

        def cut(j, s, i):
            order = np.lexsort((i, -s))[: b.k] if b.kind is not object else np.array(sorted(range(len(s)), key=lambda x: (-s[x], i[x]))[: b.k], dtype=np.int64)
            best[j] = (s[order], i[order])

        for batch in batches:
            for ids, m in _matrices(batch):
                rows, s, own = b.scores(ids, m)
                if rows is None:
                    continue
                id_of = np.array([np.inf if x is None else x for x in ids], dtype=object)
                floor = np.array([max(b.lo[j], best[j][0][-1]) if j in best and len(best[j][0]) == b.k else b.lo[j] for j in rows], dtype=b.score)
                r, c = np.nonzero((s >= floor).astype(bool) & ~own)
                order = np.argsort(c, kind="stable")
                r, c = r[order], c[order]
                for part in np.split(np.arange(len(c)), np.flatnonzero(np.diff(c)) + 1) if len(c) else []:
                    j = int(rows[c[part[0]]])
                    had = best.get(j, (np.empty(0, dtype=b.score), np.empty(0, dtype=object)))
                    cut(j, np.concatenate([had[0], s[r[part], c[part[0]]]]), np.concatenate([had[1], id_of[r[part]]]))
        q = [int(b.ids[j]) for j, (s, _) in best.items() for _ in s]
        i = [None if x == np.inf else int(x) for _, ids in best.values() for x in ids]
        s = [int(x) for scores, _ in best.values() for x in scores]
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array([max(-MOST, min(MOST, x)) for x in s], pa.int64()), pa.array([f"{x + (1 << 2200):0664d}" for x in s] if b.kind is object else [None] * len(s), pa.string())], ["query_id", "vec_id", "score", "exact"])

    return run


def histogram_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block: int = 8192, few: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest integer inner products of each query with any other row.

    Queries are the rows whose id is divisible by `every`. Null vectors and those with a null or non-finite component
    take no part; vectors are compared with those of their own length; a row with the query's own id is not a
    candidate; a null id is never a query and comes last among ties; repeated ids are separate candidates, and one
    query. An empty table, or no query, gives no rows. Ranks are by exact scores, however large; a score of 2^63 or more is
    returned as 2^63 - 1 (and below as the negative of that). A component whose product with `scale` is no finite double
    counts as non-finite.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vector_col, scale)
    queries = rows.filter(F.col("id") % every == 0)
    norm2 = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    n, longest, largest, dims = rows.agg(F.count_if(F.col("id") % every == 0), F.sqrt(F.max(norm2)), F.max(F.array_max(F.transform("q", F.abs))), F.max(F.size("q"))).first()
    reach = int((longest or 0.0) * (1 + 1e-9)) + 1 if (longest or 0.0) < math.inf else int(largest) * (math.isqrt(dims) + 1)
    out, blocks = None, math.ceil(n / block) or 1
    for at in range(blocks):
        got = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == at).groupBy("id").agg(F.min("q").alias("q")).collect() if n else []
        b = _Block([r.id for r in got], [r.q for r in got], reach, k)
        while len(b.ids) and not b.done.all():
            sent = spark.sparkContext.broadcast(b)
            counts = rows.mapInArrow(_count(sent), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            w = Window.partitionBy("q").orderBy(F.desc("bin"))
            found = counts.withColumn("upto", F.sum("n").over(w)).filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).collect()
            width, seen = b.width(), set()
            for r in found:
                seen.add(r.q)
                b.lo[r.q] += width[r.q] * r["bin"]
                b.hi[r.q] = b.lo[r.q] + width[r.q]
                b.done[r.q] = r.upto <= few or width[r.q] <= 1
            for j in range(len(b.ids)):
                if j not in seen:  # done before, or fewer than k candidates: all of them
                    b.done[j] = True
        sent = spark.sparkContext.broadcast(b)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), F.col("vec_id").asc_nulls_last())
        best = rows.mapInArrow(_keep(sent), "query_id long, vec_id long, score long, exact string").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        best = best.select("query_id", "rank", "vec_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
