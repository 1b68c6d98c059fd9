"""Centroid clustering in whole numbers, with Yinyang bounds.

Lloyd's rounds, but a vector is compared only with centroids that its bounds leave. Centroids are put in groups once, by
their own first places. A vector keeps an upper bound of the distance to its centroid and for each group one lower
bound of the distance to the group's other centroids; when centroids move, bounds move by as much. A vector whose
least lower bound lies above its upper bound stays without any distance (global filter); else groups whose bound lies
above are left out (group filter), then centroids of the others whose own drift leaves the bound above the best so far,
and what survives is measured exactly. Bounds are doubles, rounded to the safe side; what decides are squared
distances of whole numbers, so results equal those of a full scan, ties included.

Centroids (k x dimensions) are all that goes to tasks. Each round is one pass that rewrites vectors with their bounds in
the shared folder, and one that adds up components by cluster: tasks send a number for each cluster and component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, written
from .topk import MOST, quantized

ROWS = 8192
#: Bounds keep this share of themselves as a margin for rounding.
SAFE = 1e-9
#: Sums leave tasks as digits in this base, so that Spark adds them as longs.
DIGIT = 40


# ---- centroids, on the driver ----------------------------------------------------------------------------------------
def _whole(m, dims: int, kind: type) -> np.ndarray:
    """Rows of whole numbers as a matrix of `kind`."""
    if kind is object:
        return np.array([int(v) for row in m for v in row], dtype=object).reshape(-1, dims)
    return np.array(m, dtype=kind).reshape(-1, dims)


def _kind(largest: float, dims: int) -> type:
    """The least type that holds all squared distances of vectors with such components."""
    most = dims * (2 * int(largest) + 2) ** 2
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def _root(d2) -> np.ndarray:
    return np.sqrt(np.asarray(d2, dtype=np.float64))


class Centroids:
    """Centroids, their groups, and how far each has moved since the bounds were made."""

    def __init__(self, m: np.ndarray, groups: np.ndarray, before: np.ndarray | None = None):
        self.m, self.groups, self.k, self.first = m, groups, len(m), before is None
        moved = np.zeros(self.k) if before is None else _root(((m - before) ** 2).sum(axis=1))
        self.drift = moved * (1 + SAFE)
        self.members = [np.flatnonzero(groups == g) for g in range(int(groups.max(initial=-1)) + 1)]
        self.group_drift = np.array([self.drift[x].max(initial=0.0) for x in self.members])

    def distance2(self, q: np.ndarray, j: int) -> np.ndarray:
        d = q - self.m[j]
        return (d * d).sum(axis=1)


def grouped(m: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by a few rounds of clustering centroids themselves; groups without a centroid are not counted."""
    x = np.array(m, dtype=np.float64).reshape(len(m), -1)
    x = x / max(1.0, np.abs(x).max(initial=0.0))
    centres = x[:groups].copy()
    for _ in range(rounds):
        of = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in set(of.tolist()):
            centres[g] = x[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


# ---- assignment, in tasks ---------------------------------------------------------------------------------------------
def first_assignment(q: np.ndarray, c: Centroids):
    """cluster, upper and lower bounds of rows of whole numbers, from the distances to all centroids."""
    n = np.arange(len(q))
    d2 = np.stack([c.distance2(q, j) for j in range(c.k)], axis=1)
    cluster = d2.argmin(axis=1)  # the first of equals
    away = _root(d2)
    upper = away[n, cluster] * (1 + SAFE)
    away[n, cluster] = np.inf
    return cluster, upper, np.stack([away[:, x].min(axis=1) for x in c.members], axis=1) * (1 - SAFE)


def next_assignment(q: np.ndarray, c: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """cluster, upper and lower bounds after the centroids moved, and the number of distances measured."""
    cluster, old = cluster.copy(), lower
    upper = upper + c.drift[cluster]
    lower = np.maximum(0.0, old - c.group_drift) * (1 - SAFE)
    rows = np.flatnonzero(lower.min(axis=1) <= upper)  # global filter
    was, was_d2, measured = cluster[rows], np.zeros(len(rows), dtype=q.dtype), len(rows)
    for j in np.unique(was):
        was_d2[was == j] = c.distance2(q[rows[was == j]], j)
    upper[rows] = _root(was_d2) * (1 + SAFE)
    some = lower[rows].min(axis=1) <= upper[rows]
    rows, was, was_d2 = rows[some], was[some], was_d2[some]
    best, best_d2, reach = was.copy(), was_d2.copy(), upper[rows].copy()
    seen = []
    for g, members in enumerate(c.members):
        hit = np.flatnonzero(lower[rows, g] <= reach)  # group filter
        least, second, nearest = np.full(len(rows), np.inf), np.full(len(rows), np.inf), np.full(len(rows), -1)
        for j in members:
            some = hit[was[hit] != j]
            bound = np.maximum(0.0, old[rows[some], g] - c.drift[j]) * (1 - SAFE)
            skip = bound > reach[some]
            second[some[skip]] = np.minimum(second[some[skip]], bound[skip])
            some = some[~skip]
            if not len(some):
                continue
            d2 = c.distance2(q[rows[some]], j)
            measured += len(some)
            away = _root(d2) * (1 - SAFE)
            closer = away < least[some]
            second[some] = np.minimum(second[some], np.where(closer, least[some], away))
            nearest[some], least[some] = np.where(closer, j, nearest[some]), np.where(closer, away, least[some])
            wins = ((d2 < best_d2[some]) | ((d2 == best_d2[some]) & (j < best[some]))).astype(bool)
            won = some[wins]
            best[won], best_d2[won] = j, d2[wins]
            reach[won] = _root(best_d2[won]) * (1 + SAFE)
        seen.append((hit, nearest, least, second))
    for g, (hit, nearest, least, second) in enumerate(seen):
        lower[rows[hit], g] = np.where(nearest[hit] == best[hit], second[hit], np.minimum(least[hit], second[hit]))
    left = np.flatnonzero(best != was)  # a centroid that was left is one of its group's others now
    at = rows[left], c.groups[was[left]]
    lower[at] = np.minimum(lower[at], _root(was_d2[left]) * (1 - SAFE))
    cluster[rows], upper[rows] = best, reach
    return cluster, upper, lower, measured


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return _whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), dims, kind)


def _chunks(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _pass(sent, dims: int, kind: type, groups: int):
    """id, q (, cluster, upper, lower) -> id, q, cluster, upper, lower."""

    def run(batches):
        c = sent.value
        for s in _chunks(batches):
            q = _matrix(s.column(1), dims, kind)
            if c.first:
                cluster, upper, lower = first_assignment(q, c)
            else:
                lower = s.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, groups)
                cluster, upper, lower, _ = next_assignment(q, c, s.column(2).to_numpy().astype(np.int64), s.column(3).to_numpy(), lower)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(q) + 1) * groups, groups), pa.int32()), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(cluster, pa.int32()), pa.array(upper), bounds], ["id", "q", "cluster", "upper", "lower"])

    return run


def _distances(sent, dims: int, kind: type):
    """id, q, cluster -> vec_id, cluster, distance."""

    def run(batches):
        c = sent.value
        for s in _chunks(batches):
            q, cluster = _matrix(s.column(1), dims, kind), s.column(2).to_numpy()
            d2 = ((q - c.m[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), pa.array([min(MOST, int(x)) for x in d2], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _sums(dims: int, kind: type):
    """cluster, component (-1: the count), digit, n: what a task's rows add up to."""

    def run(batches):
        total, count = {}, {}
        for b in batches:
            cluster = b.column(1).to_numpy()
            q = _matrix(b.column(0), dims, object if kind is object else np.int64)
            for j in np.unique(cluster).tolist():
                part = q[cluster == j].sum(axis=0)
                total[j] = total.get(j, np.zeros(dims, dtype=object)) + np.array([int(x) for x in part], dtype=object)
                count[j] = count.get(j, 0) + int((cluster == j).sum())
        out = [(j, -1, 0, n) for j, n in count.items()]
        for j, sums in total.items():
            for i, x in enumerate(sums):
                digit, sign, x = 0, -1 if x < 0 else 1, abs(x)
                while x:
                    out.append((j, i, digit, sign * (x & ((1 << DIGIT) - 1))))
                    x, digit = x >> DIGIT, digit + 1
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if i == 3 else pa.int32()) for i in range(4)], ["cluster", "component", "digit", "n"])

    return run


def _means(state: DataFrame, c: Centroids, dims: int, kind: type) -> np.ndarray:
    """Each centroid replaced by floor(sum / count) of its vectors' components; one without vectors as it was."""
    got = state.select("q", "cluster").mapInArrow(_sums(dims, kind), "cluster int, component int, digit int, n long")
    count, total = {}, {}
    for r in got.groupBy("cluster", "component", "digit").agg(F.sum("n").alias("n")).collect():  # k x dimensions x digits at most
        if r.component < 0:
            count[r.cluster] = r.n
        else:
            at = r.cluster, r.component
            total[at] = total.get(at, 0) + (r.n << DIGIT * r.digit)
    rows = [[total.get((j, i), 0) // count[j] for i in range(dims)] if j in count else c.m[j].tolist() for j in range(c.k)]
    return _whole(rows, dims, kind)


# ---- Spark -------------------------------------------------------------------------------------------------------------
def centroid_clusters(vectors: DataFrame, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, groups: int = 4, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia of every vector that takes part; the last centroids).

    Those with exactly `dims` components, none null or non-finite, take part; a component x stands for floor(scale * x).
    The first centroids are the k vectors whose ids after `seed` have the least sha256 in hexadecimal (ties, as of
    repeated ids: by components; a null id counts as empty). Each of `rounds` rounds assigns every vector to the nearest centroid
    (squared distance; ties: smaller number) and moves each centroid that has vectors to the floors of their
    means; then all are assigned once more. With fewer than k vectors each is a centroid; none give no rows. Repeated
    rows are vectors of their own. Results are exact whatever the components' size; a distance or inertia of 2^63 or
    more is given as 2^63 - 1.

    Vectors with their bounds are written to the shared folder each round, and those of the round before deleted; what
    stays is the table of results.
    """
    spark = vectors.sparkSession
    work = Tables(spark, "yinyang")
    kind_of_id = vectors.select(id_col).dtypes[0][1]
    rows = work.write(quantized(vectors.filter(F.size(vector_col) == dims), id_col, vector_col, scale), "rows")
    largest = rows.agg(F.max(F.array_max(F.transform("q", F.abs)))).first()[0]
    kind = _kind(largest or 0.0, dims)
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = rows.withColumn("h", digest).orderBy("h", "q").limit(k).collect()
    m = _whole([r.q for r in start], dims, kind)
    of = grouped(m, min(groups, len(m))) if len(m) else np.zeros(0, dtype=np.int64)
    n_groups = int(of.max(initial=0)) + 1
    schema = f"id {kind_of_id}, q array<double>, cluster int, upper double, lower array<double>"
    c, state = Centroids(m, of), rows
    if not len(m):
        return spark.createDataFrame([], f"vec_id {kind_of_id}, cluster int, distance long, cluster_inertia long, inertia long"), m
    for r in range(rounds + 1):
        state = work.write(state.mapInArrow(_pass(spark.sparkContext.broadcast(c), dims, kind, n_groups), schema), f"round-{r}")
        work.discard("rows" if not r else f"round-{r - 1}")
        if r < rounds:
            c = Centroids(_means(state, c, dims, kind), of, c.m)
    last = state.select("id", "q", "cluster").mapInArrow(_distances(spark.sparkContext.broadcast(c), dims, kind), f"vec_id {kind_of_id}, cluster int, distance long")
    out = written(last, "clusters")
    work.close()
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)").alias("s")).collect()  # k rows
    most = lambda x: min(MOST, int(x))
    inertia = spark.createDataFrame([(r.cluster, most(r.s), most(sum(x.s for x in per))) for r in per], "cluster int, cluster_inertia long, inertia long")
    return out.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), c.m
