"""Yinyang clustering against rounds that measure every distance."""

import hashlib
import math

import numpy as np
import pytest

from graphloom.llm import yinyang

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def plain(q: list[list[int]], m: list[list[int]], rounds: int) -> tuple[list[int], list[list[int]]]:
    m = [list(x) for x in m]
    for r in range(rounds + 1):
        of = [min(range(len(m)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, m[j])), j)) for v in q]
        if r < rounds:
            for j in set(of):
                mine = [v for v, c in zip(q, of) if c == j]
                m[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return of, m


@pytest.mark.parametrize("span", [2, 9, 1000])
def test_bounds_change_nothing(span):
    rng = np.random.default_rng(span)
    for _ in range(25):
        n, d, k = int(rng.integers(20, 120)), int(rng.integers(1, 6)), int(rng.integers(1, 17))
        q = rng.integers(-span, span + 1, size=(n, d)).astype(np.int64)
        of = yinyang.grouped(q[:k], min(4, k))
        c = yinyang.Centroids(q[:k].copy(), of)
        for r in range(5):
            state = yinyang.next_assignment(q, c, *state[:3]) if r else yinyang.first_assignment(q, c)  # noqa: F821
            want, m = plain(q.tolist(), q[:k].tolist(), r)
            assert state[0].tolist() == want and c.m.tolist() == m
            new = c.m.copy()
            for j in set(want):
                new[j] = q[state[0] == j].sum(axis=0) // (state[0] == j).sum()
            c = yinyang.Centroids(new, of, c.m)


def test_bounds_leave_out_most_distances():
    rng = np.random.default_rng(3)
    q = (rng.normal(size=(4000, 16)) * 4 + rng.integers(0, 16, size=(4000, 1)) * 10).astype(np.int64)
    of = yinyang.grouped(q[:16], 4)
    c = yinyang.Centroids(q[:16].copy(), of)
    state = yinyang.first_assignment(q, c)
    for _ in range(3):
        new = c.m.copy()
        for j in set(state[0].tolist()):
            new[j] = q[state[0] == j].sum(axis=0) // (state[0] == j).sum()
        c = yinyang.Centroids(new, of, c.m)
        *state, measured = yinyang.next_assignment(q, c, *state)
        assert measured < 0.3 * len(q) * c.k


def clusters(spark, rows: list[tuple], **kw) -> tuple[list, np.ndarray]:
    found, m = yinyang.centroid_clusters(spark.createDataFrame([(*r, "own", "x") for r in rows], SCHEMA), **kw)
    return found.collect(), m


@pytest.mark.parametrize("factor", [1.0, 1e6, 1e30])
def test_clusters(spark, factor):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=4) * factor).tolist()) for i in range(150)]
    rows += [(3, rows[3][1]), (200, rows[4][1]), (None, [0.5, -0.5, 0.25, 0.0])]  # repeated rows, ties, no id
    odd = [(301, None), (302, []), (303, [1.0, 2.0, 3.0]), (304, [1.0, None, 0.0, 0.0]), (305, [float("nan"), 0.0, 0.0, 0.0]), (306, [float("inf"), 0.0, 0.0, 0.0]), (307, [1e307, 0.0, 0.0, 0.0])]
    got, m = clusters(spark, rows + odd, dims=4, k=6)
    q = [[math.floor(64 * x) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), q[i]))[:6]
    of, want = plain(q, [q[i] for i in order], 3)
    assert m.tolist() == want
    d = [sum((a - b) ** 2 for a, b in zip(v, want[c])) for v, c in zip(q, of)]
    most = (1 << 63) - 1
    cap = lambda x: min(x, most)
    sums = {j: cap(sum(cap(x) for x, c in zip(d, of) if c == j)) for j in set(of)}
    total = cap(sum(map(cap, d)))
    assert sorted(map(repr, got and [tuple(r) for r in got])) == sorted(repr((i, c, cap(x), sums[c], total)) for (i, _), c, x in zip(rows, of, d))


def test_few_vectors(spark):
    assert clusters(spark, [])[0] == []
    assert clusters(spark, [(1, [0.0, 1.0])], dims=3)[0] == []
    assert [tuple(r) for r in clusters(spark, [(1, [0.0, 1.0])], dims=2)[0]] == [(1, 0, 0, 0, 0)]
    got, _ = clusters(spark, [(i, [1.0, 1.0]) for i in range(40)], dims=2)
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0)} and len(got) == 40
