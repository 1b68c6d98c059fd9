"""Periodic runs against the definition, on odd rows, and the query's planted rows and digests against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest

from graphloom.llm import runs

SCHEMA = "doc_id long, text string, runs string, collapsed int"


def by_definition(w: list, least: int, times: int) -> list[tuple]:
    """Every stretch with its smallest period, kept if long enough and if no neighbour extends it."""
    n, out = len(w), []
    for s in range(n):
        for e in range(s + least, n + 1):
            size = e - s
            q = next(q for q in range(1, size + 1) if all(w[i] == w[i + q] for i in range(s, e - q)))
            if size >= times * q and not (s and w[s - 1] == w[s - 1 + q]) and not (e < n and w[e] == w[e - q]):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_comparison(w: list, least: int = 24, times: int = 3) -> list[tuple]:
    """For each period the stretches that agree with themselves that far on; of equal stretches the least period."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, size, q) for (s, size), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w: list, found: list) -> list:
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + size for s, size, q in found)]


def samples(seed: int, count: int):
    rng = np.random.default_rng(seed)
    for _ in range(count):
        n, w = int(rng.integers(0, 90)), rng.integers(0, int(rng.integers(1, 5)), size=90)
        w = w[:n]
        if n and rng.random() < 0.7:
            p, at = int(rng.integers(1, 12)), int(rng.integers(0, n))
            w[at:] = np.resize(w[at : at + p], n - at)
        yield w


def rows(found: np.ndarray) -> list[tuple]:
    return [tuple(x) for x in found.tolist()]


def test_runs_by_definition():
    for w in samples(1, 60):
        w = w[:36]
        assert rows(runs.find_runs(w, 6, 2)) == by_definition(w.tolist(), 6, 2)
        assert rows(runs.find_runs(w, 9, 3)) == by_definition(w.tolist(), 9, 3)


@pytest.mark.parametrize("collide", [False, True])
def test_runs_even_where_hashes_collide(monkeypatch, collide):
    if collide:
        monkeypatch.setattr(runs, "BASE", np.uint64(1))
        monkeypatch.setattr(runs, "_mixed", lambda x: np.ones(len(x), dtype=np.uint64))
    for w in samples(2, 150):
        assert rows(runs.find_runs(w)) == by_comparison(w.tolist())


def test_pairs_in_parts(monkeypatch):
    want = [rows(runs.find_runs(w)) for w in samples(3, 20)]
    monkeypatch.setattr(runs, "PAIRS", 7)
    assert [rows(runs.find_runs(w)) for w in samples(3, 20)] == want


def test_strongest_is_exact():
    assert runs.strongest(np.array([[5, 28, 7], [0, 24, 6], [0, 12, 3]])) == [0, 12, 3]
    assert runs.strongest(np.zeros((0, 3), dtype=np.int64)) is None


def test_periodic_runs_on_odd_rows(spark):
    long = "a b c d e " * 30_000
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 40), (4, "x " * 40), (None, "é ß 中文 " * 9 + "end"), (7, long), (8, "A a " * 12 + "b"), (9, "no run here")]
    got = runs.periodic_runs(spark.createDataFrame([(*r, "own", 3) for r in data], SCHEMA)).collect()
    assert len(got) == len(data)
    key = lambda r: (-1 if r[0] is None else r[0])
    for r, (i, text) in zip(sorted(got, key=key), sorted(data, key=key)):
        w = (text or "").split()
        found = [(0, len(w), 5)] if i == 7 else by_comparison(w)
        assert r.doc_id == i and [tuple(x) for x in r.runs] == found
        assert r.collapsed == (" ".join(w[:5]) if i == 7 else " ".join(collapsed(w, found)))
        assert (r.strongest is None) == (not found)
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_rows(spark):
    texts = [" ".join(str((i * j) % 7 if i % 3 else j) for j in range(i % 90)) for i in range(300)]
    data = [*enumerate(texts), (None, "a b " * 20), (300, None)]
    got = runs.digests(runs.periodic_runs(runs.planted(spark.createDataFrame(data, "doc_id long, text string")))).collect()
    want, planted = [], 0
    for i, text in data:
        w = (text or "").split()
        h, n = (zlib.crc32(str(i).encode()) if i is not None else 1), len(w)
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
        found = by_comparison(w)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *best, best[0] is not None and 1000 * best[1] // best[2], digest("".join(f"{s},{k},{q}\n" for s, k, q in found)), digest(" ".join(collapsed(w, found)))))
    assert planted > 10
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli or False, r.runs_sha256, r.collapsed_sha256)) for r in got)
