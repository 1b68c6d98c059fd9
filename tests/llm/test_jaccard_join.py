import random

import numpy as np
import pytest

from graphloom.llm import jaccard_join as J


def brute(rows, width=5, percent=80):
    """doc_id -> (size, least id reached) by all pairs."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, len(s), least.get(root(a))) for a, (i, s) in enumerate(sets)), key=repr)


def families(seed: int, n: int, copies: int) -> list:
    """Drifting copies: every copy changes a few words of an earlier one, so distances lie around the threshold; some share a passage."""
    r, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(25)]
    for _ in range(n):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(30, 120))]
        kept = [base]
        for _ in range(copies):
            w = list(r.choice(kept))
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = f"w{r.randrange(4000)}"
            kept.append(w)
        for w in kept:
            rows.append(w + passage if r.random() < 0.3 else w)
    r.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def got(spark, rows):
    out = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


@pytest.mark.parametrize("leaf, sorted_", [(4096, 200_000), (4, 200_000), (4096, 0), (4, 3)])
def test_against_all_pairs(spark, monkeypatch, leaf, sorted_):
    """sorted_ of 0: all shingles are parted by sums over sizes; of 3: the more frequent ones."""
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "SORTED", sorted_)
    rows = families(leaf, 12, 25)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "one two three"), (None, "a b c d e f"), (None, "a b c d e f"), (7, "A B C D E F"), (7, "A B C D E F"), (8, long), (9, long + " y"), (10, "   "), (11, None)]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_one_of_each(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([(5, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (9, "", 3), (10, None, 4)], "doc_id long, text string, n_shingles int")
    assert sorted(tuple(r) for r in J.one_of_each(docs).collect()) == [(3, "a b c d e f", 2), (9, "", 3), (10, None, 4)]


def test_bounds_never_exceed_the_distance():
    r = np.random.default_rng(1)
    for size in (3, 80, 1500, 5000):
        a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(size * 0.9)], r.integers(0, 1 << 63, size // 8 + 1, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        for words in (64, 4096):
            x, y = (J._folded(np.frombuffer(J.bitmap(s), np.uint16), words) for s in (a, b))
            width = min(len(x), len(y))
            m = np.stack([J._folded(x, width), J._folded(y, width)])
            assert J._bounds(np.array([len(a), len(b)]), m, 0)[1] <= 1 - both / (len(a) + len(b) - both) + 1e-12
