import hashlib
import math
from collections import defaultdict

import pytest

from graphloom.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string"


def by_hand(sizes: dict, weights=(3, 1, 2), share=1.5, most=2):
    """Hand the excess over `most` times a source's size to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    target = {s: total * w[s] / sum(w.values()) for s in order}
    full: set = set()
    while over := [s for s in order if s not in full and target[s] > most * sizes[s] + 1e-9]:
        excess = sum(target[s] - most * sizes[s] for s in over)
        full |= set(over)
        for s in over:
            target[s] = most * sizes[s]
        free = [s for s in order if s not in full]
        for s in free:
            target[s] += excess * w[s] / sum(w[f] for f in free)
    return target


def rows_of(n: int):
    return [(i, ["b", "a", None, "é", "c", "d"][i % 6 if i % 2 else 1], " ".join(["w"] * ((i * 37) % 90)), "clash") for i in range(n)]


def test_targets_and_taken_words(spark):
    rows = rows_of(900)
    got = mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, s, t, _ in rows:
        sizes[s] += len(t.split())
        largest[s] = max(largest[s], len(t.split()))
    target = by_hand(sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.pareto_mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def plain_copies(rows, most=2, seed=17):
    """The method without Spark: expected copies by bisection, ranks, and a cut by a walk over each source."""
    sizes, out = defaultdict(int), []
    size = lambda t: len((t or "").split())
    for _, s, t, _ in rows:
        sizes[s] += size(t)
    for s, target in by_hand(sizes).items():
        docs = [(i, size(t)) for i, x, t, _ in rows if x == s and size(t)]
        low, high = 0.0, float(most)
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(most, c * (math.floor(math.log2(n + 1)) + 1)) * n for _, n in docs) < target else (low, c)
        drawn, taken, need = [], {}, target
        for i, n in docs:
            e = min(most, high * (math.floor(math.log2(n + 1)) + 1))
            e = round(e) if abs(e - round(e)) < 1e-9 else e
            whole, p = math.floor(e), e - math.floor(e)
            need -= whole * n
            u = (int(hashlib.md5(f"{seed}|{s or ''}|{i}|{n}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            taken[i] = whole
            if p > 0:
                drawn.append(((u / (1 - u)) / (p / (1 - p)), i, n))
        for _, i, n in sorted(drawn):
            if n / 2 > need:
                break
            taken[i], need = taken[i] + 1, need - n
        out += taken.items()
    return dict(out)


def test_against_plain_python(spark):
    rows = rows_of(700)
    got = {r.doc_id: r.copies for r in mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain_copies(rows)
    assert {i: c for i, c in got.items() if c} == {i: c for i, c in want.items() if c}
    assert len(set(want.values())) >= 2


def test_inclusion_follows_each_documents_probability(spark):
    """60 sources of the same sizes stand for 60 draws: the shares drawn of each class of size against its p."""
    import pyspark.sql.functions as F

    sizes = [1, 3, 7, 15, 31, 63] * 30
    rows = [(1000 * s + i, f"s{s:02d}", " ".join(["w"] * n), "x") for s in range(60) for i, n in enumerate(sizes)]
    got = mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA), weights=(1,), share=0.5).groupBy(F.col("size")).agg(F.avg("copies").alias("rate")).collect()
    rate = {r["size"]: r.rate for r in got}
    c = 0.5 * sum(sizes) / sum(n * (math.floor(math.log2(n + 1)) + 1) for n in sizes)
    assert len(rate) == 6
    for n, seen in rate.items():
        assert seen == pytest.approx(c * (math.floor(math.log2(n + 1)) + 1), abs=0.03)


def test_clashing_columns(spark):
    import pyspark.sql.functions as F

    rows = spark.createDataFrame(rows_of(200), SCHEMA)
    clash = rows.withColumns({c: F.lit(c) for c in ("p", "whole", "cut", "level", "need", "rank", "u", "e", "s", "bin")})
    plain = {r.doc_id: r.copies for r in mixing.pareto_mix(rows).collect()}
    got = mixing.pareto_mix(clash).collect()
    assert {r.doc_id: r.copies for r in got} == plain and all(r.p == "p" and r.cut == "cut" for r in got)


def test_odd_rows(spark):
    rows = [(1, "a", None, "x"), (1, "a", None, "x"), (None, None, "one two", "x"), (2, "b", "", "x"), (3, "b", "long " * 30_000, "x")]
    got = mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5
    assert all(r.size == 0 for r in got if not r.text) and all(r.copies <= 2 for r in got)


def test_empty_table(spark):
    assert mixing.pareto_mix(spark.createDataFrame([], SCHEMA)).collect() == []
