"""Version chains in range parts against a loop, with one group that holds nearly all rows."""

import random

import pytest

from graphloom.operators import running


def chain(rows: list) -> list:
    out, seen = [], {}
    for path, at, value in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        had = seen.get(path)
        changed = had is None or had[0] != value
        version = (had[1] if had else 0) + changed
        seen[path] = (value, version, at)
        out.append((path, at, value, changed, version))
    return sorted(((p, a, v, c, n, seen[p][2] == a) for p, a, v, c, n in out), key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_versions(spark, parts):
    r = random.Random(parts)
    rows = [("hot", i, r.choice(["a", "b", None])) for i in range(900)] + [(r.choice(["p", "q", None]), 1000 + i, r.choice("ab")) for i in range(100)]
    df = spark.createDataFrame(rows, "path string, at long, value string")
    got = running.versions(df, "path", "at", "value", parts).collect()
    assert sorted(map(tuple, got), key=repr) == chain(rows)
    if parts > 1:
        sizes = running.in_parts(df, "path", "at", parts).filter("path = 'hot'").groupBy("part").count().collect()
        assert len(sizes) >= 5 and max(x["count"] for x in sizes) < 400


def test_no_rows(spark):
    assert running.versions(spark.createDataFrame([], "path string, at long, value string"), "path", "at", "value").collect() == []


def test_totals(spark):
    got = running.with_total(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "g string, x long"), "g").collect()
    assert sorted((r.x, r.total) for r in got) == [(1, 2), (2, 2), (3, 1)]
