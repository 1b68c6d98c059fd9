"""Streams with timers against plain loops, over timed files and a restart; upserts that touch few partitions."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import ingest, timers

START = dt.datetime(2024, 1, 1)


def events(seed: int, kinds: list[str], n: int = 120) -> list[tuple]:
    r = random.Random(seed)
    at = sorted(r.sample(range(100_000), n))
    return [(f"k{r.randrange(4)}", START + dt.timedelta(seconds=s), r.choice(kinds)) for s in at]


def streamed(spark, tmp_path, rows: list, made) -> list:
    """Three files, the last after a restart with the same checkpoint."""
    timers.use_timers(spark)
    schema = "key string, ts timestamp, kind string"
    third = len(rows) // 3
    for i in range(2):
        spark.createDataFrame(rows[i * third : (i + 1) * third], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    timers.run_once(made(read()), str(tmp_path / "out"), str(tmp_path / "check"))
    spark.createDataFrame(rows[2 * third :], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    timers.run_once(made(read()), str(tmp_path / "out"), str(tmp_path / "check"))
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def ms(t: dt.datetime) -> int:
    return int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_refreshes_wait_for_one_another(spark, tmp_path):
    rows = events(1, ["ask", "ask", "ask", "done"])
    want, until = [], {}
    for key, t, kind in rows:
        if kind == "done":
            until.pop(key, None)
        elif ms(t) >= until.get(key, 0):
            want.append((key, ms(t)))
            until[key] = ms(t) + 7_200_000
    assert streamed(spark, tmp_path, rows, lambda s: timers.debounced(s, 7_200_000)) == sorted(want)


def test_silent_jobs_fail(spark, tmp_path):
    rows = events(2, ["processing", "pending", "done"])
    limits, last, want = {"processing": 300_000, "pending": 3_600_000}, {}, []
    for key, t, kind in [*rows, *((k, None, None) for k in ("k0", "k1", "k2", "k3"))]:
        now = ms(t) if t else ms(rows[-1][1])
        if key in last and last[key][1] in limits:
            due = last[key][0] + limits[last[key][1]]
            if now > due or (t is None and now >= due):
                want.append((key, last[key][1], due))
        last[key] = (now, kind)
    assert streamed(spark, tmp_path, rows, lambda s: timers.fallen_silent(s, limits)) == sorted(want)


def test_ticks(spark, tmp_path):
    rows, hour = events(3, ["x"]), 3_600_000
    n: dict = {}
    for key, t, _ in rows:
        at = ms(t) - ms(t) % hour
        n[key, at] = n.get((key, at), 0) + 1
    end = ms(rows[-1][1])
    assert streamed(spark, tmp_path, rows, lambda s: timers.ticks(s, hour)) == sorted((k, a, c) for (k, a), c in n.items() if a + hour <= end)


def test_upserts_rewrite_the_partitions_they_touch(spark, tmp_path):
    target = str(tmp_path / "t")
    ingest.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v")), target, "k", "v", 32)
    stamp = lambda: {d: max(os.stat(os.path.join(target, d, f)).st_mtime_ns for f in os.listdir(os.path.join(target, d))) for d in os.listdir(target) if d.startswith("bucket")}
    before = stamp()
    ingest.upsert(spark.createDataFrame([(5, 2), (5, 3), (6, 0), (2000, 1)], "k long, v int"), target, "k", "v", 32)
    ingest.upsert(spark.createDataFrame([(5, 2), (5, 3), (6, 0), (2000, 1)], "k long, v int"), target, "k", "v", 32)
    after = stamp()
    assert sum(before[d] != after[d] for d in before) <= 3 and len(before) == 32
    rows = {r.k: r.v for r in spark.read.parquet(target).collect()}
    assert rows == {**dict.fromkeys(range(1000), 1), 5: 3, 2000: 1}


@pytest.mark.parametrize("batch", [0])
def test_no_rows_leave_the_target(spark, tmp_path, batch):
    ingest.upsert(spark.createDataFrame([], "k long, v int"), str(tmp_path / "none"), "k", "v")
    assert not os.path.exists(tmp_path / "none")
