"""Balanced label propagation of documents over shards. DataFrame functions only.

Documents of equal text are linked. A link is an edge to the group, not one between every two copies, and since copies
are alike the state is a table of cells: how many of a group's documents are in a shard. In a round every cell is joined
to where most of its group's documents are, and its documents want to move there. The driver turns what is wanted
between each two shards into rates at which no shard takes in more than its room and what leaves it; groups move by lot
at the rate of where they go, large groups in part. Every other round only shards with room are asked for, so that a
group whose fullest shard stays full gathers elsewhere. Room is what linked documents leave of a shard's quota, so unlinked ones, which cut nothing wherever they are, give way:
they fill the quotas up at the end, and no two shards differ by more than one document. Rounds end when no link is cut
or the cut links have not become fewer four times in a row.

Spark sums the loads, flows and cut links; the driver holds a number for each shard and for each two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, numbered, salts_for, written

SHARDS, ROUNDS, HEADER_BYTES = 40, 24, 16
#: A group that wants more than this share of a shard's room may move in part.
LARGE = 0.02


def _per_shard(values: list) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sums(rows: DataFrame, shard: Column, n: Column, shards: int) -> list[int]:
    out = [0] * shards
    for s, total in rows.select(shard.alias("s"), n.alias("n")).filter("s IS NOT NULL").groupBy("s").agg(F.sum("n")).collect():
        out[s] = total
    return out


def _loads(cells: DataFrame, shards: int) -> list[int]:
    return _sums(cells, F.col("s"), F.col("n"), shards)


def cut_links(cells: DataFrame) -> int:
    """Links to documents away from where most of their group are."""
    return cells.groupBy("g").agg((F.sum("n") - F.max("n")).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def _aims(cells: DataFrame, open_to: Column) -> DataFrame:
    """g, target: the fullest of each group's shards that are open to it; at most a row for each shard goes into a group."""
    there = F.when(open_to, F.struct("n", F.xxhash64("g", "s").alias("h"), "s"))
    return cells.groupBy("g").agg(F.max(there).alias("b")).filter("b IS NOT NULL").select("g", F.col("b.s").alias("target"))


def _rates(room: list[int], flows: list[tuple]) -> list[float]:
    """For each shard the rate at which what wants to come may come; flows: from, to, documents."""
    rate, into = [1.0] * len(room), [0] * len(room)
    for _, t, n in flows:
        into[t] += n
    for _ in range(100):
        left = [0.0] * len(room)
        for s, t, n in flows:
            left[s] += n * rate[t]
        rate = [min(r, max(0.0, 0.95 * (k + out)) / n) if n else r for r, k, out, n in zip(rate, room, left, into)]
    return rate


def _moved(joined: DataFrame, rates: list[float], room: list[int], turn: int) -> DataFrame:
    rate, lot = F.get(_per_shard(rates), F.col("target")), F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
    large = F.col("n") > F.greatest(F.lit(1.0), F.get(_per_shard(room), F.col("target")) * LARGE)
    share = F.when(rate >= 1, 1.0).when(large, rate).when(lot < rate, 1.0).otherwise(0.0)
    go = F.when(F.col("target").isNull() | (F.col("s") == F.col("target")), 0).otherwise(F.floor(F.col("n") * share)).cast("long")
    both = F.array(F.struct("s", (F.col("n") - go).alias("n")), F.struct(F.col("target").alias("s"), go.alias("n")))
    return joined.select("g", F.inline(both)).filter("n > 0").groupBy("g", "s").agg(F.sum("n").alias("n"))


def propagate(cells: DataFrame, quotas: list[int], work: Tables, rounds: int = ROUNDS) -> tuple[DataFrame, list[int], list[int]]:
    """(g, s, n) after the rounds, a table of `work`; the loads at the end; and the cut links before each round and at the end."""
    shards, cuts, idle = len(quotas), [cut_links(cells)], 0
    loads = _loads(cells, shards)
    for turn in range(rounds):
        if not cuts[-1] or idle == 4:
            break
        room = [q - n for q, n in zip(quotas, loads)]
        own = F.col("n") < F.get(_per_shard(quotas), F.col("s")) * 0.9  # a group that fills a shard goes on elsewhere
        joined = cells.join(_aims(cells, own if turn % 2 == 0 else F.get(_per_shard(room), F.col("s")) > 0), "g", "left")
        flows = [tuple(r) for r in joined.filter("s <> target").groupBy("s", "target").agg(F.sum("n")).collect()]  # at most shards * shards
        cells = work.write(_moved(joined, _rates(room, flows), room, turn), f"cells-{turn}")
        loads = _loads(cells, shards)
        cuts.append(cut_links(cells))
        idle = idle + 1 if cuts[-1] >= cuts[-2] else 0
    return cells, loads, cuts


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law `rows`.

    A null text is linked with nothing and counts as no bytes; empty texts are linked. Repeated rows and null ids are
    rows of their own. Fewer rows than shards leave the last shards empty; no rows give no rows. Which of several
    equal copies has which slot is not set. A text is only hashed and measured, whole, so its length makes no difference.
    Other columns are not looked at, whatever their names.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.length(text) + HEADER_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(F.col("text").cast("binary")).alias("g"))
    work = Tables(docs.sparkSession, "sharding")
    rows = work.write(rows.withColumn("h", F.xxhash64("doc_id", "text_crc32")), "rows")
    n = rows.count()
    quotas, salts = [n // shards + (s < n % shards) for s in range(shards)], salts_for(n)
    cells = rows.filter("g IS NOT NULL").groupBy("g", F.pmod("h", F.lit(shards)).cast("int").alias("s")).agg(F.count("*").alias("n"))
    groups = cells.groupBy("g").agg(F.sum("n").alias("total")).filter("total > 1").select("g")
    cells, loads, _ = propagate(work.write(cells.join(groups, "g", "left_semi"), "cells"), quotas, work, rounds)
    state = cells.groupBy("g").agg(F.collect_list(F.struct("s", "n")).alias("cells"))  # at most `shards` cells

    ends = F.transform("cells", lambda c, i: F.struct(c["s"].alias("s"), F.aggregate(F.slice("cells", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("end")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(salts)))
    sizes = salted.filter("g IS NOT NULL").groupBy("g", "salt").agg(F.count("*").alias("k")).join(state.select("g", ends.alias("ends")), "g")
    before = F.expr("sum(k) OVER (PARTITION BY g ORDER BY salt) - k")  # over at most `salts` rows
    sizes = sizes.select("g", "salt", "ends", before.alias("before"))
    own = F.expr("row_number() OVER (PARTITION BY g, salt ORDER BY h, doc_id, size, text_crc32) - 1")
    placed = salted.filter("g IS NOT NULL").withColumn("own", own).join(sizes, ["g", "salt"], "left")
    to = F.filter("ends", lambda e: e["end"] > F.col("before") + F.col("own"))
    columns = ("doc_id", "size", "text_crc32", "h")
    placed = placed.withColumn("shard", F.get(to, F.lit(0))["s"]).select(*columns, "shard").unionByName(salted.filter("g IS NULL").select(*columns, F.lit(None).cast("int").alias("shard")))
    placed = work.write(placed, "placed")

    linked = numbered(placed.filter("shard IS NOT NULL"), "shard", F.xxhash64("h", F.lit(8)), "slot", salts)
    over = F.col("slot") >= F.get(F.array(*map(F.lit, quotas)), F.col("shard"))
    linked = work.write(linked.withColumn("over", over), "linked")
    pool = placed.filter("shard IS NULL").drop("shard").unionByName(linked.filter("over").select(*columns)).withColumn("all", F.lit(0))
    pool = numbered(pool, "all", F.xxhash64("h", F.lit(9)), "i", salts)
    taken, room = [min(q, k) for q, k in zip(quotas, loads)], 0
    spans = []
    for s in range(shards):
        spans.append(F.struct(F.lit(s).alias("s"), F.lit(room + quotas[s] - taken[s]).cast("long").alias("end"), F.lit(taken[s] - room).cast("long").alias("shift")))
        room += quotas[s] - taken[s]
    pool = pool.withColumn("span", F.get(F.filter(F.array(*spans), lambda x: x["end"] > F.col("i")), F.lit(0)))
    pool = pool.select("doc_id", "size", "text_crc32", F.col("span.s").alias("shard"), (F.col("i") + F.col("span.shift")).alias("slot"))
    out = linked.filter("NOT over").select("doc_id", "size", "text_crc32", "shard", "slot").unionByName(pool)
    out = out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    out = written(out, "shards")
    work.close()
    return out
