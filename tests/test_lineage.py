"""Cut tables, and what graph loops leave behind."""

from pyspark.sql import functions as F

from graphloom.operators import communities, lineage, prediction


def shuffled(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def test_a_cut_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    t = lineage.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert shuffled(spark) <= before and t.count() == 7
    assert spark.conf.get(lineage.CLEAN, None) in (None, "false")


def test_dropped_tables_are_gone_and_others_stay(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/own")
    own, t = spark.read.parquet(f"{tmp_path}/own"), lineage.cut(spark.range(3))
    at = t.inputFiles()[0].removeprefix("file://")
    lineage.drop(t.select("id"), own)
    import os

    assert not os.path.exists(os.path.dirname(at)) and own.count() == 5


def test_numbers_are_in_the_order_of_names(spark):
    names = [f"n{i * 37 % 100}" for i in range(100)] + ["n5", "z", "Z", "é"]
    got = {r.name: r.id for r in lineage.numbered(spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    assert sorted(got, key=got.get) == sorted(set(names), key=str.encode)


def test_pairs_in_slices_are_those_of_one(spark, monkeypatch):
    links = spark.createDataFrame([(f"a{i}", f"m{j}") for i in range(40) for j in range(12) if (i * j + i) % 5 < 2], "a string, m string")
    whole = [[tuple(r) for r in prediction.best_pairs(links, 9, few).collect()] for few in (200, 6)]
    monkeypatch.setattr(prediction, "AT_ONCE", 300)
    slices, plain = [], prediction._of_slices
    monkeypatch.setattr(prediction, "_of_slices", lambda links, n, few, k: slices.append(k) or plain(links, n, few, k))
    assert [tuple(r) for r in prediction.best_pairs(links, 9, 200).collect()] == whole[0] == whole[1] and slices[0] > 2


def test_communities_move_numbers_only(spark, monkeypatch):
    seen, plain = [], communities._moves
    monkeypatch.setattr(communities, "_moves", lambda around, *a: seen.append(around.dtypes) or plain(around, *a))
    edges = [(f"{g}{i}", f"{g}{j}") for g in "pq" for i in range(5) for j in range(i)] + [("p0", "q0"), ("p0", "p0")]
    got = {r.node: r.community for r in communities.communities(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert seen == [[("node", "bigint"), ("other", "bigint")]]
    assert len(got) == 10 and len({got[f"p{i}"] for i in range(5)}) == len({got[f"q{i}"] for i in range(5)}) == 1 and got["p0"] != got["q0"]
