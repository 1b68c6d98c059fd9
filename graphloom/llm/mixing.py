"""Mixing sources to target weights by Pareto order sampling.

A source must give `target` words. Its documents are expected in c * emphasis copies each, at most `most`, where a
document's emphasis grows with the logarithm of its size (long ones are rarer and worth more) and c makes the expected
words the target. floor of that is given whole, for certain; the rest of it is the document's own inclusion probability
p for one copy more. With a fixed random U a document's rank is odds(U) / odds(p), and the lowest ranks are taken until
the source's words are as near to its target as a cut comes: a sample of fixed size with unequal probabilities.

c follows from the words in each class of emphasis (at most 63 for a source). The cut of each source is found from two
histograms of the ranks (4,096 bins, then 4,096 within the bin that holds the cut) and a sort of what is in one bin of
the second, so no source is ever in one task, however large. The result is one row of numbers for each source, by which
any row decides for itself; copies with equal keys share their fate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Tables, written

WEIGHTS, SHARE, MOST, BINS = (3, 1, 2), 1.5, 2, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def emphasis(size: Column) -> Column:
    """How many copies of a document are expected, up to a factor: 2 for one word, 1 more with each doubling."""
    return F.floor(F.log2(size + 1.0)).cast("long") + 1


def _uniform(seed: int, size: str) -> Column:
    """In (0, 1), from the row's own key alone."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(size).cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def _rank(u: Column, p: Column) -> Column:
    """odds(U) / odds(p) mapped to (0, 1) by x / (1 + x); null without a chance."""
    x = (u / (1 - u)) / (p / (1 - p))
    return F.when((p > 0) & (p < 1), x / (1 + x))


def _expected(size: Column, level: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), level * emphasis(size))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source: source_size, target.

    Target = min(most * source_size, level * weight), the level such that targets sum to share * all sizes: what
    handing the excess of full sources to the others by weight, again and again, ends in. This table has a row for
    each source, so its windows are over sources, not documents.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(n - 1, F.lit(len(weights))) + 1).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy(F.lit(1))
    before = Window.partitionBy(F.lit(1)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # with the sources full up to here set aside, the level rises until the first that isn't full, then falls
    s = s.withColumn("target", F.least(F.col("cap"), F.max("level").over(every) * F.col("w")))
    return s.select("source", "source_size", "target")


def levels(sized: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """targets() with level, the c of the module's text, and need, the words beyond whole copies.

    Found as the targets are, within each source and over its classes of emphasis. A full source gives `most` of each.
    """
    k = sized.filter("size > 0").groupBy("source", emphasis(F.col("size")).alias("e")).agg(F.sum("size").alias("words"))
    k = k.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    down, up, every = (Window.partitionBy("source").orderBy(F.desc("e")).rowsBetween(*r) for r in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    level = (F.col("target") - most * F.coalesce(F.sum("words").over(down), F.lit(0))) / F.sum(F.col("e") * F.col("words")).over(up)
    k = k.withColumn("level", level).withColumn("level", F.when(F.col("target") >= most * F.col("source_size"), float(most)).otherwise(F.max("level").over(every)))
    whole = F.floor(F.least(F.lit(float(most)), F.col("level") * F.col("e"))).cast("long")
    k = k.groupBy("source").agg(F.max("level").alias("level"), F.sum(whole * F.col("words")).alias("given"))
    out = goals.join(k.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("source", "source_size", "target", F.coalesce("level", F.lit(0.0)).alias("level"), (F.col("target") - F.coalesce("given", F.lit(0))).alias("need"))


def _totals(ranks: DataFrame, by: str) -> DataFrame:
    """Words of each source up to and with each of its bins (or ranks), from `base` on."""
    t = ranks.groupBy("source", by).agg(F.sum("size").alias("words"), F.min("need").alias("need"), F.min("base").alias("base"), F.max("rank").alias("top"))
    return t.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy(by)))


def _inside(ranks: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """The rows of the one bin of each source in which its words pass what it needs; base: the words before it."""
    before = F.col("upto") - F.col("words")
    cross = totals.filter((before < F.col("need")) & (F.col("upto") > F.col("need"))).select(F.col("source").alias("s"), F.col(by).alias("cross"), before.alias("b"))
    return ranks.join(cross, F.col("source").eqNullSafe(F.col("s")) & (F.col(by) == F.col("cross"))).withColumn("base", F.col("b")).drop("s", "cross", "b")


def mix_plan(docs: DataFrame, seed: int = 17, most: int = MOST, **kw) -> DataFrame:
    """levels() with `cut`: documents whose rank is at most the cut give one copy more than their whole ones."""
    work = Tables(docs.sparkSession, "mixing")
    sized = work.write(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    plan = work.write(levels(sized, work.write(targets(sized, most=most, **kw), "targets"), most), "levels")
    ranked = sized.filter("size > 0").join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    e = _expected(F.col("size"), F.col("level"), most)
    ranked = ranked.withColumn("rank", _rank(_uniform(seed, "size"), e - F.floor(e))).filter("rank IS NOT NULL")
    ranked = work.write(ranked.select("source", "size", "need", "rank", F.lit(0).cast("long").alias("base"), F.floor(F.col("rank") * BINS).alias("bin"), F.floor(F.col("rank") * BINS * BINS % BINS).alias("fine")), "ranks")
    coarse = _totals(ranked, "bin")
    some = work.write(_inside(ranked, coarse, "bin"), "inside")
    fine = _totals(some, "fine")
    last = _totals(_inside(some, fine, "fine"), "rank")
    fits = [t.filter(t["upto"] <= t["need"]) for t in (coarse, fine)] + [last.filter(last["upto"] - last["words"] / 2 <= last["need"])]
    cut = reduce(DataFrame.unionByName, [f.select("source", "top") for f in fits])
    cut = cut.groupBy(F.col("source").alias("s")).agg(F.max("top").alias("cut"))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    plan = written(plan.select("source", "source_size", "target", "level", F.coalesce("cut", F.lit(-1.0)).alias("cut")), "plan")
    work.close()
    return plan


def pareto_mix(docs: DataFrame, seed: int = 17, most: int = MOST, **kw) -> DataFrame:
    """docs with size, source_size, target and copies (0 to `most`); columns of docs by these names are replaced.

    A null text has size 0 and a null source is a source of its own. Repeated rows share one fate, as do rows that
    agree in source, doc_id and size: a source made of few such groups misses its target by up to the largest of them.
    A source without words, and an empty table, take nothing.
    """
    plan = mix_plan(docs, seed, most, **kw)
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    own = docs.drop("size", "source_size", "target", "copies").withColumn("__size", n_words(F.col("text")))
    out = own.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    e = _expected(F.col("__size"), F.col("__level"), most)
    more = F.coalesce(_rank(_uniform(seed, "__size"), e - F.floor(e)) <= F.col("__cut"), F.lit(False)).cast("long")
    copies = F.when(F.col("__size") > 0, F.floor(e).cast("long") + more).otherwise(0)
    own = [F.col(f"`{c}`") for c in own.columns if c != "__size"]
    return out.select(*own, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"))
