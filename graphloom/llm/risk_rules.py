"""Quality rules whose cutoffs carry a guarantee against rejecting good documents. DataFrame functions only.

A document's badness is the largest of three measures in units of a typical limit: symbols a word, the share of words
in repeated 8-word windows, and repeated lines a word. Cutoffs are tested on labelled documents by stratum, from the
most lenient on: the exact binomial probability that at most the observed number of good documents is rejected, if the
true share were `alpha`, must not exceed `delta` divided by the number of strata (Bonferroni over strata; a sequence
that ends with the first failure needs no division within one). Of the cutoffs so certified the one with the best
balance of bad over good rejections is taken. With probability 1 - delta no stratum rejects more than `alpha` of its
good documents by its cutoff; a stratum with too few labels for that rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
CUTOFFS = tuple(2.0**k for k in range(6, -4, -1))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of MEASURES and __badness, each made from the whole text, within the row.

    An array that later steps index is a column of its own, so that it is made once a row, not once an element. Windows
    are compared by 64-bit hashes. A null text has no words and measures of 0.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(WORD))
    d = docs.withColumns({"__w": words, "__l": lines})
    d = d.withColumns({"__h": F.transform("__w", lambda x: F.xxhash64(x)), "n_words": F.size("__w").cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"), "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")}).drop("__w", "__l")
    windows = F.when(F.size("__h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__h") - WINDOW + 1), lambda i: F.xxhash64(F.slice("__h", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("__v", windows).drop("__h")
    twice = F.size(F.array_distinct("__v")) < F.size("__v")
    by_hash = F.when(twice, F.sort_array(F.transform("__v", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("__s", by_hash).drop("__v")
    same = lambda e, k: ((k > 0) & (F.get("__s", k - 1)["h"] == e["h"])) | F.coalesce(F.get("__s", k + 1)["h"] == e["h"], F.lit(False))
    d = d.withColumn("__p", F.sort_array(F.transform(F.filter("__s", same), lambda e: e["i"]))).drop("__s")
    covered = F.aggregate(F.sequence(F.lit(1), F.size("__p") - 1), F.lit(WINDOW), lambda a, k: a + F.least(F.lit(WINDOW), F.get("__p", k) - F.get("__p", k - 1)))
    d = d.withColumn("n_repeat_words", F.when(F.size("__p") > 1, covered).otherwise(F.lit(0)).cast("long")).drop("__p")
    each = F.greatest(F.lit(1), "n_words").cast("double")
    badness = F.greatest(F.col("n_symbols") / each / 0.5, F.col("n_repeat_words") / each / 0.3, F.col("n_dup_lines") / each / 0.1)
    # a generator, so that filters on measures stay above and don't repeat their expressions below
    return d.select(*docs.columns, F.inline(F.array(F.struct(*MEASURES, badness.alias("__badness")))))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_p(n: Column, k: Column, alpha: float) -> Column:
    """P(at most k of n) at rate alpha, summed term by term in logarithms; 1 where k exceeds its expectation."""
    odds, first = math.log(alpha / (1 - alpha)), n * math.log1p(-alpha)
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))

    def add(a, j):
        term = a["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(term, a["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(a["sum"] - top))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * alpha, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, add)["sum"]))


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, MEASURES, __badness of every row, written: no text moves from here on."""
    rows = with_measures(docs.select("doc_id", F.col(stratum).alias("stratum"), "text"))
    return written(rows.drop("text"), "measures")


def cutoffs(measures: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """stratum, cutoff of the strata that have a certified cutoff; measures as from measured().

    Labels of a document that contradict one another count as bad; null labels, and labels without a document, don't
    count. Documents that the base rules reject take no part. A null stratum is a stratum of its own. Every labelled row
    is a trial, so the guarantee is for rows: exact copies count each.
    """
    given = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("__good"))
    held = measures.filter(~base_failed()).select("doc_id", "stratum", "__badness").join(given, "doc_id")
    count = lambda good: F.array(*[F.count_if((F.col("__good") == good) & (F.col("__badness") > c)) for c in CUTOFFS])
    per = held.groupBy("stratum").agg(F.count_if("__good").alias("n"), count(True).alias("hit"), count(False).alias("bad"))
    per = per.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1))))  # one row for each stratum
    rows = per.select("stratum", "n", "strata", F.posexplode(F.arrays_zip(F.array(*map(F.lit, CUTOFFS)).alias("cutoff"), "hit", "bad")).alias("i", "at")).select("stratum", "n", "strata", "i", "at.*")
    rows = rows.withColumn("ok", (binomial_p(F.col("n"), F.col("hit"), alpha) <= delta / F.col("strata")).cast("int"))
    so_far = Window.partitionBy("stratum").orderBy("i")
    best = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc(F.col("bad") - 5 * F.col("hit")), "i"))
    return rows.withColumn("ok", F.min("ok").over(so_far)).filter("ok = 1").withColumn("__r", best).filter("__r = 1").select("stratum", "cutoff")


def _verdict(measures: DataFrame, labels: DataFrame, rows: DataFrame, stratum: str, **kw) -> DataFrame:
    limit = written(cutoffs(measures, labels, **kw), "cutoffs").withColumnsRenamed({"stratum": "__stratum", "cutoff": "__cutoff"})
    failed = base_failed()
    kept = ~failed & F.coalesce(F.col("__badness") <= F.col("__cutoff"), F.lit(True))
    return rows.join(limit, F.col(stratum).eqNullSafe(F.col("__stratum")), "left").withColumns({"base_failed": failed, "kept": kept})


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **kw) -> DataFrame:
    """doc_id, MEASURES, base_failed and kept of every row; each text is read once. Cases as in judged()."""
    measures = measured(docs, stratum)
    return _verdict(measures, labels, measures, "stratum", **kw).select("doc_id", *MEASURES, "base_failed", "kept")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **kw) -> DataFrame:
    """docs with MEASURES, base_failed and kept; columns of docs by these names are replaced.

    Texts are measured twice, for the cutoffs and for the rows, so that they never move. A null or empty text has no
    words and fails the base rules. Repeated rows are judged each; no rows give no rows. A text is measured whole; its
    words and windows are arrays of one row, so a row takes memory in proportion to its text.
    """
    own = docs.drop(*MEASURES, "base_failed", "kept")
    out = _verdict(measured(docs, stratum), labels, with_measures(own), stratum, **kw)
    return out.select(*own.columns, *MEASURES, "base_failed", "kept")
