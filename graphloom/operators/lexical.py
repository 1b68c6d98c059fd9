"""Full-text search over a positional inverted index: cover density, a relaxed pass, phrases, and blocks that are skipped.

The index has a row for each term and chunk with the term's places, and for each term and block of documents the greatest
number of times that one chunk, or one document, holds the term. A cover is a shortest stretch that holds all terms; one
adds 0.1 / (1 + other words in it). A text has no more covers than it has of its rarest term, so the block table bounds the score of
every text in a block: the blocks with the greatest bounds are scored first, and of the others only those whose bound reaches
the k-th best score found there are read at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What a cover without other words adds, and what an occurrence adds where not all terms are asked for.
WEIGHT, RELAXED = 0.1, 0.5


def postings(chunks: DataFrame, blocks: int) -> DataFrame:
    """term, block, chunk_id, doc_id, base, n, places of rows chunk_id, doc_id, seq, content; base: words of the document before the chunk."""
    words = chunks.select("chunk_id", "doc_id", "seq", T.tokens(F.col("content")).alias("w"))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("base", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0)).cast("int"))
    each = words.select("chunk_id", "doc_id", "base", F.posexplode("w").alias("p", "term"))
    rows = each.groupBy("term", "chunk_id", "doc_id", "base").agg(F.sort_array(F.collect_list("p")).alias("places"))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    return rows.select("term", block.alias("block"), "chunk_id", "doc_id", "base", F.size("places").alias("n"), "places")


def postings_of(chunks: DataFrame, blocks: int, terms: list[str]) -> DataFrame:
    """postings() of some terms only: a chunk's places are found where it lies, and of other words only their number is kept."""
    words = T.tokens(F.col("content"))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("p"), x.alias("t"))), lambda x: x["t"].isin(*terms))
    some = chunks.select("chunk_id", "doc_id", "seq", words.alias("w")).select("chunk_id", "doc_id", "seq", F.size("w").alias("words"), hits.alias("hits"))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("int")).filter(F.size("hits") > 0)
    places = lambda term: F.transform(F.filter("hits", lambda x: x["t"] == term), lambda x: x["p"])
    each = F.filter(F.array(*[F.struct(F.lit(t).alias("term"), places(t).alias("places")) for t in terms]), lambda x: F.size(x["places"]) > 0)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    rows = some.select("chunk_id", "doc_id", "base", F.inline(each))
    return rows.select("term", block.alias("block"), "chunk_id", "doc_id", "base", F.size("places").alias("n"), "places")


def bounds(rows: DataFrame) -> DataFrame:
    """term, block, in_chunk, in_doc: the most that one chunk or document of the block holds of the term."""
    docs = rows.groupBy("term", "block", "doc_id").agg(F.max("n").alias("c"), F.sum("n").alias("d"))
    return docs.groupBy("term", "block").agg(F.max("c").alias("in_chunk"), F.max("d").cast("int").alias("in_doc"))


def cover_density(events: Column, terms: int) -> Column:
    """Of an array of structs (p, t) by place p: the sum over covers of all `terms` terms t (0, 1, ..)."""
    start = F.struct(F.array_repeat(F.lit(-1), terms).alias("last"), F.lit(0).alias("i"), F.lit(-1).alias("from"), F.lit(0.0).alias("score"))

    def step(s: Column, e: Column) -> Column:
        last = F.transform(s["last"], lambda x, j: F.when(j == e["t"], s["i"]).otherwise(x))
        first = F.array_min(last)
        new = first > s["from"]
        others = (e["p"] - F.get(events, first)["p"]) - (s["i"] - first)
        return F.struct(last.alias("last"), (s["i"] + 1).alias("i"), F.when(new, first).otherwise(s["from"]).alias("from"), (s["score"] + F.when(new, WEIGHT / (1 + others)).otherwise(0.0)).alias("score"))

    return F.aggregate(events, start, step, lambda s: s["score"])


def holds_phrase(events: Column, phrase: list[int]) -> Column:
    """Whether terms with these numbers stand side by side somewhere."""

    def begins(i: int, t: int) -> Column:
        """Where the phrase begins if its word i is an occurrence of t."""
        return F.transform(F.filter(events, lambda e: e["t"] == t), lambda e: e["p"] - i)

    return F.size(reduce(F.array_intersect, [begins(i, t) for i, t in enumerate(phrase)])) > 0


@dataclass
class Found:
    """hits: id, place (from 1), score; blocks: with a text that may hold all terms; read: those that were scored."""

    hits: DataFrame
    blocks: int
    read: int


class Index:
    """Stored postings and bounds."""

    def __init__(self, rows: DataFrame, limits: DataFrame):
        self.rows, self.limits = rows, limits

    def _strict(self, rows: DataFrame, terms: list[str], phrases: list[list[str]], id_col: str) -> DataFrame:
        place = lambda p: p if id_col == "chunk_id" else p + F.col("base")
        number = (F.array_position(F.array(*map(F.lit, terms)), F.col("term")) - 1).cast("int")
        each = rows.select(F.col(id_col).alias("id"), number.alias("t"), F.transform("places", place).alias("places"))
        parts = each.groupBy("id").agg(F.collect_list(F.struct("t", "places")).alias("parts"))  # of one text, the places of each term
        parts = parts.filter(F.size(F.array_distinct(F.transform("parts", lambda x: x["t"]))) == len(terms))
        texts = parts.select("id", F.array_sort(F.flatten(F.transform("parts", lambda x: F.transform(x["places"], lambda p: F.struct(p.alias("p"), x["t"].alias("t")))))).alias("events"))
        for p in phrases:
            texts = texts.filter(holds_phrase(F.col("events"), [terms.index(x) for x in p]))
        return texts.select("id", F.round(cover_density(F.col("events"), len(terms)), 6).alias("score"))

    def search(self, terms: list[str], k: int, id_col: str = "chunk_id", phrases: list[list[str]] | None = None, lead: DataFrame | None = None, first: int = 4) -> Found:
        """The k best texts (chunks, or documents with id_col doc_id): those of `lead` (ids that hold the query as it stands), then those with all
        terms and phrases by cover density, then, where these are fewer than k and there are no phrases, those with some terms at half weight. Ties by id."""
        phrases = phrases or []
        terms = list(dict.fromkeys([*terms, *(w for p in phrases for w in p)]))
        found = self.rows.filter(F.col("term").isin(terms))
        most = "in_chunk" if id_col == "chunk_id" else "in_doc"
        limits = self.limits.filter(F.col("term").isin(terms)).groupBy("block").agg(F.count("*").alias("n"), (F.min(most) * WEIGHT).alias("bound"))
        limits = limits.filter(F.col("n") == len(terms))
        best = [r["block"] for r in limits.orderBy(F.desc("bound"), "block").limit(first).collect()]
        by_rank = [F.desc("score"), F.col("id")]
        strict = self._strict(found.filter(F.col("block").isin(best)), terms, phrases, id_col).orderBy(*by_rank).limit(k)
        head = strict.collect()  # k rows
        least = head[-1]["score"] if len(head) == k else 0.0
        rest = limits.filter((F.col("bound") >= least - 1e-6) & ~F.col("block").isin(best)).select("block")
        blocks, more = limits.count(), rest.count()
        spark = self.rows.sparkSession
        kind = self.rows.schema[id_col].dataType.simpleString()
        known = spark.createDataFrame([(r["id"], r["score"]) for r in head], f"id {kind}, score double")
        if more:
            known = known.unionByName(self._strict(found.join(rest, "block", "left_semi"), terms, phrases, id_col)).orderBy(*by_rank).limit(k)
            head = known.collect()
            known = spark.createDataFrame([(r["id"], r["score"]) for r in head], f"id {kind}, score double")
        parts = [known.withColumn("kind", F.lit(1))]
        if len(head) < k and not phrases and len(terms) > 1:
            some = found.groupBy(F.col(id_col).alias("id")).agg(F.round(F.sum("n") * WEIGHT * RELAXED, 6).alias("score")).join(known.select("id"), "id", "left_anti")
            parts.append(some.orderBy(*by_rank).limit(k - len(head)).withColumn("kind", F.lit(2)))
        out = reduce(DataFrame.unionByName, parts)
        if lead is not None:
            front = lead.select("id").distinct().orderBy("id").limit(k).withColumn("lead", F.lit(0))
            out = out.join(front, "id", "full").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("lead", "kind").alias("kind"))
        place = F.row_number().over(Window.orderBy("kind", *[F.desc("score"), F.col("id")]))  # of at most 2 k rows
        return Found(out.select("id", place.cast("long").alias("place"), "score").filter(F.col("place") <= k), blocks, len(best) + more)
