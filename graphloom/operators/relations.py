"""Validation and pruning of extracted relations, and the register of conflicting facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(triples: DataFrame, entities: DataFrame, synonyms: DataFrame, allowed: DataFrame) -> DataFrame:
    """triples (head, rel, tail, confidence) with from, canon, to and reason: null where the triple holds, `flipped` where it holds the other way round.

    entities: name, type; synonyms: label, canon; allowed: canon, head_type, tail_type. The last two are vocabularies.
    Other reasons: `unknown endpoint`, `self loop`, `unknown relation`, `types`.
    """
    types = entities.select("name", "type").dropDuplicates(["name"])
    t = triples.join(types.withColumnsRenamed({"name": "head", "type": "x"}), "head", "left").join(types.withColumnsRenamed({"name": "tail", "type": "y"}), "tail", "left")
    bare = F.regexp_replace(F.lower("rel"), "^(is|was|has|a|the)_", "")
    t = t.withColumn("label", bare).join(synonyms, "label", "left").withColumn("canon", F.coalesce("canon", F.upper("rel")))
    known = allowed.select("canon").distinct().withColumn("known", F.lit(True))
    way = lambda a, b, name: allowed.select("canon", F.col("head_type").alias(a), F.col("tail_type").alias(b), F.lit(True).alias(name))
    t = t.join(known, "canon", "left").join(way("x", "y", "straight"), ["canon", "x", "y"], "left").join(way("y", "x", "turned"), ["canon", "x", "y"], "left")
    reason = F.when(F.col("x").isNull() | F.col("y").isNull(), "unknown endpoint").when(F.col("head") == F.col("tail"), "self loop").when(F.col("known").isNull(), "unknown relation")
    reason = reason.when(F.col("straight"), F.lit(None).cast("string")).when(F.col("turned"), "flipped").otherwise("types")
    t = t.withColumn("reason", reason)
    turn = F.col("reason") == "flipped"
    return t.select("head", "rel", "tail", "confidence", "canon", F.when(turn, F.col("tail")).otherwise(F.col("head")).alias("from"), F.when(turn, F.col("head")).otherwise(F.col("tail")).alias("to"), "reason")


def validated(triples: DataFrame) -> DataFrame:
    """Of judged triples those that hold, each once: head, rel, tail, confidence (the highest) and how many there were."""
    good = triples.filter("reason IS NULL OR reason = 'flipped'")
    return good.groupBy(F.col("from").alias("head"), F.col("canon").alias("rel"), F.col("to").alias("tail")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def root(name: Column) -> Column:
    """A name without digits and number signs, in lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[0-9#]+", " "), r"\s+", " "))


def pruned(relations: DataFrame, general: str = "RELATED_TO") -> DataFrame:
    """relations (head, rel, tail, confidence) without links of a root to itself, with one of all variants of names (the surest, then the least), and without a general link where the same roots have a special one."""
    r = relations.withColumns({"x": root(F.col("head")), "y": root(F.col("tail"))}).filter("x <> y")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "head", "tail")).alias("b")
    r = r.groupBy("x", "rel", "y").agg(best)
    special = r.filter(F.col("rel") != general).select("x", "y").distinct().withColumn("special", F.lit(True))
    r = r.join(special, ["x", "y"], "left").filter((F.col("rel") != general) | F.col("special").isNull())
    return r.select("b.head", "rel", "b.tail", (-F.col("b.c")).alias("confidence"))


def registered(found: DataFrame, stored: DataFrame) -> DataFrame:
    """key_uri, relation, tails, status of the register after a run that found these conflicts.

    found: key_uri, relation, tails; stored: key_uri, relation, tails, status. New conflicts are open; a dismissed one
    stays dismissed; a resolved one that is found again is open again; one that isn't found any more is resolved, unless
    it was dismissed.
    """
    f = found.select("key_uri", "relation", F.col("tails").alias("now"))
    both = stored.join(f, ["key_uri", "relation"], "full")
    status = F.when(F.col("status") == "dismissed", "dismissed").when(F.col("now").isNull(), "resolved").otherwise("open")
    return both.select("key_uri", "relation", F.coalesce("now", "tails").alias("tails"), status.alias("status"))


def competing(edges: DataFrame, relation: str) -> DataFrame:
    """Facts of a functional relation by subject, the one with most authority first (place 1), with their number n."""
    w = Window.partitionBy("src_uri").orderBy(F.desc_nulls_last("source_doc_modified_at"), F.desc_nulls_last("asserted_at"), F.desc("confidence"), "dst_uri")
    return edges.filter(F.col("rel_type") == relation).withColumn("place", F.row_number().over(w).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("src_uri")))
