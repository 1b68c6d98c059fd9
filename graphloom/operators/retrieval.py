"""Retrieval over chunks: dense, lexical and fused ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def fused(channels: list[DataFrame], k: int, base: int = 60) -> DataFrame:
    """Reciprocal rank fusion of channels (id, and place or score): id and the sum of 1 / (base + place)."""
    out = None
    for c in channels:
        r = F.col("place") if "place" in c.columns else F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # a channel holds few rows
        part = c.select("id", (1.0 / (base + r)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def names_in(texts: DataFrame, text_col: str, names: DataFrame, name_col: str) -> DataFrame:
    """texts joined with the names whose words they hold side by side, whatever stands between them; each name once a text.

    A text's distinct words and pairs of neighbours meet the names' first two words, or the only one, so no text is
    compared with names it can't hold.
    """
    line = lambda x: F.concat(F.lit(" "), F.array_join(T.tokens(x), " "), F.lit(" "))
    words = T.tokens(F.col(text_col))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.lit(1), F.size(words))), lambda a, b: F.concat_ws(" ", a, b))
    n = names.withColumn("__name", line(F.col(name_col))).filter("__name <> '  '").withColumn("__word", F.array_join(F.slice(T.tokens(F.col(name_col)), 1, 2), " "))
    t = texts.withColumn("__text", line(F.col(text_col))).withColumn("__word", F.explode(F.array_union(words, pairs)))
    return t.join(n, "__word").filter(F.contains("__text", "__name")).drop("__word", "__text", "__name")
