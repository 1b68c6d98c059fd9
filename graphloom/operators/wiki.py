"""Links between wiki pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def page_links(pages: DataFrame, rank: int) -> DataFrame:
    """source, target (slugs) of the links [[..]] between visible pages (slug, title, body, min_rank), each once.

    A link means the page with that slug, else with that title in any case, else with the title that slugifies to the same; of
    several the least slug. Links to hidden or missing pages and of a page to itself are dropped.
    """
    seen = pages.filter(F.coalesce("min_rank", F.lit(0)) <= rank)
    links = seen.select(F.col("slug").alias("source"), F.explode(T.wikilinks(F.col("body"))).alias("link")).distinct()
    by = lambda key, name: seen.groupBy(key.alias(f"by_{name}")).agg(F.min("slug").alias(name))
    out = links.join(by(F.col("slug"), "own"), F.col("link") == F.col("by_own"), "left")
    out = out.join(by(F.lower("title"), "titled"), F.lower("link") == F.col("by_titled"), "left")
    out = out.join(by(T.wiki_slug(F.col("title")), "like"), T.wiki_slug(F.col("link")) == F.col("by_like"), "left")
    return out.select("source", F.coalesce("own", "titled", "like").alias("target")).filter("target <> source").distinct()
