"""Graphs as text: JSON-LD, Turtle and GraphML lines, one for each element, for df.write.text()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def jsonld(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct(F.col("uri").alias("@id"), F.col("type").alias("@type"), "name")).alias("value"))


def turtle(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string("<%s> <rel:%s> <%s> .", "src_uri", "rel_type", "dst_uri").alias("value"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.format_string('<node id="%s"><data key="name">%s</data></node>', xml_escaped(F.col("uri")), xml_escaped(F.col("name"))).alias("value"))
    e = edges.select(F.format_string('<edge source="%s" target="%s" label="%s"/>', xml_escaped(F.col("src_uri")), xml_escaped(F.col("dst_uri")), "rel_type").alias("value"))
    return n.unionByName(e)
