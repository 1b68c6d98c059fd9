"""Texts from files by format. Formats that DataFrame functions can read stay in the JVM; mail and code go through Arrow-fed tasks."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from email import message_from_bytes
from email.policy import default

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import html_text, markdown_text

#: Which extractor an extension goes to, and formats that are turned away.
EXTENSIONS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".xml": "markup", ".html": "markup", ".htm": "markup", ".md": "markdown", ".txt": "plain", ".log": "plain", ".eml": "mail", ".py": "code", ".yaml": "plain", ".yml": "plain", ".toml": "plain", ".rtf": "rtf"}
MIME = {"text/csv": "csv", "application/json": "json", "text/html": "markup", "application/xml": "markup", "text/markdown": "markdown", "message/rfc822": "mail", "text/plain": "plain"}
REJECTED = (".doc", ".xls", ".ppt")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.[^./]+$", 0)


def extractor(path: Column, mime: Column) -> Column:
    """By extension first, by type second; `rejected` for old binary formats, null for what is unknown."""
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return F.when(extension(path).isin(*REJECTED), "rejected").otherwise(F.coalesce(F.try_element_at(table(EXTENSIONS), extension(path)), F.try_element_at(table(MIME), mime)))


def row_text(df: DataFrame, columns: list[str] | None = None, most: int = 500) -> Column:
    """`name: value | ...` of the values that aren't null or empty, each cut to `most` characters."""
    parts = [F.when(F.length(F.col(c).cast("string")) > 0, F.concat(F.lit(f"{c}: "), F.substring(F.col(c).cast("string"), 1, most))) for c in columns or df.columns]
    return F.concat_ws(" | ", *parts)


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """line, text: a line that names the columns, then one for each row."""
    df = spark.read.option("header", True).csv(path)
    rows = df.select(F.monotonically_increasing_id().alias("i"), row_text(df).alias("t"))
    head = spark.createDataFrame([(-1, "Columns: " + ", ".join(df.columns))], "i long, t string")
    return head.unionByName(rows.withColumn("t", F.concat(F.lit("Row: "), "t"))).select(F.col("i").alias("line"), F.col("t").alias("text"))


def _leaves(x) -> Iterator[str]:
    if isinstance(x, dict):
        for v in x.values():
            yield from _leaves(v)
    elif isinstance(x, list):
        for v in x:
            yield from _leaves(v)
    elif isinstance(x, str) and len(x.strip()) > 3:
        yield x.strip()


@F.pandas_udf(StringType())
def json_strings(x: pd.Series) -> pd.Series:
    """The strings of more than three characters anywhere in a JSON document, a line each; null if it isn't JSON."""

    def one(t):
        try:
            return "\n".join(_leaves(json.loads(t)))
        except (TypeError, ValueError):
            return None

    return x.map(one)


@F.pandas_udf(StringType())
def mail_text(x: pd.Series) -> pd.Series:
    """Subject, from, to, date and the plain body of a mail."""

    def one(raw):
        if raw is None:
            return None
        m = message_from_bytes(bytes(raw), policy=default)
        body = m.get_body(preferencelist=("plain", "html"))
        head = [f"{k}: {str(m[k])}" for k in ("Subject", "From", "To", "Date") if m[k]]
        return "\n".join([*head, "", body.get_content() if body else ""]).strip()

    return x.map(one)


def rtf_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\par[d]?\b", "\n"), r"\\'[0-9a-f]{2}|\\[a-z]+-?[0-9]* ?", ""), r"[{}]", ""))


def extracted(files: DataFrame) -> DataFrame:
    """path, kind, text of files (path, content as bytes, mime)."""
    kind = extractor(F.col("path"), F.col("mime"))
    f = files.withColumn("kind", kind).withColumn("t", F.decode("content", "utf-8"))
    text = F.when(F.col("kind") == "markup", html_text(F.col("t"))).when(F.col("kind") == "markdown", markdown_text(F.col("t"))).when(F.col("kind").isin("plain", "csv"), F.col("t")).when(F.col("kind") == "rtf", rtf_text(F.col("t"))).when(F.col("kind") == "json", json_strings("t")).when(F.col("kind") == "mail", mail_text("content"))
    return f.select("path", "kind", text.alias("text"))


def _parsed(path: str, content: str) -> Iterator[tuple]:
    """(path, kind, name, other) of a module: what it contains, imports, inherits from and calls."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, TypeError):
        return
    yield path, "file", path, None

    def walk(node, owner):
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = f"{owner}.{child.name}" if owner else child.name
                yield path, "class" if isinstance(child, ast.ClassDef) else "function", inner, owner or path
                for base in getattr(child, "bases", []):
                    if isinstance(base, (ast.Name, ast.Attribute)):
                        yield path, "inherits", inner, base.id if isinstance(base, ast.Name) else base.attr
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield path, "imports", path, a.name
            elif isinstance(child, ast.ImportFrom) and child.module:
                yield path, "imports", path, child.module
            elif isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                yield path, "calls", owner or path, child.func.id if isinstance(child.func, ast.Name) else child.func.attr
            yield from walk(child, inner)

    yield from walk(tree, "")


def code_facts(files: DataFrame) -> DataFrame:
    """path, kind, name, other of Python files (path, content); a file that doesn't parse gives nothing."""

    def run(batches):
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"]) for r in _parsed(p, c)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "other"]).astype("object")

    return files.select("path", "content").mapInPandas(run, "path string, kind string, name string, other string")


def code_graph(facts: DataFrame) -> DataFrame:
    """src, rel, dst: containment and imports as they are, calls and bases only where the simple name has one definition."""
    defined = facts.filter(F.col("kind").isin("class", "function")).select(F.element_at(F.split("name", r"\."), -1).alias("other"), F.concat_ws(":", "path", "name").alias("dst"))
    single = defined.groupBy("other").agg(F.count("*").alias("n"), F.first("dst").alias("dst")).filter("n = 1").drop("n")
    own = facts.filter(F.col("kind").isin("class", "function")).select(F.when(F.col("other") == F.col("path"), F.col("path")).otherwise(F.concat_ws(":", "path", "other")).alias("src"), F.lit("CONTAINS").alias("rel"), F.concat_ws(":", "path", "name").alias("dst"))
    imports = facts.filter("kind = 'imports'").select(F.col("path").alias("src"), F.lit("IMPORTS").alias("rel"), F.col("other").alias("dst"))
    source = F.when(F.col("name") == F.col("path"), F.col("path")).otherwise(F.concat_ws(":", "path", "name"))
    used = facts.filter(F.col("kind").isin("calls", "inherits")).join(single, "other").select(source.alias("src"), F.upper("kind").alias("rel"), "dst")
    return own.unionByName(imports).unionByName(used).distinct()


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^https?://([^/?#]+)", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def link_table(pages: DataFrame) -> DataFrame:
    """src, dst of links between addresses of the same host, without fragments."""
    links = pages.select(without_fragment(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", without_fragment(F.col("dst")))
    dst = F.when(F.startswith("dst", F.lit("/")), F.concat(F.regexp_extract("src", r"^(https?://[^/?#]+)", 1), "dst")).otherwise(F.col("dst"))
    return links.withColumn("dst", dst).filter((host(F.col("src")) == host(F.col("dst"))) & (F.col("src") != F.col("dst"))).distinct()


def crawl(links: DataFrame, start: DataFrame, depth: int, most: int) -> DataFrame:
    """start, url, depth of pages reached from each start (url) by links, breadth first, at most `most` a start."""
    from pyspark.sql import Window

    front = start.select(F.col("url").alias("start"), "url", F.lit(0).cast("long").alias("depth"))
    seen = front
    for d in range(1, depth + 1):
        found = front.join(links, F.col("url") == F.col("src")).select("start", F.col("dst").alias("url")).distinct()
        front = found.join(seen, ["start", "url"], "left_anti").withColumn("depth", F.lit(d).cast("long"))
        seen = seen.unionByName(front)
    place = F.row_number().over(Window.partitionBy("start").orderBy("depth", "url"))
    return seen.withColumn("place", place).filter(F.col("place") <= most).drop("place")


@F.pandas_udf(StringType())
def toml_text(x: pd.Series) -> pd.Series:
    """`key = value` lines of the leaves of a TOML document; null if it isn't one."""

    def leaves(v, key=""):
        if isinstance(v, dict):
            for k, w in v.items():
                yield from leaves(w, k)
        else:
            yield f"{key} = {v}"

    def one(t):
        import tomllib

        try:
            return "\n".join(leaves(tomllib.loads(t)))
        except (TypeError, ValueError):
            return None

    return x.map(one)
