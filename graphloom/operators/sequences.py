"""Operators whose results depend on an order within a group: they run on Arrow-fed tasks, group by group."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.text import fold

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def chunk_text(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_sequence, start_char, end_char, content: sentences packed up to `size` characters; a chunk starts again with the sentences of the last `overlap` characters, never more than half of it. A longer sentence is cut."""

    def pieces(text: str):
        at, spans = 0, []
        for m in [*SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            spans += [(a, min(a + size, end)) for a in range(at, end, size)]
            at = m.end() if m else at
        first = 0
        while first < len(spans):
            last = first
            while last + 1 < len(spans) and spans[last + 1][1] - spans[first][0] <= size:
                last += 1
            yield spans[first][0], spans[last][1]
            if last + 1 >= len(spans):
                return
            again = last + 1
            while again - 1 > first and spans[last][1] - spans[again - 1][0] <= min(overlap, size // 2):
                again -= 1
            first = again

    def run(batches):
        for b in batches:
            rows = [(i, k, a, z, t[a:z]) for i, t in zip(b["doc_id"], b["text"]) if isinstance(t, str) for k, (a, z) in enumerate(pieces(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_sequence", "start_char", "end_char", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_sequence int, start_char int, end_char int, content string")


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Of spans (doc_id, start, end, score) those that, highest score first, overlap none kept before. Spans come sorted to tasks, which hold what is kept of one document."""
    columns, last = spans.columns, object()

    def run(batches):
        doc, starts, ends = last, [], []  # of the document's spans that are kept, in order of place; they don't overlap
        for b in batches:
            keep = []
            for of, start, end in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "end"))):
                if of != doc:
                    doc, starts, ends = of, [], []
                if start is None or end is None:  # without a place it overlaps nothing
                    keep.append(True)
                    continue
                at = bisect_left(starts, end)  # those before it start before this one ends
                fits = not at or ends[at - 1] <= start
                if fits:
                    starts.insert(at, start), ends.insert(at, end)
                keep.append(fits)
            yield b.filter(pa.array(keep, pa.bool_()))

    order = F.desc_nulls_last(F.when(~F.isnan(F.col("score").cast("double")), F.col("score")))
    placed = spans.repartition("doc_id").sortWithinPartitions("doc_id", order, "start", "end")
    return placed.mapInArrow(run, spans.schema).select(columns)


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings; nine tenths of the length ratio where one holds the other, if that is more."""

    def one(x, y):
        if not x or not y:
            return 0.0
        short, long = sorted((x, y), key=len)
        inside = 0.9 * len(short) / len(long) if short in long else 0.0
        return max(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), inside)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def fuzzy_complement(pairs: DataFrame, least: float = 0.62) -> DataFrame:
    """Pairs (a, b, x_name, y_name) that trigrams missed, by matching blocks."""
    return pairs.withColumn("score", F.round(seq_ratio(fold(F.col("x_name")), fold(F.col("y_name"))), 6)).filter(F.col("score") >= least)


def alike_in_blocks(rows: DataFrame, block: list[str], least: float = 0.62) -> DataFrame:
    """fuzzy_complement() of every two rows (id, name, columns of `block`) of one block as a, b, x_name, y_name, score with a < b: two names are matched once, whatever they are of."""
    names = rows.select(*block, "name").distinct()
    x, y = names.withColumnRenamed("name", "x_name"), names.withColumnRenamed("name", "y_name")
    scores = fuzzy_complement(x.join(y, block).select("x_name", "y_name").distinct(), least)
    alike = x.join(y, block).join(scores, ["x_name", "y_name"])
    one = lambda i, name: rows.select(*block, F.col("id").alias(i), F.col("name").alias(name))
    return alike.join(one("a", "x_name"), [*block, "x_name"]).join(one("b", "y_name"), [*block, "y_name"]).filter("a < b").select("a", "b", "x_name", "y_name", "score")


def pseudonymized(texts: DataFrame, dictionary: DataFrame, reverse: bool = False) -> DataFrame:
    """texts (id, compilation_id, text) with the names of their compilation's dictionary (entity_key, pseudonym) replaced, the longest first, whole words, whatever their case. A dictionary is bounded by its compilation."""
    key, to = ("pseudonym", "entity_key") if reverse else ("entity_key", "pseudonym")
    per = dictionary.groupBy("compilation_id").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(to).alias("v"))).alias("names"))

    @F.pandas_udf(StringType())
    def swap(text: pd.Series, names: pd.Series) -> pd.Series:
        def one(t, pairs):
            if t is None or pairs is None or not len(pairs):
                return t
            table = {p["k"].lower(): p["v"] for p in pairs}
            pattern = re.compile(r"(?<!\w)(" + "|".join(re.escape(k) for k in sorted(table, key=lambda k: (-len(k), k))) + r")(?!\w)", re.IGNORECASE)
            return pattern.sub(lambda m: table[m.group(1).lower()], t)

        return pd.Series([one(t, p) for t, p in zip(text, names)])

    return texts.join(per, "compilation_id", "left").select("id", "compilation_id", swap("text", "names").alias("text"))


@F.pandas_udf(StringType())
def salvaged_json(x: pd.Series) -> pd.Series:
    """The complete objects of a JSON array that was cut off, as an array."""
    import json

    def one(t):
        found, decoder = [], json.JSONDecoder()
        at = (t or "").find("{")
        while at >= 0:
            try:
                value, end = decoder.raw_decode(t, at)
                found.append(value)
                at = t.find("{", end)
            except ValueError:
                at = t.find("{", at + 1)
        return json.dumps(found)

    return x.map(one)
