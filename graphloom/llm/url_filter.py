"""Allow or block urls: host rules first, then a naive Bayes classifier over words that hosts are made of.

Hosts run words together. Every distinct run of letters in a host is split into words by the most probable sequence
under unigram counts (Viterbi), where the counts are those of all words of all pages' own text: a run's substrings are
joined to the words counted, so no table of words goes to tasks and none is cut. A substring that is no word counts as
10 / (N * 10^length) of the N words, so long unknown runs stay whole.

A multinomial naive Bayes model then scores the words of the host and the tokens of the path. There are no labelled
urls; a page counts as blocked in training if its host has one of a list of seed words among its segments, and what
comes along with those words (in other segments, in paths) is learned from all pages. A page counts a token once, so
no long url outweighs others. Tokens are counted by hash into 2^20 cells, so the model that goes to tasks has one
size whatever the corpus.

Hosts are joined once, by name, after being folded: many pages of one host make one row of it, and the one join of
pages to hosts has a single row on the other side of each key, which Spark can split where a host has most pages.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A longer run of letters is no name in the DNS and stays one word; no word is longer than `WORD` letters.
RUN, WORD = 63, 24
CELLS = 1 << 20
LETTERS, TOKEN = r"\p{L}+", r"\p{L}+|[0-9]+"
# Words of hosts that are blocked as a rule (adult, gambling, drugs, advertising, fraud).
SEEDS = (
    "adult", "porn", "xxx", "sex", "escort", "casino", "poker", "bet", "bets", "betting", "gambling", "jackpot", "lottery", "slots", "pills", "viagra", "cialis", "pharma",
    "spam", "ads", "adserver", "clickbait", "malware", "phishing", "warez", "torrent", "payday", "loans",
)
#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


# ---- urls ------------------------------------------------------------------------------------------------------------
def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. Without :// both are empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict. A rule's host fits itself and its subdomains, its path (from / on) the paths that start with it."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


# ---- words of hosts --------------------------------------------------------------------------------------------------
def page_words(html: Column) -> Column:
    """Lower-case words of two letters or more of a page without its tags."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(html, "<[^>]*>", " ")), F.lit(r"\p{L}{2,}"), F.lit(0))


def best_split(run: str, counts: dict[str, float], total: float) -> list[str]:
    """The words whose product of probabilities is greatest; among equals the one whose last word is shortest, and so on to the left."""
    unknown = lambda size: math.log(10.0 / total) - size * math.log(10.0)
    score, back = [0.0], [0]
    for j in range(1, len(run) + 1):
        best, at = -math.inf, 0
        for i in range(j - 1, max(-1, j - WORD - 1), -1):
            n = counts.get(run[i:j])
            s = score[i] + (math.log(n / total) if n else unknown(j - i))
            if s > best + 1e-9:
                best, at = s, i
        score.append(best)
        back.append(at)
    out, j = [], len(run)
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


def _split(total: float):
    def run(batches):
        for b in batches:
            words = [best_split(r, {k["word"]: float(k["n"]) for k in known}, total) for r, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return run


def split_runs(runs: DataFrame, words: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """run, words of the distinct runs of letters (column run). words: word, n; each seed counts once more."""
    spark = runs.sparkSession
    known = words.unionByName(spark.createDataFrame([(s, 1) for s in seeds], "word string, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    total = float(known.agg(F.sum("n")).first()[0] or 1)
    size = F.length("run")
    place = F.sequence(F.lit(1), size)
    cuts = F.flatten(F.transform(place, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(WORD), size - i + 1)), lambda k: F.substring(F.col("run"), i, k))))
    runs = runs.filter(size > 0)
    short = runs.filter(size <= RUN)
    pieces = short.select("run", F.explode(F.array_distinct(cuts)).alias("word"))
    found = pieces.join(known, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # of a run's substrings, at most RUN * WORD
    with_known = short.join(found, "run", "left").select("run", F.coalesce("known", F.array().cast("array<struct<word: string, n: bigint>>")).alias("known"))
    return with_known.mapInArrow(_split(total), "run string, words array<string>").unionByName(runs.filter(size > RUN).select("run", F.array("run").alias("words")))


def segmented_hosts(hosts: DataFrame, words: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """host, words: hosts (column host, distinct) with the words that their runs of letters split into, in order; digits are runs of 0."""
    runs = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(TOKEN), F.lit(0))).alias("at", "run"))
    digits = F.col("run").rlike("^[0-9]")
    split = split_runs(runs.filter(~digits).select("run").distinct(), words, seeds)
    parts = runs.filter(~digits).join(split, "run").select("host", "at", "words").unionByName(runs.filter(digits).select("host", "at", F.array(F.lit("0")).alias("words")))
    per = parts.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    return hosts.join(per, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


# ---- naive Bayes -----------------------------------------------------------------------------------------------------
def _cell(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(CELLS)).cast("int")


def path_tokens(path: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(path), F.lit(TOKEN), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]"), F.lit("0")).otherwise(x))


def log_odds(counts: dict[bool, dict[int, int]], pages: dict[bool, int], smooth: float) -> tuple[np.ndarray, float]:
    """Of each cell log P(token | blocked) / P(token | allowed) with `smooth` added to each count, and the same of the classes (a page more of each)."""
    kinds = max(1, len(set(counts[True]) | set(counts[False])))
    out = []
    for label in (True, False):
        n = np.full(CELLS, smooth)
        n[list(counts[label])] += list(counts[label].values())
        out.append(np.log(n / (sum(counts[label].values()) + smooth * kinds)))
    return out[0] - out[1], math.log((pages[True] + 1) / (pages[False] + 1))


def _score(model):
    """Puts what the model says of a row's cells in place of these, its last column."""

    def run(batches):
        odds, prior = model.value
        for b in batches:
            cells = b.columns[-1]
            row = np.repeat(np.arange(b.num_rows), np.diff(cells.offsets.to_numpy()))
            total = prior + np.bincount(row, weights=odds[cells.flatten().to_numpy(zero_copy_only=False)], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(total)], [*b.schema.names[:-1], "log_odds"])

    return run


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS, smooth: float = 0.1) -> DataFrame:
    """page_id, host, path, rule, verdict, host_words, log_odds of every row of pages (page_id, url, html).

    The longest rule that fits decides; else log_odds of being blocked, above 0: block. Rules are a short list that is
    part of the plan. A null url, or one without ://, has an empty host and path, no tokens, and what the classes alone
    say. Null html has no words. Repeated rows and null ids are rows of their own; other columns are not looked at. With no
    page that has a seed word, or no page at all, nothing but rules blocks. Hosts and paths are never cut; a run of
    more than 63 letters is one word.
    """
    spark = pages.sparkSession
    work = Tables(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = work.write(pages.select("page_id", host.alias("host"), path.alias("path")), "rows")
    words = pages.select(F.explode(page_words(F.col("html"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages"))
    blocked = F.arrays_overlap("words", F.lit(list(seeds)))
    hosts = work.write(segmented_hosts(hosts, words, seeds).withColumn("blocked", blocked), "hosts")
    known = rows.join(hosts.select("host", "words", "blocked"), "host").withColumn("tokens", path_tokens(F.col("path")))
    cells = F.array_distinct(F.transform(F.concat("words", "tokens"), _cell))
    known = work.write(known.select("page_id", "host", "path", "blocked", F.concat_ws(" ", "words").alias("host_words"), cells.alias("cells")), "known")
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in known.select("blocked", F.explode("cells").alias("cell")).groupBy("blocked", "cell").agg(F.count("*").alias("n")).collect():  # at most 2 * CELLS rows
        counts[r.blocked][r["cell"]] = r.n
    per = {r.blocked: r.n for r in hosts.groupBy("blocked").agg(F.sum("pages").alias("n")).collect()}
    model = spark.sparkContext.broadcast(log_odds(counts, {x: per.get(x, 0) for x in (True, False)}, smooth))
    kind = pages.schema["page_id"].dataType.simpleString()
    scored = known.select("page_id", "host", "path", "host_words", "cells").mapInArrow(_score(model), f"page_id {kind}, host string, path string, host_words string, log_odds double")
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("log_odds") > 0) & F.lit(bool(per.get(True))), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "host_words", "log_odds")
