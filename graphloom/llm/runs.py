"""Periodic runs of words: stretches that repeat one pattern three times or more, found on a harmonic grid.

A run of period q keeps word i equal to word i + q over a stretch that is at least `gap(q)` long, so that one of the grid
points 0, gap, 2 gap, ... lies in it; over all periods there are about n/2 ln(n) grid points. All pairs of a period
and a grid point whose two words agree are extended at once: the longest common extension to either side is found by
bisection over prefix hashes (sums of words' numbers times powers, modulo 2^64), one step for all pairs together. What
comes out is compared word by word, so a collision of hashes changes nothing. Stretches found from several grid
points, or under multiples of their period, are one run.

A text is worked on by one task and needs some 60 bytes for each of its words; texts are not joined or sorted, so no
row is ever with another one's.
"""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import slices

SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of a text that are words at once, and pairs of a period and a grid point that are extended at once.
PIECE, PAIRS = 1 << 20, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "runs array<struct<start: long, length: long, period: long>>"


def gap(q, least: int, times: int):
    """The least number of places i in a row with word i equal to word i + q in a run of period q."""
    return np.maximum((times - 1) * q, least - q)


def word_lists(text: bytes):
    """The words of a text, in lists of those of about PIECE bytes."""
    at = 0
    while at < len(text):
        m = SPACE.search(text, at + PIECE)
        end = m.end() if m else len(text)
        yield text[at:end].split()
        at = end


def word_numbers(text: bytes) -> np.ndarray:
    """A number for each word, equal where the words are."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)) for words in word_lists(text)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _bisect(low: np.ndarray, high: np.ndarray, agrees) -> np.ndarray:
    """The greatest value in [low, high] for which agrees(value) holds, of each pair; it holds for low."""
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        ok = agrees(mid)
        low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid - 1, high)


def _grid(n: int, least: int, times: int):
    """(periods, grid points), at most about PAIRS (and those of one period) at once."""
    periods = np.arange(1, n // times + 1)
    gaps = gap(periods, least, times)
    points = -(-(n - periods) // gaps)
    batch = (np.cumsum(points) - 1) // PAIRS
    for part in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(batch)) + 1):
        k = points[part]
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        yield np.repeat(periods[part], k), place * np.repeat(gaps[part], k)


def find_runs(w: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs of the numbers w, by start and period.

    A run is as long as it can be, at least `least` and `times` (two or more) of its smallest period.
    """
    n, found = len(w), []
    if n < max(least, times):
        return np.zeros((0, 3), dtype=np.int64)
    power = np.full(n + 1, BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(w) * power[:n])])
    same = lambda i, q, size: (sums[i + size] - sums[i]) * power[q] == sums[i + q + size] - sums[i + q]
    for q, g in _grid(n, least, times):
        some = w[g] == w[g + q]
        q, g = q[some], g[some]
        right = _bisect(np.ones_like(g), n - q - g, lambda size: same(g, q, size))
        left = _bisect(np.ones_like(g), g + 1, lambda size: same(g + 1 - size, q, size))
        start, match = g + 1 - left, left + right - 1
        some = match >= gap(q, least, times)
        found.append(np.unique(np.stack([start[some], match[some] + q[some], q[some]], axis=1), axis=0))
    rows = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    return _smallest(_checked(w, rows, least, times))


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows with one start and length that with the least period; all others have multiples of it."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _checked(w: np.ndarray, rows: np.ndarray, least: int, times: int) -> np.ndarray:
    """rows if words agree where hashes said so; else, for those that don't, the stretches that do agree.

    Rows with one start and length stand or fall together, but for collisions: only the least period is compared first.
    """
    good, at, failed = _smallest(rows), [], []
    for i, (start, length, q) in enumerate(good.tolist()):
        (at if np.array_equal(w[start : start + length - q], w[start + q : start + length]) else failed).append(i)
    if not failed:
        return good
    out = [good[at]]
    bad = good[failed]
    for start, length, q in rows[(rows[:, None, :2] == bad[None, :, :2]).all(axis=2).any(axis=1)].tolist():
        ok = np.concatenate([[False], w[start : start + length - q] == w[start + q : start + length], [False]])
        edges = np.flatnonzero(np.diff(ok.astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= gap(q, least, times):
                out.append(np.array([[start + a, b - a + q, q]]))
    return np.unique(np.concatenate(out), axis=0)


def kept_words(n: int, rows: np.ndarray) -> np.ndarray:
    """Whether each of n words is in no run, or only among the first `period` words of those that hold it."""
    if not len(rows):
        return np.ones(n, dtype=bool)
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def strongest(rows: np.ndarray) -> list[int] | None:
    """The row with the greatest length / period, exactly; then the least start, then the least period."""
    if not len(rows):
        return None
    ratio = rows[:, 1] / rows[:, 2]
    near = rows[ratio >= ratio.max() * (1 - 1e-9)].tolist()
    return min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def _collapsed(text: bytes, kept: np.ndarray) -> bytes:
    out, at = [], 0
    for words in word_lists(text):
        out += [w for w, k in zip(words, kept[at : at + len(words)].tolist()) if k]
        at += len(words)
    return b" ".join(out)


def _runs(text_at: int, least: int, times: int):
    def run(batches):
        for b in slices(batches, 64):
            rows, best, texts = [], [], []
            for x in b.column(text_at).cast(pa.binary()).to_pylist():
                x = x or b""
                w = word_numbers(x)
                found = find_runs(w, least, times)
                rows.append(found)
                best.append(strongest(found))
                texts.append(_collapsed(x, kept_words(len(w), found)))
            flat, ends = np.concatenate(rows), np.cumsum([0] + [len(r) for r in rows])
            struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            columns = [c for i, c in enumerate(b.columns) if i != text_at]
            first = pa.array([x and dict(zip(("start", "length", "period"), x)) for x in best], struct.type)
            added = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct), first, pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*(n for i, n in enumerate(b.schema.names) if i != text_at), "runs", "strongest", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period, by start and period), strongest run, collapsed text of every row of docs.

    Words are what ASCII white space leaves, as they stand. A run is a stretch of words with smallest period q, of at
    least `least` words and `times` periods (2 or more), that no neighbouring word extends with that period. Collapsed
    are the words that no run contains after its first period, joined by blanks. strongest is the run with the greatest
    length / period (ties: least start, least period), null without runs.

    A null or empty text has no words, no runs and collapses to an empty one. Repeated rows and null ids are rows of
    their own; other columns are not looked at, whatever their names. No rows give no rows. A text is never cut: a long one
    takes one task's time in proportion to n log(n)^2 of its n words.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_runs(1, least, times), f"doc_id {kind}, {SCHEMA}, strongest struct<start: long, length: long, period: long>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


# ---- planted rows, and digests of results ----------------------------------------------------------------------------
def planted(docs: DataFrame, every: int = 10) -> DataFrame:
    """doc_id and text, where texts of one in `every` ids end in a repeated pattern.

    With h = crc32(doc_id as text), g = floor(h / every) and n words: where h is divisible by `every` and there are words,
    those from a = g % n on repeat the p = 1 + floor((n - a) / (3 + g % 8)) first of them, and blanks part all words. A
    null id is never divisible.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / every))
    some = some.withColumn("w", F.when(F.col("h") % every == 0, words)).withColumn("n", F.size("w"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)).cast("int") + 1)
    cycle = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return some.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(cycle, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row for each of periodic_runs: number of runs, the strongest, and sha256 of all runs and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * strongest.length) DIV strongest.period").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
