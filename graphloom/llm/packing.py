"""Packing documents into sequences by patterns fitted with non-negative least squares.

Spark turns documents into pieces of at most `size` tokens and counts the pieces of each length. That histogram has
`size` bins whatever the corpus, and the plan is made from it alone: all patterns of one to three lengths that fill a
sequence exactly are enumerated, repeat counts x >= 0 are fitted so that what they use comes near the histogram
(least squares, with patterns taken into the fit in rounds until none would lower the error), rounded, and taken off; the residual lengths are
packed best fit, longest first, by bins with counts, not by single pieces. As least squares may spend short lengths that the residual would
need, the plan is made with several shares of the fitted counts, and that with the fewest sequences is used. The plan is a table of runs: so many sequences of one pattern. Spark then numbers the
pieces of each length without gaps (salted, as one length may be that of most pieces), and a piece finds its run,
its sequence and its offset from its length and number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, salts_for, written
from .encoding import encoder, slices


# ---- the plan, from a histogram ------------------------------------------------------------------------------------
def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """Rows of one to three lengths (0: none) that add up to `size` and of which all are present; longest first in each row."""
    there = np.zeros(size + 1, dtype=bool)
    there[present] = True
    found = [np.array([[size, 0, 0]] if there[size] else [], dtype=np.int64).reshape(-1, 3)]
    b = np.arange(1, size // 2 + 1)
    b = b[there[b] & there[size - b]]
    found.append(np.stack([size - b, b, np.zeros_like(b)], axis=1))
    for a in range(-(-size // 3), size - 1):
        if there[a]:
            b = np.arange(-(-(size - a) // 2), min(a, size - a - 1) + 1)
            b = b[there[b] & there[size - a - b]]
            found.append(np.stack([np.full(len(b), a), b, size - a - b], axis=1))
    return np.concatenate(found).astype(np.int64)


class _Squares:
    """Least squares of what patterns use against a histogram. Lengths weigh by their size: a long piece left over costs a sequence, a short one fills gaps."""

    def __init__(self, histogram: np.ndarray):
        self.size = len(histogram) - 1
        self.weight = np.sqrt(np.arange(self.size + 1) / self.size) + 0.05
        self.weight[0] = 0
        self.target = histogram * self.weight

    def used(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), weights=np.repeat(x, 3), minlength=self.size + 1) * self.weight

    def back(self, rows: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (r * self.weight)[rows].sum(axis=1)

    def descend(self, rows: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
        """Accelerated projected gradient from x."""
        step = 1.0 / max(1e-9, float(self.back(rows, self.used(rows, np.ones(len(rows)))).max()))  # norm of A'A is at most its largest row sum
        y, t = x, 1.0
        for _ in range(steps):
            new = np.maximum(0, y - step * self.back(rows, self.used(rows, y) - self.target))
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, x, t = new + (t - 1) / t2 * (new - x), new, t2
        return x


def fit_counts(rows: np.ndarray, histogram: np.ndarray, start: int = 10_000, more: int = 15_000, steps: int = 60) -> np.ndarray:
    """x >= 0 that brings sum(x * pattern) near the histogram.

    The fit starts with all patterns of at most two lengths and others spread evenly; each round adds the patterns along
    which the error falls most, until it falls along none.
    """
    f, x = _Squares(histogram), np.zeros(len(rows))
    if not len(rows):
        return x
    inside = rows[:, 2] == 0
    inside[np.linspace(0, len(rows) - 1, min(start, len(rows))).astype(int)] = True
    while True:
        at = np.flatnonzero(inside)
        x[at] = f.descend(rows[at], x[at], steps)
        slope = np.where(inside, 0.0, f.back(rows, f.used(rows[at], x[at]) - f.target))
        down = np.flatnonzero(slope < -1e-3 * histogram.max())
        if not len(down):
            return x
        inside[down[np.argsort(slope[down], kind="stable")[:more]]] = True


def plan_runs(histogram: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) that use every piece of the histogram (index: length) exactly once."""
    histogram = histogram.astype(np.int64)
    size = len(histogram) - 1
    rows = patterns(np.flatnonzero(histogram), size)
    x = fit_counts(rows, histogram.astype(np.float64))
    least = max(-(-int((histogram * np.arange(size + 1)).sum()) // size), int(histogram[size // 2 + 1 :].sum()))
    best, fewest = [], None
    for share in (1.0, 0.75, 0.5, 0.25, 0.0):
        for up in (0.5, 0.0) if share else (0.0,):
            runs = _planned(histogram, rows, np.floor(share * x + up).astype(np.int64))
            n = sum(k for k, _ in runs)
            if fewest is None or n < fewest:
                best, fewest = runs, n
            if fewest <= least:
                return best
    return best


def _planned(histogram: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns as often as `counts` and what is left allow, the most frequent first; best fit for the rest."""
    left, runs = histogram.copy(), []
    some = np.flatnonzero(counts)
    for i in some[np.argsort(-counts[some], kind="stable")]:
        k, lengths = int(counts[i]), [int(v) for v in rows[i] if v]
        for v in set(lengths):
            k = min(k, int(left[v]) // lengths.count(v))
        if k > 0:
            runs.append((k, tuple(lengths)))
            for v in lengths:
                left[v] -= k
    return runs + _best_fit(left)


def _best_fit(left: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first: the longest piece that is left opens a sequence, and the longest that fits goes in until none does.

    A sequence's content is repeated as often as the counts allow, so the work follows the lengths, not the pieces.
    """
    left, runs = left.copy(), []
    size = len(left) - 1
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return runs
        content, room, taken = [], size, {}
        for v in there[::-1]:
            v = int(v)
            if v <= room:
                n = min(room // v, int(left[v]))
                content += [v] * n
                taken[v] = n
                room -= n * v
                if not room:
                    break
        k = min(int(left[v]) // n for v, n in taken.items())
        for v, n in taken.items():
            left[v] -= k * n
        runs.append((k, tuple(content)))


def slots(runs: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Sorted by length: numbers `first` to first + n - 1 of a length lie in sequences base + 0.. at `offset`."""
    out, base, used = [], 0, {}
    for n, lengths in runs:
        offset = 0
        for v in lengths:
            out.append((v, used.get(v, 0), n, base, offset))
            used[v] = used.get(v, 0) + n
            offset += v
        base += n
    a = np.array(sorted(out), dtype=np.int64).reshape(-1, 5)
    return {k: a[:, i] for i, k in enumerate(("length", "first", "n", "base", "offset"))}


# ---- Spark ---------------------------------------------------------------------------------------------------------
def _pieces(tokenizer: str, size: int, end_id: int, keeps_space: bool):
    def run(batches):
        enc, end = encoder(tokenizer, "<u4", keeps_space), np.array([end_id], dtype="<u4").tobytes()
        for b in slices(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            ids = [x + end for x in enc.encode([t or "" for t in b.column(1).to_pylist()])]
            for i, x in enumerate(ids):
                for k, at in enumerate(range(0, len(x), 4 * size)):
                    part = x[at : at + 4 * size]
                    doc.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(plan):
    def run(batches):
        p = plan.value
        top = int(p["first"].max(initial=0) + p["n"].max(initial=0)) + 1
        key = p["length"] * top + p["first"]
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(key, length * top + number, side="right") - 1
            seq, offset = p["base"][at] + number - p["first"][at], p["offset"][at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, keeps_space: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each document's pieces and their places.

    A null or empty text is its end alone, one token. Repeated rows and null ids are documents of their own. An empty
    table gives no rows. Pieces of one length are placed in an order of their own columns, so reruns and tasks that are
    run again agree.
    """
    spark = docs.sparkSession
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, size, end_id, keeps_space), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = written(pieces, "pieces")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `size` rows
        histogram[r["length"]] = r["count"]
    plan = spark.sparkContext.broadcast(slots(plan_runs(histogram)))
    rows = numbered(pieces, "length", F.xxhash64("doc_id", "piece", "ids_crc32"), "number", salts_for(int(histogram.max())))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
