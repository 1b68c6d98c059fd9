"""A quality classifier by co-training of two views: a document's words, and what is known of it without its text.

Each view has a logistic regression for each of two faults, low quality and toxicity. In every round each view scores
all unlabelled documents where they lie, and wherever it is confident its opinion becomes a label for the other view.
These labels come back as sums, the confident documents of each label that hold a feature; the log-odds of those sums,
added up over a row's features, are one more rate in the other view's regression, which weighs them against labels.
At the end each view's scores are calibrated on labelled rows that took no part in training, and the calibrated log-odds
are added (less the prior, which both hold). Only the labelled rows are a bounded sample, about `most` and never over
twice as many, drawn by a hash of doc_id and sent to the driver as word hashes. The sums are bounded by the hash space.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .encoding import slices

TEXT_BITS, META_BITS, DENSE = 20, 12, 7
FAULTS = ("low_quality", "toxic")
SYMBOLS = b"#*$%&|<>"
#: A view's opinion counts as a label for the other view from these probabilities on.
SURE_BAD, SURE_GOOD = 0.95, 0.02
#: A hash of fewer rows has no weight, a label of fewer rows no say.
LEAST = 5


# ---- views ---------------------------------------------------------------------------------------------------------
def text_view(x: bytes | None) -> tuple[np.ndarray, list[float]]:
    """Hashes of the distinct words, and seven rates of the whole text."""
    words = (x or b"").lower().split()
    kinds, n = set(words), max(1, len(words))
    lines = [s for s in (x or b"").split(b"\n") if s.strip()]
    symbols = len(x or b"") - len((x or b"").translate(None, SYMBOLS))
    dense = [1.0, min(2.0, symbols / n), words.count(b"|") / n, len(kinds) / n, min(3.0, sum(map(len, words)) / n / 10), math.log1p(n) / 10, 1 - len(set(lines)) / max(1, len(lines))]
    mask = (1 << TEXT_BITS) - 1
    return np.sort(np.fromiter((crc32(w) & mask for w in kinds), dtype=np.int32, count=len(kinds))), dense


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashes of language, source, length band and their pairs."""
    band = int(math.log2(max(1, n_chars or 0)))
    parts = (f"l{lang}", f"s{source}", f"b{band}", f"l{lang}b{band}", f"s{source}b{band}")
    return np.array([crc32(p.encode()) & ((1 << META_BITS) - 1) for p in parts], dtype=np.int32)


# ---- logistic regression on rows of hashes, and dense rates --------------------------------------------------------
class View:
    def __init__(self, bits: int, dense: int, least: int):
        self.size, self.dense, self.least = 1 << bits, dense, least

    def fit(self, rows: list[np.ndarray], rates: np.ndarray, y: np.ndarray, evidence: np.ndarray, steps: int = 80, l2: float = 0.5) -> None:
        """y in 0..1. Only hashes of at least `least` rows get a weight. Gradient steps with momentum, scaled by feature.

        evidence: log-odds of each hash by the other view's labels. They get one common factor of 0 or more.
        """
        flat, n = np.concatenate(rows), np.array([len(r) for r in rows])
        row = np.repeat(np.arange(len(rows)), n)
        seen = np.bincount(flat, minlength=self.size)
        told = np.bincount(row, weights=evidence[flat], minlength=len(rows))
        middle, spread = told.mean(), told.std() or 1.0
        keep = seen[flat] >= self.least
        flat, row = flat[keep], row[keep]
        self.w, self.d = np.zeros(self.size), np.zeros(self.dense + 2)
        rates = np.concatenate([np.ones((len(rows), 1)), rates, (told[:, None] - middle) / spread], axis=1)
        prior = (y.sum() + 1) / (len(y) + 2)
        self.d[0] = math.log(prior / (1 - prior))
        if min(y.sum(), len(y) - y.sum()) < 5:
            self.d = self.d[:-1]
            return
        scale_w, scale_d = 1 / (0.25 * np.maximum(1, seen) ** 0.5 * len(y) ** 0.5 + l2), 1 / (0.25 * (rates**2).sum(axis=0) + 0.1)
        mw, md = np.zeros_like(self.w), np.zeros_like(self.d)
        for _ in range(steps):
            z = np.bincount(row, weights=self.w[flat], minlength=len(rows)) + rates @ self.d
            r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            mw = 0.8 * mw - scale_w * (np.bincount(flat, weights=r[row], minlength=self.size) + l2 * self.w)
            md = 0.8 * md - scale_d * (rates.T @ r) * 0.5
            self.w += mw
            self.d += md
            self.d[-1] = max(self.d[-1], 0.0)
        factor = self.d[-1] / spread
        self.w += factor * evidence
        self.d = self.d[:-1]
        self.d[0] -= factor * middle

    def logits(self, rows: list[np.ndarray], rates: np.ndarray) -> np.ndarray:
        sparse = np.array([self.w[r].sum() for r in rows])
        return sparse + self.d[0] + rates @ self.d[1:]


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of Platt's sigmoid(a z + b), with his smoothed targets; few or one-sided labels: as it is."""
    good = min(y.sum(), len(y) - y.sum())
    if good < 5:
        return 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b


def cotrain(text: list, rates: np.ndarray, meta: list, y: np.ndarray, exchange: Callable, rounds: int = 3) -> list[dict]:
    """One model for each column of y (0, 1), of labelled rows; a quarter of them is for calibration.

    exchange: from the (w, d) of both views of each column, the evidence for both views of each column.
    """
    n, none, models = len(y), np.zeros((len(text), 0)), []
    held = np.arange(n) % 4 == 0
    pick = lambda rows, ids: [rows[i] for i in ids]
    own, kept, data = np.flatnonzero(~held), np.flatnonzero(held), ((text, rates), (meta, none))
    pairs = [(View(TEXT_BITS, DENSE, LEAST), View(META_BITS, 0, LEAST)) for _ in y.T]
    evidence = [[np.zeros(view.size) for view in views] for views in pairs]
    for turn in range(rounds):
        for column, views, told in zip(y.T, pairs, evidence):
            for view, (rows, dense), e in zip(views, data, told):
                view.fit(pick(rows, own), dense[own], column[own], e)
        if turn < rounds - 1:
            evidence = exchange([[(view.w, view.d) for view in views] for views in pairs])
    for column, views in zip(y.T, pairs):
        prior = (column.sum() + 1) / (n + 2)
        model = {"prior": math.log(prior / (1 - prior))}
        for name, view, (rows, dense) in zip(("text", "meta"), views, data):
            model[name] = view.w, view.d, *calibration(view.logits(pick(rows, kept), dense[kept]), column[kept])
        models.append(model)
    return models


def log_odds(size: int, feature: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of each hash, from the rows of both labels that hold it; -1 stands for all rows. 0 with under LEAST rows of a label in all."""
    out, every = np.zeros(size), feature < 0
    n_bad, n_good = bad[every].sum(), good[every].sum()
    if min(n_bad, n_good) >= LEAST:
        out[feature[~every]] = np.log((bad[~every] + 1) / (n_bad + 2)) - np.log((good[~every] + 1) / (n_good + 2))
    return out


# ---- Spark ---------------------------------------------------------------------------------------------------------
def _views(batches):
    for b in slices(batches):
        t = [text_view(x) for x in b.column("text").to_pylist()]
        m = [meta_view(*x).tobytes() for x in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("n_chars").to_pylist())]
        seen = [pa.array([x.tobytes() for x, _ in t], pa.binary()), pa.array([d for _, d in t], pa.list_(pa.float64())), pa.array(m, pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *seen], [*b.schema.names[:2], "text", "rates", "meta"])


def _opinions(shared):
    """Sums of a task's rows: view told (fault * 2 + view), feature (-1: all rows), bad, good."""

    def run(batches):
        models, sizes = shared.value, (1 << TEXT_BITS, 1 << META_BITS)
        sums = [np.zeros((2, size + 1), dtype=np.int64) for _ in models for size in sizes]
        for b in batches:
            held = []
            for name in ("text", "meta"):
                rows = [np.frombuffer(x, np.int32) for x in b.column(b.schema.get_field_index(name)).to_pylist()]
                held.append((np.concatenate([np.zeros(0, np.int32), *rows]), np.repeat(np.arange(b.num_rows), [len(x) for x in rows])))
            rates = np.array(b.column(b.schema.get_field_index("rates")).to_pylist()).reshape(b.num_rows, DENSE)
            for f, views in enumerate(models):
                for v, ((w, d), (flat, row), dense) in enumerate(zip(views, held, (rates, rates[:, :0]))):
                    z = np.bincount(row, weights=w[flat], minlength=b.num_rows) + d[0] + dense @ d[1:]
                    p, (flat, row), into = 1 / (1 + np.exp(-np.clip(z, -30, 30))), held[1 - v], sums[2 * f + 1 - v]
                    for label, sure in enumerate((p >= SURE_BAD, p <= SURE_GOOD)):
                        into[label, :-1] += np.bincount(flat[sure[row]], minlength=sizes[1 - v])
                        into[label, -1] += sure.sum()
        for told, (bad, good) in enumerate(sums):
            at = np.flatnonzero(bad + good)
            feature = np.where(at == len(bad) - 1, -1, at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), told, np.int32)), pa.array(feature), pa.array(bad[at]), pa.array(good[at])], ["told", "feature", "bad", "good"])

    return run


def _exchange(pool: DataFrame):
    """Each view's evidence by the other view's confident opinions of all rows of `pool`."""

    def run(models: list) -> list:
        sent = pool.sparkSession.sparkContext.broadcast(models)
        sums = pool.select("text", "rates", "meta").mapInArrow(_opinions(sent), "told int, feature int, bad long, good long")
        sums = sums.groupBy("told", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        got = sums.filter((F.col("feature") < 0) | (F.col("bad") + F.col("good") >= LEAST)).toArrow()
        told, *columns = (got.column(c).to_numpy() for c in ("told", "feature", "bad", "good"))
        sent.unpersist()
        return [[log_odds(len(w), *(c[told == 2 * f + v] for c in columns)) for v, (w, _) in enumerate(views)] for f, views in enumerate(models)]

    return run


def _columns(docs: DataFrame) -> list:
    have = set(docs.columns)
    as_type = {"text": "binary", "lang": "string", "source": "string", "n_chars": "long"}
    return [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in as_type.items()]


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, rounds: int = 3) -> list[dict]:
    """Models for FAULTS from about `most` labelled rows and all other rows of docs, which count as unlabelled.

    Labels of one doc_id that contradict one another count as the fault; null labels count as none. Without labels, or
    with fewer than five of a kind, a fault has its prior everywhere. Unlabelled doc_ids may repeat or be null.
    """
    bad = F.array(F.max((F.col("quality") == 0).cast("double")), F.max((F.col("toxic") == 1).cast("double")))
    given = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(bad.alias("y")).withColumnRenamed("doc_id", "id")
    part = min(1 << 30, int((1 << 30) * most / max(1, given.count())))
    lot = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(1 << 30)) < part
    same = F.col("doc_id") == F.col("id")
    rows = docs.select("doc_id", *_columns(docs))
    rows = rows.select("doc_id", F.xxhash64(*rows.columns, F.lit(6)).alias("order"), *rows.columns[1:])
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, order long, text binary, rates array<double>, meta binary"
    chosen = F.broadcast(given.filter(lot("id")))  # about `most` labels
    some = rows.filter(lot("doc_id")).join(chosen, same, "left_semi").mapInArrow(_views, kind)
    got = some.orderBy("order").limit(2 * most).join(chosen, same).drop("doc_id", "id").collect()
    got.sort(key=lambda r: (r.order, r.text, r.meta))
    if not got:
        zero = (np.zeros(1 << TEXT_BITS), np.zeros(DENSE + 1), 1.0, 0.0), (np.zeros(1 << META_BITS), np.zeros(1), 1.0, 0.0)
        return [{"prior": -10.0, "text": (zero[0][0], zero[0][1] - 10.0 * (np.arange(DENSE + 1) == 0), 1.0, 0.0), "meta": (zero[1][0], zero[1][1] - 10.0, 1.0, 0.0)} for _ in FAULTS]
    text, meta = [np.frombuffer(r.text, np.int32) for r in got], [np.frombuffer(r.meta, np.int32) for r in got]
    work = Tables(docs.sparkSession, "cotraining")
    pool = work.write(rows.join(chosen, same, "left_anti").mapInArrow(_views, kind).drop("doc_id", "order"), "pool")
    models = cotrain(text, np.array([r.rates for r in got]).reshape(len(got), DENSE), meta, np.array([r.y for r in got]), _exchange(pool), rounds)
    work.close()
    return models


def _scorer(shared, columns: int):
    def run(batches):
        models = shared.value
        for b in slices(batches):
            t = [text_view(x) for x in b.column(columns).to_pylist()]
            m = [meta_view(*x) for x in zip(*(b.column(columns + i).to_pylist() for i in (1, 2, 3)))]
            rates, out = np.array([d for _, d in t]), []
            for model in models:
                w, d, a, c = model["text"]
                z = a * (np.array([w[x].sum() for x, _ in t]) + d[0] + rates @ d[1:]) + c
                w, d, a, c = model["meta"]
                z = z + a * (np.array([w[x].sum() for x in m]) + d[0]) + c - model["prior"]
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*b.columns[:columns], *map(pa.array, out)], [*b.schema.names[:columns], *(f"p_{f}" for f in FAULTS)])

    return run


def classified(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **kw) -> DataFrame:
    """docs with p_low_quality, p_toxic, quality (the chance of neither) and kept (both below `limit`).

    Columns of docs by these names are replaced. Missing metadata columns, nulls in any column and empty texts are
    values like others. Repeated rows get equal scores. No rows give no rows. All words of a text count, however long it is.
    """
    own = docs.drop("p_low_quality", "p_toxic", "quality", "kept")
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **kw))
    ask = own.select(*own.columns, *[c.alias(f"__{i}") for i, c in enumerate(_columns(own))])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields] + [f"p_{f} double" for f in FAULTS])
    out = ask.mapInArrow(_scorer(sent, len(own.columns)), schema)
    return out.withColumns({"quality": (1 - F.col("p_low_quality")) * (1 - F.col("p_toxic")), "kept": F.greatest("p_low_quality", "p_toxic") < limit})
