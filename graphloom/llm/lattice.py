"""Language-model scores from a subword lattice over an existing vocabulary.

The model is a unigram distribution over the pieces of a given vocabulary, single bytes, and an end. A text's
probability is the sum over all ways to spell it with pieces, times the end's. A word carries the blank before it
as its first byte and no piece has a blank elsewhere, so the lattice of a text falls apart into those of its words, and
the text's probability is the product of the words', each from a forward recursion in logarithms.

The vocabulary is never changed. Its scores start from the ranks that the file gives and are fitted to the training
texts by rounds of expectation-maximisation over all distinct training words: Spark shares out the words, tasks run
forward and backward and sum expected counts by piece, and the driver gets one number for each piece.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .encoding import slices

LN10 = float(np.log(10.0))
#: Words of one length that are worked on at once; fewer of more than 16 bytes.
TOGETHER = 20_000
#: A longer word (in bytes) is known by its digest in tables that go to all tasks.
LONG = 64
#: A longer string (in bytes) is worked on by itself in blocks of so many places, with constant memory.
WHOLE, BLOCK = 512, 1 << 15


# ---- the lattice ---------------------------------------------------------------------------------------------------
def _multiples(n: int) -> np.ndarray:
    return np.uint64(0x9E3779B97F4A7C15) * (np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


class Lattice:
    """Pieces as bytes with logarithms of probabilities; the 256 bytes come first, so any string can be spelled."""

    BASE, BITS = np.uint64(0x100000001B3), 20

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.asarray(logp, dtype=np.float64)
        self.longest = max(map(len, pieces))
        self.lengths = sorted({len(p) for p in pieces})
        h = np.zeros(len(pieces), dtype=np.uint64)
        for i, p in enumerate(pieces):
            x = 0
            for c in p:
                x = (x * int(self.BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
            h[i] = x
        if len(np.unique(h)) != len(h):
            raise ValueError("pieces are not distinct")
        self.hash = np.append(h, np.uint64(0))
        for self.by in zip(_multiples(64)[::2], _multiples(64)[1::2]):  # two tables; what collides in the first is alone in the second
            one, two = (np.full(1 << self.BITS, len(pieces), dtype=np.int32) for _ in range(2))
            at = self._at(h, self.by[0])
            one[at] = np.arange(len(h))
            rest = np.flatnonzero(one[at] != np.arange(len(h)))
            at2 = self._at(h[rest], self.by[1])
            two[at2] = rest
            if len(np.unique(at2)) == len(at2):
                break
        else:
            raise ValueError("no tables found")
        self.one, self.two = one, two

    def _at(self, h: np.ndarray, by: np.uint64) -> np.ndarray:
        return ((h * by) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; len(pieces) where there is none."""
        a = self.one[self._at(h, self.by[0])]
        miss = np.flatnonzero(self.hash[a] != h)
        b = self.two[self._at(h[miss], self.by[1])]
        a[miss] = np.where(self.hash[b] == h[miss], b, len(self.pieces))
        return a

    def _edges(self, m: np.ndarray, every: bool = False) -> dict:
        """Of equally long strings (a row of bytes each): (from, to) -> number of the piece there. every: of one string, length -> numbers by place."""
        n, size = m.shape
        codes, edges = m.astype(np.uint64) + np.uint64(1), {}
        h = np.zeros((n, size), dtype=np.uint64)
        for length in range(1, min(self.longest, size) + 1):
            h = h[:, : size - length + 1] * self.BASE + codes[:, length - 1 :]
            if length in self.lengths:
                found = self.find(h.ravel()).reshape(h.shape)
                if every:
                    edges[length] = found[0]
                    continue
                for i in np.flatnonzero((found < len(self.pieces)).any(axis=0)):
                    edges[int(i), int(i) + length] = found[:, i]
        return edges

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        t = np.stack(terms)
        top = t.max(axis=0)
        return top + np.log(np.exp(t - top).sum(axis=0))

    def _forward(self, size: int, edges: dict, logp: np.ndarray, n: int) -> list[np.ndarray]:
        alpha = [np.zeros(n)]
        for j in range(1, size + 1):
            alpha.append(self._sum([alpha[i] + logp[edges[i, j]] for i in range(max(0, j - self.longest), j) if (i, j) in edges]))
        return alpha

    def _ends(self, word: bytes, at: int) -> list[list[tuple[int, int]]]:
        """For each of the places at + 1, ..., at + BLOCK of a string: (length, number) of the pieces that end there."""
        low, high = max(0, at - self.longest + 1), min(len(word), at + BLOCK)
        edges = self._edges(np.frombuffer(word[low:high], dtype=np.uint8).reshape(1, -1), every=True)
        out: list[list[tuple[int, int]]] = [[] for _ in range(high - at)]
        for length, found in edges.items():
            for i in np.flatnonzero(found < len(self.pieces)).tolist():
                j = low + i + length
                if j > at:
                    out[j - at - 1].append((length, int(found[i])))
        return out

    def _extend(self, window: list[float], ends: list[list[tuple[int, int]]], logp: list[float]) -> list[float]:
        """Logarithms of forward sums up to the last of `ends`; window: those of the places before, the last one right before."""
        alpha = window[:]
        for edges in ends:
            if len(edges) == 1:
                alpha.append(alpha[-edges[0][0]] + logp[edges[0][1]])
            else:
                t = [alpha[-length] + logp[piece] for length, piece in edges]
                top = max(t)
                alpha.append(top + math.log(sum([math.exp(x - top) for x in t])))
        return alpha

    def _long_score(self, word: bytes, logp: list[float]) -> float:
        alpha = [0.0]
        for at in range(0, len(word), BLOCK):
            alpha = self._extend(alpha[-self.longest :], self._ends(word, at), logp)
        return alpha[-1]

    def _long_expected(self, word: bytes, count: float, logp: list[float], total: np.ndarray) -> None:
        """Adds what a long string's pieces are expected to count: a pass on that keeps the sums before each block, and a pass back that makes each block's sums again."""
        windows, alpha = [], [0.0]
        for at in range(0, len(word), BLOCK):
            windows.append(alpha[-self.longest :])
            alpha = self._extend(windows[-1], self._ends(word, at), logp)
        whole, ahead = alpha[-1], {len(word): 0.0}  # ahead: logarithms of backward sums
        for at in range((len(word) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            window, ends = windows.pop(), self._ends(word, at)
            alpha = self._extend(window, ends, logp)
            first = at - len(window) + 1  # the place of alpha[0]
            for j in range(at + len(ends), at, -1):
                b = ahead.pop(j)
                for length, piece in ends[j - at - 1]:
                    i, x = j - length, logp[piece] + b
                    total[piece] += count * math.exp(alpha[i - first] + x - whole)
                    had = ahead.get(i)
                    ahead[i] = x if had is None else max(x, had) + math.log1p(math.exp(-abs(x - had)))

    def _groups(self, words: list[bytes]):
        """(places, matrix of bytes) of strings of one length, but for the long ones."""
        sizes = np.array([len(w) if len(w) <= WHOLE else -1 for w in words])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] >= 0]
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            step = max(1, TOGETHER * 16 // max(16, int(sizes[part[0]])))
            for at in range(0, len(part), step):
                some = part[at : at + step]
                yield some, np.frombuffer(b"".join([words[i] for i in some]), dtype=np.uint8).reshape(len(some), -1)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each string's probability, over all its spellings."""
        out, logp = np.zeros(len(words)), np.append(self.logp, -np.inf)
        for some, m in self._groups(words):
            out[some] = self._forward(m.shape[1], self._edges(m), logp, len(some))[-1]
        for i in [i for i, w in enumerate(words) if len(w) > WHOLE]:
            out[i] = self._long_score(words[i], self.logp.tolist())
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected among all spellings of the words, which occur so often."""
        total, logp = np.zeros(len(self.pieces) + 1), np.append(self.logp, -np.inf)
        for some, m in self._groups(words):
            size, edges, n = m.shape[1], self._edges(m), counts[some]
            alpha = self._forward(size, edges, logp, len(some))
            beta = [None] * size + [np.zeros(len(some))]
            for i in range(size - 1, -1, -1):
                beta[i] = self._sum([beta[j] + logp[edges[i, j]] for j in range(i + 1, min(size, i + self.longest) + 1) if (i, j) in edges])
            for (i, j), piece in edges.items():
                total += np.bincount(piece, weights=n * np.exp(alpha[i] + logp[piece] + beta[j] - alpha[size]), minlength=len(total))
        for i in [i for i, w in enumerate(words) if len(w) > WHOLE]:
            self._long_expected(words[i], float(counts[i]), self.logp.tolist(), total)
        return total[:-1]


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary's pieces as bytes (a blank for the mark of a word's start) after the 256 bytes, and first scores.

    The file ranks pieces by merge order; the first scores follow Zipf's law in that rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n, rank = model.get_piece_size(), {}
    for i in range(n):
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and len(piece) > 1 and b" " not in piece[1:]:
            rank.setdefault(piece, -model.get_score(i))
    pieces = [bytes([b]) for b in range(256)] + sorted(rank, key=lambda p: (rank[p], p))
    p = 1.0 / (np.arange(len(pieces)) + 3.0)
    return pieces, np.log(p / p.sum())


# ---- fitting -------------------------------------------------------------------------------------------------------
def _words(x: bytes | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know A-Z and ASCII white space only, which is what words are made by."""
    return (x or b"").lower().split()


def _count_words(batches):
    c: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    for b in slices(batches):
        for x in b.column(0).to_pylist():
            c.update(_words(x))
        if len(c) > 200_000:
            yield out()
            c.clear()
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes), n of all texts."""
    return texts.select(F.col("text").cast("binary")).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=2)
def _lattice(shared) -> Lattice:
    return Lattice(*shared.value[:2])


def _expect(shared):
    def run(batches):
        total = None
        for b in batches:
            lattice = _lattice(shared)
            got = lattice.expected([b" " + w for w in b.column(0).to_pylist()], b.column(1).to_numpy())
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

    return run


def fit(counts: DataFrame, n_docs: int, pieces: list[bytes], logp: np.ndarray, rounds: int = 2, smooth: float = 0.1) -> tuple[np.ndarray, float]:
    """(logarithms of the pieces' probabilities, of the end's), from all training words. Without words: the first scores."""
    sc = counts.sparkSession.sparkContext
    logp, end = np.append(logp, 0.0), 0.0
    logp -= np.log(np.exp(logp).sum())
    for _ in range(rounds):
        sent = sc.broadcast((pieces, logp[:-1]))
        got = counts.mapInArrow(_expect(sent), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece
        n = np.full(len(pieces) + 1, smooth)
        n[[r.piece for r in got]] += [r.n for r in got]
        n[-1] += n_docs
        logp = np.log(n / n.sum())
    return logp[:-1], float(logp[-1])


# ---- scoring -------------------------------------------------------------------------------------------------------
def _head(counts: DataFrame, size: int) -> list:
    """The most frequent words, at most `size` of them: those from a count on that this many reach. Of a long word its digest."""
    few = counts.select(F.when(F.length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5("word")))).alias("word"), "n").withColumn("band", F.floor(F.log2("n") * 8))
    bands = few.groupBy("band").agg(F.count("*").alias("words"))
    least = bands.withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("band")))).filter(F.col("upto") <= size).agg(F.min("band")).first()[0]
    return [] if least is None else few.filter(F.col("band") >= least).select("word", "n").collect()


def _short(word: bytes) -> bytes:
    """What stands for a word in the head; no word has a blank."""
    return word if len(word) <= LONG else b" " + md5(word).digest()


_memo: dict[int, dict[bytes, tuple]] = {}


def _score(shared, head, end: float, with_tail: bool, limit: int = 300_000):
    def run(batches):
        lattice, known, row = _lattice(shared), head.value, TaskContext.get().partitionId() << 33
        if shared.value[2] not in _memo:  # kept from task to task, for one model; full once the frequent words are in
            _memo.clear()
        memo = _memo.setdefault(shared.value[2], {})
        for b in slices(batches, 1024):
            docs = [Counter(_words(x)) for x in b.column(2).to_pylist()]
            new = list({w for c in docs for w in c if w not in memo})
            counts = [known.get(_short(w)) for w in new]
            # of a word: logarithm of its probability, log10 of its count in the head and one (None: not in the head)
            found = dict(zip(new, zip(lattice.log_probability([b" " + w for w in new]).tolist(), (None if n is None else math.log10(n + 1.0) for n in counts))))
            if len(memo) < limit:
                memo.update(x for x in found.items() if len(x[0]) <= LONG)
            n, hit, base, score, flat, ends = [], [], [], [], [], [0]
            for c in docs:
                total, of_head, log10, logp, rare = sum(c.values()), 0, 0.0, end, []
                for w, k in c.items():
                    p, share = memo.get(w) or found[w]
                    logp += k * p
                    if share is None:
                        rare.append((w, k))
                    else:
                        of_head += k
                        log10 += k * share
                n.append(total), hit.append(of_head), base.append(log10), score.append(logp / LN10)
                if with_tail:
                    flat += rare
                ends.append(len(flat))
            pairs = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([k for _, k in flat], pa.int64())], ["w", "k"])
            row += len(n)
            yield pa.RecordBatch.from_arrays([pa.array(range(row - len(n), row), pa.int64()), b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["row", "doc_id", "held_out", "words", "hit", "base", "score", "tail"])

    return run


def lattice_scores(docs: DataFrame, vocabulary: str, folds: int = 7, held: int = 2, rounds: int = 2, head: int = 1 << 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Learns from the rows whose crc32(doc_id as text) mod `folds` is not `held` (a null doc_id is learned from). A null
    or empty text is its end alone. base_score is that of words with add-one smoothing; score the log10 of the lattice's
    probability. With no training rows, counts are 0 and pieces keep their first scores. Repeated rows are rows of
    their own. Texts are scored whole; a text without white space is one word, however long, and takes memory for a few of its bytes'
    places at a time and time in proportion to its length.

    Counts of the `head` most frequent words go to all tasks (at most 2^17 words or digests of at most 64 bytes); rarer
    words, short or long, are joined to their counts by Spark, and as they are rare none of them is hot.
    """
    spark = docs.sparkSession
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    rows = docs.select("doc_id", out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    counts = written(word_counts(rows.filter(~out)), "words")
    n_docs = rows.filter(~out).count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pieces, first = read_pieces(vocabulary)
    logp, end = fit(counts, n_docs, pieces, first, rounds)
    frequent = _head(counts, head)
    tail = len(frequent) < distinct
    sent, known = spark.sparkContext.broadcast((pieces, logp, uuid.uuid4().int)), spark.sparkContext.broadcast({bytes(r.word): r.n for r in frequent})
    schema = "row long, doc_id long, held_out boolean, words long, hit long, base double, score double, tail array<struct<w: binary, k: bigint>>"
    scored = written(rows.mapInArrow(_score(sent, known, end, tail), schema), "scores")
    if tail:
        more = scored.select("row", F.inline("tail")).join(counts.select(F.col("word").alias("w"), "n"), "w")
        more = more.groupBy("row").agg(F.sum("k").alias("more_hit"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more"))
        scored = scored.drop("tail").join(more, "row", "left")
    else:
        scored = scored.withColumns({"more_hit": F.lit(0), "more": F.lit(0.0)})
    total, kinds = n_words + n_docs, distinct + (n_docs > 0)
    end_log = float(np.log10(n_docs + 1.0))
    n_tokens = F.col("words") + 1
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + end_log - n_tokens * float(np.log10(total + kinds + 1.0))
    known_n = F.col("hit") + F.coalesce("more_hit", F.lit(0)) + (1 if n_docs else 0)
    return scored.select("doc_id", "held_out", n_tokens.alias("n_tokens"), known_n.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
