"""Each operator on odd rows, and against brute force where it has one."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import cotraining, fixity, lattice, packing, risk_rules, sharding, token_index, topk
from graphloom.llm.common import Tables

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"
LONG = "long words repeat " * 8000
ROWS = [
    (1, None, "en", "a", 3, "x", "y"), (2, "", None, None, None, None, None), (3, "Some text here.\nSome text here.", "en", "a", 3, "x", "y"), (3, "Some text here.\nSome text here.", "en", "a", 3, "x", "y"),
    (None, "tabs\tand blanks \n\n  é ß 中文", "de", "b", 9, "x", "y"), (5, LONG, "en", "a", len(LONG), "x", "y"), (6, "<|endoftext|> it's 12,5% | a|b", "fr", "c", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded(path: str, text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


# ---- 1
def spelled(lattice_, word: bytes) -> float:
    """Sum over all spellings, by recursion without tables."""
    p = dict(zip(lattice_.pieces, np.exp(lattice_.logp)))
    if not word:
        return 1.0
    return sum(p[word[:k]] * spelled(lattice_, word[k:]) for k in range(1, len(word) + 1) if word[:k] in p)


def test_lattice_sums_all_spellings():
    pieces, logp = lattice.read_pieces(PIECES)
    model = lattice.Lattice(pieces, logp)
    words = [b" the", b" nation", "ré".encode(), b" ", b" xq9", b" " + b"e" * 9]
    assert np.allclose(model.log_probability(words), [math.log(spelled(model, w)) for w in words])
    assert np.exp(logp).sum() == pytest.approx(1.0)
    counts = model.expected([b" the", b" nation"], np.array([3, 2]))
    assert sum(n * len(p) for n, p in zip(counts, pieces)) == pytest.approx(3 * 4 + 2 * 7)


def test_lattice_of_long_words_in_blocks(monkeypatch):
    pieces, logp = lattice.read_pieces(PIECES)
    model = lattice.Lattice(pieces, logp)
    words, counts = [b" " + b"thenationofwords" * 9, b" " + bytes(range(97, 123)) * 6, b"\xe4\xb8\xad" * 40], np.array([2, 1, 3])
    whole, expected = model.log_probability(words), model.expected(words, counts)
    monkeypatch.setattr(lattice, "WHOLE", 16)
    monkeypatch.setattr(lattice, "BLOCK", 37)
    assert np.allclose(model.log_probability(words), whole, rtol=1e-12)
    assert np.allclose(model.expected(words, counts), expected, atol=1e-9)


def test_lattice_of_one_unbroken_megabyte():
    pieces, logp = lattice.read_pieces(PIECES)
    model, word = lattice.Lattice(pieces, logp), b" " + b"unbroken" * (1 << 17)
    (score,) = model.log_probability([word])
    counts = model.expected([word], np.array([1]))
    assert math.isfinite(score) and sum(n * len(p) for n, p in zip(counts, pieces)) == pytest.approx(len(word), rel=1e-5)


def test_lattice_of_long_words_keeps_little(monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 1024)
    pieces, logp = lattice.read_pieces(PIECES)
    model, most = lattice.Lattice(pieces, logp), []
    for size in (1 << 13, 1 << 15):
        tracemalloc.start()
        model.expected([b"x" * size], np.array([1]))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 1.3 * most[0]


def test_lattice_scores(spark, docs, none):
    got = lattice.lattice_scores(docs, PIECES, head=2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [((t or "").encode().lower().split() + ["end"], held(i)) for i, t, *_ in ROWS]
    c = Counter(w for x, h in words if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((len(x), sum(c[w] > 0 for w in x), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for x, _ in words)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
    model = fitted(words)
    scores = Counter(round(r.score, 5) for r in got)
    assert scores == Counter(round((sum(model["word"](w) for w in x[:-1]) + model["end"]) / math.log(10), 5) for x, _ in words)
    assert lattice.lattice_scores(none, PIECES).collect() == []


def fitted(words) -> dict:
    """Two rounds of expectation-maximisation over all spellings by plain recursion, from the file's first scores."""
    pieces, logp = lattice.read_pieces(PIECES)
    p = dict(zip(pieces, np.exp(np.append(logp, 0.0) - np.log(np.exp(logp).sum() + 1))))
    counts, docs = Counter(w for x, h in words if not h for w in x[:-1]), sum(not h for _, h in words)

    def forward(w):
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * p.get(w[i:j], 0.0) for i in range(max(0, j - 40), j))
        return a

    for _ in range(2):
        n = dict.fromkeys(p, 0.1)
        for w, k in counts.items():
            w = b" " + w
            a, b = forward(w), [0.0] * len(w) + [1.0]
            for i in range(len(w) - 1, -1, -1):
                b[i] = sum(b[j] * p.get(w[i:j], 0.0) for j in range(i + 1, min(len(w), i + 40) + 1))
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + 40) + 1):
                    if w[i:j] in p:
                        n[w[i:j]] += k * a[i] * p[w[i:j]] * b[j] / a[-1]
        total = sum(n.values()) + docs + 0.1
        p, end = {x: v / total for x, v in n.items()}, math.log((docs + 0.1) / total)
    return {"word": lambda w: math.log(forward(b" " + w)[-1]), "end": end}


# ---- 4
def test_shards_are_even_and_copies_together(spark, docs, none):
    rows = [(i, f"text {i % 40 if i < 120 else i}", "en", "a", 1, "x", "y") for i in range(400)] + ROWS
    got = sharding.sharded(spark.createDataFrame(rows, SCHEMA), shards=7).collect()
    assert len(got) == len(rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(7)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    groups = {}
    for r in got:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    copies = [zlib.crc32(f"text {k}".encode()) for k in range(40)]
    assert sum(len(groups[c]) == 1 for c in copies) >= 36
    sizes = Counter((r.doc_id, r.size) for r in got)  # ids repeat
    assert sizes == Counter((i, len((t or "").encode()) + 16) for i, t, *_ in rows)
    assert sharding.sharded(none).collect() == []


def test_propagation_cuts_few_links_and_keeps_to_quotas(spark):
    """Groups of 2 to 30 and one of a third of all, dealt out at random: against the links that any placing has to cut."""
    r = np.random.default_rng(7)
    groups = [f"g{i}" for i in range(120) for _ in range(2 + i % 29)] + ["large"] * 900
    cells = Counter((g, int(s)) for g, s in zip(groups, r.integers(0, 6, len(groups))))
    quotas = [len(groups) // 6 + 40] * 6
    state = spark.createDataFrame([(g, s, n) for (g, s), n in cells.items()], "g string, s int, n long")
    before, work = sharding.cut_links(state), Tables(spark, "test")
    total, most = Counter(), Counter()
    for (g, _), n in cells.items():
        total[g], most[g] = total[g] + n, max(most[g], n)
    assert before == sum(total[g] - most[g] for g in total)
    after, loads, cuts = sharding.propagate(state, quotas, work)
    assert cuts[0] == before and cuts[-1] == sharding.cut_links(after)
    assert {x.g: x["sum(n)"] for x in after.groupBy("g").sum("n").collect()} == dict(total)
    assert sum(loads) == len(groups) and all(n <= q * 1.1 for n, q in zip(loads, quotas))
    needed = total["large"] - max(quotas)
    assert needed <= cuts[-1] <= 0.45 * before


def test_reruns_from_shuffled_rows_agree(spark):
    rows = [(i, f"text {i % 50 if i < 200 else i} " * (i % 7), "en", "a", 1, "x", "y") for i in range(500)] + ROWS
    one = spark.createDataFrame(rows, SCHEMA).repartition(3)
    two = spark.createDataFrame(rows[::-1], SCHEMA).repartition(7, "n_chars", "text")
    for run in (lambda d: sharding.sharded(d, shards=7), lambda d: packing.pack(d, WORDS, size=64)):
        a, b = (sorted((tuple(x) for x in run(d).collect()), key=repr) for d in (one, two))
        assert a == b


# ---- 5
def test_packing_covers_every_token(docs, none):
    got = packing.pack(docs, WORDS, size=64).collect()
    want = sorted(zlib.crc32(np.array(ids[at : at + 64], dtype="<u4").tobytes()) for _, t, *_ in ROWS for ids in [encoded(WORDS, t) + [0]] for at in range(0, len(ids), 64))
    assert sorted(r.ids_crc32 for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, WORDS).collect() == []


def test_plan_uses_every_piece_and_few_sequences():
    r = np.random.default_rng(3)
    for lengths in (r.integers(1, 257, 5000), r.integers(1, 40, 900), np.full(77, 129), np.array([256, 255, 1])):
        h = np.bincount(lengths, minlength=257)
        runs = packing.plan_runs(h)
        used = np.zeros(257, dtype=int)
        for n, content in runs:
            assert sum(content) <= 256
            for x in content:
                used[x] += n
        assert (used == h).all()
        assert sum(n for n, _ in runs) <= max(-(-int((h * np.arange(257)).sum()) // 256) * 1.02 + 1, (lengths > 128).sum())


def test_plan_of_a_flat_histogram_is_near_the_least():
    h = np.concatenate([[0], np.random.default_rng(0).integers(0, 60, size=2048)])
    runs = packing.plan_runs(h)
    assert (sum(np.bincount(c, minlength=2049) * n for n, c in runs) == h).all()
    assert sum(n for n, _ in runs) <= 1.006 * (h * np.arange(2049)).sum() / 2048


def test_all_patterns_are_tried():
    rows = packing.patterns(np.arange(1, 65), 64)
    want = {(64, 0, 0)} | {(64 - b, b, 0) for b in range(1, 33)} | {(64 - b - c, b, c) for c in range(1, 22) for b in range(c, 32) if 64 - b - c >= b}
    assert len(rows) == len(want) and set(map(tuple, rows.tolist())) == want


# ---- 6
def test_token_index_round_trip(spark, docs, none):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in token_index.token_index_round_trip(docs, BYTES, 2).collect()))
    want = sorted((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for i, t, *_ in ROWS for ids in [encoded(BYTES, t) + [2]])
    assert got == want
    assert token_index.token_index_round_trip(none, BYTES, 2).collect() == []
    folder, shards, slots = token_index.write_index(docs, BYTES, 2)
    strange = spark.createDataFrame([(12345,), (5,)], "doc_id long")
    assert [r.doc_id for r in token_index.read_keys(strange, folder, shards, slots).collect()] == [5]


def test_token_index_with_empty_slots(spark, monkeypatch):
    monkeypatch.setattr(token_index, "KEYS_A_SLOT", 1)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(12)] + [(None, "none"), (3, "again")], "doc_id long, text string")
    folder, shards, slots = token_index.write_index(rows, BYTES, 2)
    assert slots.count() < 13 == slots.first().of
    got = [r.doc_id for r in token_index.read_keys(rows, folder, shards, slots).collect()]
    assert sorted(got, key=str) == sorted([*range(12), None, 3], key=str)


def test_token_index_with_a_repeated_key(spark):
    """A third of the rows has one id and a third none: their documents lie in several shards."""
    rows = [(i if i % 3 == 0 else 7 if i % 3 == 1 else None, f"text {i} " * (i % 5)) for i in range(600)]
    got = token_index.token_index_round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), BYTES, 2).collect()
    sizes = [(i, len(encoded(BYTES, t)) + 1) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(sizes, key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_perfect_hash_is_minimal_and_reads_little():
    r = np.random.default_rng(0)
    h1, h2 = (r.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    levels, number = token_index.build_mph(h1, h2)
    assert sorted(number) == list(range(5000))
    entries, runs = np.zeros(5000, dtype=token_index.ENTRY), np.zeros(5000, dtype=token_index.RUN)
    entries["run"], entries["runs"], entries["print"], runs["first"] = np.arange(5000), 1, np.arange(5000), np.arange(5000) * 7
    data, asked = token_index.pack_index(levels, entries, runs), []

    def read_at(size, at):
        asked.append(size)
        return data[at : at + size]

    assert (token_index.SlotIndex(read_at, whole=True).number(h1, h2) == number).all()
    for k in (0, 17, 4999):
        asked.clear()
        at, found = token_index.SlotIndex(read_at).lookup(h1[k : k + 1], h2[k : k + 1], number[k : k + 1])
        assert at.tolist() == [0] and found["first"].tolist() == [7 * number[k]]
        assert sum(asked) <= 32 + (8 + token_index.BLOCK) * len(levels) + 64
        assert not len(token_index.SlotIndex(read_at).lookup(h1[k : k + 1], h2[k : k + 1], number[k : k + 1] + 1)[0])


# ---- 7
def repeats(words: list[str], width: int = 8) -> int:
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(width)})


def test_measures(spark, docs):
    texts = [t for _, t, *_ in ROWS] + ["a b c d e f g h i " * 3, "x " * 30, "a\na\n\n \nb | % $"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in risk_rules.with_measures(rows).collect():
        b = (r.text or "").encode().split()
        words = [w.decode() for w in b]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeats(words)


def test_risk_is_controlled(spark, none):
    clean = " ".join(f"w{k}" for k in range(30))
    noise = "".join(f" %%%{k}" for k in range(25))
    rows = [(i, clean + (noise if i % 5 == 0 else ""), "en", "a", 1, "x", "y") for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(800)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = risk_rules.judged(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert all(r.kept == (r.doc_id % 5 > 0) for r in got) and got[0].size == "x"
    few = labels.filter("doc_id < 50")
    assert all(r.kept for r in risk_rules.judged(spark.createDataFrame(rows, SCHEMA), few).collect())
    assert risk_rules.judged(none, labels).collect() == []
    import pyspark.sql.functions as F

    p = spark.range(1).select(risk_rules.binomial_p(F.lit(40).cast("long"), F.lit(1).cast("long"), 0.1)).first()[0]
    assert p == pytest.approx(0.9**40 + 40 * 0.1 * 0.9**39)


# ---- 8
def test_cotraining_finds_toxic_and_keeps_clean(spark, docs, none):
    r = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(1600):
        words = [f"w{x}" for x in r.integers(0, 400, 40)]
        toxic = i % 8 == 0
        if toxic:
            words[3:5] = ["vile", "nasty"]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 200, "x", "y"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = cotraining.classified(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert np.mean([not g.kept for g in got if g.doc_id % 8 == 0]) > 0.9
    assert np.mean([g.kept for g in got if g.doc_id % 8]) > 0.98
    assert len(cotraining.classified(docs, labels).collect()) == len(ROWS)
    assert all(g.kept for g in cotraining.classified(docs, labels.limit(0)).collect())
    assert cotraining.classified(none, labels).collect() == []


def test_cotraining_exchanges_labels_over_all_documents(spark):
    """Words of 20 unlabelled documents alone, which only the source tells to be toxic, with a labelled sample of 800."""
    r = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(9000):
        words = [f"w{x}" for x in r.integers(0, 400, 40)]
        toxic = i % 10 == 0
        if toxic:
            words[3:5] = ["foul", "gross"] if i >= 3000 and i % 300 == 0 else ["vile", "nasty"]
        rows.append((i, " ".join(words), "en", "bad" if toxic else f"s{i % 4}", 200, "x", "y"))
        if i < 3000:
            labels.append((i, 1, int(toxic)))
    rows += [(None, "null ids are unlabelled", "en", "s1", 200, "x", "y")] * 3
    documents = spark.createDataFrame(rows, SCHEMA)
    model = cotraining.train(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most=800)[1]
    at = lambda word: zlib.crc32(word) & ((1 << cotraining.TEXT_BITS) - 1)
    assert min(model["text"][0][at(b"foul")], model["text"][0][at(b"gross")]) > 0.3
    assert model["text"][0][at(b"foul")] > 5 * abs(np.mean([model["text"][0][at(f"w{k}".encode())] for k in range(400)]))


def test_cotraining_sums_confident_rows(spark):
    """Against a count by hand, over more rows than a labelled sample has and in many partitions."""
    import pyspark.sql.functions as F

    rows = spark.range(0, 20_000, 1, 16).select(F.col("id").alias("doc_id"), F.lit(0).alias("order"), F.when(F.col("id") % 10 == 0, "only bad").otherwise("only fine").cast("binary").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("source"), F.lit(9).alias("n_chars"))
    pool = rows.mapInArrow(cotraining._views, "doc_id long, order int, text binary, rates array<double>, meta binary")
    w = np.zeros(1 << cotraining.META_BITS)
    w[cotraining.meta_view("en", "x", 9)[1]], w[cotraining.meta_view("en", "y", 9)[1]] = 9, -9
    mute = np.zeros(1 << cotraining.TEXT_BITS), np.zeros(cotraining.DENSE + 1)
    ((text, meta),) = cotraining._exchange(pool)([[mute, (w, np.zeros(1))]])
    at = lambda word: zlib.crc32(word) & ((1 << cotraining.TEXT_BITS) - 1)
    assert text[at(b"bad")] == pytest.approx(math.log(2001 / 2002) - math.log(1 / 18002))
    assert text[at(b"fine")] == pytest.approx(math.log(1 / 2002) - math.log(18001 / 18002))
    assert abs(text[at(b"only")]) < 0.001 and not meta.any()


# ---- 9
def test_audit_finds_every_fault(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 9)) for i in range(3000)] + [(None, None, None), (7, "http://h/7", "again"), (8, "u", "<b>" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = fixity.audit(pages, fault_every=40).collect()
    assert len(got) == len(rows)
    wrong = {(r.file, r.offset) for r in got if not r.intact}
    assert wrong == {(r.file, r.offset) for r in got if zlib.crc32(f"{r.file}|{r.offset}".encode()) % 40 == 0} and wrong
    assert all(r.intact for r in fixity.audit(pages).collect())
    assert fixity.audit(pages.limit(0)).collect() == []


@pytest.mark.parametrize("records", [20, 4096])
def test_audit_of_missing_short_longer_swapped_and_extra_files(spark, tmp_path, monkeypatch, records):
    monkeypatch.setattr(fixity, "RECORDS", records)
    pages = spark.createDataFrame([(i, "u", f"<p>{i:03d}</p>") for i in range(300)], "page_id long, url string, html string").repartition(6)
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    manifest = fixity.write_warc(pages, one)
    copies = fixity.replicate(manifest, one, two)
    assert all(r.fault is None for r in fixity.audit_replica(manifest, copies, two).collect())
    files = sorted(x for x in (tmp_path / "two").iterdir() if not x.name.startswith("."))
    names = {r.copy: r.file for r in copies.collect()}
    gone, short, longer, swapped = (names[x.name] for x in files[:4])
    rows = {f: sorted((r for r in manifest.collect() if r.file == f and not r.end), key=lambda r: r.seq) for f in names.values()}
    files[0].unlink()
    files[1].write_bytes(files[1].read_bytes()[:-10])
    files[2].write_bytes(files[2].read_bytes() + b"x" * 400)
    data = files[3].read_bytes()
    a, b = next((x, y) for x in rows[swapped] for y in rows[swapped] if x.length == y.length and x.seq < y.seq)
    cut = lambda r: data[r.offset : r.offset + r.length]
    files[3].write_bytes(data[: a.offset] + cut(b) + data[a.offset + a.length : b.offset] + cut(a) + data[b.offset + b.length :])
    (tmp_path / "two" / "stray.warc.gz").write_bytes(b"stray")
    got = fixity.audit_replica(manifest, copies, two).collect()
    bad = {(r.file, r.seq): r.fault for r in got if r.fault}
    want = {(gone, r.seq): "missing file" for r in rows[gone]} | {(gone, len(rows[gone])): "missing file"}
    want |= {(short, len(rows[short]) - 1): "short", (longer, len(rows[longer])): "trailing bytes", ("stray.warc.gz", None): "unlisted file"}
    want |= {(swapped, a.seq): "changed", (swapped, b.seq): "changed"}
    want.pop((gone, len(rows[gone])))
    assert bad == want
    assert sum(r.page_id is not None for r in got) == 300


def test_tree_is_that_made_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixity, "FANOUT", 3)
    monkeypatch.setattr(fixity, "RECORDS", 5)
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(40)], "page_id long, url string, html string").repartition(2)
    manifest = fixity.write_warc(pages, f"file://{tmp_path}/one")
    rows, by = manifest.collect(), {}
    for r in sorted(rows, key=lambda r: (r.file, r.seq)):
        by.setdefault(r.file, []).append(hashlib.sha256(f"{r.offset}|{r.length}|{r.sha256}".encode()).hexdigest())
    assert len(by) >= 8 and all(len(v) <= 6 for v in by.values())
    names, heights = sorted(by), (fixity._height(6), fixity._height(len(by)))
    files = spark.createDataFrame([(f, i) for i, f in enumerate(names)], "file string, number long")
    tree = fixity.Tree(manifest, files, heights, Tables(spark, "tree"), "t")
    full = lambda leaves, levels: leaves if not levels else full([hashlib.sha256("".join(leaves[i : i + 3]).encode()).hexdigest() for i in range(0, len(leaves), 3)], levels - 1)
    (root,) = full([full(by[f], heights[0])[0] for f in names], heights[1])
    assert [r.sha256 for r in tree.levels[-1].collect()] == [root]


# ---- 10
def test_top_k_against_all_scores(spark):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in np.round(r.normal(size=4), 1 if i % 3 else 3)]) for i in range(300)]
    vectors += [(300 + i, [0.5] * 4) for i in range(60)] + [(400, None), (450, [1.0, None, 1.0, 1.0]), (500, [float("nan")] * 4), (550, [1.0, 2.0]), (600, [1.5, 0.5]), (None, [0.5] * 4), (650, [float("inf")] * 4)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    good = [(i, np.floor(256 * np.array(v))) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in good:
        if q is not None and q % 50 == 0:
            s = sorted(((-int(x @ y), i is None, i or 0) for i, y in good if len(y) == len(x) and i != q))[:5]
            want += [(q, k + 1, None if none else i, -score) for k, (score, none, i) in enumerate(s)]
    key = lambda t: (t[0], t[1])
    for few in (64, 1):
        got = [tuple(x) for x in topk.histogram_top_k(df, few=few).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert topk.histogram_top_k(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [2.0**30, 3e10, 1e30, 1e200])
def test_top_k_of_large_components(spark, size):
    r = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in r.normal(size=5) * size]) for i in range(120)] + [(i, [size, -size, 1.0, 0.5, 2.0]) for i in range(120, 130)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    q = {i: [math.floor(256 * v) if abs(256 * v) < 2**53 else int(256 * v) for v in x] for i, x in vectors}
    want, most = [], 2**63 - 1
    for a in (0, 50, 100):
        s = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:5]
        want += [(a, k + 1, b, max(-most, min(most, -score))) for k, (score, b) in enumerate(s)]
    for few in (64, 1):
        assert sorted(tuple(x) for x in topk.histogram_top_k(df, few=few).collect()) == want
