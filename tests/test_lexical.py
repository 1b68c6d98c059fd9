"""Cover density over the positional index against plain Python, with skipped blocks, phrases and leading texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import lexical

TERMS = ["red", "green", "blue"]


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def density(w: list[str], terms: list[str]) -> float:
    """The sum over stretches that hold all terms and no shorter such stretch."""
    at = [(i, x) for i, x in enumerate(w) if x in terms]
    covers = [(a, b) for a in range(len(at)) for b in range(a, len(at)) if {x for _, x in at[a : b + 1]} == set(terms)]
    shortest = [(a, b) for a, b in covers if not any((c, d) != (a, b) and a <= c and d <= b for c, d in covers)]
    return sum(0.1 / (1 + at[b][0] - at[a][0] - (b - a)) for a, b in shortest)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    rows = []
    for doc in range(150):
        for seq in range(r.randrange(1, 4)):
            text = " ".join(r.choice(["red", "green", "blue", "x", "y", "z", "Red,", "w"]) if doc % 3 else r.choice("xyzw") for _ in range(r.randrange(25)))
            rows.append((f"{doc}:{seq}", doc, seq, text))
    rows.append(("500:0", 500, 0, "red green blue " * 20))
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, seq long, content string")
    postings = lexical.postings(chunks, 16).cache()
    return rows, chunks, lexical.Index(postings, lexical.bounds(postings).cache())


def expected(texts: dict, terms: list[str], k: int, relaxed: bool = True) -> list:
    strict = sorted(((-round(density(words(t), terms), 6), i) for i, t in texts.items() if set(terms) <= set(words(t))))[:k]
    out = [(i, -s) for s, i in strict]
    if relaxed and len(out) < k and len(terms) > 1:
        n = {i: sum(w in terms for w in words(t)) for i, t in texts.items() if i not in {i for i, _ in out} and not set(terms) <= set(words(t))}
        out += [(i, round(0.05 * c, 6)) for c, i in sorted((-c, i) for i, c in n.items() if c)[: k - len(out)] for c in [-c]]
    return out


@pytest.mark.parametrize("terms, k", [(TERMS, 10), (TERMS, 400), (["red", "green"], 25), (["blue"], 15), (["red", "nowhere"], 12)])
@pytest.mark.parametrize("id_col", ["chunk_id", "doc_id"])
def test_rank_equals_plain_python(corpus, terms, k, id_col):
    rows, _, index = corpus
    texts: dict = {}
    for chunk, doc, _, t in rows:
        key = chunk if id_col == "chunk_id" else doc
        texts[key] = f"{texts[key]} {t}" if key in texts else t
    got = index.search(terms, k, id_col)
    hits = [(x["id"], pytest.approx(x["score"], abs=2e-6)) for x in got.hits.orderBy("place").collect()]
    assert [(i, s) for i, s in expected(texts, terms, k)] == hits


def test_blocks_are_skipped(corpus):
    _, _, index = corpus
    found = index.search(TERMS, 1, first=1)
    assert [x["id"] for x in found.hits.collect()] == ["500:0"]
    assert found.blocks > 4 and found.read == 1


def test_phrases(corpus):
    rows, _, index = corpus
    want = {c for c, _, _, t in rows if "red green" in " ".join(words(t))}
    got = {x["id"] for x in index.search([], 1000, phrases=[["red", "green"]]).hits.collect()}
    assert got == want and want
    assert index.search(["blue"], 1000, phrases=[["red", "green"]]).hits.count() == len({c for c, _, _, t in rows if "red green" in " ".join(words(t)) and "blue" in words(t)})


def test_texts_that_hold_the_query_lead(corpus):
    rows, chunks, index = corpus
    lead = chunks.filter(F.contains(F.lower("content"), F.lit("red, y"))).select(F.col("chunk_id").alias("id"))
    front = sorted(c for c, _, _, t in rows if "red, y" in t.lower())
    got = [x["id"] for x in index.search(TERMS, 30, lead=lead).hits.orderBy("place").collect()]
    assert front and set(got[: len(front)]) == set(front) and len(got) == 30


def test_an_index_of_some_terms_holds_what_that_of_all_does(spark, corpus):
    _, chunks, _ = corpus
    terms = ["the", "licence", "nowhere", chunks.first().content.split()[0].lower()]
    got, want = (sorted(map(str, df.select("term", "block", "chunk_id", "doc_id", "base", "n", "places").collect())) for df in (lexical.postings_of(chunks, 16, terms), lexical.postings(chunks, 16).filter(F.col("term").isin(terms))))
    assert got == want and got


def test_a_query_indexes_its_own_terms_only(spark, tmp_path):
    from graphloom.plans import QUERIES, model

    texts = ["the license, version 2 of the tool", "other words\nthe version and a license", "nothing of these", None]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.place, r.id) for r in QUERIES["lexical_search"](spark, str(tmp_path)).orderBy("place").collect()]
    assert found == [(1, "0:0"), (2, "1:1")]
    index = model.term_index(spark, str(tmp_path), ["the", "license", "version"])
    assert {r.term for r in index.rows.select("term").distinct().collect()} == {"the", "license", "version"}
    whole = model.term_index(spark, str(tmp_path))
    assert model.term_index(spark, str(tmp_path), ["the"]).rows.count() == whole.rows.count() > index.rows.count()
