"""Stages of the pipeline against brute force, and on odd rows, clashing columns and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute, families
from test_llm_operators import repeats

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("kept", "QUALITY", "size", "target", "badness", "cutoff", "stratum", "p", "whole", "cut", "level", "need", "copies", "s", "x", "n", "first", "class", "p_toxic", "rank")
LONG = "a very long text of words " * 9000
ODD = [(901, None, "en", "a", 3), (902, "", None, None, None), (903, "same row", "en", "a", 8), (903, "same row", "en", "a", 8), (None, "no id at all", "de", "b", 12), (None, None, None, None, None), (904, LONG, "en", "a", len(LONG))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels: every third document is good, one in 30 toxic."""
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    labels = [(i, 1, int(i % 30 == 0)) for i in range(0, 300, 3)] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en" if i % 2 else "de", "abc"[i % 3], len(t)) for i, t in families(11, 10, 12)] + ODD


def test_near_duplicates_stage(spark, folder, rows):
    got = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    want = {least for i, n, least in brute([r[:2] for r in rows]) if n and least is not None}
    assert {r.doc_id for r in got if r.text and r.doc_id is not None} == want
    assert sum(1 for r in got if r.text and r.doc_id is not None) == len(want)
    assert Counter(r.doc_id for r in got if not r.text) == Counter([901, 902, None])
    assert sum(r.text == "no id at all" for r in got) == 1


def test_quality_rules_stage(spark, folder, rows):
    """The few labels certify no cutoff, so the base rules decide."""
    noisy = [(700 + i, "w " * 15 + "again and again it goes on " * 6, "en", "a", 9) for i in range(3)] + [(710, " ".join(f"u{k}" for k in range(19)), "en", "a", 9)]
    got = P.quality_rules(spark, spark.createDataFrame(rows + noisy, SCHEMA), folder).collect()
    keeps = lambda t: (w := (t or "").encode().split()) and len(w) >= 20 and 100 * repeats(w) <= 30 * len(w)
    assert Counter(map(tuple, got)) == Counter(r for r in rows + noisy if keeps(r[1]))


def test_classifier_stage_keeps_clean_documents(spark, folder, rows):
    some = [(i, t + (" vile nasty slur" if i % 30 == 0 else ""), *x) if i is not None and t else (i, t, *x) for i, t, *x in rows]
    got = Counter(r.doc_id for r in P.quality_classifier(spark, spark.createDataFrame(some, SCHEMA), folder).collect())
    clean = [i for i, t, *_ in some if t and "slur" not in t]
    assert sum(got[i] > 0 for i in clean) >= 0.95 * len(clean)


def test_mix_stage_takes_documents_zero_to_two_times(spark, folder, rows):
    got = Counter(tuple(r) for r in P.source_mix(spark, spark.createDataFrame(rows, SCHEMA), folder).collect())
    there = Counter(rows)
    assert set(got) <= set(there) and all(n <= 2 * there[r] for r, n in got.items())
    assert not [r for r in got if not (r[1] or "").split()]


def test_packing_stage(spark, folder, rows):
    got = P.packed_sequences(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = [0]
        for at, n in sorted(parts):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 2048


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_clashing_columns_and_empty_tables(spark, folder, rows, name, stage):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASH})
    plain, more = (stage(spark, d, folder) for d in (spark.createDataFrame(rows, SCHEMA), docs))
    assert Counter(map(tuple, plain.collect())) == Counter(tuple(r)[: len(plain.columns)] for r in more.collect())
    if name != "packing":
        assert more.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in more.collect() for c in CLASH)
    assert stage(spark, docs.limit(0), folder).collect() == []


def test_stages_are_the_ones_that_run_applies():
    assert [name for name, _ in P.STAGES] == ["quality rules", "quality classifier", "near duplicates", "source mix", "packing"]
