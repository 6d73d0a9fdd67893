"""The pipeline stage by stage against brute force, on rows with nulls, repeated ids and extra columns."""

from __future__ import annotations

import pytest

pytest.importorskip("loomline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_operators import DOCS, groups


def test_stages(spark, tmp_path):
    shared = [(i, t, "en", None) for i, t in DOCS] + [(None, DOCS[4][1], None, 3), (4, DOCS[4][1], "en", None)]
    docs = spark.createDataFrame(shared, "doc_id long, text string, lang string, n_chars long")
    spark.createDataFrame([(1, " ".join(DOCS[4][1].split()[:40]))], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["quality rules"](spark, docs, str(tmp_path)).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {4, 5, 6, 16, None} <= ids and not ids & {0, 1, 2, 3, 15}
    lines = stages["line dedup"](spark, kept, str(tmp_path)).cache()
    assert lines.count() == kept.count() and all(r.n_chars == len(r.text) for r in lines.collect())
    near = stages["n-gram Jaccard join"](spark, kept, str(tmp_path)).cache()
    rows = [(r.doc_id, r.text) for r in kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    _, of = groups(rows)
    assert {r.doc_id for r in near.collect()} == {i for i, c in of.items() if i == c}
    assert near.filter("doc_id = 4").count() == 1
    clean = stages["benchmark decontamination"](spark, near, str(tmp_path)).cache()
    assert 4 not in {r.doc_id for r in clean.collect()} and 16 in {r.doc_id for r in clean.collect()}
    last = stages["BPE encoding and decoding"](spark, clean, str(tmp_path))
    assert {r.doc_id: r.text for r in last.collect()} == {r.doc_id: r.text for r in clean.collect()}


def test_near_duplicates_without_id_and_with_an_id_of_two_groups(spark, tmp_path):
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = lambda t: t + " tail"
    rows = [(None, one, 0), (None, near(one), 1), (None, None, 2), (None, two, 3), (5, near(two), 4), (4, two, 5), (4, three, 6), (4, near(three), 7), (3, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)
    kept = sorted(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect(), key=lambda r: r.row)
    assert docs.columns == list(kept[0].asDict())
    assert [r.row in (0, 1) for r in kept] == [True, False, False, False, False]
    assert [r.row for r in kept[1:3]] == [2, 5] and kept[3].row in (6, 7) and kept[4].row == 8
    assert all(tuple(r) == rows[r.row] for r in kept)


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    spark.createDataFrame([], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
