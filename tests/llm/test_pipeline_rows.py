"""The pipeline's stages take every kind of row."""

import corpus_pipeline
from helixframe.llm import common


def test_stages_take_odd_rows_and_empty_tables(spark, sf, edge_documents, no_documents):
    left = {}
    docs = edge_documents
    for name, work in corpus_pipeline.STAGES:
        docs = common.materialise(work(spark, docs, sf), f"odd-{name}")
        left[name] = sorted({r["doc_id"] for r in docs.collect()})
    assert not {1, 2, 7, 9} & set(left["language_id"])  # no text or no letter
    assert 4 not in left["jaccard_join"] and 3 in left["jaccard_join"]  # a copy goes, the smaller id stays
    assert left["best_fit_packing"] == left["benchmark_decontamination"]
    docs = no_documents
    for name, work in corpus_pipeline.STAGES:
        docs = common.materialise(work(spark, docs, sf), f"none-{name}")
        assert docs.count() == 0


def test_rows_that_share_an_id_share_their_fate(spark, sf):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, words + " more", "en", "a", 1), (2, "another text of its own entirely", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    assert [r["doc_id"] for r in kept] == [1, 1]


def test_a_run_leaves_only_its_result(spark, sf):
    before = set(common.MADE)
    packed = corpus_pipeline.run(spark, sf)
    assert len(set(common.MADE) - before) == 1
    assert packed.count() > 100 and packed.agg({"length": "max"}).first()[0] <= 2048
