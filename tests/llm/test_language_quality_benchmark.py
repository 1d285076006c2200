import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, langid, quality, queries


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("true"))
    found = queries.op3_language_id(spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert len(found) > 20 and sum(r["lang_pred"] == r["true"] for r in found) / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_edge_rows(spark, edge_documents, no_documents):
    model = langid.fit(edge_documents, F.lit(True))
    found = {r["doc_id"]: r for r in langid.identify(edge_documents, model).collect()}
    assert {i for i, r in found.items() if r["lang_pred"] == "und"} == {1, 2, 7, 9}
    assert found[8]["lang_pred"] == "en" and set(found[3].asDict()) >= {"key", "score"}
    nothing = langid.fit(no_documents, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(edge_documents, nothing).collect()} == {"und"}
    assert langid.identify(no_documents, model).count() == 0


def test_unseen_words_fall_back_to_shorter_grams(spark):
    rows = [(1, "das ist nicht gut geschrieben", "de"), (2, "this is not well written", "en")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.predict("geschrieben")[0] == model.predict("beschreiben")[0] == "de"
    assert model.predict("written")[0] == model.predict("writt")[0] == "en"


def test_quality_of_held_out_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("true"))
    found = queries.op7_subword_quality(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["true"] for r in found) / len(found) > 0.8


def test_quality_of_edge_rows(spark, edge_documents, no_documents):
    labelled = edge_documents.withColumn("label", F.when(F.col("doc_id") < 9, (F.col("doc_id") % 2).cast("int")))
    model = quality.fit(labelled, buckets=1 << 10, epochs=2)
    found = quality.score(edge_documents, model).collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in found if r["doc_id"] in (1, 2, 7)} == {model.prior}
    assert quality.fit(no_documents.withColumn("label", F.lit(1))).score("text") == 0.5
    assert quality.score(no_documents, model).count() == 0


def test_overlaps_with_substitutions(spark):
    item = [f"w{i}" for i in range(30)]
    changed = item.copy()
    for i in (3, 11, 19, 27):
        changed[i] = "other"
    cases = {1: ["x"] * 9 + item + ["y"] * 9, 2: ["x"] * 50 + changed, 3: item[:15] + ["z"] * 20, 4: item[:11] + ["z"] * 20, 5: [f"v{i}" for i in range(60)], 6: ["tiny", "one"], 7: item[::2]}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in cases.items()] + [(8, None), (9, "")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Tiny, one!"), (3, None), (4, "")], "item_id long, text string")
    for block in (20_000, 1):
        found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(docs, bench, block_items=block).collect()}
        assert set(found) == {(1, 1), (2, 1), (3, 1), (6, 2)}
        best = found[2, 1]  # of runs with equal worth the one found first
        assert best["matched"] - 3 * (best["overlap"] - best["matched"]) == 15 and 50 <= best["doc_start"] <= 54
    assert decontaminate.overlaps(docs, bench.filter("item_id < 0")).count() == 0
    assert decontaminate.overlaps(docs.filter("doc_id < 0"), bench).count() == 0


def test_planted_benchmark_passages(spark, sf):
    found = {r["doc_id"] for r in queries.op8_spaced_seeds(spark, sf).collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holding = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"] and any(t in r["text"] for t in items)}
    assert holding and holding <= found


@pytest.mark.parametrize("n", range(12, 21))
def test_every_place_of_one_substitution(n):
    item = [f"w{i}" for i in range(n)]
    index = decontaminate.Index([(1, " ".join(item))], 13, 0.75)
    need = 13 if n > 13 else -(-3 * n // 4)
    for at in range(n):
        changed = ["x"] * 5 + item[:at] + ["other"] + item[at + 1 :] + ["y"] * 5
        found = index.look_up(" ".join(changed))
        assert len(found) == 1 and found[0][0] == 1 and found[0][1] >= need, at
    assert not index.look_up(" ".join(item[: need - 1]))


@pytest.mark.parametrize("share", [0.5, 0.75, 0.8, 0.9])
def test_longest_runs_by_brute_force(share):
    draw = random.Random(7)
    for n in [0, 1, 2, *[draw.randrange(3, 24) for _ in range(300)]]:
        equal = np.array([draw.random() < 0.75 for _ in range(n)], bool)
        runs = [(j - i, int(equal[i:j].sum())) for i in range(n) for j in range(i + 1, n + 1) if equal[i:j].sum() >= share * (j - i) - 1e-9]
        start, length, matched = decontaminate.longest_run(equal, share)
        assert matched == max((m for _, m in runs), default=0) == equal[start : start + length].sum() and matched >= share * length - 1e-9
