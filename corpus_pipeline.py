"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it as Parquet
and reads it again as the next stage's docs. All but the last keep the columns of
documents. Tested against brute force; there is no SQL for the whole.

In every stage: null and empty texts go with the first stage, as they hold no letter; an empty table gives an
empty one; texts are read whole, however long; further columns are dropped. Rows that share a doc_id are one
document: what a stage decides for the id holds for all of its rows. Ties go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import common, decontaminate, jaccard, langid, packing, queries, repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays in doubt; equal texts share their fate."""
    common.arrow_rows(spark, 1000)
    model = langid.fit(docs, F.lit(True))
    known = langid.identify(docs.select(*COLUMNS), model)
    return known.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest doc_id stays; repeated rows of that id all stay."""
    common.give_back()  # what the driver held for the stage before
    found = jaccard.similar(docs, percent=75, words=5)
    others = common.looked_up(found.filter("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller doc_id has; a text of which nothing is left goes. Repeated rows of an id don't cut each other."""
    common.give_back()
    cut = repeats.remove_repeats(docs, threshold=50, with_text=True, characters=True, carry=("lang", "source", "n_chars"))
    left = cut.withColumn("text", F.decode("kept", "UTF-8")).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, substitutions allowed; without a benchmark all stay."""
    common.arrow_rows(spark, 250)  # a batch of very long texts takes memory twice in an executor that has run for long
    hits = decontaminate.overlaps(docs, queries.table(spark, sf_dir, "benchmark"))
    return docs.select(*COLUMNS).join(common.looked_up(hits.select("doc_id").distinct(), "contaminated"), "doc_id", "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; repeated rows are packed as often as they occur."""
    common.arrow_rows(spark, 250)  # a batch of very long texts takes memory twice in an executor that has run for long
    return packing.pack(docs, queries.tokenizer_path(), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents. Intermediate tables go once the stage that made them has been written."""
    before = set(common.MADE)  # of other operators, which may still be read
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_scratch(spark, before | {common.MADE[-1]})
    return docs
