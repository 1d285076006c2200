import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import packing, queries, sharding, topk


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_ids_equal_the_tokenizers(tokenizer):
    fast = packing.FastIds(queries.tokenizer_path())
    texts = ["Hello, World! it's 42", "été Où ªµ²½ ñ", "ΟΔΟΣ İstanbul ﬁ 東京 é", "a<|endoftext|>b c", "x\x1cy\x85z w", "", "don't'll ''s", "tab\tnew\nline wide"]
    for text in texts:
        assert np.frombuffer(fast(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, capacity):
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= capacity for e in ends.values())
    return len(ends)


def test_packing_is_gapless_and_close_to_the_bound(spark, sf, tokenizer):
    rows = queries.op9_best_fit_packing(spark, sf).collect()
    n = check_packing(rows, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 2
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        own = by_doc[doc["doc_id"]]
        assert [r["start"] for r in own] == list(range(0, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def test_packing_takes_edge_rows(spark, edge_documents, no_documents):
    path = queries.tokenizer_path()
    rows = packing.pack(edge_documents, path, capacity=64).collect()
    check_packing(rows, 64)
    assert {r["doc_id"] for r in rows} == set(range(1, 11)) and sum(r["doc_id"] == 9 for r in rows) == 2
    assert next(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert packing.pack(no_documents, path).count() == 0


def test_plan_keeps_every_constraint():
    draw = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(draw.integers(1, 101, 40), draw.integers(1, 60, 40), strict=True)}
    p = packing.plan(counts, 100, most_docs=4, most_cost=6000, weights=(1, 0.5, 0.5)) if max(counts) ** 2 <= 6000 else packing.plan(counts, 100, 4, 10_000, (1, 0.5, 0.5))
    most_cost = 6000 if max(counts) ** 2 <= 6000 else 10_000
    bins, seen = {}, dict.fromkeys(counts, 0)
    for length, rank, first, each, base in zip(*p.values(), strict=True):
        nxt = min([r for le, r in zip(p["length"], p["rank"], strict=True) if le == length and r > rank], default=counts[length])
        for i in range(nxt - rank):
            bins.setdefault(first + i // each, []).append((base + i % each * length, length))
            seen[length] += 1
    assert seen == counts
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == list(np.cumsum([0, *[n for _, n in items]])[:-1])
        assert sum(n for _, n in items) <= 100 and len(items) <= 4 and sum(int(n) ** 2 for _, n in items) <= most_cost


def test_shards_are_even_and_slots_gapless(spark, sf):
    rows = queries.op2_vector_shards(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert sorted(rows["doc_id"]) == sorted(docs["doc_id"])
    want = {d: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    assert all(want[r.doc_id] == (r.size, r.text_crc32) for r in rows.itertuples())
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_sharding_takes_edge_rows_and_splits_hot_groups(spark, edge_documents, no_documents):
    rows = sharding.shard(edge_documents, shards=3).collect()
    assert len(rows) == 11 and all(0 <= r["shard"] < 3 for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {16}
    assert sharding.shard(no_documents).count() == 0
    hot = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    sizes = sharding.shard(hot, shards=6).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert len(sizes) == 6 and max(r["b"] for r in sizes) < 1.1 * min(r["b"] for r in sizes)
    few = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 30).cast("string").alias("text"))
    assert sharding.shard(few, shards=2).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0


def test_shards_do_not_depend_on_the_layout(spark):
    text = F.when(F.col("id") < 200, "the same text").otherwise(F.concat(F.lit("text "), F.col("id")))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), text.alias("text"))
    docs = docs.unionByName(spark.range(40).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))).unionByName(spark.range(60).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text")))
    one = {r["doc_id"]: r["shard"] for r in sharding.shard(docs.coalesce(1), shards=6).collect()}
    other = sharding.shard(docs.repartition(7, F.xxhash64("text", "doc_id", F.lit(3))), shards=6).collect()
    assert len(other) == 600 and len({r["shard"] for r in other if r["doc_id"] is None}) > 1
    for s in range(6):
        assert sorted(r["slot"] for r in other if r["shard"] == s) == list(range(sum(r["shard"] == s for r in other)))
    alone = [r for r in other if r["doc_id"] not in (7, None)]
    assert sum(one[r["doc_id"]] != r["shard"] for r in alone) == 0


def brute_top(vectors, k, asks):
    ok = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in ok:
        if asks(q):
            found = sorted(((-int(ok[q] @ ok[c]), c) for c in ok if c != q))[:k]
            out[q] = [(c, -s) for s, c in found]
    return out


def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.round(draw.normal(size=8), 1)]) for i in range(700)]
    vectors[5] = (5, None)
    vectors[6] = (6, [None] * 8)
    vectors[7] = (7, [float("nan")] * 8)
    vectors[8] = (8, [float("inf")] * 8)
    vectors[30] = (30, vectors[20][1])
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    found = {}
    for r in sorted(topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, shard_rows=100, query_rows=16, sample_rows=40).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == brute_top([(i, None if v is None else np.array(v, np.float32).astype(object).tolist()) for i, v in vectors], 5, lambda q: q % 10 == 0)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (1, [3.0])], "vec_id long, embedding array<float>")
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0, k=5).collect())
    assert rows == [(0, 1, 1, 768 * 256), (0, 2, 1, 768 * 256)]
    assert topk.top_k(df.filter("vec_id < 0"), F.col("vec_id") == 0).count() == 0
