"""Sharding by vector bin packing.

Groups of equal texts are placed into shards so that bytes, tokens and rows are
balanced together: a group goes to the bin where the dot product of its vector
with the bin's residual capacity is highest.

The packing has two levels, so that no step holds all groups. Groups are hashed
to cells; each cell streams its groups, largest first, into one bin per shard.
Then the bins of all cells (at most ``most_cells`` times the shards) are placed into the
shards by the same rule. A group beyond a set part of a shard in any resource is
split by a hash of doc_id first, so copies of one text can't outgrow a shard; those that share a doc_id as well are
dealt in turn. So the layout of the input has no say, but for which of such repeated rows goes where.

A null text counts as no bytes and falls into the group of empty texts. Repeated
rows are rows of their own. Of bins with the same dot product the first is taken; slots of equal rows are
interchangeable. A very long text is one item: where it outweighs a shard, that shard holds it and little else.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

RESOURCES = ("bytes", "tokens", "rows")


def place_all(vectors: np.ndarray, weights: tuple[float, ...], bins: int) -> np.ndarray:
    """Greedy placement in the given order; vectors are in units of a bin's capacity."""
    residual = np.ones((bins, vectors.shape[1])) * weights
    out = np.empty(len(vectors), np.int32)
    for i, v in enumerate(vectors):
        out[i] = at = int((residual @ v).argmax())
        residual[at] -= v * weights
    return out


def shard(docs: DataFrame, shards: int = 40, split_at: float = 0.5, most_cells: int = 4096, groups_per_cell: int = 1000, overhead: int = 16, weights: tuple[float, float, float] = (32.0, 1.0, 1.0)) -> DataFrame:
    """Every row with its shard and a gapless slot there.

    Returns doc_id, size, text_crc32, shard, slot. split_at: the part of a shard
    that a group may fill before it is split. weights: of bytes, tokens and rows in the
    dot product.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = common.plain(docs, "doc_id", "text").select(
        "doc_id",
        F.md5(text.cast("binary")).alias("key"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_tokens"),
    )
    # rows are numbered as written, so that rows which share a doc_id can part
    rows = common.materialise(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    sums = (F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = rows.groupBy("key").agg(*sums)
    total = groups.agg(*[F.sum(r).alias(r) for r in RESOURCES], F.count(F.lit(1)).alias("n")).first()
    per_shard = {r: max(1, total[r] or 0) / shards for r in RESOURCES}
    limit = {r: per_shard[r] * split_at for r in RESOURCES}
    # at most shards / split_at groups exceed each limit: that bounds what is broadcast
    parts = F.greatest(*[F.ceil(F.col(r) / F.lit(limit[r])) for r in RESOURCES])
    heavy = groups.filter(" or ".join(f"{r} > {limit[r]}" for r in RESOURCES)).select("key", parts.cast("int").alias("parts"))
    light = rows.join(F.broadcast(heavy), "key", "left_anti").withColumn("part", F.lit(0))
    # rows of one key and doc_id are numbered within the chunks that wrote them, on top of the rows of earlier chunks
    split = rows.join(F.broadcast(heavy), "key").withColumn("chunk", F.shiftright("row", 33))
    earlier = Window.partitionBy("key", "doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = split.groupBy("key", "doc_id", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(earlier)).filter("base > 0")
    base = base.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), F.col("chunk").alias("_chunk"), "base")
    within = split.withColumn("nth", F.row_number().over(Window.partitionBy("key", "doc_id", "chunk").orderBy("row")) - 1)
    told = within.join(base, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("chunk") == F.col("_chunk")), "left")
    turn = F.pmod(F.xxhash64("doc_id"), F.col("parts")) + F.col("nth") + F.coalesce("base", F.lit(0))
    items = light.unionByName(told.withColumn("part", F.pmod(turn, F.col("parts")).cast("int")).select(*rows.columns, "part"))
    cells = max(1, min(most_cells, (total["n"] or 0) // groups_per_cell))
    each = [per_shard[r] / cells for r in RESOURCES]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, residual = None, None
        for b in batches:
            vectors = b[list(RESOURCES)].to_numpy(float) / each
            bins = np.empty(len(b), np.int32)
            for i, (c, v) in enumerate(zip(b["cell"].to_numpy(), vectors, strict=True)):
                if c != cell:
                    cell, residual = c, np.ones((shards, len(RESOURCES))) * weights
                bins[i] = at = int((residual @ v).argmax())
                residual[at] -= v * weights
            yield b.assign(bin=bins)

    vectors = items.groupBy("key", "part").agg(*sums).withColumn("cell", F.pmod(F.xxhash64("key", "part"), F.lit(cells)).cast("int"))
    order = [F.col("cell"), F.col("bytes").desc(), F.col("rows").desc(), F.col("key"), F.col("part")]
    packed = vectors.repartition(cells, "cell").sortWithinPartitions(*order)
    packed = common.materialise(packed.mapInPandas(pack, "key string, part int, bytes long, tokens long, rows long, cell int, bin int"), "shard-bins")

    bins = packed.groupBy("cell", "bin").agg(*[F.sum(r).alias(r) for r in RESOURCES]).toPandas()  # at most most_cells * shards rows
    unit = np.array([per_shard[r] for r in RESOURCES])
    bins = bins.sort_values(["cell", "bytes", "bin"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
    at = place_all(bins[list(RESOURCES)].to_numpy(float) / unit, weights, shards) if len(bins) else np.empty(0, np.int32)
    bins["shard"] = at.astype(np.int32)
    bins["first"] = bins.groupby("shard")["rows"].cumsum() - bins["rows"] if len(bins) else pd.Series(dtype="int64")
    where = spark.createDataFrame(bins[["cell", "bin", "shard", "first"]].astype({"cell": "int32", "bin": "int32", "shard": "int32", "first": "int64"}), "cell int, bin int, shard int, first long")

    nth = F.row_number().over(Window.partitionBy("cell", "bin").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    out = items.join(packed.select("key", "part", "cell", "bin"), ["key", "part"]).withColumn("nth", nth)
    return out.join(F.broadcast(where), ["cell", "bin"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))
