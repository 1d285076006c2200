"""Operators over one global order that never bring all rows to one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession, tag: str) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave and that nothing will read again, as those of a round once the next one's are there. Others are left alone."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path:
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df with ``_part``: contiguous ranges of the order, written so that later passes see the same ones."""
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def running_totals(df: DataFrame, sums: dict[str, str], *order: str) -> DataFrame:
    """df with, for each name in sums, the sum of that column over all rows that come earlier in the order.

    Sums within ranges by a window, plus the totals of earlier ranges (one row per
    partition).
    """
    parts = ranged(df, *order)
    totals = parts.groupBy("_part").agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(f"_base{i}") for i, v in enumerate(sums.values())]).toPandas().sort_values("_part")  # a row per partition
    bases = [f"_base{i}" for i in range(len(sums))]
    totals[bases] = totals[bases].cumsum() - totals[bases]
    base = df.sparkSession.createDataFrame(totals.astype({"_part": "int32"}), ", ".join(["_part int", *(f"{b} long" for b in bases)]))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumns({f"_own{i}": F.coalesce(F.sum(v).over(own), F.lit(0)) for i, v in enumerate(sums.values())})
    named = {name: (F.col(f"_base{i}") + F.col(f"_own{i}")).cast("long") for i, name in enumerate(sums)}
    return inside.join(F.broadcast(base), "_part").withColumns(named).drop("_part", *bases, *[f"_own{i}" for i in range(len(sums))])


def running_total(df: DataFrame, value: str, *order: str, name: str = "before") -> DataFrame:
    """df with the sum of value over all rows that come earlier in the order."""
    return running_totals(df, {name: value}, *order)


def _by_part(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    held: list[pd.DataFrame] = []
    for b in batches:
        for part, own in b.groupby("_part", sort=False):
            if held and held[0]["_part"].iloc[0] != part:
                yield int(held[0]["_part"].iloc[0]), pd.concat(held, ignore_index=True)
                held = []
            held.append(own)
    if held:
        yield int(held[0]["_part"].iloc[0]), pd.concat(held, ignore_index=True)


def greedy_bundles(df: DataFrame, size: str, limit: int, *order: str) -> DataFrame:
    """df with bundle: a row opens a new one if the open one holds something and would exceed the limit with it.

    What a range of rows does to the open bundle is a step function of that bundle's size
    on entry. Ranges give their steps (those within the first ``limit`` of size, one for each different size), the
    driver follows one path through them, and the ranges then number their rows.
    """
    parts = ranged(df.withColumn("_size", F.col(size).cast("long")), *order)
    dealt = parts.repartition("_part").sortWithinPartitions("_part", *order)

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, b in _by_part(batches):
            cum = np.concatenate([[0], np.cumsum(b["_size"].to_numpy(np.int64))])
            n = len(b)
            after = np.maximum(np.searchsorted(cum, cum[:-1] + limit, "right") - 1, np.arange(1, n + 1))
            after += (after < n) & (cum[np.minimum(after, n)] == cum[:-1])  # a row joins a bundle that holds nothing yet
            left, begun = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
            for i in range(n - 1, -1, -1):
                left[i], begun[i] = (cum[n] - cum[i], 1) if after[i] >= n else (left[after[i]], begun[after[i]] + 1)
            last = min(n, int(np.searchsorted(cum, limit, "right")))
            # of rows without a size only the first can open a bundle, so a range has at most limit steps
            at = np.flatnonzero(np.append(True, np.diff(cum[1 : last + 1]) > 0)) if last else np.empty(0, np.int64)
            yield pd.DataFrame({"_part": part, "above": limit - cum[at + 1], "left": left[at], "begun": begun[at], "total": cum[n]})

    held, number, entry = 0, 0, {}
    found = dealt.select("_part", "_size", *order).mapInPandas(steps, "_part int, above long, left long, begun long, total long").toPandas()
    for part, f in found.groupby("_part"):
        entry[int(part)] = held, number
        opens = f[f["above"] < held]  # in row order: the first row that no longer fits
        if held == 0:
            held, number = int(f["left"].iloc[0]), number + int(f["begun"].iloc[0]) - 1
        elif len(opens):
            held, number = int(opens["left"].iloc[0]), number + int(opens["begun"].iloc[0])
        else:
            held += int(f["total"].iloc[0])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, b in _by_part(batches):
            held, number = entry[part]
            out = np.empty(len(b), np.int64)
            for i, s in enumerate(b["_size"].tolist()):
                if held and held + s > limit:
                    number, held = number + 1, 0
                held += s
                out[i] = number
            yield b.assign(bundle=out).drop(columns=["_part", "_size"])

    return dealt.mapInPandas(assign, df.withColumn("bundle", F.lit(0).cast("long")).schema)
