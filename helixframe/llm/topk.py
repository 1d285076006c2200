"""Exact top-k search by inner product: a ball tree in every shard.

Each shard holds a ball tree over its vectors. A query walks the tree best bound
first: a node with centre c and radius r can score at most q.c + |q| r, and is
skipped when that is below the query's current kth score. Shards and blocks of queries are made
within coarse cells around a few rows. A first round, of every block against part of a shard of its own
cell, gives every query a kth score that all shards then start from; a shard is sent to a block only if the
ball around it can reach the kth score of one of the block's queries (while the list of balls is within
``ball_bytes``; beyond, to every block).

Queries are handled in blocks of a fixed size; a block and a shard meet in one
task. Vectors that are null, or hold null or non-finite components, take no part.
Vectors of different lengths are compared as if padded with zeros. A row that has
the query's own id is never its candidate; repeated ids are candidates of others
each on their own, and ask once, with the first of their vectors in the order of arrays. Fewer than k candidates give all of them. Extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes as arrays; leaves are runs of rows. Rows are split on the widest axis."""

    def __init__(self, points: np.ndarray, leaf: int = 256) -> None:
        self.order = np.arange(len(points))
        self.points, self.left, self.right, self.spans, centres, radii = points, [], [], [], [], []

        def build(lo: int, hi: int) -> int:
            own = points[self.order[lo:hi]]
            at = len(self.left)
            self.left.append(-1)
            self.right.append(-1)
            self.spans.append((lo, hi))
            centre = own.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            if hi - lo > leaf and radii[at] > 0:
                axis = int(np.ptp(own, axis=0).argmax())
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
                self.left[at] = build(lo, lo + mid)
                self.right[at] = build(lo + mid, hi)
            return at

        build(0, len(points))
        self.points = points[self.order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, query: np.ndarray, visit, floor: float) -> None:
        """visit(lo, hi, scores) returns the kth score so far; nodes below it are skipped."""
        bound = self.centres @ query + float(np.sqrt(query @ query)) * self.radii
        bound += 1e-9 * np.abs(bound) + 1e-6  # rounding never hides a tie
        heap = [(-bound[0], 0)]
        while heap:
            best, at = heapq.heappop(heap)
            if -best < floor:
                return
            if self.left[at] < 0:
                lo, hi = self.spans[at]
                floor = max(floor, visit(lo, hi, self.points[lo:hi] @ query))
            else:
                for child in (self.left[at], self.right[at]):
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))


def exact(points: np.ndarray, query: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Integer products; where doubles could round, from integers."""
    if len(sums) and float(np.abs(points).max(initial=0)) * float(np.abs(query).sum()) >= 2**52:
        return points.astype(np.int64) @ query.astype(np.int64)
    return sums.astype(np.int64)


def search_block(ids: np.ndarray, tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    ids = ids[tree.order]
    for query, own, floor in zip(queries, query_ids, floors, strict=True):
        best: list[tuple[int, int]] = []  # (score, -vec_id), the worst first

        def visit(lo: int, hi: int, sums: np.ndarray, q=query, own=own, best=best, floor=floor) -> float:
            scores = exact(tree.points[lo:hi], q, sums)
            least = max(floor, best[0][0] if len(best) == k else -np.inf)
            for j in np.flatnonzero((scores >= least) & (ids[lo:hi] != own)):
                item = (int(scores[j]), -int(ids[lo + j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            return max(floor, best[0][0] if len(best) == k else -np.inf)

        tree.search(query, visit, floor)
        for score, minus in best:
            yield int(own), -minus, score


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = 4096, query_rows: int = 512, sample_rows: int = 512, most_cells: int = 64, ball_bytes: int = 32 << 20, blocks_per_tree: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score for every row of vectors where is_query holds.

    Components x become floor(scale * x). Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.select("vec_id", "embedding", is_query.alias("asks")).filter(usable & F.col("vec_id").isNotNull()).select("vec_id", whole.alias("v"), "asks")
    rows = common.materialise(rows, "vectors")
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if("asks")).first()
    n, width, asked = int(size[0]), int(size[1] or 0), int(size[2])

    def matrix(lists: pd.Series) -> np.ndarray:
        out = np.zeros((len(lists), width))
        for i, x in enumerate(lists):
            out[i, : len(x)] = x
        return out

    def blob(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one number as one row with the ball around them; they arrive sorted by it."""
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                b = pd.concat(held)
                held.clear()
                m = matrix(b["v"])
                small = m.size == 0 or np.abs(m).max() < 2**30
                centre = m.mean(axis=0)
                radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1).max()))
                yield pd.DataFrame({"part": [b["part"].iloc[0]], "ids": [b["vec_id"].to_numpy("<i8").tobytes()], "data": [m.astype("<i4" if small else "<f8").tobytes()], "small": [bool(small)], "centre": [centre.tobytes()], "radius": [radius]})

        for b in batches:
            for part, own in b.groupby("part", sort=False):
                if held and held[-1]["part"].iloc[0] != part:
                    yield from flush()
                held.append(own)
        yield from flush()

    if not n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # coarse cells around a few rows: a shard holds rows of one cell, a block queries of one
    drawn = rows.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("vec_id")).limit(min(most_cells, max(1, n // shard_rows))).collect()
    centres = spark.sparkContext.broadcast(matrix(pd.Series([r["v"] for r in drawn])))

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        m, c = matrix(v), centres.value
        return pd.Series(((c * c).sum(axis=1) - 2 * m @ c.T).argmin(axis=1).astype("int32"))

    placed = common.materialise(rows.withColumn("cell", cell_of("v")), "vector-cells")

    def numbered(df: DataFrame, each: int) -> tuple[DataFrame, dict[int, int], int]:
        """df with part, a number for about so many rows of a cell; the first of each cell; how many there are."""
        parts = {r["cell"]: -(-r["n"] // each) for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most most_cells
        first, upto = {}, 0
        for cell in sorted(parts):
            first[cell], upto = upto, upto + parts[cell]
        many = F.create_map(*[F.lit(x) for cell in parts for x in (cell, parts[cell])])
        begin = F.create_map(*[F.lit(x) for cell in first for x in (cell, first[cell])])
        return df.withColumn("part", (begin[F.col("cell")] + F.pmod(F.xxhash64("vec_id"), many[F.col("cell")])).cast("int")), first, upto

    def blobs(df: DataFrame, parts: int, tag: str) -> DataFrame:
        dealt = df.select("vec_id", "v", "part").repartitionById(parts, "part").sortWithinPartitions("part")
        return common.materialise(dealt.mapInPandas(blob, "part int, ids binary, data binary, small boolean, centre binary, radius double"), tag)

    dealt, first_shard, n_shards = numbered(placed, shard_rows)
    ones = placed.filter("asks").groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("x")).select("vec_id", "x.v", "x.cell")
    asking, first_block, n_blocks = numbered(ones, query_rows)
    shards = blobs(dealt, n_shards, "vector-shards").withColumnRenamed("part", "shard")
    blocks = blobs(asking, n_blocks, "query-blocks").selectExpr("part as block", "ids as q_ids", "data as q_data", "small as q_small")

    def opened(ids: bytes, data: bytes, small: bool) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(ids, "<i8")
        return own, np.frombuffer(data, "<i4" if small else "<f8").astype(float).reshape(len(own), width)

    def search(first: bool):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: dict[int, tuple[np.ndarray, BallTree]] = {}
            for b in batches:
                out: list[tuple[int, int, int]] = []
                for row in b.itertuples():
                    if row.shard not in kept:
                        kept.clear()
                        ids, points = opened(row.ids, row.data, row.small)
                        if first:
                            ids, points = ids[:sample_rows], points[:sample_rows]
                        kept[row.shard] = ids, BallTree(points)
                    q_ids, queries = opened(row.q_ids, row.q_data, row.q_small)
                    floors = np.frombuffer(row.floors, "<f8") if not first else np.full(len(q_ids), -np.inf)
                    out += search_block(*kept[row.shard], queries, q_ids, floors, k)
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

        return work

    common.arrow_rows(spark, 16)
    # every block first looks at a part of a shard of its own cell
    last = sorted(first_block.items(), key=lambda x: x[1])
    nearest = spark.createDataFrame([(block, first_shard[cell]) for (cell, start), (_, end) in zip(last, [*last[1:], (0, n_blocks)], strict=True) for block in range(start, end)], "block int, shard int")
    seen = shards.drop("centre", "radius").join(nearest, "shard").join(blocks, "block").mapInPandas(search(True), FOUND)
    kth = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k)
    where = asking.select(F.col("vec_id").alias("query_id"), F.col("part").alias("block"))
    kth = kth.join(where, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("known"))

    def with_floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            floors = []
            for ids, known in zip(b["q_ids"], b["known"], strict=True):
                by = {} if known is None else {x["query_id"]: x["score"] for x in known}
                floors.append(np.array([by.get(int(i), -np.inf) for i in np.frombuffer(ids, "<i8")], "<f8").tobytes())
            yield b.drop(columns="known").assign(floors=floors)

    armed = common.materialise(blocks.join(kth, "block", "left").mapInPandas(with_floors, "block int, q_ids binary, q_data binary, q_small boolean, floors binary"), "query-floors")
    if n_shards * (width + 2) * 8 <= ball_bytes:
        balls = shards.select("shard", "centre", "radius").orderBy("shard").toPandas()  # bounded by ball_bytes
        around = spark.sparkContext.broadcast((balls["shard"].to_numpy(), np.array([np.frombuffer(c) for c in balls["centre"]]), balls["radius"].to_numpy()))

        def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """block, shard: where some query's bound reaches its floor."""
            numbers, middles, radii = around.value
            for b in batches:
                for row in b.itertuples():
                    ids, queries = opened(row.q_ids, row.q_data, row.q_small)
                    bound = queries @ middles.T + np.sqrt((queries**2).sum(axis=1))[:, None] * radii
                    bound += 1e-9 * np.abs(bound) + 1e-6
                    hit = (bound >= np.frombuffer(row.floors, "<f8")[:, None]).any(axis=0)
                    yield pd.DataFrame({"block": np.int32(row.block), "shard": numbers[hit]})

        pairs = armed.mapInPandas(reachable, "block int, shard int")
    else:
        pairs = armed.select("block", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    # a task makes a shard's tree once for some blocks
    met = shards.drop("centre", "radius").join(pairs, "shard").join(armed, "block").withColumn("turn", F.floor(F.col("block") / blocks_per_tree))
    met = met.repartition(max(1, min(n_shards * -(-n_blocks // blocks_per_tree), 100_000)), "shard", "turn").sortWithinPartitions("shard", "turn").drop("turn")
    found = met.mapInPandas(search(False), FOUND)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
