"""Graph operators on edge tables; every step is a join or an aggregate, written out between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import forget, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node with an edge. edges: src, dst.

    Alternating large-star and small-star steps (Kiveris et al. 2014).
    """
    now = written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    loops = now.filter("u = v").select(F.col("u").alias("node"))
    now, before = now.filter("u <> v"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        fresh = written(small.filter("u <> v").distinct(), "edges")
        forget(least, large, low, now)  # the first of now is a filter, whose table is still read
        now = fresh
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node")).unionByName(loops).distinct()
    return stars.unionByName(roots.join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def signed_components(edges: DataFrame) -> DataFrame:
    """node, component, strand of components whose edge signs agree. edges: src, dst, twist (1 or -1).

    Components of the doubled graph, where a node has a plus and a minus side and an edge of sign -1
    crosses; a component with both sides of a node is contradictory and is dropped whole. Strands are
    relative to the smallest node, which is plus.
    """
    edges = written(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "twist"), "twisted")
    low, high = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    # a side is twice its node's number, one more for minus: a long, or a decimal where that is too short
    kind = "decimal(20,0)" if low is not None and (low < -(1 << 62) or high >= 1 << 62) else "long"
    side = lambda node, s: (F.col(node).cast(kind) * 2 + s).cast(kind)
    node = lambda c: (F.shiftright(c, 1) if kind == "long" else F.floor(F.col(c) / 2)).cast("long")
    mark = lambda c: F.when(F.col(c) % 2 == 0, "+").otherwise("-")
    cross = F.when(F.col("twist") == 1, 0).otherwise(1)
    doubled = edges.select(side("src", F.lit(0)).alias("src"), side("dst", cross).alias("dst")).unionByName(edges.select(side("src", F.lit(1)).alias("src"), side("dst", 1 - cross).alias("dst")))
    found = components(doubled).select(node("node").alias("node"), mark("node").alias("own"), node("component").alias("component"), mark("component").alias("side"))
    plus = found.filter("side = '+'").groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    bad = written(plus.filter("n > 1").select("component").distinct(), "contradictions")
    return plus.join(bad, "component", "left_anti").select("node", "component", F.when(F.col("own") == "+", 1).otherwise(-1).alias("strand"))


def consistent_edges(seen: DataFrame) -> DataFrame:
    """src, dst, twist without edges seen with both signs, and without nodes that have two or more of those. seen: src < dst, twist."""
    each = written(seen.groupBy("src", "dst").agg(F.count_distinct("twist").alias("kinds"), F.max("twist").alias("twist")), "twists")
    poison = each.filter("kinds > 1").select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    good = each.filter("kinds = 1")
    for end in ("src", "dst"):
        good = good.join(poison.withColumnRenamed("node", end), end, "left_anti")
    return good.select("src", "dst", F.col("twist").cast("int").alias("twist"))


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6, groups: str | None = None) -> DataFrame:
    """node, rank over weighted edges (src, dst, weight); ranks sum to 1, nodes without a way out give to all.

    Until no rank changes by more than tolerance, or so many rounds. groups: a column of the edges; each
    of its values is a graph of its own, all are ranked in the same rounds, and the result has that column as well.
    """
    key = "_group" if groups is None else groups
    own = edges.withColumn(key, F.lit(0)) if groups is None else edges
    out = own.groupBy(key, "src").agg(F.sum("weight").alias("total"))
    parts = written(own.join(out, [key, "src"]).select(key, "src", "dst", (F.col("weight") / F.col("total")).alias("part")), "parts")
    every = own.select(key, F.col("src").alias("node")).union(own.select(key, "dst")).distinct().join(out.withColumnRenamed("src", "node"), [key, "node"], "left")
    size = every.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("size"))
    nodes = written(every.select(key, "node", F.col("total").isNull().alias("ends")).join(size, key), "nodes")
    ranks, before = nodes.withColumn("rank", 1 / F.col("size")), None
    for _ in range(rounds):
        lost = ranks.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        given = parts.join(ranks.select(key, F.col("node").alias("src"), "rank"), [key, "src"]).groupBy(key, F.col("dst").alias("node")).agg(F.sum(F.col("part") * F.col("rank")).alias("given"))
        met = ranks.join(given, [key, "node"], "left").join(lost, key)
        rank = (1 - damping) / F.col("size") + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / F.col("size"))
        fresh = written(met.select(key, "node", "ends", "size", rank.alias("rank"), F.col("rank").alias("old")), "ranks")
        gap = fresh.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        forget(before)
        ranks, before = fresh.drop("old"), fresh
        if gap is None or gap <= tolerance:
            break
    return ranks.select("node", "rank") if groups is None else ranks.select(groups, "node", "rank")


def clique_test(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, size, n_edges, is_clique. groups: node, group_id; edges undirected and maybe repeated."""
    distinct = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    inside = distinct.join(groups.select(F.col("node").alias("a"), "group_id"), "a").join(groups.select(F.col("node").alias("b"), F.col("group_id").alias("other")), "b").filter("group_id = other")
    n = inside.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_edges"))
    size = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return size.join(n, "group_id", "left").select("group_id", "size", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), ((F.col("size") == 2) | (2 * F.coalesce("n_edges", F.lit(0)) == F.col("size") * (F.col("size") - 1))).alias("is_clique"))


def maximal_cliques(edges: DataFrame, least: int = 3) -> DataFrame:
    """clique_id (its smallest node), members of every maximal clique of at least so many nodes, two at least.

    In order of degree every node has few later neighbours (Eppstein et al. 2010). Each
    node's task holds its later neighbours and the triangles with them only and finds the cliques in which it comes first, by
    Bron and Kerbosch's recursion with pivots.
    """
    pairs = written(edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = written(both.groupBy("a").agg(F.count(F.lit(1)).alias("d")), "degrees")
    known = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("d_b")), "b")
    after = (F.col("d_b") > F.col("d")) | ((F.col("d_b") == F.col("d")) & (F.col("b") > F.col("a")))
    near = written(known.select("a", "b", after.alias("later")), "neighbours")
    # pairs of a node's later neighbours, which are few for a hub too; a triangle is a link for its first and its second node
    onward = near.filter("later").select(F.col("a").alias("u"), F.col("b").alias("x"))
    wedge = onward.join(onward.withColumnRenamed("x", "y"), "u").filter("x < y")
    order = near.filter("later").select(F.col("a").alias("w"), F.col("b").alias("z"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    triangles = written(wedge.join(order, ["x", "y"]).select("u", "w", "z"), "triangles")
    inner = triangles.select(F.col("u").alias("v"), F.col("w").alias("x"), F.col("z").alias("y")).unionByName(triangles.select(F.col("w").alias("v"), F.col("u").alias("x"), F.col("z").alias("y")))
    links = inner.groupBy("v").agg(F.collect_list(F.struct("x", "y")).alias("links"))
    rows = onward.groupBy(F.col("u").alias("v")).agg(F.collect_list("x").alias("later")).join(links, "v", "left")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                to: dict[int, set[int]] = {}
                for e in row.links if row.links is not None else ():
                    to.setdefault(e["x"], set()).add(e["y"])
                    to.setdefault(e["y"], set()).add(e["x"])

                def grow(r: list[int], p: set[int], x: set[int], to=to, out=out) -> None:
                    if not p and not x:
                        if len(r) >= least:
                            out.append((min(r), sorted(r)))
                        return
                    pivot = max(p | x, key=lambda u: len(p & to.get(u, set())))
                    for u in sorted(p - to.get(pivot, set())):
                        own = to.get(u, set())
                        grow([*r, u], p & own, x & own)
                        p = p - {u}
                        x = x | {u}

                later = {int(u) for u in row.later}
                grow([int(row.v)], later, set(to) - later)  # an earlier neighbour without a link is in no clique of three
            yield pd.DataFrame(out, columns=["clique_id", "members"])

    return rows.mapInPandas(search, "clique_id long, members array<long>")


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 20, levels: int = 20, weighted: bool = False) -> DataFrame:
    """node, community (its smallest node): modularity is raised by local moves, then on the graph of communities, and so on (Blondel et al. 2008).

    In a round every node of one half (by a hash that changes) moves to the neighbouring community with the largest gain, ties to
    the smaller one; halves keep neighbours from swapping. A level ends when a round over either half moves none, the whole when a
    level joins none. Edges count once each, unless weighted, then by the sum of their weight column.
    """
    weight = F.sum("weight") if weighted else F.lit(1.0)
    pairs = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg((weight if weighted else F.max(F.lit(1.0))).cast("double").alias("w"))
    pairs = written(pairs, "pairs")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "pairs")
    m2 = both.agg(F.sum("w")).first()[0] or 1.0
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    place = written(degrees.select("node", F.col("node").alias("community")), "communities")
    state = written(degrees.withColumn("community", F.col("node")), "communities")
    for _ in range(levels):
        moved = _local_moves(both, state, m2, resolution, rounds)
        sizes = moved.agg(F.count(F.lit(1)), F.count_distinct("community")).first()
        place = written(place.join(moved.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")), "communities")
        if sizes[0] == sizes[1]:
            break
        to = moved.select("node", "community")
        ends = both.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").filter("x <> y")
        both = written(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "pairs")
        state = written(moved.groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k")).withColumn("community", F.col("node")), "communities")
    name = place.groupBy("community").agg(F.min("node").alias("name"))
    return place.join(name, "community").select("node", F.col("name").alias("community"))


def _local_moves(both: DataFrame, state: DataFrame, m2: float, resolution: float, rounds: int) -> DataFrame:
    """node, k, community after rounds of moves. both: a, b, w in both directions; state: node, k (with weights inside it), community."""
    still, before = 0, None
    for turn in range(rounds):
        total = state.groupBy("community").agg(F.sum("k").alias("sum_k"))
        ties = both.join(state.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("links"))
        own = state.select("node", "k", F.col("community").alias("now"))
        options = ties.unionByName(state.select("node", "community", F.lit(0.0).alias("links"))).groupBy("node", "community").agg(F.max("links").alias("links")).join(own, "node").join(total, "community")
        held = F.col("sum_k") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0)
        gain = F.round(F.col("links") - F.lit(resolution) * F.col("k") * held / m2, 9)
        best = options.groupBy("node").agg(F.max(F.struct(gain.alias("gain"), (F.col("community") == F.col("now")).alias("stays"), (-F.col("community")).alias("first")))["first"].alias("first"))
        moves = F.pmod(F.shiftright(F.xxhash64("node"), turn // 2 % 32) + F.lit(turn), F.lit(2)) == 0
        fresh = written(state.join(best, "node").select("node", "k", F.when(moves, -F.col("first")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old")), "communities")
        still = 0 if fresh.filter("community <> old").count() else still + 1
        forget(before)
        state, before = fresh.drop("old"), fresh
        if still == 2 and turn % 2:  # both halves of one split
            break
    return state
