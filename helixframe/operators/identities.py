"""What a family is called by its cluster and its cliques.

Clusters are groups of a family graph; each is named by its member of the highest PageRank within
the group, and cliques of a group by their members in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import pagerank


def group_ranks(groups: DataFrame, edges: DataFrame, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """group_id, node, rank, place: PageRank within each group over its own edges, the first one in place 1.

    groups: node, group_id; edges: src, dst, weight. Members without an edge inside have no rank.
    """
    near = groups.select(F.col("node").alias("src"), "group_id")
    far = groups.select(F.col("node").alias("dst"), F.col("group_id").alias("other"))
    inside = edges.join(near, "src").join(far, "dst").filter("group_id = other").drop("other")
    ranks = pagerank(inside, rounds=rounds, tolerance=tolerance, groups="group_id")
    order = Window.partitionBy("group_id").orderBy(F.desc("rank"), "node")
    return ranks.withColumn("place", F.row_number().over(order))


def clique_memberships(cliques: DataFrame) -> DataFrame:
    """node, n: in how many cliques a family is. cliques: clique_id, members."""
    return cliques.select(F.explode("members").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def identities(ranks: DataFrame, groups: DataFrame, cliques: DataFrame) -> DataFrame:
    """node, cluster, clique of every ranked family.

    groups: group_id, is_clique; cliques: group_id, clique_id, members of groups that are none themselves. In a
    group that is a clique every member is called by the group's first. Otherwise a member of one clique gets the
    whole clique's members in rank order, dotted, or only the first if that one is in no other; a member
    of several gets its own number with a star; one of none has no clique.
    """
    first = ranks.filter("place = 1").select("group_id", F.col("node").alias("cluster"))
    named = ranks.join(first, "group_id").join(groups.select("group_id", "is_clique"), "group_id")
    member = cliques.select("group_id", "clique_id", F.explode("members").alias("node"))
    many = member.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    placed = member.join(ranks.select("group_id", "node", "place"), ["group_id", "node"]).join(many, "node")
    lists = placed.groupBy("group_id", "clique_id").agg(F.sort_array(F.collect_list(F.struct("place", "node", "n"))).alias("m"))
    head = F.col("m")[0]
    text = F.when(head["n"] == 1, head["node"].cast("string")).otherwise(F.array_join(F.transform("m", lambda x: x["node"].cast("string")), "."))
    single = lists.select(text.alias("label"), F.explode("m").alias("x")).filter("x.n = 1").select(F.col("x.node").alias("node"), "label")
    out = named.join(many, "node", "left").join(single, "node", "left")
    clique = F.when(F.col("is_clique"), F.col("cluster").cast("string")).when(F.col("n") > 1, F.concat(F.col("node").cast("string"), F.lit("*"))).otherwise(F.col("label"))
    return out.select("node", "group_id", "cluster", clique.alias("clique"))


def annotated(members: DataFrame, named: DataFrame) -> DataFrame:
    """Members of families with their family's cluster and clique, nothing where it has none. named: node, cluster, clique."""
    return members.join(named.select(F.col("node").alias("family_id"), "cluster", "clique"), "family_id", "left")
