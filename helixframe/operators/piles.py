"""From alignment pairs to piles, sub-piles, families and landscapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.interval import elliptically_close, within
from .graphs import components, consistent_edges, signed_components
from .intervals import nested_join, overlap_join, union
from .ordered import forget, running_total, written


def images(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: pair_id, side, contig, start, end, strand."""
    one = lambda s, n: pairs.select("pair_id", F.lit(n).alias("side"), F.col(f"{s}_contig").alias("contig"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"), "strand")
    return one("a", 0).unionByName(one("b", 1))


def piles(found: DataFrame, merge_overlap: int = 0) -> DataFrame:
    """pile_id, contig, start, end, n_images: images of a contig merged while they overlap by at least so much."""
    runs = union(found, "contig", gap=merge_overlap)
    return runs.select(F.concat_ws(":", F.col("contig").cast("string"), F.col("start").cast("string")).alias("pile_id"), "contig", "start", "end", F.col("n").alias("n_images"))


def placed(found: DataFrame, over: DataFrame) -> DataFrame:
    """Images with their pile: each lies within exactly one. Piles may be of any length beside their images, so bins are nested."""
    a = found.select("pair_id", "side", "contig", "strand", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    b = over.select("pile_id", "contig", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    return nested_join(a, b, ("contig", "i_start", "i_end"), ("contig", "p_start", "p_end"), (F.col("p_start") <= F.col("i_start")) & (F.col("i_end") <= F.col("p_end")))


def pile_measures(over: DataFrame) -> DataFrame:
    """Per pile of placed images: depth (images), volume (their lengths), span."""
    return over.groupBy("pile_id").agg(F.count(F.lit(1)).alias("depth"), F.sum(F.col("i_end") - F.col("i_start")).alias("volume"), F.min("i_start").alias("span_start"), F.max("i_end").alias("span_end"))


def _sides(over: DataFrame) -> DataFrame:
    side = lambda n, s: over.filter(F.col("side") == n).select("pair_id", "strand", F.col("pile_id").alias(f"{s}_pile"), (F.col("p_end") - F.col("p_start")).alias(f"{s}_plen"), (F.col("i_end") - F.col("i_start")).alias(f"{s}_ilen"))
    return side(0, "a").join(side(1, "b").drop("strand"), "pair_id")


def _alike(pile_diff: float, image_diff: float) -> Column:
    """Both images nearly fill their piles, and the shorter pile is nearly as long as the other."""
    return within(pile_diff, F.least("a_plen", "b_plen"), F.greatest("a_plen", "b_plen")) & within(image_diff, F.col("a_ilen"), F.col("a_plen")) & within(image_diff, F.col("b_ilen"), F.col("b_plen"))


def filtered_pairs(over: DataFrame, pile_diff: float = 0.05, image_diff: float = 0.05) -> DataFrame:
    """pair_id of the pairs that classic piling keeps: those whose lengths agree within tolerances."""
    return _sides(over).filter(_alike(pile_diff, image_diff)).select("pair_id")


def twists(over: DataFrame, pile_diff: float = 0.05, image_diff: float = 0.05, classic: bool = False) -> DataFrame:
    """src < dst, twist: piles that the two images of a pair connect. Lengths must agree within tolerances, unless classic, where pairs have been filtered before."""
    met = _sides(over).filter("a_pile <> b_pile")
    if not classic:
        met = met.filter(_alike(pile_diff, image_diff))
    return met.select(F.least("a_pile", "b_pile").alias("src"), F.greatest("a_pile", "b_pile").alias("dst"), F.col("strand").alias("twist"))


def touching_images(over: DataFrame, width: int, *keys: str) -> DataFrame:
    """pile_id, a, b: images of one pile that overlap or touch. over: pile_id, image_id, i_start, i_end.

    Bins of the axis keep a deep pile from being compared with itself as a whole.
    """
    own = lambda s: over.select("pile_id", F.col("image_id").alias(s), F.col("i_start").alias(f"{s}_start"), (F.col("i_end") + 1).alias(f"{s}_end"))
    met = overlap_join(own("a"), own("b"), width, ("pile_id", "a_start", "a_end"), ("pile_id", "b_start", "b_end"), F.col("a") < F.col("b"))
    return met.select("pile_id", "a", "b")


def deep_coverage(clusters: DataFrame, least: int = 2) -> DataFrame:
    """pile_id, covered: letters under accepted clusters whose images are at least so many in sum. clusters: pile_id, start, end, depth, accepted."""
    kept = clusters.filter("accepted")
    marks = kept.select("pile_id", F.col("start").alias("pos"), F.col("depth").alias("d")).unionByName(kept.select("pile_id", F.col("end").alias("pos"), (-F.col("depth")).alias("d")))
    step = marks.groupBy("pile_id", "pos").agg(F.sum("d").alias("d"))
    along = Window.partitionBy("pile_id").orderBy("pos")
    runs = step.withColumns({"deep": F.sum("d").over(along), "next": F.lead("pos").over(along)}).filter(F.col("deep") >= least)
    return runs.groupBy("pile_id").agg(F.sum(F.col("next") - F.col("pos")).alias("covered"))


def _reached(unique: DataFrame, share: float) -> DataFrame:
    """pile_id, a_start, a_end, b_start, b_end: intervals a that come before b and whose ends b's are near enough to.

    Reaches are graded by powers of two, and starts meet in bins of the grade's width, so an interval's reach is two or three bins.
    """
    grade = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("reach") + 1.0))).cast("long")
    a = unique.withColumn("reach", F.floor((F.col("i_end") - F.col("i_start")) * share)).withColumn("width", grade)
    bins = F.sequence(F.floor((F.col("i_start") - F.col("reach")) / F.col("width")), F.floor((F.col("i_start") + F.col("reach")) / F.col("width")))
    a = a.select("pile_id", "width", F.explode(bins).alias("bin"), "reach", F.col("n").alias("a_n"), F.col("i_start").alias("a_start"), F.col("i_end").alias("a_end"))
    b = unique.join(a.select("pile_id", "width").distinct(), "pile_id").select("pile_id", "width", F.floor(F.col("i_start") / F.col("width")).alias("bin"), F.col("n").alias("b_n"), F.col("i_start").alias("b_start"), F.col("i_end").alias("b_end"))
    near = (F.abs(F.col("a_start") - F.col("b_start")) <= F.col("reach")) & (F.abs(F.col("a_end") - F.col("b_end")) <= F.col("reach"))
    before = F.struct(-F.col("a_n"), "a_start", "a_end") < F.struct(-F.col("b_n"), "b_start", "b_end")
    return a.join(b, ["pile_id", "width", "bin"]).filter(near & before).select("pile_id", "a_n", "a_start", "a_end", "b_start", "b_end")


def seeded(found: DataFrame, share: float, rounds: int = 1000) -> DataFrame:
    """pile_id, i_start, i_end, n, s_start, s_end: the distinct intervals of piles, each with the seed that absorbs it.

    The deepest interval left is a seed and absorbs those whose ends are near its own; ties go by start, then end. All piles
    go on together, in rounds over the table of who reaches whom: an interval is a seed once none that comes before it and reaches it
    is left, and those that a seed reaches are out. A round settles every interval whose turn doesn't wait for another's, so there
    are as many as the longest chain of such waits.
    """
    unique = written(found.groupBy("pile_id", "i_start", "i_end").agg(F.count(F.lit(1)).alias("n")), "intervals")
    reached = written(_reached(unique, share), "reached")
    left, open_, seeds = unique.select("pile_id", F.col("i_start").alias("s_start"), F.col("i_end").alias("s_end")), reached, None
    one = lambda df, side: df.select("pile_id", F.col(f"{side}_start").alias("s_start"), F.col(f"{side}_end").alias("s_end"))
    key = ["pile_id", "s_start", "s_end"]
    for _ in range(rounds):
        fresh = written(left.join(one(open_, "b"), key, "left_anti"), "seeds")
        seeds = fresh if seeds is None else seeds.unionByName(fresh)
        lost = written(open_.join(fresh.toDF("pile_id", "a_start", "a_end"), ["pile_id", "a_start", "a_end"], "left_semi").select("pile_id", "b_start", "b_end").distinct().toDF(*key), "absorbed")
        gone = fresh.unionByName(lost)
        before = left, open_ if open_ is not reached else None
        left = written(left.join(gone, key, "left_anti"), "left")
        if left.isEmpty():
            break
        for side in ("a", "b"):
            open_ = open_.join(gone.toDF("pile_id", f"{side}_start", f"{side}_end"), ["pile_id", f"{side}_start", f"{side}_end"], "left_anti")
        open_ = written(open_, "open")
        forget(lost, *before)
    else:
        raise RuntimeError(f"seeds did not settle in {rounds} rounds")
    first = F.min(F.struct(-F.col("a_n"), "a_start", "a_end")).alias("s")
    taken = reached.join(seeds.toDF("pile_id", "a_start", "a_end"), ["pile_id", "a_start", "a_end"]).groupBy("pile_id", F.col("b_start").alias("i_start"), F.col("b_end").alias("i_end")).agg(first)
    at = lambda c, own: F.coalesce(F.col(f"s.{c}"), F.col(own))
    return unique.join(taken, ["pile_id", "i_start", "i_end"], "left").select("pile_id", "i_start", "i_end", "n", at("a_start", "i_start").alias("s_start"), at("a_end", "i_end").alias("s_end"))


def subpiles(found: DataFrame, share: float = 0.05, strictness: int = 0, overlap_tolerance: float = 0.95, target: float = 0.95, members: DataFrame | None = None) -> DataFrame:
    """Clusters of a pile's images: pile_id, cluster, start, end, depth, accepted, s_start, s_end (their seed).

    found: pile_id, p_start, p_end, i_start, i_end; members: ``seeded`` of it, if there already. Clusters are
    accepted, deepest first, until places under two or more accepted images make the target share of the pile. Strictness 1
    drops one that strictly holds an accepted one and that one too, 2 one whose overlap with an accepted one is within the tolerance
    of the shorter's length (0.95: at least a twentieth of it) and that one too; they go on counting as cover, and as what later ones are held against.
    A task accepts among the clusters of a pile, which no longer hold images.
    """
    members = seeded(found, share) if members is None else members
    made = members.groupBy("pile_id", "s_start", "s_end").agg(F.min("i_start").alias("start"), F.max("i_end").alias("end"), F.sum("n").alias("depth"))
    sizes = found.groupBy("pile_id").agg(F.max(F.col("p_end") - F.col("p_start")).alias("size"))

    def accepted(s: np.ndarray, e: np.ndarray, depth: np.ndarray, size: int) -> np.ndarray:
        held = np.zeros(len(s), bool)  # clusters that later ones are held against, and that cover
        dropped = np.zeros(len(s), bool)
        for i in range(len(s)):
            both = np.minimum(e, e[i]) - np.maximum(s, s[i])
            if strictness == 1:
                bad = held & (s[i] <= s) & (e <= e[i]) & ((s != s[i]) | (e != e[i]))
            elif strictness == 2:
                bad = held & (both > 0) & (both >= (1 - overlap_tolerance) * np.minimum(e - s, e[i] - s[i]))
            else:
                bad = np.zeros(len(s), bool)
            if bad.any():
                dropped |= bad
                dropped[i] = True
                continue
            held[i] = True
            at = np.concatenate([s[held], e[held]])
            order = np.argsort(at, kind="stable")
            deep = np.cumsum(np.concatenate([depth[held], -depth[held]])[order])[:-1]
            if np.diff(at[order])[deep > 1].sum() >= target * size:
                break
        return held & ~dropped

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [accepted(*(np.asarray(x, np.int64) for x in own), size) for *own, size in zip(b["start"], b["end"], b["depth"], b["size"], strict=True)]
            yield pd.DataFrame({"pile_id": b["pile_id"], "accepted": found})

    # the first cluster of a pile is always held, so piles of one need no task
    first = (F.struct((-F.col("depth")).alias("d"), "start", "end", "s_start", "s_end")).alias("c")
    each = made.filter("pile_id is not null").groupBy("pile_id").agg(F.sort_array(F.collect_list(first)).alias("c"))
    one = lambda rows, **more: rows.select("pile_id", F.posexplode("c").alias("cluster", "c"), *[c.alias(n) for n, c in more.items()])
    shown = lambda rows, kept: rows.select("pile_id", F.col("cluster").cast("int").alias("cluster"), "c.start", "c.end", (-F.col("c.d")).alias("depth"), kept.alias("accepted"), "c.s_start", "c.s_end")
    single = shown(one(each.filter(F.size("c") == 1)), F.lit(True))
    several = written(each.filter(F.size("c") > 1).join(sizes, "pile_id"), "clusters")
    parts = several.select("pile_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.transform("c", lambda x: -x["d"]).alias("depth"), "size")
    told = parts.mapInPandas(accept, several.select("pile_id", F.lit(None).cast("array<boolean>").alias("accepted")).schema)
    return single.unionByName(shown(one(several.join(told, "pile_id"), told=F.col("accepted")), F.get("told", F.col("cluster"))))


def subpile_twists(over: DataFrame, members: DataFrame, clusters: DataFrame, pile_diff: float = 0.05, image_diff: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The twist graph of accepted sub-piles: nodes (node, contig, start, end, kind) and edges (src < dst, twist).

    over: placed images with pile_id, contig, p_start, p_end; members and clusters: ``seeded`` and ``subpiles`` of them. A sub-pile's image links it to the
    pile in which the pair's other image lies, if the two piles' lengths are within pile_diff and each image's within image_diff of its
    pile's; never to itself or to a pile at the same place. Nodes at the same place are joined by an edge of twist 1.
    """
    kept = clusters.filter("accepted").select("pile_id", "s_start", "s_end", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    own = over.join(members.select("pile_id", "i_start", "i_end", "s_start", "s_end"), ["pile_id", "i_start", "i_end"]).join(kept, ["pile_id", "s_start", "s_end"])
    a = own.select("pair_id", "side", "strand", F.col("contig").alias("a_contig"), F.col("c_start").alias("a_from"), F.col("c_end").alias("a_to"), (F.col("c_end") - F.col("c_start")).alias("a_plen"), (F.col("i_end") - F.col("i_start")).alias("a_ilen"))
    b = over.select("pair_id", (1 - F.col("side")).alias("side"), F.col("contig").alias("b_contig"), F.col("p_start").alias("b_from"), F.col("p_end").alias("b_to"), (F.col("p_end") - F.col("p_start")).alias("b_plen"), (F.col("i_end") - F.col("i_start")).alias("b_ilen"))
    met = written(a.join(b, ["pair_id", "side"]).filter(_alike(pile_diff, image_diff)), "sub-twists")
    place = lambda s, kind: met.select(F.col(f"{s}_contig").cast("string").alias("contig"), F.col(f"{s}_from").alias("start"), F.col(f"{s}_to").alias("end"), F.lit(kind).alias("kind"))
    found = place("a", "sub").unionByName(place("b", "pile")).distinct().withColumn("_one", F.lit(1))
    nodes = written(running_total(found, "_one", "contig", "start", "end", "kind", name="node").drop("_one"), "nodes")
    name = lambda s, kind: nodes.filter(F.col("kind") == kind).select(F.col("contig").alias(f"{s}_contig"), F.col("start").alias(f"{s}_from"), F.col("end").alias(f"{s}_to"), F.col("node").alias(f"{s}_node"))
    apart = (F.col("a_contig") != F.col("b_contig")) | (F.col("a_from") != F.col("b_from")) | (F.col("a_to") != F.col("b_to"))
    joined = met.withColumns({"a_contig": F.col("a_contig").cast("string"), "b_contig": F.col("b_contig").cast("string")}).filter(apart)
    joined = joined.join(name("a", "sub"), ["a_contig", "a_from", "a_to"]).join(name("b", "pile"), ["b_contig", "b_from", "b_to"])
    twisted = joined.select(F.least("a_node", "b_node").alias("src"), F.greatest("a_node", "b_node").alias("dst"), F.col("strand").alias("twist"))
    same = nodes.groupBy("contig", "start", "end").agg(F.min("node").alias("src"), F.max("node").alias("dst")).filter("src < dst").select("src", "dst", F.lit(1).alias("twist"))
    return nodes, twisted.unionByName(same)


def twist_families(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """family_id, contig, start, end, strand: places of the components whose twists agree, relative to the family's first node."""
    found = signed_components(consistent_edges(edges))
    return found.join(nodes, "node").select(F.col("component").alias("family_id"), "contig", "start", "end", "strand").distinct()


def landscape(found: DataFrame, levels: int | None = None) -> DataFrame:
    """pile_id, pos, k, height: the k-th largest tent min(pos - start, end - pos) over the images at each inner position.

    Spark ranks within (pile, position). levels: only the largest so many of a position, all of them by default.
    """
    tents = found.filter(F.col("i_end") - F.col("i_start") > 1).select("pile_id", "i_start", "i_end", F.explode(F.sequence(F.col("i_start") + 1, F.col("i_end") - 1)).alias("pos"))
    heights = tents.withColumn("height", F.least(F.col("pos") - F.col("i_start"), F.col("i_end") - F.col("pos"))).groupBy("pile_id", "pos", "height").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("pile_id", "pos").orderBy(F.desc("height"))
    upto = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))
    ranked = heights.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n") + 1)
    last = F.col("upto")
    if levels is not None:
        ranked, last = ranked.filter(F.col("from") <= levels), F.least("upto", F.lit(levels))
    each = ranked.select("pile_id", "pos", F.explode(F.sequence(F.col("from"), last)).alias("k"), "height")
    return each.withColumn("k", F.col("k").cast("int"))


def landscape_features(levels: DataFrame) -> DataFrame:
    """Peaks (1), troughs (-1, over the height where it isn't 0) and others (0) of each level.

    A neighbour that is missing counts as 0. A first or last position above 0 is a trough.
    """
    along = Window.partitionBy("pile_id", "k").orderBy("pos")
    h = F.col("height")
    a = F.when(F.lag("pos").over(along) == F.col("pos") - 1, F.lag("height").over(along)).otherwise(0)
    b = F.when(F.lead("pos").over(along) == F.col("pos") + 1, F.lead("height").over(along)).otherwise(0)
    span = levels.groupBy("pile_id").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    edge = (F.col("pos") == F.col("_first")) | (F.col("pos") == F.col("_last"))
    near = levels.join(span, "pile_id").withColumns({"a": a, "b": b, "edge": edge})
    a, b = F.col("a"), F.col("b")
    trough = ((h == 0) & (a + b > 0)) | (F.col("edge") & (h > 0)) | ((h <= a) & (h < b)) | ((h < a) & (h <= b))
    peak = ((h >= a) & (h > b)) | ((h > a) & (h >= b))
    delta = F.when(trough, F.when(h != 0, -1.0 / h).otherwise(-1.0)).when(peak, 1.0).otherwise(0.0)
    return near.select("pile_id", "pos", "k", "height", delta.alias("delta"))


def first_members(members: DataFrame, *identity: str) -> DataFrame:
    """Each member once over all families: in the first one by (family_id, ord)."""
    firsts = members.groupBy(*identity).agg(F.min(F.struct("family_id", "ord")).alias("at"))
    return firsts.select("at.family_id", "at.ord", *identity)


def kept_families(members: DataFrame) -> DataFrame:
    """Members with a known strand, of families that have two or more of them."""
    known = members.filter("O <> 0")
    enough = known.groupBy("family_id").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    return known.join(enough.select("family_id"), "family_id", "left_semi")


def sized_families(members: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """family_id, size of families with at least and at most so many members, the largest first, then by id."""
    size = members.groupBy("family_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    return (size if most is None else size.filter(F.col("size") <= most)).orderBy(F.desc("size"), "family_id")


def member_name(family: Column, member: Column) -> Column:
    return F.format_string("family%06d_member%04d", family, member)


def long_members(members: DataFrame, share: float) -> DataFrame:
    """Members of at least a share of their family's longest, with the member's number before the filter."""
    n = (F.col("end") - F.col("start")).alias("len")
    most = members.groupBy("family_id").agg(F.max(F.col("end") - F.col("start")).alias("max_len"))
    rows = members.select("*", n).join(most, "family_id")
    order = Window.partitionBy("family_id").orderBy("ord")
    return rows.withColumn("member", F.row_number().over(order) - 1).filter(F.col("len") >= F.floor(F.col("max_len") * share))


def sampled_members(members: DataFrame, most: int, share: float, seed: int) -> DataFrame:
    """At most so many of a family's long members, in the order of a seeded hash, with that order's n."""
    order = Window.partitionBy("family_id").orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("ord").cast("string"))), "ord")
    return long_members(members, share).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)


def stitch(members: DataFrame, epsilon: float, width: int) -> DataFrame:
    """fam_a, fam_b, twist, n_bad: families of different files whose members lie at almost the same place.

    members: file_id, family_id, ord, contig, start, end, strand; files count upwards. twist is that of the
    first pair (by ords), n_bad the pairs that disagree with it.
    """
    side = lambda s: members.select("contig", F.col("file_id").alias(f"file_{s}"), F.col("family_id").alias(f"fam_{s}"), F.col("ord").alias(f"ord_{s}"), F.col("start").alias(f"start_{s}"), F.col("end").alias(f"end_{s}"), F.col("strand").alias(f"strand_{s}"))
    near = (F.col("file_a") < F.col("file_b")) & elliptically_close(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b"), epsilon)
    met = overlap_join(side("a"), side("b"), width, ("contig", "start_a", "end_a"), ("contig", "start_b", "end_b"), near)
    twist = met.withColumn("twist", F.col("strand_a") * F.col("strand_b"))
    votes = twist.groupBy("fam_a", "fam_b", "twist").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord_a", "ord_b")).alias("at"))
    return votes.groupBy("fam_a", "fam_b").agg(F.min_by("twist", "at").alias("twist"), (F.sum("n") - F.min_by("n", "at")).alias("n_bad"))


def merged_families(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of connected families under the component's id, each place once."""
    found = components(edges.select(F.col("fam_a").alias("src"), F.col("fam_b").alias("dst")))
    joined = members.join(found.select(F.col("node").alias("family_id"), "component"), "family_id")
    return joined.select("component", "contig", "start", "end").distinct()


def stitched_families(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``stitch`` joins, with strands: (component, n_families, n_members, n_bad, oriented) and (component, contig, start, end, strand).

    n_members: different places; n_bad: pairs of members that disagree with their families' twist. A family's sign is that relative to the component's
    smallest family, carried along edges of twist 1 or -1; where these contradict each other, or only edges of twist 0 lead to a family, it
    has none, and the component is not oriented. A place's strand is its members' times their families' signs, 0 if these differ or are unknown.
    """
    ends = edges.select(F.col("fam_a").alias("src"), F.col("fam_b").alias("dst"), "twist", "n_bad")
    found = components(ends.select("src", "dst"))
    signs = signed_components(ends.filter("twist <> 0")).select("node", "component", F.col("strand").alias("sign"))
    placed = written(found.join(signs, ["node", "component"], "left").select(F.col("node").alias("family_id"), "component", "sign"), "stitched")
    strand = F.coalesce(F.col("strand") * F.col("sign"), F.lit(0))
    shown = members.join(placed, "family_id").groupBy("component", "contig", "start", "end").agg(F.min(strand).alias("_least"), F.max(strand).alias("_most"))
    places = shown.select("component", "contig", "start", "end", F.when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise(0).cast("int").alias("strand"))
    bad = ends.join(placed.select(F.col("family_id").alias("src"), "component"), "src").groupBy("component").agg(F.sum("n_bad").cast("long").alias("n_bad"))
    n = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n_families"), (F.count("sign") == F.count(F.lit(1))).alias("oriented"))
    sizes = shown.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))
    return n.join(sizes, "component").join(bad, "component").select("component", "n_families", "n_members", "n_bad", "oriented"), places
