"""Interval joins and coverage algebra on half-open intervals [start, end) of a contig.

A range condition alone would be planned as a nested loop. Both sides are cut into bins of
a width near the usual interval, joined on (contig, bin), and a pair counts only in the
bin where its overlap begins, so no duplicate needs removing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.interval import contains, ends_close, overlap_length, overlaps, overlaps_by


def binned(df: DataFrame, start: str, end: str, width: int, name: str = "_bin") -> DataFrame:
    """A row for each bin that an interval touches; empty intervals have none."""
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    return df.filter(F.col(end) > F.col(start)).withColumn(name, F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, width: int, left_cols: tuple[str, str, str] = ("contig", "l_start", "l_end"), right_cols: tuple[str, str, str] = ("contig", "r_start", "r_end"), condition: Column | None = None) -> DataFrame:
    """Pairs of overlapping intervals. Column names of the two sides differ but for the contig."""
    (lc, ls, le), (rc, rs, re) = left_cols, right_cols
    a, b = binned(left, ls, le, width), binned(right, rs, re, width)
    if lc == rc:
        met = a.join(b, [lc, "_bin"])
    else:
        met = a.join(b, (F.col(lc) == F.col(rc)) & (a["_bin"] == b["_bin"])).drop(b["_bin"])
    met = met.filter(overlaps(F.col(ls), F.col(le), F.col(rs), F.col(re)) & (F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("_bin")))
    return (met if condition is None else met.filter(condition)).drop("_bin")


#: Widths of nested bins grow by this factor; no bin is narrower than this power of it.
FACTOR, NARROWEST = 4, 3


def _graded(df: DataFrame, start: str, end: str) -> DataFrame:
    """df without empty intervals, with the level of each: the first whose bins are at least as wide as it is long."""
    level = F.ceil(F.log(F.col(end) - F.col(start)) / F.log(F.lit(float(FACTOR)))).cast("int")
    return df.filter(F.col(end) > F.col(start)).withColumn("_level", F.greatest(level + 1, F.lit(NARROWEST)))  # one more: no power is taken for its root


def nested_join(left: DataFrame, right: DataFrame, left_cols: tuple[str, str, str] = ("contig", "l_start", "l_end"), right_cols: tuple[str, str, str] = ("contig", "r_start", "r_end"), condition: Column | None = None) -> DataFrame:
    """Pairs of overlapping intervals of any lengths, as ``overlap_join`` gives them, without a width to choose.

    Bins are nested. Of a pair the longer interval lies in one or two bins of its own level, and the shorter one in as few of that
    level, so an interval is a row or two for each level that the other side has, whatever its length. A pair counts in the bin in which its overlap begins.
    """
    (lc, ls, le), (rc, rs, re) = left_cols, right_cols
    sides = [(_graded(left, ls, le), lc, ls, le), (_graded(right, rs, re).withColumnRenamed(rc, "_key") if lc == rc else _graded(right, rs, re), "_key" if lc == rc else rc, rs, re)]

    def own(side: tuple) -> DataFrame:
        df, _, start, end = side
        width = F.pow(F.lit(float(FACTOR)), F.col("_level")).cast("long")
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))

    def upper(side: tuple, other: tuple, same: bool) -> DataFrame:
        """A side in the bins of the levels of longer intervals of the other side (or of equally long ones)."""
        df, _, start, end = side
        levels = F.broadcast(other[0].select(F.col("_level").alias("_at")).distinct())  # at most one for each power of the factor
        met = df.join(levels, F.col("_at") >= F.col("_level") if same else F.col("_at") > F.col("_level")).drop("_level").withColumnRenamed("_at", "_level")
        return own((met, None, start, end))

    a, b = sides
    out = None
    for long, short, same in ((a, b, True), (b, a, False)):
        x, y = own(long), upper(short, long, same)
        met = x.join(y, (x[long[1]] == y[short[1]]) & (x["_level"] == y["_level"]) & (x["_bin"] == y["_bin"])).drop(y["_level"], y["_bin"])
        begin = F.floor(F.greatest(F.col(ls), F.col(rs)) / F.pow(F.lit(float(FACTOR)), F.col("_level")).cast("long"))
        met = met.filter(overlaps(F.col(ls), F.col(le), F.col(rs), F.col(re)) & (begin == F.col("_bin"))).drop("_level", "_bin", "_key")
        out = met if out is None else out.unionByName(met)
    return out if condition is None else out.filter(condition)


def close_pairs(left: DataFrame, right: DataFrame, share: float, *keys: str, left_cols: tuple[str, str] = ("a_start", "a_end"), right_cols: tuple[str, str] = ("b_start", "b_end"), condition: Column | None = None) -> DataFrame:
    """Pairs of equal keys whose starts and ends are within a share of the left one's length of each other.

    Reaches are graded by powers of two, and starts meet in bins of the grade's width: a left interval is at most three
    rows, a right one a row for each grade that the left side has.
    """
    (ls, le), (rs, re) = left_cols, right_cols
    reach = F.floor((F.col(le) - F.col(ls)) * F.lit(share))
    a = left.withColumn("_reach", reach).filter("_reach >= 0").withColumn("_width", F.greatest(F.lit(32), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_reach") + 1.0)))).cast("long"))
    widths = F.broadcast(a.select("_width").distinct())  # at most one for each power of two
    a = a.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(ls) - F.col("_reach")) / F.col("_width")), F.floor((F.col(ls) + F.col("_reach")) / F.col("_width"))))).drop("_reach")
    b = right.join(widths).withColumn("_bin", F.floor(F.col(rs) / F.col("_width")))
    met = a.join(b, [*keys, "_width", "_bin"]).filter(ends_close(F.col(ls), F.col(le), F.col(rs), F.col(re), share)).drop("_width", "_bin")
    return met if condition is None else met.filter(condition)


def best_overlaps(targets: DataFrame, sources: DataFrame, width: int, share: float = 0.05, most: int = 8) -> DataFrame:
    """Left outer join: each target (t_id, contig, t_start, t_end, strand) with its longest overlaps.

    The overlap must exceed a whole-numbered share of the target on either side; ties go to the
    smaller s_id. Ranks follow the strand: by start, from the end on minus. A target without
    a match stays, with nulls.
    """
    cond = overlaps_by(F.col("t_start"), F.col("t_end"), F.col("s_start"), F.col("s_end"), share)
    found = overlap_join(targets, sources, width, ("contig", "t_start", "t_end"), ("contig", "s_start", "s_end"), cond)
    found = found.withColumn("overlap", overlap_length(F.col("t_start"), F.col("t_end"), F.col("s_start"), F.col("s_end")))
    top = Window.partitionBy("t_id").orderBy(F.desc("overlap"), "s_id")
    kept = found.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= most)
    along = Window.partitionBy("t_id").orderBy(F.when(F.col("strand") == 1, F.col("s_start")).otherwise(-F.col("s_start")), "s_id")
    ranked = kept.withColumn("rank", F.row_number().over(along)).select("t_id", "s_id", "overlap", "rank")
    return targets.select("t_id").join(ranked, "t_id", "left")


def contained(regions: DataFrame, motifs: DataFrame, width: int) -> DataFrame:
    """Pairs of a region (contig, r_id, r_start, r_end) and a motif (contig, m_start, m_end) that lies within it.

    A motif falls into the bin of its start only, so a pair is found once and empty motifs count.
    """
    first, last = F.floor(F.col("r_start") / width), F.floor(F.col("r_end") / width)
    a = regions.filter("r_start <= r_end").withColumn("_bin", F.explode(F.sequence(first, last)))
    b = motifs.withColumn("_bin", F.floor(F.col("m_start") / width))
    return a.join(b, ["contig", "_bin"]).filter(contains(F.col("r_start"), F.col("r_end"), F.col("m_start"), F.col("m_end"))).drop("_bin")


def motif_statistics(regions: DataFrame, motifs: DataFrame, width: int) -> DataFrame:
    """Per region: motifs within, their mean midpoint, its spread and the mean distance from the region's middle."""
    mid = (F.col("m_start") + F.col("m_end")) / 2.0
    off = F.abs(mid - (F.col("r_start") + F.col("r_end")) / 2.0)
    found = contained(regions, motifs, width).groupBy("r_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(mid).alias("mean_mid"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp(mid)).alias("spread"),
        F.when(F.count(F.lit(1)) > 1, F.sqrt(F.var_pop(mid) * F.count(F.lit(1))) / (F.count(F.lit(1)) - 1)).alias("spread_compat"),
        F.avg(off).alias("mean_off"),
    )
    return regions.filter("r_start <= r_end").select("r_id").join(found, "r_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def backwards(regions: DataFrame) -> DataFrame:
    """Regions that start after their end: skipped above, reported here."""
    return regions.filter("r_start > r_end")


#: Length of the tiles of an axis that windows run within.
TILE = 1 << 16


def _with_tiles(rows: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what tiles says of their tile; keys may be null."""
    own = [c for c in tiles.columns if c not in keys]
    named = tiles.select(*[F.col(k).alias(f"_key{k}") for k in keys], *own)
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key{k}")) for k in keys])
    return rows.join(named, same).select(*rows.columns, *own)


def union(df: DataFrame, *keys: str, gap: int = 0) -> DataFrame:
    """Merged runs per key: keys, start, end, n. Intervals that touch are merged; with gap they must overlap by at least so much.

    A hot key is no window of its own: intervals are merged within tiles of its axis, and from tile to tile only goes
    how far the earlier ones reach.
    """
    by = [*keys, "_tile"]
    rows = df.select(*keys, F.floor(F.col("start") / TILE).alias("_tile"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    order = Window.partitionBy(*by).orderBy("start", "end")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)

    reach = F.max("end").over(before)
    run = rows.withColumn("_fresh", F.when(reach.isNull() | (F.col("start") > reach - gap), 1).otherwise(0)).withColumn("_run", F.sum("_fresh").over(upto))
    runs = run.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")

    far = runs.groupBy(*by).agg(F.max("end").alias("_most")).withColumn("_reach", F.max("_most").over(along)).drop("_most")
    met = _with_tiles(runs, far, by)
    reach = F.greatest(F.max("end").over(before), F.col("_reach"))
    met = met.withColumn("_fresh", F.when(reach.isNull() | (F.col("start") > reach - gap), 1).otherwise(0)).withColumn("_run", F.sum("_fresh").over(upto))
    # a run that is not fresh and has none before it in its tile goes with the last fresh one of an earlier tile
    made = met.groupBy(*by).agg(F.sum("_fresh").alias("_made")).withColumn("_last", F.last(F.when(F.col("_made") > 0, F.struct("_tile", F.col("_made").alias("_run"))), ignorenulls=True).over(along)).drop("_made")
    found = _with_tiles(met, made, by)
    island = F.when(F.col("_run") > 0, F.struct("_tile", "_run")).otherwise(F.col("_last"))
    return found.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_island")


def covered_length(df: DataFrame, *keys: str) -> DataFrame:
    return union(df, *keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def _followed(steps: DataFrame, keys: list[str], *sums: str) -> DataFrame:
    """steps (keys, pos and others, a row for each place) with next, the place after, and the running sums of columns in their place.

    Windows run within tiles; between tiles go their first places and sums.
    """
    by = [*keys, "_tile"]
    rows = steps.withColumn("_tile", F.floor(F.col("pos") / TILE))
    along = Window.partitionBy(*keys).orderBy("_tile")
    tiles = rows.groupBy(*by).agg(F.min("pos").alias("_first"), *[F.sum(c).alias(f"_{c}") for c in sums])
    tiles = tiles.withColumns({"_then": F.lead("_first").over(along)} | {f"_{c}": F.sum(f"_{c}").over(along.rowsBetween(Window.unboundedPreceding, -1)) for c in sums}).drop("_first")
    order = Window.partitionBy(*by).orderBy("pos")
    met = _with_tiles(rows, tiles, by)
    totals = {c: F.sum(c).over(order) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}
    return met.withColumns({"next": F.coalesce(F.lead("pos").over(order), F.col("_then"))} | totals).select(*steps.columns, "next")


def depth(df: DataFrame, *keys: str) -> DataFrame:
    """Step function of how many intervals cover each place: keys, start, end, depth > 0."""
    marks = df.select(*keys, F.col("start").alias("pos"), F.lit(1).alias("depth")).unionByName(df.select(*keys, F.col("end").alias("pos"), F.lit(-1).alias("depth")))
    steps = marks.groupBy(*keys, "pos").agg(F.sum("depth").alias("depth"))
    return _followed(steps, list(keys), "depth").filter("depth > 0").select(*keys, F.col("pos").alias("start"), F.col("next").alias("end"), "depth")


def intersections(families: DataFrame, width: int) -> DataFrame:
    """fam_a < fam_b, shared: bases covered by both families, for pairs that share any.

    families: family_id, contig, start, end. Each family is merged first, then runs are joined by overlap,
    so pairs that share nothing are never formed.
    """
    runs = union(families, "family_id", "contig")
    a = runs.select("contig", F.col("family_id").alias("fam_a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = runs.select("contig", F.col("family_id").alias("fam_b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = overlap_join(a, b, width, ("contig", "a_start", "a_end"), ("contig", "b_start", "b_end"), F.col("fam_a") < F.col("fam_b"))
    return met.groupBy("fam_a", "fam_b").agg(F.sum(overlap_length(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))).alias("shared"))


def family_edges(families: DataFrame, width: int, least: float = 0.05) -> DataFrame:
    """src, dst, weight: from the smaller family by shared / smaller, and back by shared / larger, each if it reaches least."""
    size = covered_length(families, "family_id", "contig").groupBy("family_id").agg(F.sum("covered").alias("len"))
    pairs = intersections(families, width)
    both = pairs.join(size.select(F.col("family_id").alias("fam_a"), F.col("len").alias("len_a")), "fam_a").join(size.select(F.col("family_id").alias("fam_b"), F.col("len").alias("len_b")), "fam_b")
    a_first = (F.col("len_a") < F.col("len_b")) | ((F.col("len_a") == F.col("len_b")) & (F.col("fam_a") < F.col("fam_b")))
    both = both.select(F.when(a_first, F.col("fam_a")).otherwise(F.col("fam_b")).alias("short"), F.when(a_first, F.col("fam_b")).otherwise(F.col("fam_a")).alias("long"), (F.col("shared") / F.least("len_a", "len_b")).alias("upper"), (F.col("shared") / F.greatest("len_a", "len_b")).alias("lower"))
    forth = both.filter(F.col("upper") >= least).select(F.col("short").alias("src"), F.col("long").alias("dst"), F.col("upper").alias("weight"))
    back = both.filter((F.col("upper") >= least) & (F.col("lower") >= least)).select(F.col("long").alias("src"), F.col("short").alias("dst"), F.col("lower").alias("weight"))
    return forth.unionByName(back)


def overlay(segments: DataFrame, width: int, *keys: str) -> DataFrame:
    """Where segments (keys, seg_id, ord, start, end) overlap the one with the larger ord shows: keys, start, end, seg_id."""
    ends = segments.select(*keys, F.col("start").alias("pos")).union(segments.select(*keys, F.col("end").alias("pos"))).distinct()
    pieces = _followed(ends, list(keys)).withColumnRenamed("next", "stop").filter("stop is not null")
    a = pieces.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor((F.col("stop") - 1) / width))))
    b = binned(segments, "start", "end", width)
    met = a.join(b, [*keys, "_bin"]).filter((F.col("start") < F.col("stop")) & (F.col("pos") < F.col("end")))
    return met.groupBy(*keys, "pos", "stop").agg(F.max(F.struct("ord", "seg_id"))["seg_id"].alias("seg_id")).select(*keys, F.col("pos").alias("start"), F.col("stop").alias("end"), "seg_id")
