"""Annotation of features by masked repeats: maps, shares and coverage of consensus sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import union

CELLS = 20


def parsed_repeat(value: Column) -> Column:
    """Struct of a repeat attribute: name, class and consensus left (0-based), right, remains; a dot is null."""
    part = F.split(value, " ")
    number = lambda i: F.nullif(F.get(part, F.lit(i)), F.lit(".")).cast("int")
    whole = F.when(F.size(part) < 2, F.raise_error(F.concat(F.lit("no repeat in: "), value)).cast("string")).otherwise(part[0])
    return F.struct(whole.alias("name"), F.get(part, F.lit(1)).alias("class"), (number(2) - 1).alias("left"), number(3).alias("right"), number(4).alias("remains"))


def consensus_place(t_start: Column, t_end: Column, r_start: Column, r_end: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """The part of the consensus that a target shows: the record's, less what sticks out of the target."""
    return left + F.greatest(F.lit(0), t_start - r_start), right + F.least(F.lit(0), t_end - r_end)


def masked_shares(matches: DataFrame) -> DataFrame:
    """t_id, s_id, masked_percent (of the record's consensus part), element_percent (of the whole element).

    matches: t_id, s_id, t_start, t_end, s_start, s_end, left, right, remains.
    """
    start, end = consensus_place(F.col("t_start"), F.col("t_end"), F.col("s_start"), F.col("s_end"), F.col("left"), F.col("right"))
    known = matches.filter("left is not null and right > left")
    return known.select("t_id", "s_id", (100.0 * (end - start) / (F.col("right") - F.col("left"))).alias("masked_percent"), (100.0 * (end - start) / (F.col("right") + F.col("remains"))).alias("element_percent"))


def consensus_coverage(matches: DataFrame) -> DataFrame:
    """name, start, end: runs of each repeat's consensus that targets cover."""
    start, end = consensus_place(F.col("t_start"), F.col("t_end"), F.col("s_start"), F.col("s_end"), F.col("left"), F.col("right"))
    return union(matches.filter("left is not null and right >= left").select("name", start.alias("start"), end.alias("end")).filter("end > start"), "name")


def coverage_bars(runs: DataFrame, lengths: DataFrame, cells: int = 40) -> DataFrame:
    """name, bar: a run [s, e) fills the cells from int(s * scale) to int(e * scale) - 1. lengths: name, len."""
    scale = F.lit(float(cells)) / F.col("len")
    filled = runs.join(lengths, "name").select("name", F.floor(F.col("start") * scale).cast("int").alias("a"), F.floor(F.col("end") * scale).cast("int").alias("z"))
    spans = filled.groupBy("name").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    cell = lambda i: F.when(F.exists("spans", lambda x: (x["a"] <= i) & (i < x["z"])), F.lit("#")).otherwise(F.lit("-"))
    return spans.select("name", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), cell), "").alias("bar"))


def _ranked(matches: DataFrame, strict_margin: bool) -> DataFrame:
    """t_id, found: a target's matches (at most eight, by the join's bound) in rank order, each with its cells [a, z), whether the consensus begins
    or ends near them, and its text."""
    t_start, t_end, s_start, s_end, left, right, remains = (F.col(c) for c in ("t_start", "t_end", "s_start", "s_end", "left", "right", "remains"))
    cell = lambda x: F.floor((x - t_start) * (F.lit(float(CELLS)) / (t_end - t_start)) + 0.5).cast("int")
    a, z = cell(F.greatest(s_start, t_start)), cell(F.least(s_end, t_end))
    minus = F.col("strand") == -1
    start, end = consensus_place(t_start, t_end, s_start, s_end, left, right)
    size = F.when(end + remains == 0, 1).otherwise(end + remains).cast("double")
    near_end = (1 - end / size if strict_margin else end / size) <= 1.0 / CELLS
    known = left.isNotNull() & right.isNotNull() & remains.isNotNull()
    sides = (F.when(minus, CELLS - z).otherwise(a).alias("a"), F.when(minus, CELLS - a).otherwise(z).alias("z"))
    percent = lambda whole: F.coalesce(F.rint(F.try_divide(F.least(s_end, t_end) - F.greatest(s_start, t_start), whole) * 100).cast("long").cast("string"), F.lit("NaN"))
    shares = F.when(left.isNotNull(), F.concat(F.lit("("), percent(s_end - s_start), F.lit("%|"), percent(right + remains), F.lit("%)"))).otherwise("")
    text = F.concat(F.lit(" "), F.col("name") if "name" in matches.columns else F.lit(""), shares)
    one = F.struct("rank", *sides, (known & (start / size <= 1.0 / CELLS)).alias("first"), (known & near_end).alias("last"), text.alias("text"))
    return matches.groupBy("t_id").agg(F.sort_array(F.collect_list(one)).alias("found"))


def _map(found: Column) -> Column:
    letter = lambda m, i: F.struct(m["a"].alias("a"), m["z"].alias("z"), F.coalesce(m["first"], F.lit(False)).alias("first"), F.coalesce(m["last"], F.lit(False)).alias("last"), F.char(F.lit(97) + i).alias("low"))
    at = lambda c: F.try_element_at(F.filter(F.transform(found, letter), lambda m: (m["a"] <= c) & (c < m["z"])), F.lit(-1))

    def cell(c: Column) -> Column:
        m = at(c)
        up = ((c == m["a"]) & m["first"]) | ((c == m["z"] - 1) & m["last"])
        return F.coalesce(F.when(up, F.upper(m["low"])).otherwise(m["low"]), F.lit("-"))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell), "")


def annotation_maps(matches: DataFrame, strict_margin: bool = False) -> DataFrame:
    """t_id, map: twenty cells along each target with a letter for each match in rank order.

    A match's first cell is in upper case if the consensus begins within a twentieth of its
    start, its last one if it ends near the end; later matches show over earlier ones. matches: t_id, rank, strand,
    t_start, t_end, s_start, s_end, left, right, remains.
    """
    return _ranked(matches, strict_margin).select("t_id", _map(F.col("found")).alias("map"))


def annotation_texts(targets: DataFrame, matches: DataFrame, strict_margin: bool = False) -> DataFrame:
    """t_id, text of every target: its map and its matches' names in rank order, in quotes. A target without matches has an empty map.

    A match of known place in its consensus has its overlap with the target in percent of the record and of the
    whole element, halves to even. targets: t_id; matches: as for the maps, with name.
    """
    names = F.array_join(F.transform("found", lambda m: m["text"]), "")
    shown = _ranked(matches, strict_margin).select("t_id", F.concat(F.lit('"'), _map(F.col("found")), names, F.lit('"')).alias("text"))
    return targets.select("t_id").join(shown, "t_id", "left").withColumn("text", F.coalesce("text", F.lit('"' + "-" * CELLS + '"')))
