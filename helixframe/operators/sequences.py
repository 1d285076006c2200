"""Filters, windows, fragments and statistics of sequences (id, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import col, letters
from .tiles import pieces


def statistics(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: counts, lengths, G+C share, N50 and N50 as older reports count it.

    Lengths are brought to one row per distinct length before they are ordered, so the
    cumulative sum runs over those only. n50: the largest length such that sequences of at
    least it hold half of all letters; n50_compat: one element further, 0 if there is none.
    """
    sizes = seqs.select(F.length(seq).cast("long").alias("len"), letters(seq, "gc").cast("long").alias("gc"), letters(seq, "acgt").cast("long").alias("acgt"))
    per_length = sizes.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum("gc").alias("gc"), F.sum("acgt").alias("acgt"))
    down = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = per_length.withColumns({"before": F.coalesce(F.sum(F.col("len") * F.col("n")).over(down), F.lit(0)), "all": F.sum(F.col("len") * F.col("n")).over(every)})
    half = F.floor(F.col("all") / 2)
    reached = F.col("before") + F.col("len") * F.col("n") >= F.col("all") / 2
    later = (F.col("before") + F.col("len") * (F.col("n") - 1) >= half) & ((F.col("before") > 0) | (F.col("n") > 1))
    return summed.agg(
        F.sum("n").alias("n_seqs"),
        F.sum(F.col("len") * F.col("n")).alias("size"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        F.try_divide(F.sum(F.col("len") * F.col("n")), F.sum("n")).alias("mean_len"),
        (F.try_divide(F.sum("gc"), F.sum("acgt")) * 100).alias("gc_percent"),
        F.coalesce(F.max(F.when(reached, F.col("len"))), F.lit(0)).alias("n50"),
        F.coalesce(F.max(F.when(later, F.col("len"))), F.lit(0)).alias("n50_compat"),
    )


def longer_than(seqs: DataFrame, least: int = 2500, strict: bool = True, seq: str = "seq") -> DataFrame:
    n = F.length(seq)
    return seqs.filter(n > least if strict else n >= least)


def split_windows(seqs: DataFrame, window: int = 5000, least: int = 2500, id_: str = "id", seq: str = "seq") -> DataFrame:
    """Windows of a fixed length, the last one with what remains; sequences under two windows stay whole.

    One pass over a sequence, whatever its length; ``tiles.split_windows`` takes sequences that are no single rows.
    """
    n = F.length(seq)
    # the last window is the one behind which nothing but less than a window is left
    runs = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{{window}}}(?:.{{0,{window - 1}}}\\z)?"), F.lit(0))
    each = seqs.filter(n >= least).select(F.col(id_), F.posexplode(F.when(n < 2 * window, F.array(F.col(seq))).otherwise(runs)).alias("_i", "_part"), (n < 2 * window).alias("_whole"))
    start = F.col("_i").cast("long") * window
    end = start + F.length("_part")
    name = F.when(F.col("_whole"), F.col(id_).cast("string")).otherwise(F.concat_ws("", F.col(id_).cast("string"), F.lit("_"), start.cast("string"), F.lit("-"), end.cast("string")))
    return each.select(name.alias("id"), start.alias("start"), end.cast("long").alias("end"), F.col("_part").alias("seq"))


def fragments(seqs: DataFrame, size: int = 40, id_: str = "id", seq: str = "seq") -> DataFrame:
    """Under 20 letters nothing, up to 85 the sequence without its first five, above that full pieces of ``size``."""
    n = F.length(seq)
    full = F.filter(pieces(F.col(seq), size), lambda x: F.length(x) == size)
    each = seqs.filter(n >= 20).select(F.col(id_).alias("id"), F.posexplode(F.when(n <= 85, F.array(F.substr(F.col(seq), F.lit(6)))).otherwise(full)).alias("_i", "seq"), (n <= 85).alias("_short"))
    return each.select("id", F.when(F.col("_short"), F.lit(5)).otherwise(F.col("_i").cast("long") * size).cast("long").alias("start"), "seq")


def phylip(alignment: DataFrame, id_: str = "id", seq: str = "seq") -> DataFrame:
    """Lines of a PHYLIP file: a header with count and width, then ten-letter names and rows. Unequal widths raise."""
    head = alignment.agg(F.count(F.lit(1)).alias("n"), F.min(F.length(seq)).alias("least"), F.max(F.length(seq)).alias("most"))
    fit = F.when(F.col("least") == F.col("most"), F.concat_ws(" ", F.col("n").cast("string"), F.col("most").cast("string"))).otherwise(F.raise_error(F.concat(F.lit("rows differ in length: "), F.col("least").cast("string"), F.lit(" to "), F.col("most").cast("string"))))
    rows = alignment.select(F.lit(1).alias("kind"), F.col(id_).cast("string").alias("id"), F.concat(F.rpad(F.col(id_).cast("string"), 10, " "), col(seq)).alias("line"))
    return head.filter("n > 0").select(F.lit(0).alias("kind"), F.lit("").alias("id"), fit.alias("line")).unionByName(rows)


def consensus(alignment: DataFrame, key: str = "family_id", seq: str = "seq", least_quality: int = 42) -> DataFrame:
    """Most frequent letter of each column of a group's equally long rows, with a Phred-like quality; weak columns in lower case."""
    letter = alignment.select(key, F.posexplode(F.split(F.upper(seq), "")).alias("pos", "letter")).filter("letter <> ''")
    counts = letter.groupBy(key, "pos", "letter").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key, "pos").agg(F.max(F.struct("n", (-F.ascii("letter")).alias("first"), "letter")).alias("best"), F.sum("n").alias("depth"))
    error = 1 - F.col("best.n") / (F.col("depth") + 1.0)
    quality = F.least(F.lit(93), F.floor(-10 * F.log10(error)))
    votes = best.select(key, "pos", F.col("best.letter").alias("letter"), quality.cast("int").alias("quality"), "depth")
    shown = F.when(F.col("quality") >= least_quality, F.col("letter")).otherwise(F.lower("letter"))
    return votes.withColumn("shown", shown)


def first_record(seqs: DataFrame, order: str) -> DataFrame:
    """The record that comes first in an order; one number reaches the rows that are compared."""
    first = seqs.agg(F.min(order).alias(order))
    return seqs.join(F.broadcast(first), order)  # one row


def runs_of_equal(rows: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """rows with run: a number that rises within keys whenever value differs from the row before."""
    along = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.lag(value).over(along) == F.col(value), 0).otherwise(1)
    numbered = rows.withColumn("_fresh", fresh)
    return numbered.withColumn("run", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
