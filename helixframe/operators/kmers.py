"""k-mer tables in long form: one row per sequence and k-mer, never a dense 4^k array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.sequence import kmer_code
from . import letters
from .ordered import written
from .tiles import pieces


def occurrences(seqs: DataFrame, k: int, id_: str = "id", seq: str = "seq") -> DataFrame:
    """id, kmer, pos of every window without a letter outside ACGT."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in letters.portions(batches, 1, 1 << 20):
            found, owner, first = letters.joined(batch.column(1))
            at = letters.windows(found, owner, k)
            of = owner[at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), letters.words(letters.codes(found, at, k), k), pa.array((at - first[of]).astype(np.int32))], ["id", "kmer", "pos"])

    rows = seqs.select(F.col(id_).alias("id"), seq)
    return rows.mapInArrow(find, StructType([rows.schema["id"], StructField("kmer", StringType()), StructField("pos", IntegerType())]))


#: Letters of a long record that are counted at a time.
MOST = 4 << 20


def tallied(found: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and count of the k-mers of each row."""
    if len(found) >= MOST + k:
        parts = [tallied(found[s : s + MOST + k - 1], owner[s : s + MOST + k - 1], k) for s in range(0, len(found), MOST)]
        of, own, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((own, of))
        of, own, n = of[order], own[order], n[order]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1]))) if len(own) else np.empty(0, np.int64)
        return of[first], own[first], np.add.reduceat(n, first) if len(first) else n
    at = letters.windows(found, owner, k)
    own, of = letters.codes(found, at, k), owner[at]
    rows = int(of[-1]) + 1 if len(of) else 0
    if rows << 2 * k <= 1 << 22:
        times = np.bincount((of << 2 * k) + own, minlength=1)
        both = np.flatnonzero(times)
        return both >> 2 * k, both & ((1 << 2 * k) - 1), times[both]
    order = np.lexsort((own, of))
    own, of = own[order], of[order]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1]))) if len(own) else np.empty(0, np.int64)
    return of[first], own[first], np.diff(np.append(first, len(own)))


def counts(seqs: DataFrame, k: int, id_: str = "id", seq: str = "seq") -> DataFrame:
    """id, kmer, n for each record: windows are counted before they become rows, and nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in letters.portions(batches, 1):
            row, number, n = tallied(*letters.joined(batch.column(1))[:2], k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), letters.words(number, k), pa.array(n.astype(np.int64))], ["id", "kmer", "n"])

    rows = seqs.select(F.col(id_).alias("id"), seq)
    return rows.mapInArrow(count, StructType([rows.schema["id"], StructField("kmer", StringType()), StructField("n", LongType())]))


def total_weights(table: DataFrame) -> DataFrame:
    """kmer, weight: the sum of a k-mer's frequencies over all sequences."""
    return frequencies(table).groupBy("kmer").agg(F.sum("freq").alias("weight"))


def sequence_matrix(table: DataFrame, n_seqs: int, low: int = 1, high: float = 0.5) -> DataFrame:
    """k-mers by sequences (i, j, v): frequencies of the k-mers that occur in at least low sequences and at most a share of them."""
    kept = in_band(table, n_seqs, low, high).select("kmer")
    return frequencies(table).join(kept, "kmer", "left_semi").select(F.col("kmer").alias("i"), F.col("id").alias("j"), F.col("freq").alias("v"))


def frequencies(table: DataFrame) -> DataFrame:
    """Counts as shares of their sequence's sum. The k-mers of a sequence are at most 4^k rows."""
    return table.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("id")))


def count_statistics(table: DataFrame, k: int, p: float = 0.95, fill: bool = False) -> DataFrame:
    """Mean, sample deviation and percentile of a sequence's k-mer counts, over its length in k-mers.

    fill: k-mers that don't occur count as zeros in mean and deviation (in closed form).
    The percentile is over cumulated counts: the count at which so much of their sum is reached, linear
    between neighbours.
    """
    up = Window.partitionBy("id").orderBy("n", "kmer").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("id").orderBy("n", "kmer")
    rows = table.withColumns({"r": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy("id")), "c_lo": F.lag("n").over(back)})
    rows = rows.withColumn("t", F.floor(F.col("total") * F.lit(p))).withColumn("r_lo", F.col("r") - F.col("n"))
    hit = F.when((F.col("r") >= F.col("t")) & (F.col("r_lo") < F.col("t")) | F.col("c_lo").isNull() & (F.col("t") <= F.col("r")), F.when((F.col("r") == F.col("t")) | F.col("c_lo").isNull(), F.col("n").cast("double")).otherwise((F.col("c_lo") * (F.col("r") - F.col("t")) + F.col("n") * (F.col("t") - F.col("r_lo"))) / F.col("n")))
    m = F.lit(float(4**k)) if fill else F.count(F.lit(1)).cast("double")
    s, ss = F.sum("n").cast("double"), F.sum((F.col("n") * F.col("n")).cast("double"))
    total = F.max("total")
    return rows.groupBy("id").agg(
        total.alias("n_kmers"),
        F.count(F.lit(1)).alias("distinct_kmers"),
        (s / m / total).alias("mean"),
        F.when(m > 1, F.sqrt(F.greatest(F.lit(0.0), ss - s * s / m) / (m - 1)) / total).alias("stdev"),
        (F.min(hit) / total).alias("percentile"),
    )


def windows(seqs: DataFrame, chunk: int, compat: bool = False, id_: str = "id", seq: str = "seq") -> DataFrame:
    """Full windows of chunk letters, in one pass; compat leaves out a window's first letter and a window that ends with the sequence."""
    full = F.filter(pieces(F.col(seq), chunk), lambda x: F.length(x) == chunk)
    if compat:
        full = F.when(F.length(seq) % chunk == 0, F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0)))).otherwise(full)
    cut = seqs.select(F.col(id_).alias("id"), F.posexplode(full).alias("_i", "seq"))
    return cut.select("id", (F.col("_i").cast("long") * chunk).alias("start"), F.substr(F.col("seq"), F.lit(2)).alias("seq") if compat else "seq")


def euclidean(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Distance of two frequency tables (keys, kmer, freq) that share keys; a k-mer missing on one side is 0 there.

    From sums instead of an outer join: |a|^2 + |b|^2 - 2 a.b, each map-side combined.
    """
    sign = a.select(*keys, "kmer", "freq", F.lit(1).alias("side")).unionByName(b.select(*keys, "kmer", "freq", F.lit(-1).alias("side")))
    gap = sign.groupBy(*keys, "kmer").agg(F.sum(F.col("freq") * F.col("side")).alias("gap"))
    return gap.groupBy(*keys).agg(F.sqrt(F.sum(F.col("gap") * F.col("gap"))).alias("distance"))


def in_band(table: DataFrame, n_seqs: int, low: int = 1, high: float = 0.5) -> DataFrame:
    """k-mers that occur in at least low sequences and at most a share of them."""
    seen = table.groupBy("kmer").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))
    return seen.filter((F.col("n_docs") >= low) & (F.col("n_docs") / F.lit(float(n_seqs)) <= high))


#: Cells of the table of places by k-mers that a task holds.
CELLS = 1 << 22


def place_counts(seqs: DataFrame, k: int, id_: str = "id", seq: str = "seq") -> DataFrame:
    """kmer, pos, n_docs, n: distinct sequences with the k-mer there, and occurrences.

    A sequence has one k-mer at a place, so those whose id occurs once are counted within tasks before they become rows;
    only those that share an id, or have none, go on as single occurrences.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)

        def rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(key), 1 << 18):
                own = key[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([letters.words(own & ((1 << 2 * k) - 1), k), pa.array((own >> 2 * k).astype(np.int32)), pa.array(n[i : i + (1 << 18)].astype(np.int64))], ["kmer", "pos", "n"])

        for batch in letters.portions(batches, 0):
            found, owner, first = letters.joined(batch.column(0))
            at = letters.windows(found, owner, k)
            key = ((at - first[owner[at]]) << 2 * k) + letters.codes(found, at, k)
            near = np.bincount(key[key < CELLS], minlength=len(held))
            near[: len(held)] += held
            held = near
            yield from rows(*np.unique(key[key >= CELLS], return_counts=True))
        yield from rows(np.flatnonzero(held), held[held > 0])

    each = lambda rows: occurrences(rows, k).groupBy("kmer", "pos").agg(F.count_distinct("id").alias("n_docs"), F.count(F.lit(1)).alias("n"))
    all_ = seqs.select(F.col(id_).alias("id"), F.col(seq).alias("seq"))
    if k > 16:  # a longer one and its place have no common 64-bit number
        return each(all_)
    shared = written(all_.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select("id"), "shared-ids")
    single = all_.filter("id is not null").join(shared, "id", "left_anti").select("seq")
    made = single.mapInArrow(count, "kmer string, pos int, n long").withColumn("n_docs", F.col("n"))
    if not shared.isEmpty():
        made = made.unionByName(each(all_.filter("id is null").unionByName(all_.join(shared, "id", "left_semi"))))
    return made.groupBy("kmer", "pos").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def position_matrix(counted: DataFrame, low: int = 1, high: float = 0.9) -> DataFrame:
    """kmer, pos, n_docs of ``place_counts``.

    k-mers with at least low occurrences and at most ``high`` of the largest position;
    then places with at least low sequences.
    """
    each = written(counted, "place-counts")
    last = F.lit(each.agg(F.max("pos")).first()[0])
    kept = each.groupBy("kmer").agg(F.sum("n").alias("times")).filter((F.col("times") >= low) & (F.try_divide(F.col("times"), last) <= high))
    return each.join(kept.select("kmer"), "kmer").filter(F.col("n_docs") >= low).select("kmer", "pos", "n_docs")


def chaos_cells(found: DataFrame, k: int, diagonal: bool = True) -> DataFrame:
    """x, y of each k-mer in the square of the chaos game: A lower left, C upper left, G upper right, T lower right.

    Not diagonal: T upper right and G lower right.
    """
    right, upper = ("GT", "CG") if diagonal else ("GT", "CT")
    bit = lambda which: F.aggregate(F.split("kmer", ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 2 + F.when(c.isin(*which), 1).otherwise(0)))
    return found.select("*", bit(right).alias("x"), bit(upper).alias("y"))


def rainbow(table: DataFrame, k: int) -> DataFrame:
    """id, x, y, h, s, v: a row of cells in which a k-mer's place gives the hue and its share of the most frequent one's count the value."""
    most = table.groupBy("id").agg(F.max("n").alias("_most"))
    x = kmer_code("kmer")
    return table.join(most, "id").select("id", x.cast("int").alias("x"), F.lit(0).alias("y"), (x / F.lit(float(4**k))).alias("h"), F.lit(1.0).alias("s"), (F.col("n") / F.col("_most")).alias("v"))
