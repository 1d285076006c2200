"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing (tests on one machine) a temporary folder is
    used; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folders for intermediate tables in the order in which they were named.
MADE: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    MADE.append(f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}")
    return MADE[-1]


def drop_scratch(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Remove the intermediate tables that this process has named, but for some; what is still to be read from them is lost."""
    for path in [p for p in MADE if p not in keep]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        MADE.remove(path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    Cuts the lineage; what was written survives lost executors and makes every
    later read see the same rows.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, n: int) -> None:
    """Rows of an Arrow batch; texts are long, so batches are kept small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column can clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and the next task may need it elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What operators keep in a worker between tasks, by operator: workers are reused by later stages.
CACHES: dict[str, Callable[[], None]] = {}


def forget(but: str = "") -> None:
    """Drop what other operators have kept in this worker."""
    for name, clear in CACHES.items():
        if name != but:
            clear()


def trimmed(work: Callable[[Iterator], Iterator], own: str = "") -> Callable[[Iterator], Iterator]:
    """work over a partition's batches without other operators' caches; gives back its memory at the end."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        forget(own)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def cuts(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Where to cut texts into runs of about so many bytes, one text at least: start and length of each.

    Texts may be very long, so a number of rows bounds nothing.
    """
    lengths = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    part = (np.cumsum(lengths) // size).astype(np.int64)
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return ((a, b - a) for a, b in itertools.pairwise(at) if b > a)


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices with a bounded size of a text column."""
    return (batch.slice(*cut) for batch in batches for cut in cuts(batch.column(column), size))


def worded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space; of all words in order, which one each is and whose text it is from.

    Nulls count as empty.
    """
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    empty = pc.index(coded.dictionary, "").as_py()  # stands at the ends of a text
    if empty >= 0:
        there = codes != empty
        codes, owner = codes[there], owner[there]
    return coded.dictionary, codes, owner


def text_size(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and characters of a table: what partition counts are derived from."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


MIX = np.uint64(0x9E3779B97F4A7C15)


class Spelling:
    """The characters of words, each within < and >, as numbers for hashing many words at once."""

    def __init__(self, words: pa.Array) -> None:
        self.n = len(words)
        text = f"<{pc.binary_join(pa.ListArray.from_arrays([0, self.n], words), '><')[0].as_py()}>" if self.n else ""
        self.chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        length = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
        self.first = np.cumsum(length) - length
        self.owner = np.repeat(np.arange(self.n), length)
        self.rest = length[self.owner] - (np.arange(len(self.chars)) - self.first[self.owner])  # characters up to the word's end
        self.longest = int(length.max(initial=1))

    @staticmethod
    def settled(hashes: np.ndarray) -> np.ndarray:
        hashes ^= hashes >> np.uint64(31)
        return hashes * MIX

    def words(self) -> np.ndarray:
        """A hash of each whole word."""
        powers = np.cumprod(np.full(self.longest, MIX))
        return self.settled(np.add.reduceat(self.chars * powers[self.rest - 1], self.first)) if self.n else np.empty(0, np.uint64)

    def grams(self, size: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every run of so many characters (single ones without the marks), and its word; of: words that count."""
        there = self.rest >= size if size > 1 else (self.rest > 1) & np.append(False, self.rest[:-1] > 1)
        at = np.flatnonzero(there if of is None else there & of[self.owner])
        found = np.full(len(at), np.uint64(size))
        for k in range(size):
            found = found * MIX + self.chars[at + k]
        return self.settled(found), self.owner[at]


def thinned(df: DataFrame, rows: int, chars: int) -> DataFrame:
    """df, or where it has more a sample of at most so many rows and characters of text, in expectation, by a hash of doc_id.

    Rows are counted without their texts, characters only in the sample by rows.
    """
    place, span = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), 1 << 20
    share = min(1.0, rows / max(df.count(), 1))
    if share < 1:
        df = df.filter(place < F.lit(int(span * share)))
    size = text_size(df)[1]
    return df if size <= chars else df.filter(place < F.lit(int(span * share * chars / size)))


def slices(spark: SparkSession, amount: float, each: float, most: int = 100_000) -> int:
    """Partitions for an amount of work at so much each, the session's setting at least."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, int(amount / each) + 1))


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """Write df as a table bucketed by key; a join on the key and others then leaves its rows in place."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    buckets = slices(spark, 2 * df.rdd.getNumPartitions(), 1)
    path = scratch_path(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


def looked_up(table: DataFrame, tag: str, most_rows: int = 100_000) -> DataFrame:
    """A table to be joined by its unique key: written out, and broadcast only up to so many rows.

    Beyond that both sides of the join are shuffled as they are, so Spark can split a
    hot key's rows.
    """
    written = materialise(table, tag)
    return F.broadcast(written) if written.count() <= most_rows else written


def ranked(df: DataFrame, order: list[Column], tag: str, within: tuple[str, ...] = ()) -> DataFrame:
    """df with rank, from 1, in an order of its rows (or of those that share ``within``, which must hold no null).

    Rows are written in ranges of the order; a row's rank is its place in its range and the sizes of the ranges
    before, so no group is brought to one task. A further column of unlike values breaks ties, so that equal rows part.
    """
    own = [*map(F.col, within), *order, F.col("_row")]
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    parts = materialise(numbered.repartitionByRange(*own).withColumn("_part", F.spark_partition_id()), tag)
    sizes = parts.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range and group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select(*within, "_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order, "_row"))
    return parts.withColumn("_place", place).join(first, [*within, "_part"]).withColumn("rank", F.col("_before") + F.col("_place")).select(*df.columns, "rank")
