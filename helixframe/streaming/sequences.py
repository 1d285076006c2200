"""Operators that hold for a stream of sequences as for a table.

Filters and header parsing are stateless; k-mer counts keep one state row for each k-mer
and window. Operators that need a total order (bundles, sub-piles) are not offered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmers import counts
from ..operators.sequences import longer_than
from ..sources.formats import located

__all__ = ["kmer_counts", "located", "longer_than"]


def kmer_counts(seqs: DataFrame, k: int, time: str = "ts", window: str = "1 hour", late: str = "1 hour", seq: str = "seq") -> DataFrame:
    """window, kmer, n of a stream with event times; windows close once the watermark has passed them."""
    found = counts(seqs, k, time, seq).withColumnRenamed("id", time).withWatermark(time, late)
    return found.groupBy(F.window(time, window), "kmer").agg(F.sum("n").alias("n"))
