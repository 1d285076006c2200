"""Position weight matrices: from alignments, and over sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.sequence import reverse_complement
from . import letters


def column_counts(alignment: DataFrame, seq: str = "seq") -> DataFrame:
    """pos, A, C, G, T of an alignment's rows."""
    each = alignment.select(F.posexplode(F.split(F.upper(seq), "")).alias("pos", "base")).filter("base <> ''")
    return each.groupBy("pos").agg(*[F.count_if(F.col("base") == b).alias(b) for b in "ACGT"])


def scan(seqs: DataFrame, matrix: list[list[float]], least: float = 0.9, id_: str = "id", seq: str = "seq") -> DataFrame:
    """id, start, end, strand, score, word of windows that reach a share of the matrix's best sum, on both strands.

    matrix: rows of weights for A, C, G, T. Windows with other letters score nothing there. Only hits become rows.
    """
    width, top = len(matrix), sum(max(r) for r in matrix)
    backward = [[r[3], r[2], r[1], r[0]] for r in reversed(matrix)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in letters.portions(batches, 1):
            found, owner, first = letters.joined(batch.column(1))
            n = len(found) - width + 1
            if n < 1:
                continue
            number, within = letters.NUMBER[found], owner[:n] == owner[width - 1 :]
            for strand, rows in ((1, matrix), (-1, backward)):
                score = np.zeros(n)
                for p, row in enumerate(rows):
                    score += np.array([*row, 0.0])[number[p : p + n]]
                at = np.flatnonzero(within & (score >= (least - 1e-6) * top))
                of = owner[at]
                word = letters.spelled(found[at[:, None] + np.arange(width)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(at - first[of]), pa.array(np.full(len(at), strand, np.int32)), pa.array(score[at]), word], ["id", "start", "strand", "total", "word"])

    rows = seqs.select(F.col(id_).alias("id"), seq)
    kinds = StructType([rows.schema["id"], StructField("start", LongType()), StructField("strand", IntegerType()), StructField("total", DoubleType()), StructField("word", StringType())])
    score = F.round(F.col("total") / F.lit(top), 9)
    word = F.when(F.col("strand") == -1, reverse_complement("word")).otherwise(F.col("word"))
    return rows.mapInArrow(find, kinds).select("id", "start", (F.col("start") + width).alias("end"), "strand", score.alias("score"), word.alias("word")).filter(F.col("score") >= least)
