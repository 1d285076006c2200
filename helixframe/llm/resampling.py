"""Importance resampling towards a target distribution, with hashed n-grams from prefix CRCs.

A text is normalised to its words with one space between them and scanned once; the running
CRC-32 register is kept at every byte. A CRC is linear over GF(2): the register after b bytes, less (xor) that
after a bytes carried over b - a zero bytes, is the register of the bytes between. So the CRC of any n-gram comes
from two prefixes, whatever its length, and no n-gram is ever spelled out.

Features are all runs of 1 to ``longest`` words, repeats counted; a feature's bucket is its CRC modulo ``buckets``. With
s of S features of the documents and t of T of the target texts in a bucket, its gain is
``floor(1000 * ln((t+1)*(S+buckets) / ((s+1)*(T+buckets))))``. A document's weight is the sum of its features' gains; a
Gumbel draw from the seed and its doc_id is added, and the highest ``percent`` of the documents with at least
``shortest`` words are drawn, without replacement.

What is broadcast has ``buckets`` numbers. Null, empty and wordless texts have no feature and weight 0. Repeated rows
count in the sums, are drawn and ranked each for itself, and share their draw's random part, as equal doc_ids do; a null doc_id
is drawn by the seed alone and ranks before the others on a tie. Ties go to the smaller doc_id, then to the row with fewer features.
Very long texts are read whole, a bounded size of texts at a time. Empty tables give an empty result (documents) or T = 0
(target). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of words, in lower case; all others are separators.
WORD_BYTES = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PORTION = 2 << 20


def byte_table() -> np.ndarray:
    """What eight steps of the reflected polynomial make of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


BYTE = byte_table()
#: Registers of which one byte is set, by its place.
UNITS = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)])


def applied(operator: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """A linear map of registers, given as its values for each byte of each of the four places."""
    return operator[0][registers & 255] ^ operator[1][registers >> np.uint32(8) & 255] ^ operator[2][registers >> np.uint32(16) & 255] ^ operator[3][registers >> np.uint32(24)]


def zero_powers(bits: int = 32) -> list[np.ndarray]:
    """The maps that carry a register over 1, 2, 4, ... zero bytes."""
    powers = [BYTE[UNITS & 255] ^ (UNITS >> np.uint32(8))]
    while len(powers) < bits:
        powers.append(applied(powers[-1], powers[-1]))
    return powers


POWERS = zero_powers()


def carried(registers: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes each."""
    out = registers.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> k & 1)
        out[at] = applied(POWERS[k], out[at])
    return out


def running(stream: np.ndarray) -> np.ndarray:
    """The register (from 0) before each byte and after the last, in lanes that are scanned side by side.

    The first scan gives what each lane adds; carried over the lanes, that is where the second one starts each of them.
    """
    lanes = int(len(stream) ** 0.5) + 1
    wide = -(-len(stream) // lanes)
    rows = np.zeros(lanes * wide, np.uint8)
    rows[: len(stream)] = stream
    rows = np.ascontiguousarray(rows.reshape(lanes, wide).T)
    state = np.zeros(lanes, np.uint32)
    for row in rows:
        state = BYTE[(state ^ row) & 255] ^ (state >> np.uint32(8))
    a, b, c, d = carried(UNITS.ravel(), np.full(UNITS.size, wide)).reshape(UNITS.shape).tolist()  # over a lane's bytes
    at, starts = 0, [0]
    for added in state[:-1].tolist():
        at = a[at & 255] ^ b[at >> 8 & 255] ^ c[at >> 16 & 255] ^ d[at >> 24] ^ added
        starts.append(at)
    start = np.array(starts, np.uint32)
    out = np.empty((wide + 1, lanes), np.uint32)
    out[0] = state = start
    for k, row in enumerate(rows):
        out[k + 1] = state = BYTE[(state ^ row) & 255] ^ (state >> np.uint32(8))
    return np.append(out[:-1].T.ravel(), out[-1, -1])[: len(stream) + 1]


class Scan:
    """The words of texts in one normalised stream, and its prefix CRCs."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.fill_null("").cast(pa.large_string())
        begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        raw = np.frombuffer((whole.to_pybytes() if whole else b"")[begin[0] : begin[-1]].translate(WORD_BYTES), np.uint8)
        inside = raw != 32
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[(begin - begin[0])[:-1][np.diff(begin) > 0]] |= inside[(begin - begin[0])[:-1][np.diff(begin) > 0]]
        first = np.flatnonzero(opens)
        self.texts, self.owner = len(texts), np.searchsorted(begin - begin[0], first, "right") - 1
        word = np.cumsum(opens, dtype=np.int32)[inside] - 1
        self.length = np.bincount(word, minlength=len(first))
        self.start = np.cumsum(self.length + 1) - self.length - 1
        stream = np.full(len(word) + len(first), 32, np.uint8)
        stream[np.arange(len(word), dtype=np.int32) + word] = raw[inside]
        self.before = running(stream)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The CRC-32 of every run of n words, and its text."""
        at = np.arange(max(0, len(self.owner) - n + 1))
        at = at[self.owner[at] == self.owner[at + n - 1]]
        a, b = self.start[at], self.start[at + n - 1] + self.length[at + n - 1]
        return ~(self.before[b] ^ carried(~self.before[a], b - a)), self.owner[at]

    def features(self, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all features, and their texts in order."""
        found = [self.grams(n) for n in range(1, longest + 1)]
        bucket, owner = np.concatenate([c for c, _ in found]).astype(np.int64) % buckets, np.concatenate([o for _, o in found])
        order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
        return bucket[order], owner[order]


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """bucket, n: the features of all texts, summed within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in common.portions(batches, 0, PORTION):
            n += np.bincount(Scan(b.column(0)).features(longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    return common.plain(texts, "text").mapInArrow(common.trimmed(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """The gain of each bucket."""

    def counted(texts: DataFrame) -> np.ndarray:
        n = np.zeros(buckets, np.int64)
        for row in bucket_counts(texts, longest, buckets).collect():  # a row for each bucket at most
            n[row["bucket"]] = row["n"]
        return n

    s, t = counted(docs).astype(float), counted(target).astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_features, n_words and weight of every document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in common.portions(batches, 1, PORTION):
            scan = Scan(b.column(1))
            bucket, owner = scan.features(longest, len(own))
            sums = np.append(0, np.cumsum(own[bucket]))
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1))
            words = np.bincount(scan.owner, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (np.diff(ends), words, np.diff(sums[ends])))], ["doc_id", "n_features", "n_words", "weight"])

    return common.plain(docs, "doc_id", "text").mapInArrow(common.trimmed(weigh), "doc_id long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, shortest: int = 20, seed: int = 2024) -> DataFrame:
    """Every document with doc_id, n_features, weight, score and, of those drawn, rank."""
    scores = weighed(docs, gains(docs, target, longest, buckets), longest)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = common.materialise(scores.withColumn("score", F.col("weight") + gumbel), "resampling-scores")
    may = F.col("n_words") >= shortest
    rows = scored.filter(may).count() * percent // 100
    placed = common.ranked(scored.filter(may), [F.col("score").desc(), F.col("doc_id"), F.col("n_features")], "resampling-ranks")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= rows, F.col("rank")))
    rest = scored.filter(~may).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
