"""Phrase collocations: the counts of all phrases from those of the longest windows.

Every word opens one window: itself and the words that lead on from it, in columns w1 to w<longest>, null where the piece has
ended. Only these padded windows are counted. ROLLUP over the columns then sums their shorter and shorter prefixes, so the
counts of phrases of every length, of single words and of all words come out of one table, and no shorter n-gram is
ever made a row of its own.

A phrase with ``least`` occurrences holds no shorter run of words with fewer, so a window may be padded before a rarer word and where a
rarer pair or triple of words ends without touching any count that matters. Words, then pairs of words that may be frequent, then such triples, are
counted beforehand by 44-bit hashes; for each a bitmap of ``filter_bits`` bits, whatever the input's size, tells tasks which may be
frequent. What shares a hash or a bit with a frequent one only makes windows longer.

A phrase of 2 to ``longest`` words that occurs ``least`` times is cut after each of its words; with a, l and r occurrences of it and of
the two parts among n words a cut scores floor(1000 * a * n / (l * r)), in exact decimals, and the lowest score counts, of equal ones that of the
first cut. Phrases go that a longer one holds which occurs at least ``covered`` percent as often, even where that one goes, too. Of the rest each lang
reports its ``first`` highest by score, then a, then the phrase's bytes.

Words are what stands between spaces and tabs, in pieces between ``.,;:!?`` and line ends, with A-Z in lower case. A null
text is empty, a null lang is ``und``. Repeated rows count each. Very long texts are read whole, a bounded size of
texts at a time. An empty table, or one without a frequent phrase, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Breaks between pieces become line feeds, tabs spaces, capitals small.
FOLDED = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b | 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of the hashes by which runs of words are counted, and the length of the longest of these runs.
BITS, LEVELS = 44, 3
#: Hashes that a task sums before it hands them on.
HELD = 3_000_000
PORTION = 2 << 20


def folded(texts: pa.Array) -> pa.Array:
    """Texts with a line feed between spaces for every break and no other separator than spaces."""
    texts = texts.fill_null("").cast(pa.large_string())
    whole = texts.buffers()[2]
    data = pa.py_buffer((whole.to_pybytes() if whole else b"").translate(FOLDED))
    same = pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], data, offset=texts.offset)
    return pc.replace_substring(same, "\n", " \n ")


class Words:
    """The words of texts as codes, each with the number of its piece and its text's lang."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        lists = pc.split_pattern(folded(texts), " ")
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        ends = [pc.index(words, s).as_py() for s in ("", "\n")]
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        breaks = codes == ends[1]
        breaks[1:] |= owner[1:] != owner[:-1]
        there = (codes != ends[0]) & (codes != ends[1])
        self.words, self.codes, self.piece = words, codes[there], np.cumsum(breaks, dtype=np.int32)[there]
        kinds = langs.fill_null("und").dictionary_encode()
        self.langs, self.lang = kinds.dictionary, kinds.indices.to_numpy()[owner[there]]
        self.known: dict[int, np.ndarray] = {}
        self.word_hash, self.lang_hash = (common.Spelling(x.cast(pa.string())).words() for x in (words, self.langs))

    def runs(self, size: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places where so many words follow one another of which all shorter runs may be frequent, and hashes of the words and their lang."""
        if size == 1:
            at = np.arange(len(self.codes))
        else:
            there = self.may(size - 1, filters)
            there = there & np.append(there[1:], False)
            at = np.flatnonzero(there & np.append(self.piece[1:] == self.piece[:-1], False) if size == 2 else there)
        found = self.lang_hash[self.lang[at]]
        for k in range(size):
            found = found * common.MIX + self.word_hash[self.codes[at + k]]
        return at, common.Spelling.settled(found) >> np.uint64(64 - BITS)

    def may(self, size: int, filters: list[np.ndarray]) -> np.ndarray:
        """Where something frequent of this size may begin."""
        if size not in self.known:
            at, hashes = self.runs(size, filters)
            cells = filters[size - 1]
            self.known[size] = np.zeros(len(self.codes), bool)
            self.known[size][at] = cells[(hashes >> np.uint64(6)) % np.uint64(len(cells))] >> (hashes & np.uint64(63)) & np.uint64(1) > 0
        return self.known[size]

    def windows(self, longest: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct padded windows as rows of lang and codes (-1 where padded), and how often each occurs."""
        n, on = len(self.codes), self.may(1, filters)
        columns = [self.lang.astype(np.int64), np.where(on, self.codes, -1).astype(np.int64)]
        for k in range(1, longest):
            size = min(k + 1, len(filters))  # the run of words that must be frequent for the window to go on to its k-th next word
            further = np.zeros(n, bool)
            further[: max(0, n - (k + 1 - size))] = self.may(size, filters)[k + 1 - size :]
            on = on & further
            column = np.full(n, -1, np.int64)
            at = np.flatnonzero(on)
            column[at] = self.codes[at + k]
            columns.append(column)
        wide, key = len(self.words) + 1, columns[0]
        for column in columns[1:]:  # numbers of the rows so far, and what follows
            key = np.unique(key * wide + column + 1, return_inverse=True)[1].astype(np.int64)
        _, first, many = np.unique(key, return_index=True, return_counts=True)
        return np.stack([c[first] for c in columns], axis=1), many


def frequent(docs: DataFrame, size: int, least: int, filter_bits: int, filters: list[np.ndarray]) -> np.ndarray:
    """A bitmap in which the runs of so many words that occur so often have their bits set."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    cells = filter_bits // 64

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([np.empty(0, np.uint64), *[c for c, _ in held]]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([np.empty(0), *[n for _, n in held]]), len(codes)).astype(np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's hashes in buckets by their first bits: the others, and how often each occurs."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            codes, n = summed(held)
            held.clear()
            ends = np.searchsorted(codes >> np.uint64(32), np.arange((1 << BITS - 32) + 1, dtype=np.uint64))
            of = np.flatnonzero(np.diff(ends))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[of], ends[of + 1], strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(of), cut(codes.astype(np.uint32)), cut(n.astype(np.uint32))], ["bucket", "codes", "n"])

        for b in common.portions(batches, 0, PORTION):
            held.append(np.unique(Words(b.column(0), b.column(1)).runs(size, sent.value)[1], return_counts=True))
            if sum(len(c) for c, _ in held) > HELD:
                yield dealt()
        yield dealt()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells and bits of what occurs often enough over all tasks."""
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for bucket, codes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(bucket, []).append((np.frombuffer(codes, np.uint32).astype(np.uint64), np.frombuffer(n, np.uint32)))
        often = [np.empty(0, np.uint64)]
        for bucket in list(held):
            codes, n = summed(held.pop(bucket))
            often.append(codes[n >= least] + np.uint64(bucket << 32))
        hashes = np.concatenate(often)
        cell, at = np.unique((hashes >> np.uint64(6)) % np.uint64(cells), return_inverse=True)
        bits = np.zeros(len(cell), np.uint64)
        np.bitwise_or.at(bits, at, np.uint64(1) << (hashes & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(bits.view(np.int64))], ["cell", "bits"])

    buckets = docs.mapInArrow(common.trimmed(count), "bucket long, codes binary, n binary").repartition("bucket")
    found = buckets.mapInArrow(common.trimmed(gather), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # a row for each cell at most
    out = np.zeros(cells, np.uint64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def window_counts(docs: DataFrame, longest: int, filters: list[np.ndarray]) -> DataFrame:
    """lang, w1 .. w<longest>, n: the padded windows, counted."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    names = [f"w{k}" for k in range(1, longest + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.portions(batches, 0, PORTION):
            words = Words(b.column(0), b.column(1))
            rows, n = words.windows(longest, held.value)
            spelled = [words.words.take(pa.array(np.maximum(c, 0), mask=c < 0)).cast(pa.string()) for c in rows.T[1:]]
            yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(rows[:, 0])).cast(pa.string()), *spelled, pa.array(n)], ["lang", *names, "n"])

    rows = docs.mapInArrow(common.trimmed(count), f"lang string, {', '.join(f'{w} string' for w in names)}, n long")
    return rows.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, words (an array; empty: all words of the lang), f."""
    names = [f"w{k}" for k in range(1, longest + 1)]
    rolled = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("_id")).filter(F.col("lang").isNotNull())
    size = F.lit(longest) - F.length(F.regexp_replace(F.bin("_id"), "0", ""))  # columns summed over are ones in the id
    words = F.slice(F.array(*names), F.lit(1), size)
    whole = rolled.select("lang", words.alias("words"), "f").filter(~F.exists("words", F.isnull))
    return whole.filter((F.col("f") >= least) | (F.size("words") == 0))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, covered: int = 100, first: int = 2000, filter_bits: int = 1 << 25) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    docs = common.plain(docs, "text", "lang")
    filters: list[np.ndarray] = []
    for size in range(1, min(longest, LEVELS) + 1):
        filters.append(frequent(docs, size, least, filter_bits, filters))
    windows = window_counts(docs, longest, filters)
    counts = common.materialise(phrase_counts(windows, longest, least), "phrase-counts")
    phrases = counts.filter(F.size("words") > 1).withColumnRenamed("f", "a")
    part = counts.filter(F.size("words") > 0)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"head": F.expr("slice(words, 1, k)"), "tail": F.expr("slice(words, k + 1, size(words) - k)")})
    cuts = cuts.join(part.select("lang", F.col("words").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("words").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(counts.filter(F.size("words") == 0).select("lang", F.col("f").alias("n")), "lang")
    score = F.expr("cast(1000 as decimal(4,0)) * (cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    inner = phrases.filter(F.size("words") > 2).select("lang", "a", F.explode(F.expr("""
        flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))""")).alias("words"))
    longer = inner.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "words"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(covered) * F.col("cut.a")))
    flat = kept.select("lang", F.array_join("words", " ").alias("phrase"), "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    ranked = common.ranked(flat, [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "phrase-ranks", ("lang",))
    return ranked.filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
