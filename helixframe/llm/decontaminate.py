"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens that ignores some positions; the
tokens at the others are hashed. Every benchmark item is indexed under several
masks, every document is looked up under the same masks, and each hit fixes an
alignment that is then verified token by token: some run of which at least ``share``
is equal must hold enough equal tokens. The longest such run decides; reported is the best run in
which a mismatch costs as much as ``1 / (1 / share - 1)`` matches are worth, if it holds enough by itself, as
it leaves out loose ends.

The five masks hit every run of 13 to 17 tokens with 13 equal ones, wherever the others stand, and nearly all
longer runs of which three quarters are equal.

Tokens are runs of letters, digits and underscores in lower case. Items of fewer than eleven tokens are
matched whole and exactly, those of fewer than ``shortest`` tokens match nothing, as one
common word is no trace of a benchmark. The benchmark is handled in blocks of at most ``block_items`` items and
``block_chars`` characters, in expectation; each block's index is broadcast, so memory is bounded whatever its size, and
each block reads the documents once. Hits are verified many at a time, a bounded number of tokens at once.

Null and empty texts, on either side, match nothing. Repeated benchmark items give a row
each unless they share an id; repeated documents share theirs. Very long texts are read whole. Of several places
of an item in a document the one with most equal tokens counts, then the longest, then the first. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: 1: the token counts; 0: any token will do.
MASKS = ("10110111", "11100010011", "10110000111", "1110100101", "11101000101")
SPAN = 11
FOUND = "doc_id long, item_id long, matched int, overlap int, doc_start int"
#: Alignments and compared tokens that are held at once.
MOST_PAIRS, MOST_CELLS = 500_000, 2_000_000
_words = re.compile(r"\w+").findall
_kept = bytes(b if chr(b).isalnum() or b == ord("_") else 32 for b in range(256))


def spaced(text: str | None) -> str:
    """The tokens of a text between spaces."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_kept).decode("latin-1")
    except UnicodeEncodeError:
        return " ".join(_words(low))


def worded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return common.worded(pa.array([spaced(t) for t in texts.to_pylist()], pa.string()))


def best_runs(equal: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: start, length and matches of the run with the most matches less weighted mismatches."""
    rows, n = equal.shape
    hits = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
    cost = 1 / (1 / share - 1) if share < 1 else n + 1
    worth = hits - cost * (np.arange(n + 1) - hits)
    low = np.minimum.accumulate(worth, axis=1)
    at, end = np.arange(rows), (worth - low).argmax(axis=1)
    lowest = (worth <= low[at, end][:, None] + 1e-9) & (np.arange(n + 1) <= end[:, None])
    start = n - lowest[:, ::-1].argmax(axis=1)  # the last of the least worth before the end
    return start, end - start, hits[at, end] - hits[at, start]


def longest_runs(equal: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: start, length and matches of the longest run of which at least share (in thousandths) is equal, without unequal ends.

    No other such run has more matches: one with more could be made as long as this.
    """
    rows, n = equal.shape
    hits = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
    place = np.arange(n + 1)
    sums = 1000 * hits - round(1000 * share) * place
    row = np.arange(rows)[:, None]
    apart = 4000 * (n + 1) * row  # of all rows one ascending list
    earliest = np.searchsorted((apart - np.minimum.accumulate(sums, axis=1)).ravel(), (apart - sums).ravel(), "left").reshape(rows, n + 1) - row * (n + 1)
    end = ((place - earliest) * (n + 2) + hits - np.take_along_axis(hits, earliest, 1)).argmax(axis=1)
    first = earliest[row[:, 0], end]
    inside = equal & (place[:n] >= first[:, None]) & (place[:n] < end[:, None])
    some = inside.any(axis=1)
    left = np.where(some, inside.argmax(axis=1), 0) if n else first
    right = np.where(some, n - inside[:, ::-1].argmax(axis=1), 0) if n else first
    return left, right - left, inside.sum(axis=1)


def longest_run(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    start, length, matched = longest_runs(np.asarray(equal, bool)[None, :], share)
    return int(start[0]), int(length[0]), int(matched[0])


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], least: int, share: float, shortest: int = 2) -> None:
        self.least, self.share = least, share
        words, codes, owner = worded(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = words
        size = np.bincount(owner, minlength=len(items))
        self.item_ids = np.array([i for i, _ in items], np.int64)
        self.same = np.unique(self.item_ids, return_inverse=True)[1]  # items may share an id
        self.tokens = codes.astype(np.int32) + 1
        self.first = np.cumsum(size) - size
        self.size = size
        draw = np.random.default_rng(5)
        self.codes = draw.integers(1, 2**63, len(words) + 1, dtype=np.uint64) | np.uint64(1)
        masks = [m for m in MASKS if (size >= SPAN).any()] + ["1" * n for n in sorted(set(size[(size >= shortest) & (size < SPAN)].tolist()))]
        self.masks = [(m, draw.integers(1, 2**63, len(m), dtype=np.uint64) | np.uint64(1)) for m in masks]
        hashes, places = [], []
        place = np.arange(len(self.tokens)) - self.first[owner] if len(items) else np.empty(0, np.int64)
        for mask, factors in self.masks:
            n = size[owner]
            at = np.flatnonzero((n == len(mask)) & (place == 0) if set(mask) == {"1"} else (n >= SPAN) & (place <= n - len(mask)))
            hashes.append(self.hashes(self.tokens, at, mask, factors))
            places.append(at)
        h, at = np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int64), *places])
        order = np.argsort(h, kind="stable")
        self.seeds, self.item, self.place = h[order], owner[at[order]], place[at[order]].astype(np.int32)
        self.shift = np.uint64(64 - min(24, max(10, int(len(h)).bit_length() + 3)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(h >> self.shift).astype(np.int64)] = True

    def hashes(self, ids: np.ndarray, at: np.ndarray, mask: str, factors: np.ndarray) -> np.ndarray:
        out = np.full(len(at), np.uint64(len(mask)))
        for p, used in enumerate(mask):
            if used == "1":
                out += self.codes[ids[at + p]] * factors[p]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out

    def hits(self, ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens' numbers and those of the seeds that they begin."""
        known = ids > 0
        for mask, factors in self.masks:
            n = len(ids) - len(mask) + 1
            if n < 1:
                continue
            there = doc[len(mask) - 1 :] == doc[:n]
            for p, used in enumerate(mask):
                if used == "1":
                    there &= known[p : p + n]
            at = np.flatnonzero(there)
            h = self.hashes(ids, at, mask, factors)
            may = self.seen[(h >> self.shift).astype(np.int64)]
            at, h = at[may], h[may]
            low = np.searchsorted(self.seeds, h, "left")
            many = np.searchsorted(self.seeds, h, "right") - low
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(many) // MOST_PAIRS)) + 1):
                k = many[part]
                yield np.repeat(at[part], k), np.arange(k.sum()) + np.repeat(low[part] - (np.cumsum(k) - k), k)

    def found(self, texts: pa.Array) -> np.ndarray:
        """For each text and item that it holds: text, item, matched, overlap and doc_start of the best place, in columns."""
        words, codes, doc = worded(texts)
        at = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy().astype(np.int32) + 1
        ids = at[codes]
        begin = np.searchsorted(doc, np.arange(len(texts) + 1))
        wide, many = int(self.size.max(initial=0)), max(1, len(self.size))
        out, held, n = [np.empty((0, 5), np.int64)], [], 0

        def verify(held: list[np.ndarray]) -> None:
            start, item = np.divmod(np.unique(np.concatenate([np.empty(0, np.int64), *held])), many)
            text = np.searchsorted(begin + wide * np.arange(len(begin)), start, "right") - 1
            order = np.argsort(self.size[item], kind="stable")
            text, item, shift = text[order], item[order], (start - begin[text] - wide * (text + 1))[order]
            for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(np.cumsum(self.size[item]) // MOST_CELLS)) + 1):
                out.append(self.verified(ids, begin, text[part], item[part], shift[part]))

        for token, seed in self.hits(ids, doc):  # texts are set apart, so that an alignment's start tells its text
            item = self.item[seed]
            held.append(np.unique((token - self.place[seed] + wide * (doc[token].astype(np.int64) + 1)) * many + item))
            n += len(held[-1])
            if n > MOST_PAIRS:
                verify(held)
                held, n = [], 0
        verify(held)
        rows = np.concatenate(out)
        if not len(rows):
            return rows
        rows = rows[np.lexsort((rows[:, 4], -rows[:, 3], -rows[:, 2], self.same[rows[:, 1]], rows[:, 0]))]
        return rows[np.append(True, (np.diff(rows[:, 0]) != 0) | (np.diff(self.same[rows[:, 1]]) != 0))]

    def verified(self, ids: np.ndarray, begin: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Of alignments (text, item, the text's token at which the item would begin) those that hold enough, with their runs."""
        if not len(doc):
            return np.empty((0, 5), np.int64)
        size = self.size[item]
        need = np.where(size > self.least, self.least, np.ceil(size * self.share - 1e-9)).astype(np.int64)
        place = np.arange(size.max())
        there = (place < size[:, None]) & (place + shift[:, None] >= 0) & (place + shift[:, None] < (begin[doc + 1] - begin[doc])[:, None])
        mine = ids[np.where(there, begin[doc][:, None] + shift[:, None] + place, 0)]
        equal = there & (mine == self.tokens[np.where(there, self.first[item][:, None] + place, 0)])
        enough = equal.sum(axis=1) >= need
        doc, item, shift, need, equal = doc[enough], item[enough], shift[enough], need[enough], equal[enough]
        start, length, matched = longest_runs(equal, self.share)
        held = matched >= need
        best = best_runs(equal, self.share)
        start, length, matched = (np.where(best[2] >= need, b, x) for b, x in zip(best, (start, length, matched), strict=True))
        return np.stack([doc, item, matched, length, shift + start], axis=1)[held]

    def look_up(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """item_id, matched, overlap, doc_start of each item that a text holds."""
        return [(int(self.item_ids[i]), int(m), int(n), int(s)) for _, i, m, n, s in self.found(pa.array([text], pa.string()))]


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.75, block_items: int = 20_000, block_chars: int = 3_000_000, shortest: int = 2) -> DataFrame:
    """A row for each document and benchmark item that it holds.

    least: tokens that must be equal within the run (share of those of an item that has no more).
    Returns doc_id, item_id, matched, overlap, doc_start (a token's number).
    """
    spark = docs.sparkSession
    items = common.plain(benchmark, "item_id", "text").filter("item_id is not null and text is not null")
    texts = common.plain(docs, "doc_id", "text")
    many, size = common.text_size(items)
    blocks = max(1, -(-many // block_items), -(-size // block_chars))

    def search(held):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in common.portions(batches, 1):
                text, item, *rest = index.found(b.column(1)).T
                ids = b.column(0).take(pa.array(text)), pa.array(index.item_ids[item])
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x.astype(np.int32)) for x in rest)], ["doc_id", "item_id", "matched", "overlap", "doc_start"])

        return common.trimmed(work)

    out = None
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # bounded by block_items and block_chars
        held = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own], least, share, shortest))
        found = texts.mapInArrow(search(held), FOUND)
        out = found if out is None else out.unionByName(found)
    return out
