"""Exact removal of repeated passages by a depth-limited radix sort of suffixes.

A window of ``threshold`` bytes is a repeat if it also starts in a document with a
smaller id. Suffixes are ordered by most-significant-digit passes of eight bytes, only
through the threshold, and a group drops out as soon as it has one member; the groups
that are left after the last pass are exactly the repeated windows.

Only suffixes near a repeated anchor are sorted. An anchor is the k-gram with the
smallest hash of those in a window, so that two equal windows have an equal anchor at the
same place in them; an anchor that occurs in one document only proves all its
windows unique. One exchange counts anchors (their hashes, in packed arrays, from
blocks of documents), one sends the surroundings of the shared ones to the sort, and
one brings the ranges back to the texts.

Hot passages: within a block, surroundings that are equal are settled there against the
smallest doc_id and only that one is sent; documents that are whole copies of a
smaller one are settled by their digest. So what a task gets of one passage is at
most one row per block.

Null and empty texts have no bytes, texts under the threshold no windows. Rows with
equal doc_id don't count as repeats of each other; rows without doc_id are refused.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LOW = np.uint64((1 << 40) - 1)
_draw = np.random.default_rng(11)
LETTERS = _draw.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(_draw.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
PLACE_BITS = 24


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram, from hashes of halves."""
    def of(n: int) -> np.ndarray:
        if n == 1:
            return LETTERS[data]
        half = n // 2
        x = of(half)
        y = x[: len(x) - half] * np.uint64(pow(BASE, half, 1 << 64)) + x[half:]
        return y if n % 2 == 0 else y[:-1] * np.uint64(BASE) + LETTERS[data[n - 1 :]]

    h = of(k)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def remixed(h: np.ndarray) -> np.ndarray:
    """Hashes chosen for being small, spread evenly again (one to one)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def anchors(data: np.ndarray, ends: np.ndarray, threshold: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows that lie within a document."""
    n = len(data)
    if n < threshold:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data, k)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~mask) | (np.arange(len(h), dtype=np.uint64) & mask)
    w, size = threshold - k + 1, 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    good = np.ones(len(least), bool)
    for e in ends[:-1].tolist():
        good[max(0, e - threshold + 1) : e] = False
    start = np.flatnonzero(good)
    at = start + ((least[start] - start.astype(np.uint64)) & mask).astype(np.int64)
    chosen = np.zeros(n, bool)
    chosen[at] = True
    at = np.flatnonzero(chosen)
    return at, remixed(h[at])


def opened(ids: bytes, sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ends and bytes of a block."""
    ends = np.cumsum(np.frombuffer(sizes, "<i8"))
    total = int(ends[-1]) if len(ends) else 0
    raw = pa.decompress(data, decompressed_size=total, codec="zstd", asbytes=True) if total else b""
    return np.frombuffer(ids, "<i8"), ends, np.frombuffer(raw, np.uint8)


def blocks_of(docs: DataFrame, block_bytes: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents as blocks of compressed bytes: part, block, ids, sizes, digests, data.

    With carry there is one more, rest: those columns of each document as JSON. The table
    is bucketed by part, the task that wrote a block, so what is later joined to the
    blocks moves to them and the texts stay where they are.
    """
    names = ["part", "block", "ids", "sizes", "digests", "data", *(["rest"] if carry else [])]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            ids = np.array([i for i, *_ in held], "<i8").tobytes()
            sizes = np.array([len(t) for _, t, *_ in held], "<i8").tobytes()
            digests = b"".join(hashlib.md5(t).digest() for _, t, *_ in held)
            joined = b"".join(t for _, t, *_ in held)
            data = pa.compress(joined, codec="zstd", asbytes=True) if joined else b""
            rest = ["\n".join(r for *_, r in held).encode()] if carry else []  # JSON has no line ends
            return pa.RecordBatch.from_arrays([pa.array([number >> 32], pa.int64()), pa.array([number], pa.int64()), *[pa.array([x], pa.binary()) for x in (ids, sizes, digests, data, *rest)]], names)

        for b in batches:
            for doc_id, text, *rest in zip(*[c.to_pylist() for c in b.columns], strict=True):
                raw = text.encode() if text else b""
                if held and size + len(raw) > block_bytes:
                    yield flush()
                    number, held, size = number + 1, [], 0
                held.append((doc_id, raw, *rest))
                size += len(raw)
        if held:
            yield flush()

    doc_id = F.coalesce("doc_id", F.raise_error(F.concat(F.lit("a row has no doc_id: "), F.coalesce(F.left("text", F.lit(40)), F.lit("")))).cast("long"))
    rest = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in carry])).alias("rest")] if carry else []
    schema = ", ".join(f"{n} {'long' if n in ('part', 'block') else 'binary'}" for n in names)
    return common.bucketed(docs.select(doc_id.alias("doc_id"), "text", *rest).mapInArrow(common.trimmed(build), schema), "part", "blocks")


def by_block(messages: DataFrame, *columns: str) -> DataFrame:
    """All of a block's messages in one row, with the block's part."""
    own = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    return messages.groupBy(F.shiftright("block", 32).alias("part"), "block").agg(F.collect_list(own).alias(columns[-1]))


def packed(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def by_key(batches: Iterator[pd.DataFrame], key: str, work: Callable[[int, pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """work(key, rows) for each key; rows arrive sorted by it."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for value, own in b.groupby(key, sort=False):
            if held and held[-1][key].iloc[0] != value:
                if (out := work(int(held[0][key].iloc[0]), pd.concat(held, ignore_index=True))) is not None:
                    yield out
                held = []
            held.append(own)
    if held and (out := work(int(held[0][key].iloc[0]), pd.concat(held, ignore_index=True))) is not None:
        yield out


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that occur, and where each begins and ends."""
    number = ((sorted_hashes >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    if not len(number):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return number[first].astype(np.int64), first, np.append(first[1:], len(number))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, the sorted distinct hashes and where each begins in that order."""
    order = np.argsort(hashes, kind="stable")
    own = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    return order, own[first], first


def anchor_messages(blocks: DataFrame, buckets: int, threshold: int, k: int) -> DataFrame:
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                _, ends, data = opened(row.ids, row.sizes, row.data)
                at, h = anchors(data, ends, threshold, k)
                order, own, first = distinct(h)
                doc = np.searchsorted(ends, at, "right")[order]
                last = np.append(first[1:], len(order)) - 1
                many = doc[first] != doc[last] if len(first) else np.empty(0, bool)
                low = (own & LOW).view(np.uint8).reshape(-1, 8)[:, :5]
                rows = [(n, row.block, low[s:e].tobytes(), packed(many[s:e])) for n, s, e in zip(*bucket_cuts(own, buckets), strict=True)]
                yield pd.DataFrame(rows, columns=["bucket", "block", "low", "many"])

    return blocks.select("block", "ids", "sizes", "data").mapInPandas(common.trimmed(send), "bucket int, block long, low binary, many binary")


def shared_anchors(messages: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, bits: which of a block's anchors in the bucket occur in more than one document."""

    def count(bucket: int, rows: pd.DataFrame) -> pd.DataFrame | None:
        sizes = np.array([len(x) // 5 for x in rows["low"]])
        wide = np.zeros((sizes.sum(), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(rows["low"]), np.uint8).reshape(-1, 5)
        many = np.concatenate([unpacked(m, n) for m, n in zip(rows["many"], sizes, strict=True)])
        order, _, first = distinct(wide.view("<u8").ravel())
        times = np.diff(np.append(first, len(order))) + np.logical_or.reduceat(many[order], first)
        shared = np.empty(len(order), bool)
        shared[order] = np.repeat(times > 1, np.diff(np.append(first, len(order))))
        cuts = np.cumsum(sizes)[:-1]
        out = [(block, bucket, packed(own)) for block, own in zip(rows["block"], np.split(shared, cuts), strict=True) if own.any()]
        return pd.DataFrame(out, columns=["block", "bucket", "bits"]) if out else None

    dealt = messages.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(common.trimmed(lambda batches: by_key(batches, "bucket", count)), "block long, bucket int, bits binary")


def whole_copies(blocks: DataFrame) -> DataFrame:
    """part, block, copies: the places in the block of documents that equal one with a smaller id."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids = np.frombuffer(row.ids, "<i8")
                yield pd.DataFrame({"doc_id": ids, "digest": [row.digests[i : i + 16] for i in range(0, 16 * len(ids), 16)], "block": row.block, "nth": np.arange(len(ids), dtype=np.int32)})

    each = blocks.select("block", "ids", "digests").mapInPandas(common.trimmed(rows), "doc_id long, digest binary, block long, nth int")
    first = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    return each.join(common.looked_up(first, "repeat-digests"), "digest").filter("doc_id > first").select("block", F.col("nth").alias("copies")).transform(by_block, "copies")


def radix_groups(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over equally long byte rows, each within the groups so far.

    Returns the members of groups of two or more, and their group numbers.
    """
    width = rows.shape[1]
    padded = np.zeros((len(rows), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view("<u8")
    alive = np.arange(len(rows))
    for digit in range(-1, words.shape[1]):
        key = words[alive, digit] if digit >= 0 else np.zeros(len(alive), np.uint64)
        order = np.lexsort((key, groups))
        g, key = groups[order], key[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])]) if len(g) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
        alive, groups = alive[order][keep], number[keep]
    return alive, groups


def settle(doc: np.ndarray, members: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members with a smaller document in their group; and the first member of each group's smallest document."""
    order = np.lexsort((members, doc[members], groups))
    m, g = members[order], groups[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
    first = m[new][np.cumsum(new) - 1] if len(m) else m
    return m[doc[m] > doc[first]], m[(doc[m] == doc[first]) & (m != first)]


def surroundings(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, side: int, k: int) -> np.ndarray:
    """side bytes before and after each anchor, zeros beyond the document, then the two lengths that are real."""
    left, right = np.minimum(side, at - starts), np.minimum(side, ends - at - k)
    width = 2 * side + k
    offsets = np.arange(width)
    index = at[:, None] - side + offsets
    rows = np.empty((len(at), width + 2), np.uint8)
    rows[:, :width] = data[np.clip(index, 0, max(0, len(data) - 1))]
    rows[:, :width][(offsets < side - left[:, None]) | (offsets >= side + k + right[:, None])] = 0
    rows[:, width], rows[:, width + 1] = left, right
    return rows


def cleared(blocks: DataFrame, threshold: int, k: int, buckets: int, shared: DataFrame, copies: DataFrame) -> DataFrame:
    """block, ranges: (document's place, start, end) to remove, as packed arrays."""
    side, width = threshold - k, 2 * (threshold - k) + k
    met = blocks.select("part", "block", "ids", "sizes", "data").join(by_block(shared, "bucket", "bits"), ["part", "block"]).join(copies, ["part", "block"], "left").drop("part")

    def whole_range(rows: np.ndarray, nth: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        left, right = rows[which, width].astype(np.int64), rows[which, width + 1].astype(np.int64)
        out = np.stack([nth[which], at[which] - left, at[which] + k + right], axis=1)
        return out[left + right + k >= threshold].astype("<u4")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids, ends, data = opened(row.ids, row.sizes, row.data)
                at, h = anchors(data, ends, threshold, k)
                order, own, first = distinct(h)
                spans = {n: (s, e) for n, s, e in zip(*[x.tolist() for x in bucket_cuts(own, buckets)], strict=True)}
                hit = np.zeros(len(own), bool)
                for x in row.bits:
                    s, e = spans[x["bucket"]]
                    hit[s:e] = unpacked(x["bits"], e - s)
                flags = np.zeros(len(at), bool)
                flags[order] = np.repeat(hit, np.diff(np.append(first, len(order))))
                nth = np.searchsorted(ends, at, "right")
                if row.copies is not None and len(row.copies):
                    flags &= ~np.isin(nth, row.copies)
                at, h, nth = at[flags], h[flags], nth[flags]
                starts = ends - np.diff(np.append(0, ends))
                rows = surroundings(data, at, starts[nth], ends[nth], side, k)
                alive, groups = radix_groups(rows, h.view(np.int64))
                gone, same = settle(ids[nth], alive, groups)
                at -= starts[nth]
                keep = np.ones(len(at), bool)
                keep[gone] = False
                # a further place in the smallest document: its windows are judged with the first one's, so it is sent on
                out = [(int(row.block) % buckets, row.block, b"", b"", b"", b"", whole_range(rows, nth, at, gone).tobytes())] if len(gone) else []
                rest = np.flatnonzero(keep)
                rest = rest[np.argsort(h[rest], kind="stable")]
                for n, s, e in zip(*[x.tolist() for x in bucket_cuts(h[rest], buckets)], strict=True):
                    i = rest[s:e]
                    out.append((n, row.block, h[i].tobytes(), ids[nth[i]].astype("<i8").tobytes(), np.stack([nth[i], at[i]], axis=1).astype("<u4").tobytes(), rows[i].tobytes(), b""))
                yield pd.DataFrame(out, columns=["bucket", "block", "hashes", "docs", "places", "rows", "ranges"])

    def sort(bucket: int, b: pd.DataFrame) -> pd.DataFrame | None:
        h = np.frombuffer(b"".join(b["hashes"]), "<u8")
        doc = np.frombuffer(b"".join(b["docs"]), "<i8")
        nth, at = np.frombuffer(b"".join(b["places"]), "<u4").reshape(-1, 2).astype(np.int64).T
        rows = np.frombuffer(b"".join(b["rows"]), np.uint8).reshape(-1, width + 2)
        source = np.repeat(np.arange(len(b)), [len(x) // 8 for x in b["hashes"]])
        _, inverse = np.unique(h, return_inverse=True)
        alive, groups = radix_groups(rows, inverse)
        gone, same = settle(doc, alive, groups)
        found = [(source[gone], whole_range_all(rows, nth, at, gone))]
        left = np.ones(len(h), bool)
        left[gone] = False
        rest = np.flatnonzero(left)
        many = np.bincount(inverse[rest], minlength=inverse.max(initial=-1) + 1)
        rest = rest[many[inverse[rest]] > 1]
        # all windows around an anchor hold it, so those that go make one range: from the first to the last
        low, high = np.full(len(h), side + 1, np.int16), np.full(len(h), -1, np.int16)
        for shift in range(side + 1):  # windows that start so many bytes into the surroundings
            own = rest[(shift >= side - rows[rest, width].astype(np.int64)) & (shift <= rows[rest, width + 1])]
            if len(own) < 2:
                continue
            members, groups = radix_groups(rows[own, shift : shift + threshold], inverse[own])
            lost, _ = settle(doc[own], members, groups)
            lost = own[lost]
            low[lost], high[lost] = np.minimum(low[lost], shift), shift
        lost = np.flatnonzero(high >= 0)
        start = at[lost] - side
        found.append((source[lost], np.stack([nth[lost], start + low[lost], start + high[lost] + threshold], axis=1)))
        where = np.concatenate([x for x, _ in found])
        ranges = np.concatenate([x for _, x in found])
        out = [(block, r) for block, r in zip(b["block"], b["ranges"], strict=True) if r]
        order = np.lexsort((ranges[:, 1], ranges[:, 0], where))
        where, ranges = where[order], ranges[order]
        if len(where):
            # ranges of one document that touch become one
            fresh = np.concatenate([[True], (where[1:] != where[:-1]) | (ranges[1:, 0] != ranges[:-1, 0]) | (ranges[1:, 1] > ranges[:-1, 2])])
            first = np.flatnonzero(fresh)
            joined = np.stack([ranges[first, 0], ranges[first, 1], np.maximum.reduceat(ranges[:, 2], first)], axis=1).astype("<u4")
            cut = np.flatnonzero(np.concatenate([[True], where[first][1:] != where[first][:-1]]))
            out += [(b["block"].iloc[where[first][s]], joined[s:e].tobytes()) for s, e in zip(cut, np.append(cut[1:], len(first)), strict=True)]
        return pd.DataFrame(out, columns=["block", "ranges"]) if out else None

    def whole_range_all(rows: np.ndarray, nth: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        left, right = rows[which, width].astype(np.int64), rows[which, width + 1].astype(np.int64)
        fits = left + right + k >= threshold
        out = np.stack([nth[which], at[which] - left, at[which] + k + right], axis=1)
        out[~fits, 2] = out[~fits, 1]  # too short for a window: nothing is removed
        return out

    messages = met.mapInPandas(common.trimmed(send), "bucket int, block long, hashes binary, docs binary, places binary, rows binary, ranges binary")
    dealt = messages.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(common.trimmed(lambda batches: by_key(batches, "bucket", sort)), "block long, ranges binary")


def remove_repeats(docs: DataFrame, threshold: int = 50, k: int = 24, block_bytes: int = 1 << 20, bucket_chars: int = 32 << 20, with_text: bool = False, characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document without the bytes of its repeated windows.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes
    that stay) if with_text is set, with characters without those that a cut has broken. carry names columns to return as well.
    """
    spark = docs.sparkSession
    _, chars = common.text_size(docs)
    buckets = common.slices(spark, chars, bucket_chars, 1 << 20)
    common.arrow_rows(spark, 500)
    blocks = blocks_of(docs, block_bytes, carry)
    common.arrow_rows(spark, 16)  # rows are packed arrays from here on
    shared = shared_anchors(anchor_messages(blocks, buckets, threshold, k), buckets)
    copies = common.materialise(whole_copies(blocks), "repeat-copies")
    ranges = cleared(blocks, threshold, k, buckets, shared, copies)
    met = blocks.drop("digests").join(by_block(ranges, "ranges"), ["part", "block"], "left").join(copies, ["part", "block"], "left").drop("part")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids, ends, data = opened(row.ids, row.sizes, row.data)
                starts = ends - np.diff(np.append(0, ends))
                step = np.zeros(len(data) + 1, np.int32)
                if row.ranges is not None and len(row.ranges):
                    nth, s, e = np.frombuffer(b"".join(row.ranges), "<u4").reshape(-1, 3).astype(np.int64).T
                    step += np.bincount(starts[nth] + s, minlength=len(step)).astype(np.int32)
                    step -= np.bincount(starts[nth] + e, minlength=len(step)).astype(np.int32)
                gone = np.cumsum(step) > 0
                for i in row.copies if row.copies is not None else ():
                    if ends[i] - starts[i] >= threshold:
                        gone[starts[i] : ends[i]] = True
                out, rest = [], row.rest.decode().split("\n") if carry else [""] * len(ids)
                for doc_id, s, e, other in zip(ids.tolist(), starts.tolist(), ends.tolist(), rest, strict=True):
                    own = gone[s:e]
                    n = int(own.sum())
                    kept = data[s:e].tobytes() if not n else data[s:e][~own].tobytes()
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                    digest = hashlib.sha256(kept).hexdigest()
                    if n and characters:
                        kept = kept.decode("utf-8", "ignore").encode()
                    out.append((doc_id, e - s, n, spans, digest, *([kept] if with_text else []), *([other] if carry else [])))
                yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []), *(["rest"] if carry else [])]
    done = met.mapInPandas(common.trimmed(apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text + ", rest string" * bool(carry))
    if not carry:
        return done
    kinds = docs.select(*[F.col(f"`{c}`") for c in carry]).schema
    return done.withColumn("rest", F.from_json("rest", kinds)).select("*", "rest.*").drop("rest")
