"""Exact similarity join of documents in the Jaccard metric space of their word shingles.

A document is the set of its distinct word n-grams; two are linked if their Jaccard
similarity reaches a share. The result is exact: every link counts.

1. Counting. With every set in one order, two linked sets share a minimum of members in their
   prefixes. Shingle hashes of prefixes are counted in one exchange of packed arrays, and a
   document that shares too few of them with any other has no link and goes no further.
2. Cells. The survivors' sets are ordered by rarity; documents with enough shared members
   in their prefixes fall into one cell, all others are proven apart. Cells are connected
   components, so no link leaves one.
3. Regions. In a cell a pivot is compared with every document. Those within the radius
   (1 - similarity) of it are linked to it. By the triangle inequality, a document x at
   distance a from the pivot can be linked only with those whose distance is within a plus the radius: the
   window. Expansion goes on inside the window, then recursively with a pivot from what is
   left.
4. Large cells. A cell with more documents than a task should hold gets several pivots at
   once. Documents go to the Voronoi region of the nearest one; pivots that share a document within the
   radius are one component. Documents outside the largest component are compared, in windows around
   the pivots, with the regions they could reach (replicated to each of their parts), and form
   the cell of the next round. A cell that pivots don't reduce is compared in pairs of blocks.

Equal sets are joined first and go on as one document, so a hot group of copies costs a
row each and no more. Null and empty texts have empty sets, linked with nothing. Rows that
share a doc_id count as one document for links. An empty table gives no rows; extra columns are
ignored. Rows without doc_id are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .repeats import LETTERS, blocks_of, bucket_cuts, by_block, by_key, distinct, opened, packed, remixed, unpacked

BASE = (1 << 63) // 5 * 2 + 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
CERTAIN = 1 << 20
_powers: dict[int, np.ndarray] = {}
common.CACHES["jaccard"] = _powers.clear


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 21), base, np.uint64)]))
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """For each document of a block the sorted distinct 64-bit hashes of its shingles."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if not len(data):
        return [np.empty(0, np.uint64)] * len(ends)
    inside = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[ends] = True
    before = np.concatenate([[False], inside])
    after = np.append(inside, False)
    begin = np.flatnonzero(after & (~before | edge))
    finish = np.flatnonzero(before & (~after | edge))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[LOWER[data]] * powers(BASE, len(data)), dtype=np.uint64)])
    h = mixed((total[finish] - total[begin]) * powers(BASE_INVERSE, len(data))[begin])
    first = np.searchsorted(begin, starts)
    n_words = np.append(first[1:], len(begin)) - first
    long = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        long += h[j : len(h) - words + 1 + j] * np.uint64(2 * j + 3) if len(long) else long
        long = mixed(long) if len(long) else long
    out = []
    for f, n in zip(first.tolist(), n_words.tolist(), strict=True):
        if n >= words:
            own = np.sort(long[f : f + n - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            whole = hashlib.blake2b(h[f : f + n].tobytes() + bytes([n]), digest_size=8).digest()
            out.append(np.frombuffer(whole, "<u8"))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Rule:
    """Integer bounds for a similarity of percent / 100."""

    def __init__(self, percent: int) -> None:
        self.percent, self.radius = percent, 1 - percent / 100

    def overlap(self, n: int) -> int:
        """What a set of n members shares at least with any it is linked to."""
        return -(-self.percent * n // 100)

    def extra(self, n: int) -> int:
        return max(1, n // 12)

    def prefix(self, n: int) -> int:
        return n - self.overlap(n) + self.extra(n)

    def first(self, hashes: np.ndarray) -> np.ndarray:
        """The prefix of a sorted set, its hashes spread over all buckets again."""
        return remixed(hashes[: self.prefix(len(hashes))]) if len(hashes) else hashes

    def shared(self, n: int) -> int:
        """Members of its prefix that a linked set has in its own prefix, for its smallest possible partner."""
        return max(1, self.overlap(n) // 12)

    def linked(self, both: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (a + b - both)


def narrow(blocks: DataFrame, words: int) -> DataFrame:
    """doc_id, n, sig, block, nth."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids, ends, data = opened(row.ids, row.sizes, row.data)
                sets = shingle_sets(data, ends, words)
                yield pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets], "sig": [hashlib.md5(s.tobytes()).digest() for s in sets], "block": row.block, "nth": np.arange(len(ids), dtype=np.int32)})

    return common.materialise(blocks.mapInPandas(common.trimmed(rows), "doc_id long, n long, sig binary, block long, nth int"), "jaccard-sets")


def prefix_messages(blocks: DataFrame, rule: Rule, words: int, buckets: int) -> DataFrame:
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                _, ends, data = opened(row.ids, row.sizes, row.data)
                own, many = distinct_counts([rule.first(s) for s in shingle_sets(data, ends, words)])
                rows = [(n, row.block, low40(own[s:e]), packed(many[s:e] > 1)) for n, s, e in zip(*bucket_cuts(own, buckets), strict=True)]
                yield pd.DataFrame(rows, columns=["bucket", "block", "low", "many"])

    return blocks.mapInPandas(common.trimmed(send), "bucket int, block long, low binary, many binary")


def low40(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def wide(low: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(low), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def distinct_counts(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of several sets, and in how many each is."""
    joined = np.sort(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]])) if len(joined) else np.empty(0, np.int64)
    return joined[first], np.diff(np.append(first, len(joined)))


def survivors(blocks: DataFrame, shared: DataFrame, copies: DataFrame, rule: Rule, words: int, buckets: int) -> DataFrame:
    """Sets of the documents that may have links, as blocks: block, ids, sizes, sets."""
    met = blocks.join(by_block(shared, "bucket", "bits"), ["part", "block"]).join(copies, ["part", "block"], "left").drop("part")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids, ends, data = opened(row.ids, row.sizes, row.data)
                sets = shingle_sets(data, ends, words)
                prefixes = [rule.first(s) for s in sets]
                own, _ = distinct_counts(prefixes)
                hit = np.zeros(len(own), bool)
                spans = {n: (s, e) for n, s, e in zip(*[x.tolist() for x in bucket_cuts(own, buckets)], strict=True)}
                for x in row.bits:
                    s, e = spans[x["bucket"]]
                    hit[s:e] = unpacked(x["bits"], e - s)
                gone = set(row.copies.tolist()) if row.copies is not None else set()
                kept = [i for i, (s, p) in enumerate(zip(sets, prefixes, strict=True)) if len(s) and i not in gone and hit[np.searchsorted(own, p)].sum() >= rule.shared(len(s))]
                if kept:
                    yield pd.DataFrame([(row.block, ids[kept].astype("<i8").tobytes(), np.array([len(sets[i]) for i in kept], "<i8").tobytes(), np.concatenate([sets[i] for i in kept]).astype("<u8").tobytes())], columns=["block", "ids", "sizes", "sets"])

    return common.materialise(met.mapInPandas(common.trimmed(pick), "block long, ids binary, sizes binary, sets binary"), "jaccard-survivors")


def opened_sets(row) -> tuple[np.ndarray, list[np.ndarray]]:
    sizes = np.frombuffer(row.sizes, "<i8")
    return np.frombuffer(row.ids, "<i8"), np.split(np.frombuffer(row.sets, "<u8"), np.cumsum(sizes)[:-1]) if len(sizes) else []


def rarity_classes(sets: DataFrame, buckets: int) -> DataFrame:
    """block, classes: for each of a block's distinct shingles how common it is; 1 means in no other document."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                own, n = distinct_counts(opened_sets(row)[1])
                rows = [(k, row.block, low40(own[s:e]), n[s:e].astype("<u4").tobytes()) for k, s, e in zip(*bucket_cuts(own, buckets), strict=True)]
                yield pd.DataFrame(rows, columns=["bucket", "block", "low", "n"])

    def count(bucket: int, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(x) // 5 for x in rows["low"]])
        n = np.frombuffer(b"".join(rows["n"]), "<u4").astype(np.int64)
        order, _, first = distinct(wide(list(rows["low"])))
        df = np.add.reduceat(n[order], first)
        level = np.where(df < 100, df, 100 + np.minimum(155, (8 * np.log2(np.maximum(df, 100) / 100)).astype(np.int64))).astype(np.uint8)
        out = np.empty(len(order), np.uint8)
        out[order] = np.repeat(level, np.diff(np.append(first, len(order))))
        return pd.DataFrame({"block": rows["block"], "bucket": bucket, "levels": [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]})

    dealt = sets.mapInPandas(common.trimmed(send), "bucket int, block long, low binary, n binary").repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(common.trimmed(lambda batches: by_key(batches, "bucket", count)), "block long, bucket int, levels binary")


def candidate_edges(sets: DataFrame, levels: DataFrame, rule: Rule, buckets: int, small: int = 8) -> DataFrame:
    """a, b: documents that share enough of their rarest members, so that linked ones are connected."""
    met = sets.join(levels.groupBy("block").agg(F.collect_list(F.struct("bucket", "levels")).alias("levels")), "block")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids, own_sets = opened_sets(row)
                own, _ = distinct_counts(own_sets)
                level = np.concatenate([np.frombuffer(x["levels"], np.uint8) for x in sorted(row.levels, key=lambda x: x["bucket"])])
                hashes, docs, sizes = [], [], []
                for doc_id, s in zip(ids.tolist(), own_sets, strict=True):
                    c = level[np.searchsorted(own, s)]
                    first = np.lexsort((s, c))[: rule.prefix(len(s))]
                    first = first[c[first] > 1]
                    hashes.append(remixed(s[first]))
                    docs.append(np.full(len(first), doc_id))
                    sizes.append(np.full(len(first), len(s)))
                h, d, n = np.concatenate(hashes), np.concatenate(docs), np.concatenate(sizes)
                order = np.argsort(h, kind="stable")
                h, d, n = h[order], d[order], n[order]
                rows = [(k, low40(h[s:e]), d[s:e].astype("<i8").tobytes(), n[s:e].astype("<u4").tobytes()) for k, s, e in zip(*bucket_cuts(h, buckets), strict=True)]
                yield pd.DataFrame(rows, columns=["bucket", "low", "docs", "sizes"])

    def connect(bucket: int, rows: pd.DataFrame) -> pd.DataFrame | None:
        h = wide(list(rows["low"]))
        d = np.frombuffer(b"".join(rows["docs"]), "<i8")
        n = np.frombuffer(b"".join(rows["sizes"]), "<u4").astype(np.int64)
        order = np.lexsort((d, n, h))
        h, d, n = h[order], d[order], n[order]
        new = np.concatenate([[True], (h[1:] != h[:-1])])
        # in order of size, a gap that no link crosses ends a group
        new[1:] |= 100 * n[:-1] < rule.percent * n[1:]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        found = []
        for g in range(2, small + 1):
            at = first[size == g]
            for i in range(g):
                for j in range(i + 1, g):
                    p, q = at + i, at + j
                    ok = (100 * n[p] >= rule.percent * n[q]) & (d[p] != d[q])
                    found.append((np.minimum(d[p], d[q])[ok], np.maximum(d[p], d[q])[ok], np.maximum(1, n[p] // 12)[ok], np.ones(ok.sum(), np.int64)))
        large = size > small
        if large.any():
            root = np.minimum.reduceat(d, first)
            within = np.repeat(large, size)
            a, b = np.repeat(root, size)[within], d[within]
            found.append((a[a != b], b[a != b], np.ones((a != b).sum(), np.int64), np.full((a != b).sum(), CERTAIN)))
        a, b, need, times = (np.concatenate([f[i] for f in found]) for i in range(4))
        if not len(a):
            return None
        order = np.lexsort((b, a))
        a, b, need, times = a[order], b[order], need[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return pd.DataFrame({"a": a[first], "b": b[first], "need": np.minimum.reduceat(need, first), "times": np.minimum(CERTAIN, np.add.reduceat(times, first))})

    dealt = met.mapInPandas(common.trimmed(send), "bucket int, low binary, docs binary, sizes binary").repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    pairs = dealt.mapInPandas(common.trimmed(lambda batches: by_key(batches, "bucket", connect)), "a long, b long, need long, times long")
    return pairs.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("times").alias("times")).filter("times >= need").select("a", "b")


def region_links(ids: np.ndarray, sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that connect what is linked: pivots, their windows, then what is left."""
    sizes = np.array([len(s) for s in sets])
    _, members = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(members.max() + 1, bool)
    free = np.ones(len(ids), bool)
    links: list[tuple[int, int]] = []

    def compare(x: int, others: np.ndarray) -> np.ndarray:
        own = members[offsets[x] : offsets[x + 1]]
        mark[own] = True
        if len(others) * 4 > len(ids):
            both = np.add.reduceat(mark[members], offsets[:-1])[others]
        else:
            both = np.array([mark[members[offsets[o] : offsets[o + 1]]].sum() for o in others])
        mark[own] = False
        return both

    for pivot in np.lexsort((ids, sizes)).tolist():
        if not free[pivot]:
            continue
        free[pivot] = False
        others = np.flatnonzero(free)
        if not len(others):
            break
        both = compare(pivot, others)
        away = np.full(len(ids), np.inf)
        away[pivot] = 0.0
        away[others] = 1 - both / (sizes[pivot] + sizes[others] - both)
        near = others[rule.linked(both, sizes[pivot], sizes[others])]
        links += [(int(ids[pivot]), int(ids[i])) for i in near]
        free[near] = False
        queue = near.tolist()
        while queue:
            x = queue.pop()
            window = np.flatnonzero(free & (away <= away[x] + rule.radius + 1e-9))
            if not len(window):
                continue
            both = compare(x, window)
            more = window[rule.linked(both, sizes[x], sizes[window])]
            links += [(int(ids[x]), int(ids[i])) for i in more]
            free[more] = False
            queue += more.tolist()
    return links


def cell_links(rows: DataFrame, keys: list[str], rule: Rule, parts: int) -> DataFrame:
    """a, b over rows of doc_id, set in groups that fit a task."""
    keyed = rows.select(F.concat_ws("/", *keys).alias("cell"), "doc_id", "set")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            b = pd.concat(held, ignore_index=True)
            return pd.DataFrame(region_links(b["doc_id"].to_numpy(), [np.frombuffer(s, "<u8") for s in b["set"]], rule), columns=["a", "b"], dtype="int64")

        for b in batches:
            for cell, own in b.groupby("cell", sort=False):
                if held and held[0]["cell"].iloc[0] != cell:
                    yield flush()
                    held = []
                held.append(own)
        if held:
            yield flush()

    return keyed.repartition(parts, "cell").sortWithinPartitions("cell").mapInPandas(common.trimmed(links), "a long, b long")


def large_cell_links(rows: DataFrame, rule: Rule, most: int, parts: int, pivots: int = 8, rounds: int = 6) -> list[DataFrame]:
    """Links of cells with more than ``most`` documents. rows: cell, doc_id, n, set, size (of the cell)."""
    out: list[DataFrame] = []
    for turn in range(rounds + 1):
        if turn == rounds:
            return [*out, block_pairs(rows, rule, most, parts)]
        # the documents with the smallest hashes under several seeds: an aggregate, so a hot cell is combined before it moves
        draws = [F.min(F.struct(F.xxhash64("doc_id", F.lit(turn * pivots + j)), F.col("doc_id").alias("pivot"))) for j in range(pivots)]
        chosen = rows.groupBy("cell").agg(F.array_distinct(F.array(*[x["pivot"] for x in draws])).alias("ids")).select("cell", F.explode("ids").alias("doc_id"))
        held = rows.select("cell", "doc_id", "set").join(common.looked_up(chosen, "jaccard-chosen"), ["cell", "doc_id"]).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("doc_id", "set"))).alias("pivots"))
        held = common.materialise(held, "jaccard-pivots")

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                away, near, ids = [], [], []
                for s, ps in zip(b["set"], b["pivots"], strict=True):
                    own, p_sets = np.frombuffer(s, "<u8"), [np.frombuffer(p["set"], "<u8") for p in ps]
                    sizes = np.array([len(p) for p in p_sets])
                    both = np.array([len(np.intersect1d(own, p, assume_unique=True)) for p in p_sets])
                    away.append((1 - both / (len(own) + sizes - both)).tolist())
                    near.append(int((rule.linked(both, len(own), sizes).astype(np.int64) << np.arange(len(sizes))).sum()))
                    ids.append([p["doc_id"] for p in ps])
                yield b[["cell", "doc_id", "n", "set"]].assign(pivot_ids=ids, away=away, near=near)

        measured = rows.join(held, "cell").mapInPandas(common.trimmed(measure), "cell string, doc_id long, n long, set binary, pivot_ids array<long>, away array<double>, near long")
        measured = common.materialise(measured, "jaccard-measured")
        at = F.posexplode("pivot_ids").alias("j", "pivot")
        near = F.getbit("near", "j") == 1
        out.append(measured.select("doc_id", "near", at).filter(near & (F.col("doc_id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))

        @F.pandas_udf("long")
        def largest(masks: pd.Series) -> pd.Series:
            """The pivots of the component with most documents; a pivot is a bit."""
            def one(found) -> int:
                parts: list[list[int]] = []
                for x in found:
                    mask, n = int(x["near"]), int(x["docs"])
                    if mask:
                        touching = [p for p in parts if p[0] & mask]
                        parts = [p for p in parts if not p[0] & mask]
                        for p in touching:
                            mask, n = mask | p[0], n + p[1]
                        parts.append([mask, n])
                return max(parts, key=lambda p: (p[1], p[0]))[0] if parts else 0

            return masks.map(one)

        masks = measured.groupBy("cell", "near").agg(F.count(F.lit(1)).alias("docs")).groupBy("cell").agg(F.sum("docs").alias("size"), F.collect_list(F.struct("near", "docs")).alias("found"))
        state = common.materialise(masks.select("cell", "size", largest("found").alias("main")), "jaccard-main")
        joined = measured.join(state, "cell").withColumn("is_main", F.col("near").bitwiseAND(F.col("main")) != 0)
        joined = common.materialise(joined.drop("near", "pivot_ids"), "jaccard-rounds")

        # the Voronoi region of each document of the main component, in parts that fit a task
        inside = joined.filter("is_main").withColumn("home", F.array_position("away", F.array_min("away")) - 1)
        region = inside.groupBy("cell", "home").agg(F.count(F.lit(1)).alias("docs"), F.max(F.array_min("away")).alias("reach"))
        region = common.materialise(region.withColumn("parts", F.ceil(F.col("docs") / F.lit(most // 2)).cast("int")), "jaccard-regions")
        inside = inside.join(region, ["cell", "home"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        # windows: documents outside that a region's members may be linked with
        outside = joined.filter("not is_main").join(region, "cell").filter(F.get("away", F.col("home").cast("int")) <= F.col("reach") + F.lit(rule.radius + 1e-9))
        groups = common.looked_up(outside.groupBy("cell", "home").agg(F.ceil(F.count(F.lit(1)) / F.lit(most // 2)).cast("int").alias("groups")), "jaccard-windows")
        outside = outside.join(groups, ["cell", "home"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("group", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int"))
        inside = inside.join(groups, ["cell", "home"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        both = [x.select("cell", "home", "part", "group", "doc_id", "set") for x in (inside, outside)]
        out.append(cell_links(both[0].unionByName(both[1]), ["cell", "home", "part", "group"], rule, parts))

        # what is left is the next round's cell
        left = joined.filter("not is_main").select("cell", "doc_id", "n", "set", F.col("size").alias("before"))
        left = left.join(common.looked_up(left.groupBy("cell").agg(F.count(F.lit(1)).alias("size")), "jaccard-left"), "cell")
        fits, stuck = F.col("size") <= most, F.col("size") > F.col("before") * 0.9
        out.append(cell_links(left.filter(fits), ["cell"], rule, parts))
        rest = left.filter(~fits & stuck)
        out.append(block_pairs(rest.select("cell", "doc_id", "set", "size"), rule, most, parts))
        rows = left.filter(~fits & ~stuck).select("cell", "doc_id", "n", "set", "size")
        if rows.isEmpty():
            return out
    return out


def block_pairs(rows: DataFrame, rule: Rule, most: int, parts: int) -> DataFrame:
    """Links within cells in pairs of blocks, each of which fits a task."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("size") / F.lit(most // 2)).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return cell_links(met, ["cell", "i", "j"], rule, parts)


def similar(docs: DataFrame, percent: int = 75, words: int = 5, most: int = 120, block_bytes: int = 1 << 20, bucket_chars: int = 96 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    most: documents of a cell that one task compares.
    """
    spark = docs.sparkSession
    rule = Rule(percent)
    _, chars = common.text_size(docs)
    buckets = common.slices(spark, chars, bucket_chars, 1 << 20)
    common.arrow_rows(spark, 500)
    blocks = blocks_of(docs, block_bytes).drop("digests")
    common.arrow_rows(spark, 16)
    facts = narrow(blocks, words)
    filled = facts.filter("n > 0")
    reps = filled.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "block", "nth")).alias("at"), F.count(F.lit(1)).alias("times"))
    reps = common.materialise(reps, "jaccard-reps")
    repeated = filled.join(reps.filter("times > 1"), "sig").filter((F.col("block") != F.col("at.block")) | (F.col("nth") != F.col("at.nth")))
    copies = common.materialise(by_block(repeated.select("block", F.col("nth").alias("copies")), "copies"), "jaccard-copies")

    from .repeats import shared_anchors

    shared = shared_anchors(prefix_messages(blocks, rule, words, buckets), buckets)
    sets = survivors(blocks, shared, copies, rule, words, buckets)
    edges = candidate_edges(sets, rarity_classes(sets, buckets), rule, buckets)
    cells = components(edges)  # doc_id, component
    sized = cells.join(common.looked_up(cells.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "jaccard-cells"), "component").select("doc_id", F.col("component").cast("string").alias("cell"), "size")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                ids, own = opened_sets(row)
                yield pd.DataFrame({"doc_id": ids, "n": [len(s) for s in own], "set": [s.tobytes() for s in own]})

    rows = sets.mapInPandas(common.trimmed(each), "doc_id long, n long, set binary").join(sized, "doc_id")
    parts = common.slices(spark, chars, bucket_chars)
    common.arrow_rows(spark, 400)
    found = cell_links(rows.filter(F.col("size") <= most), ["cell"], rule, parts)
    large = common.materialise(rows.filter(F.col("size") > most).select("cell", "doc_id", "n", "set", "size"), "jaccard-large")
    if not large.isEmpty():
        for more in large_cell_links(large, rule, most, parts):
            found = found.unionByName(more)
    linked = components(common.materialise(found, "jaccard-links"))
    by_sig = reps.join(linked, reps["rep"] == linked["doc_id"], "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    joined = facts.withColumn("key", F.when(F.col("n") > 0, F.col("sig"))).join(by_sig.withColumnRenamed("sig", "key"), "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two array columns."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
