"""Collocations, mixing and resampling against plain versions of themselves."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import collocations, mixing, resampling

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def random_documents(spark):
    """Few words, so that phrases repeat; odd separators, nulls, copies, and a source with most of the rows."""
    draw = random.Random(3)
    words = ["the", "The", "sun", "Été", "moon", "new", "york", "city", "new york city", "a b", "x1", "\x00", "東京"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ;", "-"]
    rows = [(1, None, None, None), (2, "", "en", "s"), (2, "", "en", "s"), (3, " \t. ", None, "s"), (4, "lone", "de", None)]
    for i in range(5, 160):
        text = "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(1, 60)))
        rows.append((i, text, draw.choice(["en", "en", "en", "fr", None]), draw.choice(["s", "s", "t", "é", "z", None])))
    rows += [(i, "all of this text is a copy " * 8, "en", "s") for i in range(200, 220)]
    rows += [(300, "new york city " * 3000, "en", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(null as string) as words", "1 as rank", "2 as n", "'x' as score", "1L as size")


def plain_collocations(rows, longest, least, covered, first):
    f = defaultdict(Counter)
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r["text"] or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[r["lang"] or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        n = sum(c for w, c in count.items() if len(w) == 1)
        mine = {w: c for w, c in count.items() if len(w) > 1 and c >= least}
        kept = []
        for w, a in mine.items():
            if any(len(v) > len(w) and 100 * b >= covered * a and any(v[i : i + len(w)] == w for i in range(len(v))) for v, b in mine.items()):
                continue
            score, k = min((1000 * a * n // (count[w[:k]] * count[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), count[w[:k]], count[w[k:]], n))
        out |= {(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right, n) in enumerate(sorted(kept)[:first], 1)}
    return out


@pytest.mark.parametrize("longest, least, covered, first", [(5, 3, 100, 10**6), (3, 2, 60, 7), (2, 5, 100, 20)])
def test_collocations_equal_plain_ones(random_documents, longest, least, covered, first):
    found = collocations.collocations(random_documents, longest, least, covered, first, filter_bits=1 << 12)
    assert {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == plain_collocations(random_documents.collect(), longest, least, covered, first)


def test_a_full_filter_changes_nothing(random_documents):
    rows = [sorted(collocations.collocations(random_documents, 4, 4, filter_bits=b).collect()) for b in (64, 1 << 20)]
    assert rows[0] == rows[1]


def test_products_beyond_64_bits(spark):
    windows = spark.createDataFrame([("en", "a", "b", 3 * 10**12), ("en", "b", None, 10**6), ("en", "c", None, 4 * 10**12)], "lang string, w1 string, w2 string, n long")
    counts = {tuple(r["words"]): r["f"] for r in collocations.phrase_counts(windows, 2, 10).collect()}
    assert counts == {(): 7 * 10**12 + 10**6, ("a",): 3 * 10**12, ("b",): 10**6, ("c",): 4 * 10**12, ("a", "b"): 3 * 10**12}


def test_collocations_of_edge_cases(edge_documents, no_documents):
    assert collocations.collocations(no_documents).count() == 0
    assert {tuple(r)[:8] for r in collocations.collocations(edge_documents, least=2).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == plain_collocations(edge_documents.collect(), 5, 2, 100, 2000)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    named = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(named)}
    left, full = share * sum(sizes.values()), {}
    while True:
        still = [s for s in named if s not in full]
        rest = left - sum(full.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in still) for s in still}
        over = [s for s in still if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | target
        full |= {s: float(most * sizes[s]) for s in over}


def plain_apportionment(weights, seats):
    heap = [(-w, name, 0) for name, w in weights.items() if w > 0]
    heapq.heapify(heap)
    out = Counter()
    for _ in range(seats):
        _, name, k = heapq.heappop(heap)
        out[name] += 1
        heapq.heappush(heap, (-weights[name] / (2 * k + 3), name, k + 1))
    return out


def test_seats_go_to_the_highest_quotients(spark):
    from pyspark.sql import functions as F

    draw = random.Random(4)
    for n, seats in ((1, 5), (7, 3), (40, 1000), (40, 10), (300, 4000)):
        weights = {i: draw.choice([0.0, 1.0, 1.0, draw.uniform(0, 100), draw.uniform(0, 2)]) for i in range(n)}
        weights[0] = 2.0
        parts = spark.createDataFrame(list(weights.items()), "id long, w double")
        found = {r["id"]: r["seats"] for r in mixing.apportioned(parts, "w", F.lit(seats), "id", "seats").collect() if r["seats"]}
        assert found == plain_apportionment(weights, seats)


@pytest.mark.parametrize("shard_words, block", [(10**6, 16), (300, 16), (200, 1)])
def test_mix_meets_its_targets(random_documents, shard_words, block):
    rows = mixing.mix(random_documents, block=block, shard_words=shard_words).collect()
    source = {r["doc_id"]: r["source"] for r in random_documents.collect()}
    docs = Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in random_documents.collect())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == docs
    sizes, taken, shards = Counter(), Counter(), Counter()
    for r in rows:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
    for s in sizes:
        shards[s] = 1 + sizes[s] // shard_words
        assert abs(taken[s] - want[s]) <= block * (1 + shards[s])


def test_mix_repeats_itself_in_another_layout(spark, random_documents):
    rows = sorted(map(tuple, mixing.mix(random_documents, shard_words=500).collect()))
    assert sorted(map(tuple, mixing.mix(random_documents.repartition(7), shard_words=500).collect())) == rows


def test_mix_of_edge_cases(spark, edge_documents, no_documents):
    assert mixing.mix(no_documents).count() == 0
    assert all(r["taken"] <= 2 * r["size"] for r in mixing.mix(edge_documents).collect())
    empty = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(empty).collect()} == {(0, 0.0, 0)}


def test_targets_where_several_sources_stay_open(spark):
    draw = random.Random(6)
    names = [None, "", "Z", "a", "b", "é", "\ufffd", "😀"]
    cases = [{"a": 100, "b": 100, "c": 100}, {"a": 1, None: 10**12}, {f"s{i}": 200 + i for i in range(20)}, {"a": 0, "b": 7}]
    cases += [{s: draw.choice([0, 3, draw.randrange(100), draw.randrange(10**6)]) for s in names[i % 8 :]} for i in range(12)]
    for sizes in cases:
        rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 150, 2).collect()
        assert {r["source"]: r["target"] for r in rows} == pytest.approx(plain_targets(sizes))


def test_mix_of_odd_rows_meets_its_targets(spark):
    """Sources of like sizes, so that some fill up and some don't; one beside very many that are smaller than a block."""
    texts = [None, "", "\t\n ", "a\x1cb\x85c\xa0d\u2028e", "x\x0by\x0cz", "\x00 \x7f 😀 東京\u3000é", "a b c d e f g h " * 40]
    even = [(i // 2, texts[i % 7], ["b", "Z", "é", "", None][i % 5]) for i in range(350)] + [(None, "q r", None)] * 2
    small = [(i, "a b c", f"s{i:03}") for i in range(300)] + [(1000 + i, "w " * 100, None) for i in range(100)]
    for given in (even, small):
        rows = mixing.mix(spark.createDataFrame([(*r, i) for i, r in enumerate(given)], "doc_id long, text string, source string, n int")).collect()
        sizes, taken = Counter(), Counter()
        for _, text, s in given:
            sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        want = plain_targets(sizes)
        found = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows)
        assert found == Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), sizes[s], round(want[s], 6)) for d, t, s in given)
        for r in rows:
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source_size"], round(r["target"], 6)] += r["taken"]
        alike = Counter((sizes[s], round(want[s], 6)) for s in sizes)
        for (size, target), n in alike.items():
            assert abs(taken[size, target] - n * target) <= 24 * n


def test_crcs_of_n_grams():
    texts = ["The sun", None, "", "-a--b c,", "東京 été x 1", "z" * 5000 + " end", " \x7f{", "q"]
    texts += ["".join(random.Random(i).choice("ab c") for _ in range(i * 37 % 900)) for i in range(40)]
    scan = resampling.Scan(pa.array(["cut off", *texts], pa.string()).slice(1))
    for n in (1, 2, 3, 7):
        want = []
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(SMALL))
            want += [(zlib.crc32(" ".join(w[j : j + n]).encode()), i) for j in range(len(w) - n + 1)]
        assert list(zip(*(x.tolist() for x in scan.grams(n)), strict=True)) == want


def plain_resampling(rows, target, longest, buckets, percent, shortest, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r["text"])[1])
    for r in target:
        t.update(features(r["text"])[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for r in rows:
        n, found = features(r["text"])
        h = int(hashlib.sha256(f"{seed}:{r['doc_id']}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((n >= shortest, r["doc_id"], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in out if r[0]), key=lambda r: (-r[4], r[1], r[2]))
    drawn = [(*r[1:], i) for i, r in enumerate(may[: percent * len(may) // 100], 1)]
    return sorted([*drawn, *((*r[1:], None) for r in [*may[len(drawn) :], *(r for r in out if not r[0])])], key=str)


@pytest.mark.parametrize("longest, buckets, percent, shortest", [(1, 10_000, 10, 20), (3, 97, 100, 0), (2, 1, 33, 5)])
def test_resampling_equals_plain_one(spark, random_documents, longest, buckets, percent, shortest):
    target = spark.createDataFrame([("new york city the sun",), (None,), ("lone",)], "text string")
    found = resampling.resample(random_documents, target, longest, buckets, percent, shortest, seed=9)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_resampling(random_documents.collect(), target.collect(), longest, buckets, percent, shortest, 9)


def test_resampling_of_edge_cases(spark, edge_documents, no_documents):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(no_documents, none).count() == 0
    rows = resampling.resample(edge_documents, none, shortest=1, percent=100).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1 + sum(r["n_features"] > 0 for r in rows)))
    assert len(rows) == edge_documents.count()
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "a b")], "doc_id long, text string")
    assert len(resampling.resample(odd, none, shortest=1, percent=100).collect()) == 3


def test_zero_bytes_are_skipped_in_bulk():
    registers, n = np.array([1, 0xDEADBEEF, 7], np.uint32), np.array([0, 1000, 3])
    assert resampling.carried(registers, n).tolist() == [int(r) if not k else int(resampling.carried(resampling.carried(np.array([r]), np.array([k - 1])), np.array([1]))[0]) for r, k in zip(registers, n, strict=True)]
