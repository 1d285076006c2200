"""Operators against plain versions of themselves on small inputs."""

import itertools
import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import common, decontaminate, html_text, langid, packing, quality, queries, sharding, warc


def test_token_ids_equal_the_tokenizer():
    ids = packing.FastIds(queries.tokenizer_path())
    assert ids.merger is not None
    whole = [t.removesuffix("</w>") for t in list(ids.tokenizer.get_vocab())[::40] if t.endswith("</w>") and t.isascii()]
    draw = random.Random(3)
    latin = [chr(c) for c in range(1, 256)] + ["'s", "'ll", "'re", "'ve", "'", "''", " the ", " and", "<|endoftext|>"] * 8
    wide = [chr(c) for c in [*range(1, 0x600), 0x2019, 0x212A, 0x3000, 0x4E00, 0x1F600]]
    texts = [*whole, "", "'", "x's", "don't 12½ \x85", "\n"]
    texts += ["".join(draw.choice(pool) for _ in range(draw.randint(0, 40))) for pool in (latin, wide) for _ in range(400)]
    assert [x.tobytes() for x in ids.many(texts)] == [ids.whole(t).tobytes() for t in texts]


def best_fit(lengths, full, weights):
    """One piece after the other, the longest first, to the open sequence that is fullest with it."""
    bins = []
    for n in sorted(lengths, reverse=True):
        need = (n, 1, n * n)
        fits = [b for b in bins if all(r >= x for r, x in zip(b[0], need))]
        left = lambda b: sum(w * ((r - x) / f) ** 2 for w, r, x, f in zip(weights, b[0], need, full))
        if fits:
            own = min(fits, key=left)
        else:
            own = [list(full), []]
            bins.append(own)
        own[0] = [r - x for r, x in zip(own[0], need)]
        own[1].append(n)
    return sorted(tuple(b[1]) for b in bins)


@pytest.mark.parametrize("most_docs, most_cost", [(1000, 10**9), (3, 10**9), (1000, 700), (4, 900)])
def test_plans_equal_plain_best_fit(most_docs, most_cost):
    draw = random.Random(most_docs + most_cost)
    for _ in range(20):
        lengths = [draw.randint(1, 26) for _ in range(draw.randint(1, 60))]
        counts = Counter(lengths)
        weights = (1.0, 1e-3, 1e-3)
        p = packing.plan(dict(counts), 32, most_docs, most_cost, weights)
        bins = defaultdict(list)
        upto = np.append(p["rank"][1:], 0)
        for i, (length, rank, first, each, _) in enumerate(zip(*(p[c].tolist() for c in ("length", "rank", "first", "each", "base")))):
            end = int(upto[i]) if i + 1 < len(p["rank"]) and p["length"][i + 1] == length else counts[length]
            for r in range(rank, end):
                bins[first + (r - rank) // each].append(length)
        assert all(sum(b) <= 32 and len(b) <= most_docs and sum(x * x for x in b) <= most_cost for b in bins.values())
        assert sorted(x for b in bins.values() for x in b) == sorted(lengths)
        assert len(bins) == len(best_fit(lengths, (32, most_docs, most_cost), weights))


def test_shards_are_nearly_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = sharding.shard(docs, shards=40).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in found]
    assert len(sizes) == 40 and max(sizes) <= 1.1 * sum(sizes) / 40 and min(sizes) >= 0.9 * sum(sizes) / 40


def test_bins_equal_plain_vector_packing():
    draw = np.random.default_rng(4)
    vectors, weights = draw.random((300, 3)) / 30, (32.0, 1.0, 1.0)
    left = np.ones((7, 3)) * weights
    want = []
    for v in vectors:
        scores = [sum(r * x for r, x in zip(row, v)) for row in left]
        want.append(max(range(7), key=lambda i: (scores[i], -i)))
        left[want[-1]] -= v * weights
    assert sharding.place_all(vectors, weights, 7).tolist() == want


def test_scores_of_words_equal_a_plain_count():
    draw = np.random.default_rng(2)
    model = quality.Model(draw.normal(size=1 << 10), 0.1, 0.4)
    texts = ["a bb bb ccc", "", None, "  ", "déjà vu déjà", "x" * 5000, "one two\tone\none one"]
    got = model.scores(pa.array(texts, pa.string()))
    for text, score in zip(texts, got):
        total, n, words = 0.0, 0, (text or "").split()
        for word in words:
            found, of = quality.features(pa.array([word]), 1 << 10)
            marked = len(word) + 2
            assert len(found) == 1 + sum(max(0, marked - k + 1) for k in (3, 4, 5)) and set(of) == {0}
            total, n = total + sum(model.weights[i] for i in found), n + len(found)
        again = sum(a == b for a, b in itertools.pairwise(words))
        total, n = total + again * model.weights[quality.repeat_bucket(1 << 10)], n + again
        want = 1 / (1 + math.exp(-(total / n + 0.1))) if n else 0.4
        assert abs(score - want) < 1e-9


def test_backoff_equals_plain_dictionaries(spark):
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, "la maison et le jardin été", "fr"), (4, "der hund und das haus", "de")]
    from pyspark.sql import functions as F

    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    langs = ["de", "en", "fr"]
    assert model.langs == langs
    words = {k: Counter(w for _, t, x in rows if x == k for w in t.split()) for k in langs}
    grams = {n: {k: Counter(g for w in words[k] for g in ([f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w))) for k in langs} for n in range(1, 6)}

    def logs(tables):
        every = set().union(*tables.values())
        return {x: [math.log((tables[k][x] + 0.5) / (sum(tables[k].values()) + 0.5 * len(every))) for k in langs] for x in every}

    known, back = logs(words), {n: logs(t) for n, t in grams.items()}
    floor = min(min(v) for t in (known, *back.values()) for v in t.values())
    for text in ("the haus", "hausgarten", "jardinet zzz", "qqq", "été"):
        total = [0.0] * 3
        for w in text.split():
            row = known.get(w)
            for n in range(5, 0, -1):
                if row is None:
                    hits = [back[n][g] for g in ([f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)) if g in back[n]]
                    row = [sum(h[k] for h in hits) / len(hits) for k in range(3)] if hits else None
            total = [t + x for t, x in zip(total, row or [floor] * 3)]
        odds = [math.exp(t - max(total)) for t in total]
        lang, score = model.predict(text)
        assert lang == langs[total.index(max(total))] and abs(score - max(odds) / sum(odds)) < 1e-4


def alignments(words, item, least, share):
    """All places of an item, the longest run of which share is equal by trying every run."""
    need = least if len(item) > least else math.ceil(len(item) * share - 1e-9)
    best = 0
    for shift in range(-len(item) + 1, len(words)):
        equal = [0 <= i + shift < len(words) and words[i + shift] == x for i, x in enumerate(item)]
        hits = [0, *itertools.accumulate(equal)]
        best = max([best, *(hits[j] - hits[i] for i in range(len(item)) for j in range(i + need, len(item) + 1) if hits[j] - hits[i] >= share * (j - i))])
    return best if best >= need else 0


@pytest.mark.parametrize("changed", [0, 1, 3, 5, 7])
def test_overlaps_equal_exhaustive_alignment(changed):
    draw = random.Random(changed)
    pool = ["".join(p) for p in itertools.product(string.ascii_lowercase[:6], repeat=2)]
    missed = held = 0
    for _ in range(60):
        items = [[draw.choice(pool) for _ in range(draw.randint(14, 36))] for _ in range(3)]
        text = [draw.choice(pool) for _ in range(30)]
        for item in items[:2]:
            copy = item.copy()
            for i in draw.sample(range(len(copy)), min(changed, len(copy))):
                copy[i] = "other"
            text += copy + [draw.choice(pool) for _ in range(8)]
        found = {k for k, *_ in decontaminate.Index([(k, " ".join(x)) for k, x in enumerate(items)], 13, 0.75).look_up(" ".join(text))}
        want = {k for k, x in enumerate(items) if alignments(text, x, 13, 0.75)}
        assert found <= want
        missed, held = missed + len(want - found), held + len(want)
    assert missed <= 0.02 * held


@pytest.mark.parametrize("length", range(13, 18))
def test_masks_hit_every_run_with_thirteen_equal_tokens(length):
    for gaps in itertools.combinations(range(length), length - 13):
        equal = ["0" if i in gaps else "1" for i in range(length)]
        assert any(all(equal[i + p] == "1" for p, used in enumerate(mask) if used == "1") for mask in decontaminate.MASKS for i in range(length - len(mask) + 1))


def test_long_texts_and_common_words_against_a_benchmark(spark):
    template = [f"w{i}" for i in range(20)]
    items = [(k, " ".join([*template, f"own{k}"])) for k in range(300)] + [(1000, "yes"), (1001, "yes indeed")]
    docs = [(1, " ".join(template * 20)), (2, "yes " * 50), (3, "x" * 2_000_000), (4, "well yes indeed")]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, k) for k in range(300)} | {(4, 1001)}


def test_entropies_equal_plain_counts(spark):
    draw = random.Random(9)
    rows = [(f"h{draw.randrange(2)}", p, n, False, 0, draw.randrange(1 + n), draw.randrange(2 + 3 * n)) for p in range(60) for n in range(6)]
    df = spark.createDataFrame(rows, "host string, page long, node long, inside boolean, main long, shape long, words long")
    got = {(r["host"], r["node"]) for r in html_text.low_branches(df, threshold=0.6).collect()}
    want = set()
    for host, node in {(r[0], r[2]) for r in rows}:
        own = [r for r in rows if (r[0], r[2]) == (host, node)]
        share = lambda at: -sum(n / len(own) * math.log(n / len(own)) for n in Counter(r[at] for r in own).values()) / math.log(len(own))  # noqa: B023, E731
        if len(own) >= 4 and 0.3 * share(5) + 0.7 * share(6) < 0.6:
            want.add((host, node))
    assert got == want and want


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "end", "<ul><li>" * 10_000 + "end", "<span>" * 20_000 + "end", "<p>a" * 20_000 + "<p>end", "<span>" * 20_000 + "</b>" * 20_000 + "end", '<a "' * 20_000 + ">end", "<a '\">" * 20_000 + "end", "<b " + "x" * 300_000 + ">end", "<!" * 100_000 + ">end"])
def test_deep_and_broken_pages(page):
    assert html_text.extract(page).endswith("end")
    html_text.branches(page)


def test_style_tree_where_class_names_lie(spark):
    body = "<html><body><div class='story'><p>Buy this thing now</p></div><div class='x9'><h2>News {0}</h2><p>{1}</p></div><section class='content2'><p>Terms of the site</p></section></body></html>"
    rows = [(i, f"http://lying/{i}", body.format(i, f"what happened on day {i}")) for i in range(40)]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {i: f"News {i}\n\nwhat happened on day {i}" for i in range(40)}


def test_shard_starts_with_spread_ids(spark):
    draw = random.Random(5)
    ids = sorted({draw.randrange(-(1 << 62), 1 << 62) for _ in range(1500)} | set(range(300)))
    df = spark.createDataFrame([(i, 100 + i % 7) for i in ids], "page_id long, size long")
    starts = warc.shard_starts(df, 2000, 50_000, most_cells=64)
    ends = [*starts[1:].tolist(), ids[-1] + 1]
    sums = [sum(100 + i % 7 for i in ids if a <= i < b) for a, b in zip(starts.tolist(), ends)]
    assert starts[0] == ids[0] and sum(sums) == sum(100 + i % 7 for i in ids) and max(sums) <= 2000


def test_portions_hold_every_row():
    texts = pa.array(["a" * n if n % 3 else None for n in [5, 0, 3_000_000, 9_000_000, 1, 2, 4]], pa.string())
    cuts = list(common.cuts(texts))
    assert [x for a, n in cuts for x in range(a, a + n)] == list(range(len(texts)))
    assert re.fullmatch(r"\w*", langid.letters("Ab, ç 3_é½").replace(" ", "")) and langid.letters(None) == ""


def test_clustered_vectors_meet_few_shards(spark):
    from pyspark.sql import functions as F

    from helixframe.llm import topk

    draw = np.random.default_rng(1)
    centres = draw.normal(size=(8, 6)) * 20
    points = (centres[np.arange(1600) % 8] + draw.normal(size=(1600, 6)) * 0.2).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + [(3, points[8].tolist()), (20, points[9].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = F.col("vec_id") % 20 == 0
    own = np.floor(256 * np.array([v for _, v in rows]))
    ids = np.array([i for i, _ in rows])
    for extra in ({}, {"ball_bytes": 0}, {"shard_rows": 100, "query_rows": 7, "sample_rows": 50}):
        found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, asks, k=5, **extra).collect()}
        for q in range(0, 1600, 20):
            vector = min((own[ids == q]).tolist())
            scores = sorted((-int(own[j] @ vector), int(ids[j])) for j in range(len(ids)) if ids[j] != q)[:5]
            assert [found[q, r] for r in range(1, 6)] == [(i, -s) for s, i in scores]
