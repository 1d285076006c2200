import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline
from helixframe.llm import common, components, jaccard, langid, packing, queries, repeats


def brute_repeats(rows, threshold):
    owner, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - threshold + 1):
            if owner.setdefault(raw[i : i + threshold], doc_id) < doc_id:
                gone[i : i + threshold] = [True] * threshold
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abé") for _ in range(draw.randint(1, 5)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(draw.randint(0, 30))) for _ in range(3)]
        parts.insert(draw.randint(0, 3), draw.choice(passages)[draw.randint(0, 9) :])
        rows.append((i * 3 % 121, " ".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, "a" * 300), (503, "a" * 120), (504, None), (505, ""), (506, rows[4][1][7:90])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (200, 1 << 20):
        found = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeats.remove_repeats(df, 50, block_bytes=block).collect()}
        assert found == brute_repeats(rows, 50)


def test_repeats_of_edge_rows(spark, edge_documents, no_documents):
    found = repeats.remove_repeats(edge_documents, 50, with_text=True, carry=("lang", "n_chars", "score")).collect()
    assert len(found) == 11
    by = {r["doc_id"]: r for r in found}
    assert by[4]["n_removed"] == by[4]["n_bytes"] and by[3]["n_removed"] == 0 and by[9]["n_removed"] == 0
    assert by[6]["lang"] == "fr" and by[1]["n_chars"] is None and bytes(by[10]["kept"]) == b"a"
    assert repeats.remove_repeats(no_documents, 50).count() == 0


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, groups=8, most=30):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 3000)}"
    rows, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(draw.randint(5, 90))]
        for _ in range(draw.randint(1, most)):
            own = base.copy()
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = word()
            rows.append((n, ("X " if draw.random() < 0.2 else "") + " ".join(own).upper()))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE\ttwo"), (n + 4, "two one"), (n + 5, "é"), (n + 6, " \n")]


@pytest.mark.parametrize("most", [120, 4])
def test_similar_documents_equal_brute_force(spark, most):
    """most = 4 sends nearly all groups through pivots, windows and blocks of large cells."""
    rows = near_copies(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "'x' as cell", "1 as n", "2 as part")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(df, most=most).collect()}
    assert found == brute_components(rows, 75)


def test_similar_edge_rows(spark, edge_documents, no_documents):
    found = jaccard.similar(edge_documents).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 11 and by[4]["component_id"] == by[5]["component_id"] == 3 and by[2]["component_id"] == 2
    assert by[8]["n_shingles"] == 1 and by[1]["n_shingles"] == 0
    assert jaccard.similar(no_documents).count() == 0


def test_region_links_connect_exactly_what_is_linked():
    import numpy as np

    draw = random.Random(2)
    rule = jaccard.Rule(75)
    for _ in range(30):
        base = [sorted(draw.sample(range(60), draw.randint(3, 25))) for _ in range(3)]
        sets = [np.array(sorted({x if draw.random() > 0.1 else draw.randint(0, 99) for x in draw.choice(base)}), np.uint64) for _ in range(14)]
        ids = np.arange(14)
        links = jaccard.region_links(ids, sets, rule)
        want = {(a, b) for a in range(14) for b in range(14) if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
        assert {(min(x), max(x)) for x in links} <= want
        for pairs in (links, want):
            root = list(range(14))
            for _ in range(14):
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            if pairs is links:
                mine = root
        assert mine == root


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 200).selectExpr("id as a", "id - 1 as b").union(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "a long, b long"))
    found = {r["doc_id"]: r["component"] for r in components.components(edges).collect()}
    assert found == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}


def test_pipeline_against_its_parts_by_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), corpus_pipeline.F.lit(True))
    left = {i: t for i, t in docs.items() if (p := model.predict(t))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    sets = {i: shingles(t) for i, t in left.items()}
    by_shingle = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, both in collections.Counter(j for x in s for j in by_shingle[x] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = {i: t for i, t in left.items() if find(i) == i}
    owner, cut = {}, {}
    for i in sorted(left):
        raw = left[i].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if owner.setdefault(raw[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or kept.strip(" "):
            cut[i] = kept
    stage = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {}
    for name, work in corpus_pipeline.STAGES[:-1]:
        stage = common.materialise(work(spark, stage, sf), f"test-{name}")
        assert stage.columns == list(corpus_pipeline.COLUMNS)
        texts[name] = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert texts["jaccard_join"] == left and texts["suffix_array_dedup"] == cut
    assert set(texts["benchmark_decontamination"]) < set(cut)
    encode = packing.FastIds(queries.tokenizer_path())
    packed = corpus_pipeline.STAGES[-1][1](spark, stage, sf).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(encode(t)) // 4 + 1 for i, t in texts["benchmark_decontamination"].items()}
