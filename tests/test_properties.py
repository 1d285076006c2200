"""Operators that SQL can't express, against plain Python on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.interval import within
from helixframe.functions.sequence import reverse_complement, wrapped
from helixframe.operators import annotation, graphs, intervals, kmers, matrix, ordered, piles, sequences
from helixframe.plans import graph_queries


def test_sequence_functions(spark):
    r = spark.createDataFrame([("ACGTNacgt",), ("",)], "s string").select(reverse_complement("s").alias("r"), reverse_complement(reverse_complement("s")).alias("same"), wrapped("s", 4).alias("w"), "s").collect()
    assert r[0]["r"] == "acgtNACGT" and all(x["same"] == x["s"] for x in r)
    assert [x["w"] for x in r] == ["ACGT\nNacg\nt", ""]


@pytest.mark.parametrize("tolerance, short, long", [(0.95, 5, 100), (0.95, 1, 20), (0.8, 20, 100), (0.2, 8, 10), (0.05, 19, 20)])
def test_a_length_at_the_tolerance_is_within_it(spark, tolerance, short, long):
    r = spark.range(1).select(within(tolerance, F.lit(short), F.lit(long)).alias("at"), within(tolerance, F.lit(short), F.lit(long + 1)).alias("beyond")).first()
    assert r["at"] and not r["beyond"]


def test_statistics_of_few(spark):
    df = spark.createDataFrame([(1, "GGCC"), (2, "AAAATTTT"), (3, "NN")], "id long, seq string")
    r = sequences.statistics(df).first()
    assert (r["n_seqs"], r["size"], r["min_len"], r["max_len"], r["n50"], r["n50_compat"]) == (3, 14, 2, 8, 8, 4)
    one = sequences.statistics(df.filter("id = 1")).first()
    assert (one["n50"], one["n50_compat"]) == (4, 0)
    none = sequences.statistics(df.filter("id > 9")).first()
    assert none["n_seqs"] is None and none["n50"] == 0


def test_windows_join_to_the_sequence(spark):
    df = spark.createDataFrame([("a", "ACGT" * 7), ("b", "ACG"), ("c", "ACGTAC" * 2)], "id string, seq string")
    found = sequences.split_windows(df, window=10, least=0).orderBy("id", "start").collect()
    assert [(r["id"], r["start"], r["end"]) for r in found] == [("a_0-10", 0, 10), ("a_10-28", 10, 28), ("b", 0, 3), ("c", 0, 12)]
    assert "".join(r["seq"] for r in found if r["id"].startswith("a")) == "ACGT" * 7


@pytest.mark.parametrize("limit", [1, 7, 40, 1000])
def test_bundles_equal_a_loop(spark, limit):
    draw = random.Random(limit)
    sizes = [draw.choice([0, 1, 2, 3, 5, 9, 60]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(5)
    want, held, number = [], 0, 0
    for s in sizes:
        if held and held + s > limit:
            number, held = number + 1, 0
        held += s
        want.append(number)
    assert [r["bundle"] for r in ordered.greedy_bundles(df, "size", limit, "id").orderBy("id").collect()] == want


def test_running_total(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7).repartition(6)
    assert [r["before"] for r in ordered.running_total(df, "v", "id").orderBy("id").collect()] == [sum(j % 7 for j in range(i)) for i in range(100)]


def test_words_cross_chunks(spark):
    seq = "".join(random.Random(1).choices("ACGTN", k=1300))
    found = kmers.occurrences(spark.createDataFrame([(1, seq), (2, "AC"), (3, "")], "id long, seq string"), 5).collect()
    assert sorted((r["id"], r["pos"], r["kmer"]) for r in found) == [(1, i, seq[i : i + 5]) for i in range(1296) if "N" not in seq[i : i + 5]]


@pytest.mark.parametrize("k", [3, 8, 17])
def test_place_counts_equal_brute_force(spark, k):
    """Ids that occur once, several times and not at all; places beyond those that a task holds; nothing is counted by single rows where an id is alone."""
    draw = random.Random(k)
    passage = "".join(draw.choices("ACGT", k=90))
    rows = [(i if i < 30 else draw.choice([None, 30, 31, 32]), draw.choice(["", "AC", passage, passage[:70], passage[:40] + "N" + passage[41:], passage.lower()])) for i in range(50)]
    want = {}
    for i, x in rows:
        for p in range(len(x) - k + 1):
            if (w := x[p : p + k].upper()).strip("ACGT") == "":
                want.setdefault((w, p), []).append(i)
    df = spark.createDataFrame(rows, "id long, seq string")
    found = kmers.place_counts(df, k).collect()
    assert {(r["kmer"], r["pos"]): (r["n_docs"], r["n"]) for r in found} == {key: (len(set(x) - {None}), len(x)) for key, x in want.items()} and len(found) == len(want)
    assert kmers.place_counts(df.filter("id < 0"), k).count() == 0


@pytest.mark.parametrize("width", [1, 5, 64])
def test_overlap_join_equals_brute_force(spark, width):
    draw = random.Random(width)
    a = [(draw.choice("xy"), i, s, s + draw.randint(0, 20)) for i in range(60) for s in [draw.randint(0, 90)]]
    b = [(draw.choice("xy"), i, s, s + draw.randint(0, 20)) for i in range(60) for s in [draw.randint(0, 90)]]
    found = intervals.overlap_join(spark.createDataFrame(a, "contig string, a long, l_start long, l_end long"), spark.createDataFrame(b, "contig string, b long, r_start long, r_end long"), width)
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3])
    assert sorted((r["a"], r["b"]) for r in found.select("a", "b").collect()) == want


def test_union_across_tiles(spark):
    rows = [("k", 0, 70_000), ("k", 65_000, 66_000), ("k", 70_000, 140_000), ("k", 140_001, 140_002), ("m", 5, 6)]
    found = intervals.union(spark.createDataFrame(rows, "key string, start long, end long"), "key").collect()
    assert sorted((r["key"], r["start"], r["end"], r["n"]) for r in found) == [("k", 0, 140_000, 3), ("k", 140_001, 140_002, 1), ("m", 5, 6, 1)]


def random_edges(seed, nodes, n):
    draw = random.Random(seed)
    return sorted({tuple(sorted(draw.sample(range(nodes), 2))) for _ in range(n)})


def test_components_and_signs(spark):
    edges = random_edges(3, 60, 40)
    draw = random.Random(4)
    signed = [(a, b, draw.choice([1, 1, -1])) for a, b in edges]
    df = spark.createDataFrame(signed, "src long, dst long, twist int")
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["component"] for r in graphs.components(df.select("src", "dst")).collect()} == root
    good = {}
    for c in set(root.values()):
        own = [e for e in signed if root[e[0]] == c]
        strand, todo = {c: 1}, True
        while todo:
            todo = False
            for a, b, t in own:
                for p, q in ((a, b), (b, a)):
                    if p in strand and q not in strand:
                        strand[q], todo = strand[p] * t, True
        if all(strand[a] * strand[b] == t for a, b, t in own):
            good |= strand
    assert {r["node"]: r["strand"] for r in graphs.signed_components(df).collect()} == good


@pytest.mark.parametrize("shift", [0, -1000, (1 << 63) - 40, -(1 << 63) + 5])
def test_signs_of_nodes_of_any_number(spark, shift):
    """The smallest node is plus, below zero and near the ends of 64 bits as well; a component that contradicts itself goes."""
    edges = [(1, 2, -1), (2, 13, 1), (13, 14, -1), (20, 21, 1), (21, 22, 1), (20, 22, -1), (30, 31, -1)]
    df = spark.createDataFrame([(a + shift, b + shift, t) for a, b, t in edges], "src long, dst long, twist int")
    found = {(r["node"] - shift, r["component"] - shift, r["strand"]) for r in graphs.signed_components(df).collect()}
    assert found == {(1, 1, 1), (2, 1, -1), (13, 1, -1), (14, 1, 1), (30, 30, 1), (31, 30, -1)}


def test_maximal_cliques_equal_brute_force(spark):
    edges = random_edges(8, 12, 36)
    near = {x: {b if a == x else a for a, b in edges if x in (a, b)} for x in range(12)}
    cliques = [set(c) for n in range(1, 9) for c in itertools.combinations(range(12), n) if all(y in near[x] for x, y in itertools.combinations(c, 2))]
    want = sorted(sorted(c) for c in cliques if len(c) >= 3 and not any(c < d for d in cliques))
    found = graphs.maximal_cliques(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(r["members"] for r in found.collect()) == want


def test_pagerank_sums_to_one(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (2, 1, 1.0), (4, 3, 1.0)], "src long, dst long, weight double")
    ranks = {r["node"]: r["rank"] for r in graphs.pagerank(df, rounds=30, tolerance=1e-9).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == 3


def test_communities_of_two_cliques(spark):
    edges = [*itertools.combinations(range(6), 2), *itertools.combinations(range(6, 12), 2), (0, 6)]
    found = {r["node"]: r["community"] for r in graphs.communities(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(found) == 12 and len({found[i] for i in range(6)}) == 1 and found[3] != found[9]


def test_factors_are_positive_and_errors_fall(spark):
    rows = [(i, j, float((i % 3 + 1) * (j % 2 + 1) + (i + j) % 2)) for i in range(9) for j in range(6)]
    w, h, errors = matrix.factorise(spark.createDataFrame(rows, "i long, j long, v double"), k=2, rounds=4)
    assert all(b <= a + 1e-6 for a, b in itertools.pairwise(errors))
    assert all(x >= 0 for f in (w, h) for r in f.collect() for x in r["w"])


def test_replicated_runs_equal_numpy_and_stop_alone(spark):
    v = np.array([[float((i % 3 + 1) * (j % 2 + 1) + (i * j) % 4) for j in range(6)] for i in range(8)])
    df = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(8) for j in range(6)], "i long, j long, v double")
    starts = {r: [df.select(x).distinct().select(x, matrix._draw(x, 2, 5 + 100 * r + more).alias("w")).orderBy(x).collect() for x, more in (("i", 0), ("j", 1))] for r in range(3)}
    w, h, errors = matrix.replicated(df, k=2, runs=3, rounds=30, tolerance=0.05, seed=5)
    got = {(r["run"], r["i"], r["pattern"]): r["weight"] for r in matrix.run_table(w, "i", 2).collect()}
    for r in range(3):
        a, b = (np.array([x["w"] for x in s]) for s in starts[r])
        want = []
        for _ in range(30):
            b *= (v.T @ a) / (b @ (a.T @ a) + 1e-12)
            a *= (v @ b) / (a @ (b.T @ b) + 1e-12)
            want.append(((v - a @ b.T) ** 2).sum())
            if len(want) > 1 and want[-2] - want[-1] <= 0.05 * want[-2]:
                break
        assert errors[r] == pytest.approx(want, rel=1e-6)
        assert [got[r, i, p] for i in range(8) for p in range(2)] == pytest.approx(a.ravel().tolist(), rel=1e-6)
    own_w, own_h, best = matrix.best_run(w, h, errors, 2)
    assert best == min(range(3), key=lambda r: errors[r][-1])
    assert {r["i"]: r["w"] for r in own_w.collect()} == {i: [got[best, i, 0], got[best, i, 1]] for i in range(8)} and own_h.count() == 6


def test_runs_end_with_the_time_limit_and_an_empty_matrix_has_empty_factors(spark):
    df = spark.createDataFrame([(i, j, float(i + j + 1)) for i in range(4) for j in range(3)], "i long, j long, v double")
    assert [len(e) for e in matrix.replicated(df, k=2, runs=2, rounds=50, tolerance=-1.0, seconds=0.0)[2]] == [1, 1]
    w, h, errors = matrix.factorise(df.limit(0), k=2)
    assert w.count() == h.count() == 0 and errors[-1] == 0


def test_stitched_families_carry_strands(spark):
    # families 1 and 2 turned, 3 as 2, 4 and 5 contradict each other through 6
    rows = [(0, 1, 0, "c", 0, 100, 1), (1, 2, 0, "c", 0, 100, -1), (1, 2, 1, "c", 500, 600, 1), (2, 3, 0, "c", 501, 600, 1), (2, 3, 1, "d", 7, 9, -1), (0, 1, 1, "d", 40, 60, 1), (1, 2, 2, "d", 40, 60, 1)]
    rows += [(0, 4, 0, "e", 0, 100, 1), (1, 5, 0, "e", 0, 100, 1), (1, 5, 1, "e", 300, 400, 1), (2, 6, 0, "e", 300, 400, 1), (2, 6, 1, "e", 800, 900, -1), (0, 4, 1, "e", 800, 900, 1)]
    members = spark.createDataFrame(rows, "file_id int, family_id long, ord long, contig string, start long, end long, strand int")
    found, places = piles.stitched_families(members, piles.stitch(members, 0.0225, 64))
    assert {tuple(r) for r in found.collect()} == {(1, 3, 5, 1, True), (4, 3, 3, 0, False)}
    assert {tuple(r) for r in places.filter("component = 1").collect()} == {(1, "c", 0, 100, 1), (1, "c", 500, 600, -1), (1, "c", 501, 600, -1), (1, "d", 7, 9, 1), (1, "d", 40, 60, 0)}
    assert {r["strand"] for r in places.filter("component = 4").collect()} == {0}


def test_annotation_texts_name_their_matches(spark):
    rows = [(1, 1, 1, 0, 100, 0, 50, 0, 50, 50, "AluY", ), (1, 2, 1, 0, 100, 60, 100, None, None, None, "L1"), (1, 3, 1, 0, 100, 90, 130, 10, 50, 0, "MIR")]
    schema = "t_id long, rank int, strand int, t_start long, t_end long, s_start long, s_end long, left long, right long, remains long, name string"
    targets = spark.createDataFrame([(1,), (2,)], "t_id long")
    got = {r["t_id"]: r["text"] for r in annotation.annotation_texts(targets, spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: '"Aaaaaaaaaa--bbbbbbcc AluY(100%|50%) L1 MIR(25%|20%)"', 2: '"--------------------"'}


def test_subpiles_absorb_near_images(spark):
    rows = [("p", 0, 100, 0, 50)] * 3 + [("p", 0, 100, 1, 51), ("p", 0, 100, 60, 100)]
    found = piles.subpiles(spark.createDataFrame(rows, "pile_id string, p_start long, p_end long, i_start long, i_end long")).orderBy("cluster").collect()
    assert [(r["start"], r["end"], r["depth"], r["accepted"]) for r in found] == [(0, 51, 4, True), (60, 100, 1, True)]


def test_landscape_peaks(spark):
    levels = piles.landscape(spark.createDataFrame([("p", 0, 6), ("p", 2, 8)], "pile_id string, i_start long, i_end long"))
    top = {r["pos"]: (r["height"], r["delta"]) for r in piles.landscape_features(levels).filter("k = 1").collect()}
    assert top[3] == (3, 1.0) and top[5] == (3, 1.0) and top[4] == (2, -0.5) and top[1][1] == -1.0


def test_annotation_map(spark):
    rows = [(1, 1, 1, 0, 100, 0, 50, 0, 50, 100), (1, 2, 1, 0, 100, 50, 100, 5, 55, 0), (2, 1, -1, 0, 100, 0, 50, None, None, None)]
    schema = "t_id long, rank int, strand int, t_start long, t_end long, s_start long, s_end long, left long, right long, remains long"
    found = {r["t_id"]: r["map"] for r in annotation.annotation_maps(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: "Aaaaaaaaaa" + "b" * 10, 2: "-" * 10 + "a" * 10}
    strict = {r["t_id"]: r["map"] for r in annotation.annotation_maps(spark.createDataFrame(rows, schema), strict_margin=True).collect()}
    assert strict[1] == "Aaaaaaaaaa" + "b" * 9 + "B"


def test_cliques_around_a_hub_equal_brute_force(spark):
    edges = random_edges(3, 14, 40) + [(100, x) for x in range(60)]
    nodes = sorted({x for e in edges for x in e})
    near = {x: {b if a == x else a for a, b in edges if x in (a, b)} for x in nodes}
    want = []

    def grow(r, p, x):
        if not p and not x and len(r) >= 3:
            want.append(sorted(r))
        for u in sorted(p):
            grow([*r, u], p & near[u], x & near[u])
            p, x = p - {u}, x | {u}

    grow([], set(nodes), set())
    found = graphs.maximal_cliques(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(r["members"] for r in found.collect()) == sorted(want)


def test_graph_queries_take_every_row(spark, tmp_path):
    rows = [(o, p, 1 + p % 3, "R" if p % 3 == 1 else "N", 1.0, 5) for o, parts in enumerate([(1, 2, 3), (1, 2, 3), (3, 4, 5, 6), (7, 8)]) for p in parts]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    cliques = graph_queries.graph_maximal_cliques(spark, str(tmp_path)).collect()
    assert sorted(r["members"] for r in cliques) == [[1, 2, 3], [3, 4, 5, 6]]
    assert graph_queries.graph_consistent_edges(spark, str(tmp_path)).count() == 12
    assert {r["node"] for r in graph_queries.graph_components(spark, str(tmp_path)).collect()} == set(range(1, 9)) | {-2, -3, -4}
    assert {r["node"] for r in graph_queries.graph_communities(spark, str(tmp_path)).collect()} == {1, 2, 3}
