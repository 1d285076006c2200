"""Values that are known beforehand, on inputs written anew with the listed properties."""

import random

import pytest

from helixframe.operators import identities, intervals, kmers, piles, references, sequences
from helixframe.plans import report_queries
from helixframe.sources import formats, reports


def thirty_records():
    """30 records of 498 to 46,751 letters, 257,235 in all, 16 of them over 2,500, N50 17,916 and one further 16,688."""
    long = [46_751, 27_582, 25_000, 22_000, 17_916, 16_688, 16_000, 15_000]
    rest = [14_000, 12_000, 9_000, 8_000, 7_500, 3_000, 2_900, 2_600]
    short = [498, *[700 + 10 * i for i in range(13)]]
    short[-1] += 257_235 - sum(long + rest + short)
    return long + rest + short


def test_statistics_of_thirty_records(spark):
    sizes = thirty_records()
    assert len(sizes) == 30 and sum(sizes) == 257_235 and max(sizes[16:]) <= 2500 and min(sizes) == 498
    draw = random.Random(1)
    text = "".join(draw.choices("GGCCAT", k=sum(sizes)))
    seqs, at = [], 0
    for i, n in enumerate(sizes):
        seqs.append((i, text[at : at + n]))
        at += n
    df = spark.createDataFrame(seqs, "id long, seq string")
    found = sequences.statistics(df).first()
    assert (found["n_seqs"], found["size"], found["min_len"], found["max_len"], found["mean_len"]) == (30, 257_235, 498, 46_751, 8574.5)
    assert (found["n50"], found["n50_compat"]) == (17_916, 16_688)
    assert sequences.longer_than(df, 2500).count() == 16
    cut = sequences.split_windows(df, window=5000, least=2500).collect()
    own = sorted((r["start"], r["end"]) for r in cut if r["id"].startswith("1_"))
    assert own == [(0, 5000), (5000, 10_000), (10_000, 15_000), (15_000, 20_000), (20_000, 27_582)]
    assert sum(r["end"] - r["start"] for r in cut) == sum(n for n in sizes if n >= 2500)


def test_phylip_of_an_alignment(spark):
    rows = [(f"seq{i}", "ACDE-FGHIK" * 15 + "LMNP") for i in range(45)]
    lines = [r["line"] for r in sequences.phylip(spark.createDataFrame(rows, "id string, seq string")).orderBy("kind", "id").collect()]
    assert lines[0] == "45 154" and lines[1].startswith("seq0      ACDE-") and len(lines) == 46
    with pytest.raises(Exception, match="rows differ in length"):
        sequences.phylip(spark.createDataFrame([*rows, ("z", "A")], "id string, seq string")).collect()


def test_contigs_of_two_segments(spark):
    shown = spark.createDataFrame([("test", 2, 6, "AGTC"), ("test", 15, 19, "ACGT")], "contig_id string, start long, end long, seq string")
    lengths = spark.createDataFrame([("test", 20), ("bare", 3)], "contig_id string, len long")
    found = {r["contig_id"]: r["seq"] for r in references.rendered(shown, lengths).collect()}
    assert found == {"test": "nnAGTCnnnnnnnnnACGTn", "bare": "nnn"}
    assert {r["seq"] for r in references.rendered(shown, lengths, most=4).collect()} == {"nnAG...", "nnn"}
    turned = references.reversed_segments(shown.join(lengths, "contig_id"), complement=True).selectExpr("contig_id", "start", "start + length(seq) as end", "seq")
    assert references.rendered(turned, lengths.filter("contig_id = 'test'")).first()["seq"] == "nACGTnnnnnnnnnGACTnn"
    record = references.rendered(shown, lengths).filter("contig_id = 'test'").selectExpr("contig_id as name", "'' as descr", "seq").select(formats.record_text(10).alias("v")).first()["v"]
    assert record == ">test\nnnAGTCnnnn\nnnnnnACGTn"
    places = spark.createDataFrame([("test", i) for i in range(20)], "contig_id string, pos long")
    assert "".join(r["letter"] for r in references.letter_at(places, shown, 8).orderBy("pos").collect()) == "nnAGTCnnnnnnnnnACGTn"
    from pyspark.sql import functions as F

    assert references.with_letter(shown, F.lit(16), F.lit("T")).orderBy("start").collect()[1]["seq"] == "ATGT"
    assert [r["seq"] for r in references.with_letter(shown, F.lit(9), F.lit("T")).orderBy("start").collect()] == ["AGTC", "ACGT"]


def test_located_header(spark):
    descr = "range=chr18:78016000-78016181 5'pad=0 3'pad=0 strand=+ repeatMasking=none"
    found = formats.located(spark.createDataFrame([("x", descr, "A")], "id string, descr string, seq string")).first()
    assert (found["chr"], found["offset"], found["strand"]) == ("chr18", 78_015_999, 1)


def test_features_across_tiles(spark):
    text = "".join(random.Random(2).choices("ACGT", k=500))
    rows = [(i, "c", i * 7 % 450, i * 7 % 450 + 3 + i, 1 - 2 * (i % 2)) for i in range(60)] + [(100, "none", 0, 5, 1), (101, "c", 490, 600, 1)]
    found = references.extracted(spark.createDataFrame(rows, "feature_id long, contig string, start long, end long, strand int"), spark.createDataFrame([("c", text)], "id string, seq string"), width=16).collect()
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert {r["feature_id"]: r["seq"] for r in found} == {i: text[s:e] if d == 1 else turn(text[s:e]) for i, c, s, e, d in rows if c == "c"}


def test_identities_of_clusters_and_cliques(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    ranks = table([("g", n, 1.0 / p, p) for p, n in enumerate([5, 3, 8, 1, 9], 1)] + [("h", 20, 0.6, 1), ("h", 21, 0.4, 2)], "group_id string, node long, rank double, place int")
    groups = table([("g", False), ("h", True)], "group_id string, is_clique boolean")
    cliques = table([("g", "a", [1, 3, 8]), ("g", "b", [3, 5, 8])], "group_id string, clique_id string, members array<long>")
    found = {r["node"]: (r["cluster"], r["clique"]) for r in identities.identities(ranks, groups, cliques).collect()}
    # 3 and 8 are in both cliques; 1 is only in the one that 3 leads, so it is called by all of it
    assert found == {5: (5, "5"), 3: (5, "3*"), 8: (5, "8*"), 1: (5, "3.8.1"), 9: (5, None), 20: (20, "20"), 21: (20, "20")}
    assert {r["node"]: r["n"] for r in identities.clique_memberships(cliques).collect()} == {1: 1, 3: 2, 5: 1, 8: 2}


def test_group_ranks_rank_each_group_by_itself(spark):
    edges = [("a", 1, 2, 1.0), ("a", 2, 1, 1.0), ("a", 3, 1, 2.0), ("b", 4, 5, 1.0)]
    df = spark.createDataFrame([e[1:] for e in edges] + [(1, 4, 9.0)], "src long, dst long, weight double")
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b")], "node long, group_id string")
    found = {r["node"]: r for r in identities.group_ranks(groups, df).collect()}

    def plain(nodes, own):
        rank = dict.fromkeys(nodes, 1 / len(nodes))
        for _ in range(200):
            lost = sum(r for n, r in rank.items() if not any(s == n for s, *_ in own))
            total = {n: sum(w for s, _, w in own if s == n) for n in nodes}
            rank = {n: 0.15 / len(nodes) + 0.85 * (sum(rank[s] * w / total[s] for s, d, w in own if d == n) + lost / len(nodes)) for n in nodes}
        return rank

    for name in "ab":
        own = [e[1:] for e in edges if e[0] == name]
        for node, rank in plain(sorted({x for s, d, _ in own for x in (s, d)}), own).items():
            assert abs(found[node]["rank"] - rank) < 1e-5 and found[node]["group_id"] == name
    assert found[1]["place"] == 1 and found[5]["place"] == 1


def test_acceptance_by_deep_coverage(spark):
    schema = "pile_id string, p_start long, p_end long, i_start long, i_end long"
    rows = [("p", 0, 100, 0, 60)] * 3 + [("p", 0, 100, 55, 100)] * 2 + [("p", 0, 100, 0, 100)]
    at = {s: {(r["start"], r["end"]): r["accepted"] for r in piles.subpiles(spark.createDataFrame(rows, schema), target=1.0, strictness=s).collect()} for s in (0, 1, 2)}
    assert at[0] == {(0, 60): True, (55, 100): True, (0, 100): False}  # two or more images cover all before the last
    long = [("p", 0, 100, 10, 60)] * 3 + [("p", 0, 100, 0, 100)] * 2
    one = {(r["start"], r["end"]): r["accepted"] for r in piles.subpiles(spark.createDataFrame(long, schema), target=1.0, strictness=1).collect()}
    assert one == {(10, 60): False, (0, 100): False}  # the longer one holds the deeper one: both go
    clusters = spark.createDataFrame([("p", 0, 60, 1, True), ("p", 40, 100, 1, True), ("p", 90, 120, 5, False)], "pile_id string, start long, end long, depth long, accepted boolean")
    assert [tuple(r) for r in piles.deep_coverage(clusters).collect()] == [("p", 20)]


def test_unions_that_need_some_overlap(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 15, 30), ("c", 28, 40)], "contig string, start long, end long")
    runs = lambda gap: sorted((r["start"], r["end"]) for r in intervals.union(df, "contig", gap=gap).collect())
    assert runs(0) == [(0, 40)] and runs(2) == [(0, 10), (10, 40)] and runs(4) == [(0, 10), (10, 30), (28, 40)]


def test_reports(spark):
    rows = spark.createDataFrame([(1, 2.5, None), (2, None, "x")], "a long, b double, c string")
    assert [r["value"] for r in reports.tsv_lines(rows, ("a", "%d"), ("b", "%.1f"), ("c", "%s")).collect()] == ["1\t2.5\t", "2\t\tx"]
    w = spark.createDataFrame([(0, "r1", 2.0), (0, "r2", 30.0), (1, "r1", 0.5)], "pattern int, name string, weight double")
    h = spark.createDataFrame([(0, "c1", 1.0)], "pattern int, name string, weight double")
    lines = reports.pattern_lines(w, h).orderBy("pattern")
    assert [r["value"] for r in lines.collect()] == ["0\t[r2/3.000e+01,r1/2.000e+00]\t(c1/1.000e+00)", "1\t[r1/5.000e-01]\t()"]
    assert reports.pattern_blocks(lines).collect()[0]["value"].startswith("Feature 0:\n[r2/3.000e+01 r1/2.000e+00]\nc1/1.000e+00")
    bars = spark.createDataFrame([("rep", "#" * 40)], "name string, bar string")
    text = [r["value"] for r in reports.coverage_table(bars, bars.filter("name = ''")).collect()]
    assert text == ["repeat " + "named coverage".ljust(41) + "de novo coverage", "rep    " + "#" * 40 + " " + "-" * 40]
    files = spark.createDataFrame([("b",), ("a",), ("c",)], "f string")
    assert sorted(map(tuple, reports.job_pairs(files, "f").collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c")]
    assert reports.job_pairs(files, "f", diagonal=True).count() == 3
    table = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (5, 0, 0.0), (5, 1, 0.0)], "pos long, pattern int, weight double")
    assert [tuple(r) for r in reports.position_table(table, 2).collect()] == [(0, 1, 2.0, 1.0, 2.0)]


def test_trapezoid_bytes(spark):
    traps = spark.createDataFrame([(1, 4, -3, 2, 1), (2, 9, 8, 7, 1 << 40), (3, 1, 1, 1, 1)], "id long, top long, bottom long, left long, right long")
    back = formats.parse_trapezoids(formats.trapezoid_bytes(traps, "id"), "id").orderBy("id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in traps.collect()]


def test_protein_letters(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">p one\nMK-L.*\nVV\n")
    assert formats.read_fasta(spark, f"{tmp_path}/a.fa", "protein").first()["seq"] == "MK-L.*VV"
    (tmp_path / "b.fa").write_text(">p one\nMK1L\n")
    with pytest.raises(Exception, match="no letter of a protein"):
        formats.read_fasta(spark, f"{tmp_path}/b.fa", "protein").collect()


def test_kmers_of_odd_sequences(spark, monkeypatch):
    rows = [(1, "ACGTNACGT"), (2, ""), (3, None), (4, "ac"), (5, "acgtacgtaé")]
    df = spark.createDataFrame(rows, "id long, seq string")
    want = {}
    for i, s in rows:
        for p in range(len(s or "") - 2):
            word = s[p : p + 3].upper()
            if set(word) <= set("ACGT"):
                want.setdefault((i, word), []).append(p)
    assert {(r["id"], r["kmer"]): r["n"] for r in kmers.counts(df, 3).collect()} == {k: len(v) for k, v in want.items()}
    assert sorted((r["id"], r["kmer"], r["pos"]) for r in kmers.occurrences(df, 3).collect()) == sorted((*k, p) for k, v in want.items() for p in v)
    import numpy as np

    from helixframe.operators import letters

    found = np.frombuffer("".join(random.Random(1).choices("ACGTN", k=5000)).encode(), np.uint8)
    owner = np.repeat(np.arange(10), 500)
    whole = [x.tolist() for x in kmers.tallied(found, owner, 6)]
    monkeypatch.setattr(kmers, "MOST", 700)
    assert [x.tolist() for x in kmers.tallied(found, owner, 6)] == whole
    assert letters.words(np.array([27]), 3).to_pylist() == ["CGT"]


def test_landscape_files_name_their_place(spark):
    found = report_queries.pile_landscape_files(spark, "/root/testdata/sf0.001").collect()
    assert found and all(r["value"].startswith('{"Chromosome":"' + r["contig"]) for r in found)


def test_error_of_a_factorisation_equals_its_definition(spark):
    from helixframe.operators import matrix

    v = {(i, j): float((i % 3 + 1) * (j % 2 + 1) + (i + j) % 2) for i in range(7) for j in range(5)}
    w, h, errors = matrix.factorise(spark.createDataFrame([(*k, x) for k, x in v.items()], "i long, j long, v double"), k=2, rounds=3, tolerance=-1.0)
    w, h = {r["i"]: r["w"] for r in w.collect()}, {r["j"]: r["w"] for r in h.collect()}
    error = sum((x - sum(a * b for a, b in zip(w[i], h[j]))) ** 2 for (i, j), x in v.items())
    assert len(errors) == 3 and abs(errors[-1] - error) < 1e-6 * sum(x * x for x in v.values())
