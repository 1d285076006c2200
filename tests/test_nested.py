"""Joins of intervals of any length through nested bins."""

import random

from pyspark.sql import functions as F

from helixframe.operators import intervals, references
from helixframe.plans import interval_queries


def test_nested_join_equals_brute_force(spark):
    draw = random.Random(6)

    def some(n):
        return [(i, draw.choice("xy"), s := draw.randrange(-500, 3000), s + draw.choice([0, 1, 2, 15, 16, 17, 64, 300, 5000]) + draw.randrange(0, 3)) for i in range(n)]

    left, right = some(150), some(120)
    a = spark.createDataFrame(left, "a long, contig string, l_start long, l_end long")
    b = spark.createDataFrame(right, "b long, contig string, r_start long, r_end long")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3]))
    assert sorted((r["a"], r["b"]) for r in intervals.nested_join(a, b).select("a", "b").collect()) == want
    other = b.withColumnRenamed("contig", "place")
    found = intervals.nested_join(a, other, ("contig", "l_start", "l_end"), ("place", "r_start", "r_end"), F.col("a") < F.col("b"))
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [p for p in want if p[0] < p[1]]
    assert intervals.nested_join(a.filter("a < 0"), b).count() == 0


def test_long_intervals_are_few_rows(spark):
    """A hundred million letters against single ones; with bins of one width these would be millions of rows."""
    long = spark.createDataFrame([(i, "c", i, i + 100_000_000) for i in range(20)], "a long, contig string, l_start long, l_end long")
    short = spark.range(1000).selectExpr("id as b", "'c' as contig", "id * 100001 as r_start", "id * 100001 + 1 as r_end")
    found = intervals.nested_join(long, short)
    assert found.count() == sum(i <= b * 100_001 < i + 100_000_000 for i in range(20) for b in range(1000))
    assert intervals.nested_join(long, long.toDF("b", "contig", "r_start", "r_end")).count() == 400


def test_places_of_the_packed_target(spark):
    lengths = spark.createDataFrame([(i, n) for i, n in enumerate([3, 0, 70_000, 1, 5])], "id long, len long")
    places = spark.createDataFrame([(p,) for p in (0, 2, 3, 70_002, 70_003, 70_004, 70_008, 70_009)], "place long")
    rows = {r["place"]: (r["id"], r["pos"]) for r in references.packed_places(places, lengths).collect()}
    assert rows == {0: (0, 0), 2: (0, 2), 3: (2, 0), 70_002: (2, 69_999), 70_003: (3, 0), 70_004: (4, 0), 70_008: (4, 4)}


def test_close_pairs_equal_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice("xy"), s := draw.randrange(-300, 900), s + draw.choice([-3, 0, 1, 9, 63, 64, 70, 400, 3000]) + draw.randrange(0, 3)) for i in range(200)] + [(900, None, 5, 9), (901, None, 5, 9), (902, "x", None, 7)]
    a = spark.createDataFrame(rows, "a long, contig string, a_start long, a_end long")
    for share in (0.0, 0.3, 0.5, 1.5):
        want = sorted((x[0], y[0]) for x in rows[:200] for y in rows[:200] if x[1] == y[1] and max(abs(x[2] - y[2]), abs(x[3] - y[3])) <= (x[3] - x[2]) * share // 1)
        found = intervals.close_pairs(a, a.toDF("b", "contig", "b_start", "b_end"), share, "contig")
        assert sorted((r["a"], r["b"]) for r in found.select("a", "b").collect()) == want


def test_close_members_of_one_large_family(spark, tmp_path):
    """Two hundred thousand parts of one brand and type: comparing each with each would take hours."""
    spark.range(200_000).selectExpr("id * 20 AS p_partkey", "'Brand#7' AS p_brand", "'t' AS p_type", "CAST(id % 50 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert interval_queries.close_members(spark, str(tmp_path)).count() == sum(20 <= (i + 1) // 2 and abs(20 + (i + 1) % 50 - i) <= (i + 1) // 2 for i in range(50)) * 4000
