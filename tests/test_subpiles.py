"""Sub-piles in rounds, their acceptance and the families that they make, against the sequential loop."""

import random

import pytest

from helixframe.operators import piles


def plain_clusters(rows, share):
    """rows: (start, end) of a pile's images. The deepest interval absorbs what is near, again and again."""
    left = {}
    for x in rows:
        left[x] = left.get(x, 0) + 1
    out = []
    while left:
        s, e = min(left, key=lambda x: (-left[x], x))
        reach = int(share * (e - s))
        own = [x for x in left if abs(x[0] - s) <= reach and abs(x[1] - e) <= reach]
        out.append((min(x[0] for x in own), max(x[1] for x in own), sum(left.pop(x) for x in own), s, e))
    return sorted(out, key=lambda c: (-c[2], *c[:2], *c[3:]))


def plain_acceptance(made, size, strictness, tolerance, target):
    held, dropped = [], set()
    for i, (s, e, *_) in enumerate(made):
        bad = []
        for j in held:
            a, z = made[j][:2]
            both = min(e, z) - max(s, a)
            if strictness == 1 and ((s <= a and e > z) or (s < a and e >= z)) or strictness == 2 and both > 0 and both >= (1 - tolerance) * min(e - s, z - a):
                bad.append(j)
        if bad:
            dropped |= {i, *bad}
            continue
        held.append(i)
        deep = sum(sum(made[j][2] for j in held if made[j][0] <= x < made[j][1]) > 1 for x in range(size))
        if deep >= target * size:
            break
    return [i in held and i not in dropped for i in range(len(made))]


@pytest.mark.parametrize("share, strictness, tolerance, target", [(0.05, 0, 0.95, 0.95), (0.3, 1, 0.95, 0.99), (0.2, 2, 0.95, 2.0), (0.2, 2, 0.4, 0.9), (1.0, 0, 0.95, 0.5), (0.0, 2, 0.6, 0.95)])
def test_subpiles_equal_the_sequential_loop(spark, share, strictness, tolerance, target):
    draw = random.Random(int(share * 100) + strictness)
    found, size = {}, 300
    for p in range(12):
        centres = [draw.randrange(0, 250) for _ in range(draw.randrange(1, 6))]
        found[f"p{p}"] = [(s := max(0, draw.choice(centres) + draw.randrange(-6, 7)), min(size, s + draw.choice([5, 40, 43, 120]) + draw.randrange(0, 5))) for _ in range(draw.randrange(1, 80))]
    rows = [(p, 0, size, s, e) for p, x in found.items() for s, e in x]
    df = spark.createDataFrame(rows, "pile_id string, p_start long, p_end long, i_start long, i_end long")
    got = piles.subpiles(df, share, strictness, tolerance, target).orderBy("pile_id", "cluster").collect()
    for p, x in found.items():
        made = plain_clusters(x, share)
        mine = [r for r in got if r["pile_id"] == p]
        assert [(r["start"], r["end"], r["depth"], r["s_start"], r["s_end"]) for r in mine] == made
        assert [r["accepted"] for r in mine] == plain_acceptance(made, size, strictness, tolerance, target)


def test_a_deep_pile_of_like_images(spark):
    """Each interval reaches the next few: the longest chain of waits is that of the depths."""
    df = spark.range(60).selectExpr("'deep' as pile_id", "0L as p_start", "700L as p_end", "id as i_start", "id + 100 as i_end")
    got = piles.subpiles(df, share=0.05, target=2.0).orderBy("cluster").collect()
    assert [(r["start"], r["end"], r["depth"]) for r in got] == [c[:3] for c in plain_clusters([(i, i + 100) for i in range(60)], 0.05)]


def test_families_of_sub_piles(spark):
    """Two repeats of three places each; one of the second's is on the other strand. A deep short repeat lies within a long one."""
    pairs, n = [], 0
    for family, places in (("a", [("x", 100, 1), ("y", 500, 1), ("z", 900, 1)]), ("b", [("x", 2000, 1), ("y", 3000, -1), ("w", 10, 1)])):
        length = 100 if family == "a" else 60
        for i, (c, s, o) in enumerate(places):
            for d, t, q in places[i + 1 :]:
                pairs.append((n, c, s, s + length, d, t, t + length, o * q))
                n += 1
    found = piles.images(spark.createDataFrame(pairs, "pair_id long, a_contig string, a_start long, a_end long, b_contig string, b_start long, b_end long, strand int"))
    over = piles.placed(found, piles.piles(found))
    members = piles.seeded(over, 0.05)
    nodes, edges = piles.subpile_twists(over, members, piles.subpiles(over, target=2.0, members=members))
    assert {r["kind"] for r in nodes.collect()} == {"sub", "pile"}  # the same places, so pairs of nodes
    assert edges.filter("twist = 1 and src = dst - 1").count() >= 6
    rows = piles.twist_families(nodes, edges).collect()
    by = {}
    for r in rows:
        by.setdefault(r["family_id"], {})[r["contig"], r["start"]] = r["strand"]
    assert sorted(map(len, by.values())) == [3, 3]
    a, b = sorted(by.values(), key=lambda f: ("x", 2000) in f)
    assert len(set(a.values())) == 1 and b["x", 2000] == b["w", 10] == -b["y", 3000]


def test_piles_of_one_cluster_need_no_group_of_their_own(spark):
    """A Python group for each pile takes milliseconds, and most piles hold one cluster."""
    rows = [(f"p{p}", 0, 100, s, s + 30) for p in range(300) for s in ([5] if p % 3 else [5, 60, 61])]
    df = spark.createDataFrame(rows, "pile_id string, p_start long, p_end long, i_start long, i_end long")
    made = piles.subpiles(df, share=0.1, target=2.0)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    got = sorted((r["pile_id"], r["cluster"], r["start"], r["end"], r["depth"], r["accepted"]) for r in made.collect())
    one, two = [(0, 5, 35, 1, True)], [(0, 60, 91, 2, True), (1, 5, 35, 1, True)]
    assert got == sorted((f"p{p}", *c) for p in range(300) for c in (one if p % 3 else two))
