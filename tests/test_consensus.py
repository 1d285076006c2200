"""Centre star alignments against plain dynamic programming, and consensus of members with planted indels."""

import random

import pytest

from helixframe.operators import consensus


def plain_score(c, m, mismatch=-1, gap=-2):
    t = [0] * (len(c) + 1)
    for x in m:
        new = [0]
        for j in range(1, len(c) + 1):
            up = t[j] if j == len(c) else t[j] + gap
            new.append(max(t[j - 1] + (1 if c[j - 1] == x else mismatch), up, new[j - 1] + gap))
        t = new
    return max(t)


def score_of(c, m, col, ins, mismatch=-1, gap=-2):
    paired = [i for i in range(len(m)) if ins[i] == 0]
    if not paired:
        return 0
    total = sum(1 if c[col[i]] == m[i] else mismatch for i in paired)
    total += gap * sum(1 for i in range(paired[0], paired[-1]) if ins[i]) + gap * (col[paired[-1]] - col[paired[0]] + 1 - len(paired))
    return total


@pytest.mark.parametrize("block", [3, 128])
def test_alignment_has_the_best_score(monkeypatch, block):
    monkeypatch.setattr(consensus, "BLOCK", block)
    draw = random.Random(3)
    for _ in range(150):
        c = "".join(draw.choices("ACGT", k=draw.randrange(1, 30)))
        m = "".join(x for x in c[draw.randrange(len(c)) :] if draw.random() > 0.15) + "".join(draw.choices("ACGT", k=draw.randrange(0, 5)))
        if not m:
            continue
        col, ins = consensus.aligned(c, m)
        assert all((a, b) < (x, y) for a, b, x, y in zip(col, ins, col[1:], ins[1:]))
        assert score_of(c, m, col, ins) == plain_score(c, m)


def test_planted_indels_are_voted_out(spark):
    draw = random.Random(9)
    rows, truth = [], {}
    for f in range(3):
        truth[f] = "".join(draw.choices("ACGT", k=300))
        for _ in range(24):
            x = list(truth[f])
            for _ in range(5):
                at = draw.randrange(len(x))
                kind = draw.randrange(3)
                x[at : at + 1] = [[], [x[at], draw.choice("ACGT")], [draw.choice("ACGT")]][kind]
            a = draw.randrange(0, 60)
            rows.append((f, "".join(x)[a : len(x) - draw.randrange(0, 60)]))
        rows += [(f, truth[f][:280]), (f, None), (f, "")]
    members = spark.createDataFrame(rows, "family_id int, seq string").repartition(5)
    got = {r["family_id"]: r for r in consensus.aligned_consensus(members, least_quality=5).collect()}
    assert {f: r["n_members"] for f, r in got.items()} == dict.fromkeys(truth, 25)
    for f, t in truth.items():
        shown = got[f]["seq"].upper()
        assert shown in t and len(shown) >= 270 and len(got[f]["qualities"]) == len(shown)
    text = {r["family_id"]: r["value"] for r in consensus.fastq(consensus.aligned_consensus(members)).collect()}
    assert text[2].startswith("@family000002_consensus (25 members)\n")


def test_an_insertion_that_most_members_have_is_kept(spark):
    t = "ACGGTTACCAGATTACAGGCATTACCGA"
    longer = t[:14] + "GGG" + t[14:]
    rows = [(1, longer)] * 3 + [(1, t)] * 2 + [(2, "ACG")]
    got = {r["family_id"]: r["seq"] for r in consensus.aligned_consensus(spark.createDataFrame(rows, "family_id int, seq string")).collect()}
    assert got == {1: longer.lower(), 2: "acg"}
    none = spark.createDataFrame([], "family_id int, seq string")
    assert consensus.aligned_consensus(none).count() == 0
