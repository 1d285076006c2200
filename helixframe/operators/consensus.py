"""Consensus of families whose members differ in length: a centre star alignment and votes over its columns.

A family's centre is the member whose k-mers other members share most. Every member is aligned with its centre
over all cells of their table, so indels of any length are found; columns are the centre's letters (ins 0) and what members
have between them (ins 1, 2, ...). A member votes only between the first and the last letter of the centre that it is aligned with: a
fragment says nothing of the rest, and letters that stick out of the centre stay out.

Members are rows of (key, id, seq). A family is no task of its own: members meet copies of their centre in salted keys, and votes are
counted before they move. Null and empty sequences take no part; members with the same id are members of their own; of equally
shared members the longest, then the one that comes first by letters is the centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import written

#: Rows of a table of alignment that are held with their directions at once; the scores of the rows before each such block stay.
BLOCK = 128
#: Copies of a family's small side that its members are dealt to.
SALTS = 16


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def centres(members: DataFrame, key: str = "family_id", k: int = 6) -> DataFrame:
    """key, centre: of each family the member that shares most k-mers, each counted by the other members that hold it. members: key, seq, _n (a number of its own)."""
    places = F.when(F.length("seq") >= k, F.sequence(F.lit(1), F.length("seq") - k + 1)).otherwise(F.array())
    held = members.select(key, "_n", F.explode_outer(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("seq"), i, k)))).alias("kmer"))
    counts = held.filter("kmer is not null").groupBy(key, "kmer").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    dealt = held.withColumn("_salt", F.pmod(F.xxhash64("_n"), F.lit(SALTS)).cast("int"))
    shared = dealt.join(_salted(counts), [key, "kmer", "_salt"], "left").groupBy(key, "_n").agg(F.coalesce(F.sum("others"), F.lit(0)).alias("shared"))
    best = F.min(F.struct((-F.col("shared")).alias("shared"), (-F.length("seq")).alias("len"), "seq")).alias("best")
    return shared.join(members.select("_n", "seq"), "_n").groupBy(key).agg(best).select(key, F.col("best.seq").alias("centre"))


def aligned(centre: str, member: str, mismatch: int = -1, gap: int = -2) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of member (col, ins): its column of the centre and its number among the letters inserted behind that column.

    Match 1. Gaps at either end of the centre cost nothing, nor do letters of member that stick out there. The rows of the table are
    computed at once, gaps along a row by a running maximum; the way back computes each block of rows again.
    """
    c, m = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (centre, member))
    n, ramp = len(c), gap * np.arange(len(c) + 1)

    def step(row: np.ndarray, letter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        across, up = row[:-1] + np.where(c == letter, 1, mismatch), row + gap
        up[[0, -1]] = np.array([0, row[-1]])  # before the first and behind the last letter of the centre
        best = up.copy()
        np.maximum(best[1:], across, out=best[1:])
        return np.maximum.accumulate(best - ramp) + ramp, across, up

    row, kept = np.zeros(n + 1, np.int64), []
    for i, letter in enumerate(m):
        if i % BLOCK == 0:
            kept.append(row)
        row = step(row, letter)[0]
    col, ins = np.empty(len(m), np.int64), np.zeros(len(m), np.int64)
    j, i = int(row.argmax()), len(m)
    while i:
        first = (i - 1) // BLOCK * BLOCK
        rows, acrosses, ups, row = [], [], [], kept[first // BLOCK]
        for letter in m[first:i]:
            row, across, up = step(row, letter)
            rows.append(row), acrosses.append(across), ups.append(up)
        while i > first:
            at = i - 1 - first
            if j and rows[at][j] == acrosses[at][j - 1]:
                i, j = i - 1, j - 1
                col[i] = j
            elif rows[at][j] == ups[at][j]:
                i -= 1
                col[i], ins[i] = j - 1, 1
            else:
                j -= 1
    # letters of a run behind the same column are numbered
    for i in range(1, len(m)):
        if ins[i] and ins[i - 1] and col[i] == col[i - 1]:
            ins[i] = ins[i - 1] + 1
    return col, ins


def alignment(members: DataFrame, key: str = "family_id", seq: str = "seq", k: int = 6) -> DataFrame:
    """key, member, col, ins, letter, on: a row for each letter of the alignment and for each gap within a member's part of the centre.

    on: of ins 0, whether the member goes on to the next column, that is whether it says something of what lies between. member numbers rows.
    """
    rows = members.filter(F.length(seq) > 0).select(key, F.upper(seq).alias("seq"))
    known = written(rows.withColumn("_n", F.monotonically_increasing_id()), "members")
    salt = F.pmod(F.xxhash64("_n"), F.lit(SALTS)).cast("int")
    met = known.withColumn("_salt", salt).join(_salted(written(centres(known, key, k), "centres")), [key, "_salt"]).select(key, "_n", "seq", "centre")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own, number, text, centre in b.itertuples(index=False):
                col, ins = aligned(centre, text)
                paired = np.flatnonzero(ins == 0)
                if not len(paired):
                    continue
                low, high = col[paired[0]], col[paired[-1]]
                inner = slice(paired[0], paired[-1] + 1)
                gaps = np.setdiff1d(np.arange(low, high + 1), col[paired])
                letters = np.frombuffer(text.encode("utf-32-le"), "<U1")[inner]
                at, between = np.concatenate([col[inner], gaps]), np.concatenate([ins[inner], np.zeros(len(gaps), np.int64)])
                yield pd.DataFrame({key: own, "member": number, "col": at, "ins": between, "letter": np.concatenate([letters, np.full(len(gaps), "-")]), "on": (between == 0) & (at < high)})

    kind = members.schema[key].dataType.simpleString()
    return met.mapInPandas(align, f"{key} {kind}, member long, col long, ins long, letter string, on boolean")


def quality(n: Column, depth: Column) -> Column:
    """Phred-like quality of n votes out of depth, at most 93."""
    return F.least(F.lit(93), F.floor(-10 * F.log10(1 - n / (depth + 1.0)))).cast("int")


def votes(found: DataFrame, key: str = "family_id", least_quality: int = 42) -> DataFrame:
    """key, col, ins, letter, quality, depth, shown of the columns whose most frequent entry is a letter; a gap wins ties, then the first letter does. Weak ones in lower case."""
    counts = written(found.groupBy(key, "col", "ins", "letter").agg(F.count(F.lit(1)).alias("n"), F.count_if("on").alias("on")), "votes")
    inside = counts.filter("ins > 0").groupBy(key, "col", "ins").agg(F.sum("n").alias("with_"))
    over = counts.filter("ins = 0").groupBy(key, "col").agg(F.sum("on").alias("over"))
    # members that go on behind a column without an inserted letter there
    none = inside.join(over, [key, "col"]).select(key, "col", "ins", F.lit("-").alias("letter"), (F.col("over") - F.col("with_")).alias("n"))
    each = counts.select(key, "col", "ins", "letter", "n").unionByName(none)
    best = each.groupBy(key, "col", "ins").agg(F.max(F.struct("n", (F.col("letter") == "-").alias("gap"), (-F.ascii("letter")).alias("first"), "letter")).alias("best"), F.sum("n").alias("depth"))
    q = quality(F.col("best.n"), F.col("depth"))
    shown = F.when(q >= least_quality, F.col("best.letter")).otherwise(F.lower("best.letter"))
    return best.filter("not best.gap").select(key, "col", "ins", F.col("best.letter").alias("letter"), q.alias("quality"), "depth", shown.alias("shown"))


def aligned_consensus(members: DataFrame, key: str = "family_id", seq: str = "seq", least_quality: int = 42, k: int = 6) -> DataFrame:
    """key, seq, qualities (Phred+33), n_members: one row for each family, as long as its consensus."""
    found = votes(alignment(members, key, seq, k), key, least_quality)
    at = F.sort_array(F.collect_list(F.struct("col", "ins", "shown", "quality")))
    text = lambda f: F.array_join(F.transform("at", f), "")
    rows = found.groupBy(key).agg(at.alias("at")).select(key, text(lambda x: x["shown"]).alias("seq"), text(lambda x: F.char(x["quality"] + 33)).alias("qualities"))
    return rows.join(members.filter(F.length(seq) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("n_members")), key)


def fastq(found: DataFrame, key: str = "family_id") -> DataFrame:
    """key, value: FASTQ records of ``aligned_consensus`` under the names that members' files have."""
    name = F.format_string("family%06d_consensus", F.col(key))
    head = F.concat(F.lit("@"), name, F.lit(" ("), F.col("n_members").cast("string"), F.lit(" members)"))
    return found.select(key, F.concat_ws("\n", head, "seq", F.lit("+"), "qualities").alias("value"))
