"""Sequences as tiles give what whole sequences give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from helixframe.operators import kmers, sequences, tiles
from helixframe.sources import formats


def letters(seed, n):
    return "".join(random.Random(seed).choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n))


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(f"s{i}", letters(i, n)) for i, n in enumerate([0, 1, 9, 10, 11, 99, 100, 101, 257, 1000, 5003])], "id string, seq string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("width", [7, 64, 10_000])
def test_tiles_join_to_the_sequence(seqs, width):
    whole = {r["id"]: r["seq"] for r in seqs.collect() if r["seq"]}
    cut = tiles.cut(seqs, width)
    assert {r["id"]: r["part"] for r in tiles.joined(cut, "id").collect()} == whole
    assert rows(tiles.recut(tiles.cut(seqs, 13), width), "id", "tile") == rows(cut, "id", "tile")


@pytest.mark.parametrize("window, least", [(10, 0), (40, 100), (100, 50), (6000, 1)])
def test_windows_of_tiles_equal_windows_of_sequences(seqs, window, least):
    some = seqs.filter("seq <> ''")
    assert rows(tiles.split_windows(tiles.cut(some, 33), window, least), "id", "start") == rows(sequences.split_windows(some, window, least), "id", "start")


@pytest.mark.parametrize("window, least", [(10, 0), (40, 100), (100, 50)])
def test_windows_equal_a_loop(seqs, window, least):
    want = []
    for r in seqs.collect():
        n, q = len(r["seq"]), len(r["seq"]) // window
        if n >= least:
            ends = [(0, n)] if n < 2 * window else [(i * window, n if i == q - 1 else (i + 1) * window) for i in range(q)]
            want += [(r["id"] if n < 2 * window else f"{r['id']}_{a}-{b}", a, b, r["seq"][a:b]) for a, b in ends]
    assert rows(sequences.split_windows(seqs, window, least), "id", "start") == sorted(want, key=lambda x: (x[0], x[1]))


def test_words_of_tiles_with_halo(seqs):
    k, width = 6, 50
    found = kmers.occurrences(tiles.with_halo(tiles.cut(seqs, width), k - 1).withColumn("id", F.struct("id", "start")), k, seq="part")
    placed = found.select("id.id", (F.col("id.start") + F.col("pos")).cast("int").alias("pos"), "kmer")
    assert rows(placed, "id", "pos") == rows(kmers.occurrences(seqs, k).select("id", "pos", "kmer"), "id", "pos")


@pytest.mark.parametrize("chunk", [10, 100])
def test_full_windows(seqs, chunk):
    for compat in (False, True):
        want = [(r["id"], i * chunk, r["seq"][i * chunk + compat : (i + 1) * chunk]) for r in seqs.collect() for i in range((len(r["seq"]) - compat) // chunk)]
        assert rows(kmers.windows(seqs, chunk, compat), "id", "start") == sorted(want)


def test_lines_of_tiles(seqs):
    want = [(r["id"], i // 60, r["seq"][i : i + 60]) for r in seqs.collect() for i in range(0, len(r["seq"]), 60)]
    assert rows(tiles.wrapped_lines(tiles.cut(seqs, 77)), "id", "line_no") == sorted(want)


@pytest.mark.parametrize("split", ["64b", "1000b", "1m"])
def test_fasta_over_split_borders(spark, seqs, tmp_path, split):
    """Records span several byte ranges; lines differ in length, and one record is empty."""
    draw, text = random.Random(1), "no record\n"
    for r in seqs.collect():
        text += f">{r['id']} a  description\n"
        at = 0
        while at < len(r["seq"]):
            n = draw.randrange(1, 90)
            text += r["seq"][at : at + n] + "\n"
            at += n
    (tmp_path / "a.fna").write_text(text)
    (tmp_path / "b.fna").write_text(">last\nAC GT\n\nAC\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = formats.read_fasta_tiles(spark, str(tmp_path), 100)
        got = {(r["seq_ord"], r["id"], r["descr"]): r["part"] for r in tiles.joined(found, "seq_ord", "id", "descr").collect()}
        widths = {len(r["part"]) for r in found.filter("id = 's10' and tile < 50").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(i, r["id"], "a  description"): r["seq"] for i, r in enumerate(seqs.orderBy(F.length("seq")).collect()) if r["seq"]}
    assert got == want | {(len(want) + 1, "last", ""): "ACGTAC"}
    assert widths == {100}


def test_four_million_letters_in_seconds(spark):
    rows = spark.range(1).select(F.lit("c").alias("id"), F.expr("repeat('ACGTTGCA', 500000)").alias("seq"))
    began = time.time()
    assert sequences.split_windows(rows, 500, 250).count() == 8000
    assert kmers.windows(rows, 400).count() == 10_000
    assert tiles.split_windows(tiles.cut(rows, 1 << 16), 500, 250).count() == 8000
    assert formats.fasta_text(rows, descr=None).select(F.length("value")).first()[0] == 4_000_000 + 2 + 66_667
    assert time.time() - began < 30
