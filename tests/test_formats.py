"""Readers and writers, the remote source and the streaming forms."""

import gzip
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from helixframe.sources import files, formats, remote
from helixframe.streaming import sequences as streaming

FASTA = ">s1 first range=chr2:101-110 5'pad=0 strand=-\nACGT\nACGTAC\n>s2\nGG\n\n>s3 last one\nTTTT"


def test_fasta_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(FASTA)
    for name in ("a.fa", "b.fa.gz"):
        df = formats.read_fasta(spark, str(tmp_path / name))
        rows = df.orderBy("seq_ord").collect()
        assert [(r["seq_ord"], r["id"], r["seq"], r["len"]) for r in rows] == [(0, "s1", "ACGTACGTAC", 10), (1, "s2", "GG", 2), (2, "s3", "TTTT", 4)]
        at = formats.located(df).filter("id = 's1'").first()
        assert (at["chr"], at["offset"], at["strand"]) == ("chr2", 100, -1)
    assert formats.fasta_text(df, 4).filter("value like '>s1%'").first()[0].endswith("strand=-\nACGT\nACGT\nAC")


def test_gff_round_trip(spark, tmp_path):
    text = '##gff-version 2\nc1\tsrc\trep\t11\t20\t1.5\t-\t0\tRepeat "L1 LINE 3 . 7"; Target "c9 5 14"\nc2\tsrc\trep\t1\t5\t.\t+\t.\t\n'
    (tmp_path / "x.gff").write_text(text)
    rows = formats.parse_gff(formats.lines(spark, str(tmp_path / "x.gff")))
    first = rows.orderBy("line_no").first()
    assert (first["seqname"], first["start"], first["end"], first["score"], first["strand"], first["frame"]) == ("c1", 10, 20, 1.5, -1, 0)
    r = formats.repeat_records(rows.filter("seqname = 'c1'")).first()
    assert (r["name"], r["class"], r["left"], r["right"], r["remains"]) == ("L1", "LINE", 2, None, 7)
    pair = formats.alignment_pairs(rows.filter("seqname = 'c1'")).first()
    assert (pair["b_contig"], pair["b_start"], pair["b_end"]) == ("c9", 4, 14)
    assert formats.gff_text(rows).filter("value like 'c1%'").first()[0] == 'c1\tsrc\trep\t11\t20\t1.50\t-\t0\tRepeat "L1 LINE 3 . 7"; Target "c9 5 14"'
    assert "Target" in formats.pairs_text(formats.alignment_pairs(rows.filter("seqname = 'c1'"))).first()[0]
    with pytest.raises(Exception, match="no Repeat"):
        formats.repeat_records(rows).collect()
    lengths = spark.createDataFrame([("c1", 100), ("c3", 7)], "seqname string, len long")
    assert [x[0] for x in formats.sequence_regions(rows, lengths).collect()] == ["##sequence-region c1 1 100"]


def test_bed_tables_pwm_and_families(spark, tmp_path):
    (tmp_path / "x.bed").write_text("c\t1\t5\nc\t7\t9\n")
    assert formats.read_bed3(spark, str(tmp_path / "x.bed")).count() == 2
    (tmp_path / "bad.bed").write_text("c\tone\t5\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|Malformed|MALFORMED"):
        formats.read_bed3(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "m.tsv").write_text("name\ta\tb\nr1\t1.5\t0\nr2\t2\t3")
    assert sorted(tuple(r) for r in formats.read_matrix(spark, str(tmp_path / "m.tsv")).collect()) == [("r1", "a", 1.5), ("r1", "b", 0.0), ("r2", "a", 2.0), ("r2", "b", 3.0)]
    (tmp_path / "p.txt").write_text("0.1\t0.2\t0.3\t0.4\n1\t0\t0\t0\nend\n9\t9\t9\t9\n")
    assert [r["weights"] for r in formats.parse_pwm(formats.lines(spark, str(tmp_path / "p.txt"))).orderBy("pos").collect()] == [[0.1, 0.2, 0.3, 0.4], [1, 0, 0, 0]]
    (tmp_path / "f.json").write_text('[{"C":"c","S":1,"E":2,"O":-1},{"C":"d","S":3,"E":4,"O":1}]\n[]\n[{"C":"e","S":5,"E":6,"O":0}]\n')
    members = formats.parse_families(formats.lines(spark, str(tmp_path / "f.json")))
    assert sorted(tuple(r) for r in members.collect()) == [(0, 0, "c", 1, 2, -1), (0, 1, "d", 3, 4, 1), (2, 0, "e", 5, 6, 0)]
    assert {r["value"] for r in formats.families_text(members).collect()} == {'[{"C":"c","S":1,"E":2,"O":-1},{"C":"d","S":3,"E":4,"O":1}]', '[{"C":"e","S":5,"E":6,"O":0}]'}


def test_pictures_and_binary_rows(spark):
    cells = spark.createDataFrame([("p", x, y, 0.3 * x, 1.0, 1.0) for x in range(2) for y in range(2)], "id string, x int, y int, h double, s double, v double")
    raw = bytes(formats.images(cells, 2, 2).first()["png"])
    assert raw.startswith(b"\x89PNG") and struct.unpack(">II", raw[16:24]) == (2, 2)
    size = struct.unpack(">I", raw[33:37])[0]
    assert len(zlib.decompress(raw[41 : 41 + size])) == 2 * (1 + 6)
    traps = spark.createDataFrame([(4, 3, 2, -1)], "top long, bottom long, left long, right long")
    assert struct.unpack("<4q", bytes(formats.trapezoid_bytes(traps).first()[0])) == (4, 3, 2, -1)


def names(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_bundles_pictures_and_trapezoids_under_their_names(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "b", "G" * 61), (1, "c", ""), (0, "a", "ACGT")], "bundle int, id string, seq string").repartition(3)
    formats.write_bundles(seqs, str(tmp_path / "out"), "in.fa")
    assert names(tmp_path) == ["in.fa-0.fa", "in.fa-1.fa"]
    assert (tmp_path / "out/in.fa-0.fa").read_text() == ">a\nACGT\n>b\n" + "G" * 60 + "\nG\n" and (tmp_path / "out/in.fa-1.fa").read_text() == ">c\n"
    with pytest.raises(Exception, match="already"):
        formats.write_bundles(seqs, str(tmp_path / "out"), "in.fa")
    assert names(tmp_path) == ["in.fa-0.fa", "in.fa-1.fa"]

    cells = spark.createDataFrame([(n, x, 0, 0.3 * x, 1.0, 1.0) for n in "pq" for x in range(2)], "id string, x int, y int, h double, s double, v double")
    pictures = formats.images(cells, 2, 1)
    formats.write_images(pictures, f"file://{tmp_path}/png")
    assert {r["id"]: bytes(r["png"]) for r in pictures.collect()} == {n: (tmp_path / f"png/{n}.png").read_bytes() for n in "pq"}

    traps = spark.range(0, 3000, 1, 6).selectExpr("id as top", "-id as bottom", "id * id as left", "1L << 40 as right", "case when id % 10 = 3 then -1 else 1 end as strand")
    formats.write_trapezoids(traps, str(tmp_path / "t"), "run")
    assert names(tmp_path / "t") == ["run-fwd.traps.le.gz", "run-rev.traps.le.gz"]
    for side, mine in (("fwd", [i for i in range(3000) if i % 10 != 3]), ("rev", range(3, 3000, 10))):
        raw = gzip.decompress((tmp_path / f"t/run-{side}.traps.le.gz").read_bytes())
        assert raw == b"".join(struct.pack("<4q", i, -i, i * i, 1 << 40) for i in mine)


def test_a_failed_attempt_leaves_no_file(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).selectExpr("'f' as file", "id", "case when id = 77 then raise_error('no') else 'x' end as content")
    with pytest.raises(Exception, match="no"):
        files.write_files(rows, str(tmp_path / "out"), "id")
    assert names(tmp_path) == []


def test_remote_pages_with_retries(spark):
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            fields = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            calls.append(self.path)
            if len(calls) == 1:
                self.send_response(500)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"7" if "/search" in self.path else f">r{fields['retstart']} {fields['term']}\nAC\n".encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(remote.SequenceService)
    read = spark.read.format("sequence_service").options(url=f"http://127.0.0.1:{server.server_port}", query="x y", email="a@b", retmax=3, wait=0)
    rows = sorted(tuple(r) for r in read.load().collect())
    server.shutdown()
    assert rows == [(0, ">r0 x y\nAC\n"), (1, ">r3 x y\nAC\n"), (2, ">r6 x y\nAC\n")]


def test_stream_counts_equal_table_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "ACGTAC"), ("2024-01-01 00:20:00", "ACNGT"), ("2024-01-01 05:00:00", "TTT")], "ts string, seq string").select(F.to_timestamp("ts").alias("ts"), "seq")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.kmer_counts(stream, 2).writeStream.format("memory").queryName("kmers").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    found = sorted((r["kmer"], r["n"]) for r in spark.table("kmers").collect())
    assert found == [("AC", 3), ("CG", 1), ("GT", 2), ("TA", 1), ("TT", 2)]
