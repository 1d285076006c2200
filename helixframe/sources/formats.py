"""Readers and writers of sequence and interval text formats.

Readers keep a file's order in a dense number (seq_ord, line_no), made without one task
for all rows. Writers render lines as columns and leave the writing to Spark.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import wrapped
from ..operators.annotation import parsed_repeat
from ..operators import tiles
from ..operators.ordered import running_total, running_totals
from .files import write_files


def lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """value, line_no in the order of files and lines; compressed files by their suffix."""
    read = spark.read.text(path) if sep is None else spark.read.text(path, lineSep=sep)
    rows = read.select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"), F.lit(1).alias("_one"))
    return running_total(rows, "_one", "_file", "_id", name="line_no").select("value", "line_no")


def read_fasta(spark: SparkSession, path: str, alphabet: str = "dna") -> DataFrame:
    """seq_ord, id (up to the first blank of the header), descr, alphabet, seq, len.

    A protein may have gaps (- and .) and stops (*); a sign that is no letter raises there.
    """
    rows = lines(spark, path, "\n>").filter(F.trim("value") != "")
    text = F.regexp_replace("value", r"^\s*>", "")
    head = F.regexp_extract(text, r"^([^\n\r]*)", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s+", "")
    if alphabet == "protein":
        wrong = F.regexp_extract(body, r"([^A-Za-z*\-.])", 1)
        body = F.when(wrong == "", body).otherwise(F.raise_error(F.concat(F.lit("no letter of a protein: "), wrong)).cast("string"))
    parts = rows.select(F.col("line_no").alias("seq_ord"), F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("descr"), F.lit(alphabet).alias("alphabet"), body.alias("seq"))
    return parts.withColumn("len", F.length("seq"))


def read_fasta_tiles(spark: SparkSession, path: str, width: int = 1 << 16) -> DataFrame:
    """seq_ord, id, descr, tile, start, part: FASTA records as tiles, read by lines.

    Partitions are byte ranges of the files, so a record may span many of them and no row is longer than a tile. What
    stands before the first header is no record. Lines know how many headers and letters come before them.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    head = F.col("value").startswith(">")
    rows = read.withColumn("part", F.when(head, F.lit("")).otherwise(F.regexp_replace("value", r"\s+", "")))
    rows = running_totals(rows.withColumns({"_head": head.cast("int"), "_n": F.length("part")}), {"_heads": "_head", "_at": "_n"}, "_file", "_id")
    named = rows.filter("_head = 1").select(F.col("_heads").alias("seq_ord"), F.col("_at").alias("_from"), F.substr(F.col("value"), F.lit(2)).alias("_text"))
    parts = rows.filter("_head = 0 and _heads > 0 and _n > 0").select((F.col("_heads") - 1).alias("seq_ord"), "_at", "part")
    placed = parts.join(named, "seq_ord").select(F.col("seq_ord").alias("id"), (F.col("_at") - F.col("_from")).alias("start"), "part")
    names = named.select("seq_ord", F.regexp_extract("_text", r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace("_text", r"^\S*", "")).alias("descr"))
    return tiles.recut(placed, width).withColumnRenamed("id", "seq_ord").join(names, "seq_ord").select("seq_ord", "id", "descr", "tile", "start", "part")


def literal_fasta(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, n, name, descr, seq of the records in a text column, as of FASTA held in a program."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), "\n>"), lambda x: F.trim(x) != "")
    each = rows.select(*keep, F.posexplode(parts).alias("n", "_r"))
    head = F.regexp_extract("_r", r"^([^\n\r]*)", 1)
    body = F.regexp_replace(F.regexp_replace("_r", r"^[^\n]*\n?", ""), r"\s+", "")
    return each.select(*keep, "n", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("descr"), body.alias("seq"))


def record_text(width: int, name: str = "name", descr: str = "descr", seq: str = "seq") -> Column:
    """A FASTA record: header and wrapped lines."""
    head = F.concat(F.lit(">"), F.col(name), F.when(F.col(descr) != "", F.concat(F.lit(" "), F.col(descr))).otherwise(""))
    return F.when(F.length(seq) > 0, F.concat_ws("\n", head, wrapped(seq, width))).otherwise(head)


def located(seqs: DataFrame, descr: str = "descr") -> DataFrame:
    """Adds chr, offset (0-based) and strand from range= and strand= in a header."""
    place = r"range=(\S+?):(\d+)-(\d+)"
    return seqs.withColumns({"chr": F.regexp_extract(descr, place, 1), "offset": F.regexp_extract(descr, place, 2).try_cast("long") - 1, "strand": F.when(F.regexp_extract(descr, r"strand=(\S)", 1) == "-", -1).when(F.regexp_extract(descr, r"strand=(\S)", 1) == "+", 1).otherwise(0)})


def fasta_text(seqs: DataFrame, width: int = 60, id_: str = "id", descr: str | None = "descr", seq: str = "seq") -> DataFrame:
    """value: a record's header and wrapped lines."""
    head = F.concat(F.lit(">"), F.col(id_).cast("string"))
    if descr:
        head = F.concat(head, F.when(F.coalesce(F.col(descr), F.lit("")) != "", F.concat(F.lit(" "), F.col(descr))).otherwise(""))
    return seqs.select(F.when(F.length(seq) > 0, F.concat_ws("\n", head, wrapped(seq, width))).otherwise(head).alias("value"))


def write_bundles(seqs: DataFrame, folder: str, name: str, key: str = "bundle", order: str = "id") -> None:
    """A FASTA file ``<name>-<key>.fa`` for each bundle, family or other key, with its records in an order."""
    text = F.concat_ws("\n", F.concat(F.lit(">"), F.col("id").cast("string")), F.when(F.length("seq") > 0, wrapped("seq", 60)), F.lit(""))
    write_files(seqs.select(F.concat(F.lit(f"{name}-"), F.col(key).cast("string"), F.lit(".fa")).alias("file"), F.col(order).alias("_order"), text.alias("content")), folder, "_order")


def attributes(text: Column) -> Column:
    """Array of tag and value structs, in order; values lose their quotes."""
    parts = F.filter(F.transform(F.split(text, r"\s*;\s*"), F.trim), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("tag"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^\S+", "")), r'^"|"$', "").alias("value")))


def attribute(attrs: str | Column, tag: str) -> Column:
    """The first value of a tag, or null."""
    return F.get(F.filter(attrs, lambda a: a["tag"] == tag), F.lit(0))["value"]


def parse_gff(rows: DataFrame, value: str = "value") -> DataFrame:
    """seqname, source, feature, start (0-based), end, score, strand, frame, attrs from text lines."""
    f = F.split(F.col(value), "\t")
    at = lambda i: F.get(f, F.lit(i))
    kept = rows.filter(~F.col(value).startswith("#") & (F.trim(value) != ""))
    dot = lambda i: F.nullif(at(i), F.lit("."))
    strand = F.when(at(6) == "+", 1).when(at(6) == "-", -1).otherwise(0)
    return kept.select(*[c for c in rows.columns if c != value], at(0).alias("seqname"), at(1).alias("source"), at(2).alias("feature"), (at(3).cast("long") - 1).alias("start"), at(4).cast("long").alias("end"), dot(5).cast("double").alias("score"), strand.alias("strand"), dot(7).cast("int").alias("frame"), attributes(F.coalesce(at(8), F.lit(""))).alias("attrs"))


def gff_text(features: DataFrame, precision: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """value: GFF lines, 1-based and inclusive; keep: names of columns to keep, which features has with an underscore before."""
    score = F.when(F.col("score").isNull(), F.lit(".")).otherwise(F.format_string(f"%.{precision}f", "score"))
    strand = F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").otherwise(".")
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(a["tag"], F.lit(' "'), a["value"], F.lit('"'))), "; ")
    return features.select(*[F.col(f"_{c}").alias(c) for c in keep], F.concat_ws("\t", "seqname", "source", "feature", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), score, strand, F.coalesce(F.col("frame").cast("string"), F.lit(".")), attrs).alias("value"))


def sequence_regions(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """value: a metadata line for each sequence that has features. lengths: seqname, len."""
    return lengths.join(features.select("seqname").distinct(), "seqname", "left_semi").select(F.concat(F.lit("##sequence-region "), "seqname", F.lit(" 1 "), F.col("len").cast("string")).alias("value"))


def repeat_records(features: DataFrame) -> DataFrame:
    """Features with the parsed Repeat attribute; one without it raises."""
    value = F.coalesce(attribute("attrs", "Repeat"), F.raise_error(F.concat(F.lit("no Repeat attribute at "), "seqname", F.lit(":"), F.col("start").cast("string"))).cast("string"))
    return features.withColumn("repeat", parsed_repeat(value)).select("*", "repeat.*").drop("repeat")


def alignment_pairs(features: DataFrame) -> DataFrame:
    """Pairs from features whose Target attribute holds the partner: name, start (1-based) and end."""
    t = F.split(attribute("attrs", "Target"), " ")
    return features.select(F.col("line_no").alias("pair_id") if "line_no" in features.columns else F.monotonically_increasing_id().alias("pair_id"), F.col("seqname").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), t[0].alias("b_contig"), (t[1].cast("long") - 1).alias("b_start"), t[2].cast("long").alias("b_end"), "strand", "score")


def pairs_text(pairs: DataFrame, *keep: str) -> DataFrame:
    """keep, value: a GFF line for each pair with its partner in the Target attribute."""
    target = F.concat_ws(" ", "b_contig", (F.col("b_start") + 1).cast("string"), F.col("b_end").cast("string"))
    attrs = F.array(F.struct(F.lit("Target").alias("tag"), target.alias("value")))
    return gff_text(pairs.select(*[F.col(c).alias(f"_{c}") for c in keep], F.col("a_contig").cast("string").alias("seqname"), F.lit("align").alias("source"), F.lit("hit").alias("feature"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("score").cast("double").alias("score"), "strand", F.lit(None).cast("int").alias("frame"), attrs.alias("attrs")), keep=keep)


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end; a bad row raises."""
    return spark.read.csv(path, sep="\t", schema="contig string, start long, end long", mode="FAILFAST")


MEMBER = "array<struct<C:string,S:long,E:long,O:int>>"


def parse_families(rows: DataFrame, value: str = "value") -> DataFrame:
    """family_id (the line's number), ord and C, S, E, O of each member."""
    made = rows.select(F.col("line_no").alias("family_id"), F.posexplode(F.from_json(value, MEMBER)).alias("ord", "m"))
    return made.select("family_id", "ord", "m.*")


def families_text(members: DataFrame) -> DataFrame:
    """family_id, value: a JSON array of members in order."""
    rows = members.groupBy("family_id").agg(F.sort_array(F.collect_list(F.struct("ord", "C", "S", "E", "O"))).alias("m"))
    return rows.select("family_id", F.to_json(F.transform("m", lambda x: F.struct(x["C"].alias("C"), x["S"].alias("S"), x["E"].alias("E"), x["O"].alias("O")))).alias("value"))


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """i, j, v of a numeric table with column names in its first row and row names in its first column."""
    head = spark.read.csv(path, sep=sep, header=True, mode="FAILFAST")
    name, *columns = head.columns
    schema = ", ".join([f"`{name}` string", *[f"`{c}` double" for c in columns]])
    table = spark.read.csv(path, sep=sep, header=True, schema=schema, mode="FAILFAST")
    return table.unpivot([name], columns, "j", "v").select(F.col(name).alias("i"), "j", "v")


def parse_pwm(rows: DataFrame, value: str = "value") -> DataFrame:
    """pos and weights (A, C, G, T) of the lines up to the first with under four fields."""
    f = F.split(F.trim(value), "\t")
    short = rows.filter(F.size(f) < 4).agg(F.min("line_no")).first()[0]
    kept = rows if short is None else rows.filter(F.col("line_no") < short)
    return kept.select(F.col("line_no").alias("pos"), F.transform(F.slice(f, 1, 4), lambda x: x.cast("double")).alias("weights"))


def dot_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, value: lines of a DOT graph. nodes: node, cluster, members; edges: src, dst, weight."""
    n = nodes.select(F.lit(1).alias("kind"), F.format_string('  %s [cluster="%s" members=%d];', F.col("node").cast("string"), F.coalesce(F.col("cluster").cast("string"), F.lit("")), "members").alias("value"))
    e = edges.select(F.lit(2).alias("kind"), F.format_string("  %s -> %s [weight=%.6f];", F.col("src").cast("string"), F.col("dst").cast("string"), "weight").alias("value"))
    return n.unionByName(e)


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An 8-bit colour PNG of rows of RGB triples."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def images(cells: DataFrame, width: int, height: int, key: str = "id") -> DataFrame:
    """key, png of cells (key, x, y, h, s, v in 0 to 1). A picture's cells are bounded by its size."""
    import colorsys

    def draw(ids: tuple, b: pd.DataFrame) -> pd.DataFrame:
        data = bytearray(3 * width * height)
        for r in b.itertuples(index=False):
            at = 3 * (int(r.y) * width + int(r.x))
            data[at : at + 3] = bytes(int(round(255 * c)) for c in colorsys.hsv_to_rgb(r.h, r.s, r.v))
        return pd.DataFrame({key: [ids[0]], "png": [png(width, height, bytes(data))]})

    return cells.groupBy(key).applyInPandas(draw, f"{key} {dict(cells.dtypes)[key]}, png binary")


TRAPEZOID = ("top", "bottom", "left", "right")


def trapezoid_bytes(traps: DataFrame, *keep: str) -> DataFrame:
    """keep, value: top, bottom, left, right as little-endian 64-bit numbers, 32 bytes a row."""
    # a number's bytes from the last to the first, by its hexadecimal form
    turned = lambda c: F.concat(*[F.substring(F.lpad(F.hex(F.col(c).cast("long")), 16, "0"), 2 * i + 1, 2) for i in range(7, -1, -1)])
    return traps.select(*keep, F.unhex(F.concat(*[turned(c) for c in TRAPEZOID])).alias("value"))


def parse_trapezoids(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, top, bottom, left, right of 32-byte rows."""
    digits = F.hex("value")
    number = lambda n: F.conv(F.concat(*[F.substring(digits, 16 * n + 2 * i + 1, 2) for i in range(7, -1, -1)]), 16, -10).cast("long")
    return rows.select(*keep, *[number(n).alias(c) for n, c in enumerate(TRAPEZOID)])


def write_trapezoids(traps: DataFrame, folder: str, name: str) -> None:
    """``<name>-fwd.traps.le.gz`` and ``<name>-rev.traps.le.gz``: packed rows of alignments on the same strand and on the other one. traps has strand as well.

    Tasks compress their rows; a gzip file may be made of several.
    """
    side = F.concat(F.lit(f"{name}-"), F.when(F.col("strand") == -1, "rev").otherwise("fwd"), F.lit(".traps.le.gz"))

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, own in b.groupby("file"):
                yield pd.DataFrame({"file": [file], "at": [own["at"].iloc[0]], "content": [gzip.compress(b"".join(map(bytes, own["value"])), mtime=0)]})

    packed = trapezoid_bytes(traps.withColumns({"file": side, "at": F.monotonically_increasing_id()}), "file", "at").mapInPandas(save, "file string, at long, content binary")
    write_files(packed, folder, "at")


def write_images(pictures: DataFrame, folder: str, key: str = "id") -> None:
    """A file ``<key>.png`` for each of ``images``."""
    write_files(pictures.select(F.concat(F.col(key).cast("string"), F.lit(".png")).alias("file"), F.col("png").alias("content")), folder)
