"""Views of the relational tables as sequences, intervals, families, graphs and matrices.

Each has a Spark form and a SQL form with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 7)[:26]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences: letters a to z become bases in turn, all else goes."""
    text = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.translate(text, ALPHABET, BASES).alias("seq"), "source")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as intervals: supplier is the contig, part number the start, quantity the length."""
    strand = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), strand.alias("strand"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of their user, in minutes."""
    start = (F.datediff("ts", F.lit("1970-01-01").cast("date")) * 1440 + F.hour("ts") * 60 + F.minute("ts")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("contig"), start.alias("start"), (start + 1 + F.floor(F.abs("value")).cast("long")).alias("end"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family for each brand: its parts' intervals, of width p_size, on the contig of their type."""
    width = (F.col("p_size") + 1).cast("long")
    return table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("family_id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("contig"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + width).alias("end"), F.when(F.col("p_size") % 3 == 0, -1).when(F.col("p_size") % 3 == 1, 1).otherwise(0).alias("strand"), (F.col("p_partkey") % 3).alias("file_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are joined to the suppliers of their line items; suppliers are numbered from -1 down."""
    return table(spark, sf_dir, "lineitem").select((-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("twist"))


def supplier_graph(spark: SparkSession, sf_dir: str, shared: int = 2) -> DataFrame:
    """src < dst, weight: suppliers that share customers' nations through line items of one order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = items.withColumnRenamed("l_suppkey", "src"), items.withColumnRenamed("l_suppkey", "dst")
    return a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= shared)


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src < dst: parts in one order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = items.withColumnRenamed("l_partkey", "src"), items.withColumnRenamed("l_partkey", "dst")
    return a.join(b, "l_orderkey").filter("src < dst").select("src", "dst").distinct()


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part and the next one of its brand as an alignment pair; contigs are a brand's types, which have a sign; parts of size 50 turn theirs."""
    sign = F.lit(1) - 2 * (F.length("p_type") % 2)
    own = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.concat_ws("/", "p_brand", "p_type").alias("a_contig"), F.col("p_partkey").alias("a_start"), (F.col("p_partkey") + F.col("p_size") + 1).alias("a_end"), sign.alias("sign"))
    after = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = own.withColumns({n: F.lead(c).over(after) for n, c in (("b_contig", "a_contig"), ("b_start", "a_start"), ("b_end", "a_end"), ("b_sign", "sign"))}).filter("b_start is not null")
    strand = F.col("sign") * F.col("b_sign") * F.when(F.col("p_size") == 50, -1).otherwise(1)
    return pairs.select(F.col("p_partkey").alias("pair_id"), "a_contig", "a_start", "a_end", "b_contig", "b_start", "b_end", strand.alias("strand"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by customer segments: summed order totals in whole units."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    met = o.join(c, o["o_custkey"] == c["c_custkey"])
    return met.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("j")).agg(F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("v"))


DNA = f"dna AS (SELECT doc_id AS id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{ALPHABET}', '{BASES}') AS seq, source FROM documents)"
SPANS = "spans AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS contig, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) AS \"end\", CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS strand, l_orderkey AS \"order\", l_linenumber AS line FROM lineitem)"
MARKS = "marks AS (SELECT event_id, user_id AS contig, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS start, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) + 1 + CAST(floor(abs(value)) AS BIGINT) AS \"end\" FROM events)"
FAMILIES = "families AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS family_id, p_partkey AS ord, p_type AS contig, p_partkey AS start, p_partkey + p_size + 1 AS \"end\", CASE p_size % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS strand, p_partkey % 3 AS file_id FROM part)"
EDGES = "edges AS (SELECT -1 - l_suppkey AS src, l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS twist FROM lineitem)"
SUPPLIERS = "items AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), graph AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS weight FROM items a JOIN items b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2)"
MATRIX = "matrix AS (SELECT CAST(c_nationkey AS BIGINT) AS i, c_mktsegment || '/' || o_orderpriority AS j, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
