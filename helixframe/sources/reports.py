"""Text reports: statistics lines, coverage tables, patterns of a factorisation, landscapes and job lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tsv_lines(rows: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """value: the columns by name and printf format, between tabs; nothing for nulls."""
    cells = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(form, c)), F.lit("")) for c, form in columns]
    return rows.select(F.concat_ws("\t", *cells).alias("value"))


def scientific(weight: Column) -> Column:
    return F.format_string("%.3e", weight)


def coverage_table(named: DataFrame, found: DataFrame) -> DataFrame:
    """name, value: repeats in order of name with two bars, columns padded to the widest and a blank between.

    named, found: name, bar. A repeat without a bar on one side has dashes there.
    """
    both = named.withColumnRenamed("bar", "named").join(found.withColumnRenamed("bar", "found"), "name", "full")
    empty = F.lit("-" * 40)
    head = "repeat", "named coverage", "de novo coverage"
    width = named.select("name").union(found.select("name")).agg(F.greatest(F.coalesce(F.max(F.length("name")), F.lit(0)), F.lit(len(head[0]))).alias("w"))
    rows = both.select("name", F.coalesce("named", empty).alias("a"), F.coalesce("found", empty).alias("b"))
    first = width.select(F.lit(0).alias("kind"), F.lit("").alias("name"), F.concat(F.rpad(F.lit(head[0]), F.col("w"), F.lit(" ")), F.lit(" "), F.rpad(F.lit(head[1]), 41, " "), F.lit(head[2])).alias("value"))
    rest = rows.join(F.broadcast(width)).select(F.lit(1).alias("kind"), "name", F.concat(F.rpad("name", F.col("w"), F.lit(" ")), F.lit(" "), F.col("a"), F.lit(" "), F.col("b")).alias("value"))  # one row on the broadcast side
    return first.unionByName(rest).orderBy("kind", "name")


def pattern_lines(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """pattern, value: a line for each pattern of a factorisation with its row names and column names by weight.

    rows, columns: pattern, name, weight (positive ones); ties go by name.
    """
    def listed(long: DataFrame, to: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "name")))
        return long.groupBy("pattern").agg(F.array_join(F.transform(parts, lambda x: F.concat_ws("/", x["name"], scientific(-x["w"]))), ",").alias(to))

    met = listed(rows, "r").join(listed(columns, "c"), "pattern", "full")
    return met.select("pattern", F.concat(F.col("pattern").cast("string"), F.lit("\t["), F.coalesce("r", F.lit("")), F.lit("]\t("), F.coalesce("c", F.lit("")), F.lit(")")).alias("value"))


def pattern_blocks(lines: DataFrame) -> DataFrame:
    """value: the same patterns as blocks of text under a heading."""
    return lines.select(F.concat_ws("\n", F.format_string("Feature %d:", "pattern"), F.regexp_replace(F.split("value", "\t")[1], ",", " "), F.regexp_replace(F.regexp_replace(F.split("value", "\t")[2], r"^\(|\)$", ""), ",", "\n")).alias("value"))


def position_table(weights: DataFrame, patterns: int) -> DataFrame:
    """pos, feature, weight and the weight of each pattern p0, p1, ...: positions whose best pattern has any weight.

    weights: pos, pattern, weight.
    """
    columns = [F.coalesce(F.max(F.when(F.col("pattern") == p, F.col("weight"))), F.lit(0.0)).alias(f"p{p}") for p in range(patterns)]
    best = F.max(F.struct("weight", (-F.col("pattern")).alias("n")))
    out = weights.groupBy("pos").agg(best.alias("best"), *columns)
    return out.filter("best.weight > 0").select("pos", (-F.col("best.n")).alias("feature"), F.col("best.weight").alias("weight"), *[f"p{p}" for p in range(patterns)])


def landscape_json(levels: DataFrame, contigs: DataFrame, accepted: DataFrame, least: int = 5) -> DataFrame:
    """contig, pile_id, value: a JSON text for each pile with more than so many accepted clusters.

    levels: pile_id, pos, k, height, delta; contigs: pile_id, contig, start, end; accepted: pile_id, n. A pile's
    positions are gathered into its one text, as the format wants.
    """
    many = accepted.filter(F.col("n") > least).select("pile_id")
    at = levels.join(many, "pile_id", "left_semi").groupBy("pile_id", "pos").agg(F.sort_array(F.collect_list(F.struct("k", "height", "delta"))).alias("l"))
    point = F.struct(F.col("pos").alias("Pos"), F.transform("l", lambda x: x["height"]).alias("Lambda"), F.transform("l", lambda x: x["delta"]).alias("Delta"), F.size("l").alias("K"))
    piles = at.select("pile_id", point.alias("p")).groupBy("pile_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    value = F.to_json(F.struct(F.col("contig").alias("Chromosome"), F.col("start").alias("Start"), F.col("end").alias("End"), F.col("p").alias("Lambdas")))
    return piles.join(contigs, "pile_id").select("contig", "pile_id", value.alias("value"))


def write_landscapes(texts: DataFrame, path: str) -> None:
    """A folder for each contig."""
    texts.select("contig", "value").write.partitionBy("contig").text(path)


def job_pairs(targets: DataFrame, name: str, diagonal: bool = False) -> DataFrame:
    """a, b: a job for each target with itself and, unless diagonal, with each later one. The number of targets is that of files, not of rows."""
    a, b = targets.select(F.col(name).alias("a")), targets.select(F.col(name).alias("b"))
    own = a.select("a", F.col("a").alias("b"))
    if diagonal:
        return own
    later = targets.select(F.col(name).alias("_n")).groupBy().agg(F.sort_array(F.collect_set("_n")).alias("all"))  # names of files
    order = later.select(F.posexplode("all").alias("i", "a"), "all")
    return own.unionByName(order.select("a", F.explode(F.slice("all", F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0)))).alias("b")))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank in a report's order; for tables of report size, as a total order is one task's."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
