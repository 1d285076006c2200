"""Queries over intervals, annotation and text formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.interval import touches, within
from ..operators import annotation, intervals, piles
from ..sources import formats
from .bindings import FAMILIES, MARKS, SPANS, families, marks, spans

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _targets(spark, sf_dir):
    return spans(spark, sf_dir).filter("line = 1").select(F.col("id").alias("t_id"), "contig", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "strand")


def _sources(spark, sf_dir):
    return spans(spark, sf_dir).filter("line > 1").groupBy(F.col("id").alias("s_id")).agg(F.min("contig").alias("contig"), F.min("start").alias("s_start"), F.min("end").alias("s_end")).filter("s_end > s_start")


MATCHES = f"""{SPANS},
t AS (SELECT id AS t_id, any_value(contig) AS contig, any_value(start) AS t_start, any_value("end") AS t_end, any_value(strand) AS strand FROM spans WHERE line = 1 GROUP BY id HAVING count(*) = 1),
s AS (SELECT id AS s_id, min(contig) AS contig, min(start) AS s_start, min("end") AS s_end FROM spans WHERE line > 1 GROUP BY id HAVING min("end") > min(start)),
m AS (SELECT t_id, s_id, t.contig, strand, t_start, t_end, s_start, s_end, least(t_end, s_end) - greatest(t_start, s_start) AS overlap FROM t JOIN s USING (contig)
  WHERE t_end > t_start AND t_start < s_end AND s_start < t_end AND s_end > t_start + floor((t_end - t_start) * 0.05) AND s_start < t_end - floor((t_end - t_start) * 0.05)),
k AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY overlap DESC, s_id) AS n FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY CASE WHEN strand = 1 THEN s_start ELSE -s_start END, s_id) AS rank FROM k WHERE n <= 8)"""


def _single_targets(spark, sf_dir):
    t = _targets(spark, sf_dir)
    return t.groupBy("t_id").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("contig", "t_start", "t_end", "strand")]).filter("n = 1").drop("n")


@query(f"WITH {MATCHES} SELECT t_id, s_id, overlap, CAST(rank AS INTEGER) AS rank FROM t LEFT JOIN r USING (t_id)")
def interval_best_overlaps(spark, sf_dir):
    return intervals.best_overlaps(_single_targets(spark, sf_dir), _sources(spark, sf_dir), width=32)


def _annotated(spark, sf_dir):
    """Matches of targets with a made-up consensus place for each source."""
    t, s = _single_targets(spark, sf_dir), _sources(spark, sf_dir)
    best = intervals.best_overlaps(t, s, width=32).filter("s_id is not null")
    known = best.join(t, "t_id").join(s.drop("contig"), "s_id")
    return known.withColumns({"left": F.when(F.col("s_id") % 5 != 0, F.col("s_id") % 40), "name": F.concat(F.lit("rep"), (F.col("s_id") % 17).cast("string"))}).withColumns({"right": F.col("left") + F.col("s_end") - F.col("s_start"), "remains": F.col("s_id") % 11})


ANNOTATED = MATCHES + """,
a AS (SELECT *, CASE WHEN s_id % 5 <> 0 THEN s_id % 40 END AS "left", s_id % 11 AS remains, 'rep' || (s_id % 17) AS name FROM r),
b AS (SELECT *, "left" + s_end - s_start AS "right" FROM a),
c AS (SELECT *, "left" + greatest(0, t_start - s_start) AS c_start, "right" + least(0, t_end - s_end) AS c_end FROM b)"""


@query(f'WITH {ANNOTATED} SELECT t_id, s_id, round(100.0::DOUBLE * (c_end - c_start) / ("right" - "left"), 6) AS masked_percent, round(100.0::DOUBLE * (c_end - c_start) / ("right" + remains), 6) AS element_percent FROM c WHERE "left" IS NOT NULL AND "right" > "left"')
def annotation_shares(spark, sf_dir):
    out = annotation.masked_shares(_annotated(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("masked_percent", "element_percent")})


RUNS = """,
i AS (SELECT name, c_start AS s, c_end AS e, max(c_end) OVER (PARTITION BY name ORDER BY c_start, c_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE "left" IS NOT NULL AND "right" >= "left" AND c_end > c_start),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM i),
u AS (SELECT name, min(s) AS start, max(e) AS stop FROM g GROUP BY name, run)"""


@query(f"""
WITH {ANNOTATED}{RUNS},
l AS (SELECT name, max(stop) AS len FROM u GROUP BY name),
f AS (SELECT name, CAST(floor(start * 40.0::DOUBLE / len) AS INTEGER) AS a, CAST(floor(stop * 40.0::DOUBLE / len) AS INTEGER) AS z FROM u JOIN l USING (name)),
x AS (SELECT name, i, max(CASE WHEN a <= i AND i < z THEN 1 ELSE 0 END) AS hit FROM f, range(40) r(i) GROUP BY name, i)
SELECT name, string_agg(CASE hit WHEN 1 THEN '#' ELSE '-' END, '' ORDER BY i) AS bar FROM x GROUP BY name""")
def annotation_coverage_bars(spark, sf_dir):
    runs = annotation.consensus_coverage(_annotated(spark, sf_dir))
    return annotation.coverage_bars(runs, runs.groupBy("name").agg(F.max("end").alias("len")))


MAPS = ANNOTATED + """,
d AS (SELECT t_id, rank, name, "left", overlap, s_end - s_start AS len, "right" + remains AS whole, row_number() OVER (PARTITION BY t_id ORDER BY rank) - 1 AS i, c_start, c_end, CASE WHEN c_end + remains = 0 THEN 1 ELSE c_end + remains END AS size, strand,
  CAST(floor((greatest(s_start, t_start) - t_start) * (20.0::DOUBLE / (t_end - t_start)) + 0.5::DOUBLE) AS INTEGER) AS u, CAST(floor((least(s_end, t_end) - t_start) * (20.0::DOUBLE / (t_end - t_start)) + 0.5::DOUBLE) AS INTEGER) AS v FROM c),
e AS (SELECT *, CASE strand WHEN -1 THEN 20 - v ELSE u END AS a, CASE strand WHEN -1 THEN 20 - u ELSE v END AS z FROM d),
cells AS (SELECT t_id, p, arg_max(CASE WHEN "left" IS NOT NULL AND (p = a AND c_start / size::DOUBLE <= 1.0::DOUBLE / 20 OR p = z - 1 AND c_end / size::DOUBLE <= 1.0::DOUBLE / 20) THEN chr(CAST(65 + i AS INTEGER)) ELSE chr(CAST(97 + i AS INTEGER)) END, i) AS letter
  FROM e, range(20) r(p) WHERE a <= p AND p < z GROUP BY 1, 2),
maps AS (SELECT t_id, string_agg(coalesce(letter, '-'), '' ORDER BY p) AS map FROM (SELECT DISTINCT t_id, p FROM e, range(20) r(p)) LEFT JOIN cells USING (t_id, p) GROUP BY 1)"""


@query(f"WITH {MAPS} SELECT t_id, map FROM maps")
def annotation_maps(spark, sf_dir):
    return annotation.annotation_maps(_annotated(spark, sf_dir))


@query(f"""
WITH {MAPS}, names AS (SELECT t_id, string_agg(' ' || name || CASE WHEN "left" IS NULL THEN '' ELSE '(' || coalesce(CAST(CAST(round_even(CAST(overlap AS DOUBLE) / nullif(len, 0) * 100, 0) AS BIGINT) AS VARCHAR), 'NaN') || '%|' || coalesce(CAST(CAST(round_even(CAST(overlap AS DOUBLE) / nullif(whole, 0) * 100, 0) AS BIGINT) AS VARCHAR), 'NaN') || '%)' END, '' ORDER BY rank) AS names FROM e GROUP BY 1)
SELECT t_id, '"' || coalesce(map, repeat('-', 20)) || coalesce(names, '') || '"' AS text FROM t LEFT JOIN maps USING (t_id) LEFT JOIN names USING (t_id)""")
def annotation_texts(spark, sf_dir):
    return annotation.annotation_texts(_single_targets(spark, sf_dir), _annotated(spark, sf_dir))


def _regions(spark, sf_dir):
    """Every hour of every user with an event is a region."""
    hour = F.floor(F.col("start") / 60)
    return marks(spark, sf_dir).select("contig", hour.alias("h")).distinct().select((F.col("contig") * 1_000_000_000 + F.col("h")).alias("r_id"), "contig", (F.col("h") * 60).alias("r_start"), (F.col("h") * 60 + 90).alias("r_end"))


@query(f"""
WITH {MARKS}, r AS (SELECT DISTINCT contig * 1000000000 + start // 60 AS r_id, contig, (start // 60) * 60 AS r_start, (start // 60) * 60 + 90 AS r_end FROM marks),
m AS (SELECT r_id, (start + "end") / 2.0::DOUBLE AS mid, (r_start + r_end) / 2.0::DOUBLE AS middle FROM r JOIN marks USING (contig) WHERE r_start <= start AND "end" <= r_end),
a AS (SELECT r_id, count(*) AS n, avg(mid) AS mean_mid, CASE WHEN count(*) > 1 THEN stddev_samp(mid) END AS spread, CASE WHEN count(*) > 1 THEN sqrt(var_pop(mid) * count(*)) / (count(*) - 1) END AS spread_compat, avg(abs(mid - middle)) AS mean_off FROM m GROUP BY r_id)
SELECT r_id, CAST(coalesce(n, 0) AS BIGINT) AS n, round(mean_mid, 4) AS mean_mid, round(spread, 4) AS spread, round(spread_compat, 4) AS spread_compat, round(mean_off, 4) AS mean_off FROM r LEFT JOIN a USING (r_id)""")
def interval_motif_statistics(spark, sf_dir):
    motifs = marks(spark, sf_dir).select("contig", F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    out = intervals.motif_statistics(_regions(spark, sf_dir), motifs, width=64)
    return out.withColumns({c: F.round(c, 4) for c in ("mean_mid", "spread", "spread_compat", "mean_off")})


ISLANDS = """i AS (SELECT {key}, start AS s, "end" AS e, max("end") OVER (PARTITION BY {key} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM i),
u AS (SELECT {key}, min(s) AS start, max(e) AS stop, count(*) AS n FROM g GROUP BY {key}, run)"""


@query(f"WITH {MARKS}, {ISLANDS.format(key='contig', src='marks')} SELECT contig, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS \"end\", CAST(n AS BIGINT) AS n FROM u")
def interval_union(spark, sf_dir):
    return intervals.union(marks(spark, sf_dir), "contig")


@query(f"WITH {SPANS}, {ISLANDS.format(key='contig', src='spans')} SELECT contig, CAST(sum(stop - start) AS BIGINT) AS covered FROM u GROUP BY contig")
def interval_covered_length(spark, sf_dir):
    return intervals.covered_length(spans(spark, sf_dir), "contig")


@query(f"""
WITH {SPANS}, m AS (SELECT contig, start AS pos, 1 AS d FROM spans UNION ALL SELECT contig, "end", -1 FROM spans), s AS (SELECT contig, pos, sum(d) AS d FROM m GROUP BY 1, 2),
r AS (SELECT contig, pos AS start, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS stop, sum(d) OVER (PARTITION BY contig ORDER BY pos) AS depth FROM s)
SELECT contig, start, stop AS "end", CAST(depth AS BIGINT) AS depth FROM r WHERE depth > 0""")
def interval_depth(spark, sf_dir):
    return intervals.depth(spans(spark, sf_dir), "contig")


SHARED = f"""{FAMILIES}, {ISLANDS.format(key='family_id, contig', src='families')},
x AS (SELECT a.family_id AS fam_a, b.family_id AS fam_b, CAST(sum(least(a.stop, b.stop) - greatest(a.start, b.start)) AS BIGINT) AS shared FROM u a JOIN u b ON a.contig = b.contig AND a.family_id < b.family_id AND a.start < b.stop AND b.start < a.stop GROUP BY 1, 2)"""


@query(f"WITH {SHARED} SELECT fam_a, fam_b, shared FROM x")
def family_intersections(spark, sf_dir):
    return intervals.intersections(families(spark, sf_dir), width=32)


@query(f"""
WITH {SHARED}, l AS (SELECT family_id, CAST(sum(stop - start) AS BIGINT) AS len FROM u GROUP BY 1),
p AS (SELECT fam_a, fam_b, shared, a.len AS la, b.len AS lb FROM x JOIN l a ON a.family_id = fam_a JOIN l b ON b.family_id = fam_b),
q AS (SELECT CASE WHEN la <= lb THEN fam_a ELSE fam_b END AS s, CASE WHEN la <= lb THEN fam_b ELSE fam_a END AS l, shared / least(la, lb) AS upper, shared / greatest(la, lb) AS lower FROM p)
SELECT s AS src, l AS dst, round(upper, 9) AS weight FROM q WHERE upper >= 0.05 UNION ALL SELECT l, s, round(lower, 9) FROM q WHERE upper >= 0.05 AND lower >= 0.05""")
def family_edges(spark, sf_dir):
    return intervals.family_edges(families(spark, sf_dir), width=32).withColumn("weight", F.round("weight", 9))


@query(f"""
WITH {FAMILIES}, e AS (SELECT DISTINCT contig, start AS pos FROM families UNION SELECT contig, "end" FROM families),
p AS (SELECT contig, pos, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS stop FROM e)
SELECT p.contig, p.pos AS start, p.stop AS "end", arg_max(f.family_id, f.ord) AS seg_id FROM p JOIN families f ON f.contig = p.contig AND f.start < p.stop AND p.pos < f."end" WHERE p.stop IS NOT NULL GROUP BY 1, 2, 3""")
def interval_overlay(spark, sf_dir):
    segments = families(spark, sf_dir).select("contig", F.col("family_id").alias("seg_id"), "ord", "start", "end")
    return intervals.overlay(segments, 32, "contig")


@query(f"""
WITH {FAMILIES}, m AS (SELECT contig, start, "end", arg_min(family_id, family_id * 1000000000 + ord) AS family_id, min(family_id * 1000000000 + ord) % 1000000000 AS ord FROM families GROUP BY 1, 2, 3)
SELECT family_id, CAST(ord AS BIGINT) AS ord, contig, start, "end" FROM m""")
def family_first_members(spark, sf_dir):
    return piles.first_members(families(spark, sf_dir), "contig", "start", "end")


@query(f"WITH {FAMILIES}, k AS (SELECT * FROM families WHERE strand <> 0) SELECT family_id, ord, contig, start, \"end\", strand FROM k WHERE family_id IN (SELECT family_id FROM k GROUP BY 1 HAVING count(*) >= 2)")
def family_kept(spark, sf_dir):
    members = families(spark, sf_dir).withColumnRenamed("strand", "O")
    return piles.kept_families(members).select("family_id", "ord", "contig", "start", "end", F.col("O").alias("strand"))


@query(f"""
WITH {FAMILIES}, p AS (SELECT a.family_id AS fam_a, b.family_id AS fam_b, a.strand * b.strand AS twist, a.ord * 1000000000 + b.ord AS place FROM families a JOIN families b ON a.contig = b.contig AND a.file_id < b.file_id AND a.start < b."end" AND b.start < a."end"
  AND ((a.start - b.start) ** 2 + (a."end" - b."end") ** 2) < 0.5 * ((greatest(a."end", b."end") - least(a.start, b.start)) / 4.0::DOUBLE) ** 2),
v AS (SELECT fam_a, fam_b, arg_min(twist, place) AS twist FROM p GROUP BY 1, 2)
SELECT fam_a, fam_b, v.twist, CAST(count(*) FILTER (p.twist <> v.twist) AS BIGINT) AS n_bad FROM p JOIN v USING (fam_a, fam_b) GROUP BY 1, 2, 3""")
def family_stitch_votes(spark, sf_dir):
    return piles.stitch(families(spark, sf_dir), 0.5, width=32)


@query(f"""
WITH {FAMILIES}, m AS (SELECT family_id, '[' || string_agg('{{"C":"' || contig || '","S":' || start || ',"E":' || "end" || ',"O":' || strand || '}}', ',' ORDER BY ord) || ']' AS value FROM families GROUP BY 1) SELECT family_id, value FROM m""")
def families_json_text(spark, sf_dir):
    members = families(spark, sf_dir).select("family_id", "ord", F.col("contig").alias("C"), F.col("start").alias("S"), F.col("end").alias("E"), F.col("strand").alias("O"))
    return formats.families_text(members)


@query(f"WITH {FAMILIES} SELECT family_id, CAST(row_number() OVER (PARTITION BY family_id ORDER BY ord) - 1 AS INTEGER) AS ord, contig AS C, start AS S, \"end\" AS E, strand AS O FROM families")
def families_json_parsed(spark, sf_dir):
    text = families_json_text(spark, sf_dir).withColumnRenamed("family_id", "line_no")
    return formats.parse_families(text)


@query(f"""
WITH {FAMILIES} SELECT contig || chr(9) || 'parts' || chr(9) || 'repeat' || chr(9) || (start + 1) || chr(9) || "end" || chr(9) || '.' || chr(9) || CASE strand WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '.' END || chr(9) || '.' || chr(9) || 'Family "' || family_id || '"; Note "p' || ord || '"' AS value FROM families""")
def gff_lines(spark, sf_dir):
    return formats.gff_text(_features(spark, sf_dir))


def _features(spark, sf_dir):
    attrs = F.array(F.struct(F.lit("Family").alias("tag"), F.col("family_id").cast("string").alias("value")), F.struct(F.lit("Note").alias("tag"), F.concat(F.lit("p"), F.col("ord").cast("string")).alias("value")))
    return families(spark, sf_dir).select(F.col("contig").alias("seqname"), F.lit("parts").alias("source"), F.lit("repeat").alias("feature"), "start", "end", F.lit(None).cast("double").alias("score"), "strand", F.lit(None).cast("int").alias("frame"), attrs.alias("attrs"))


@query(f"WITH {FAMILIES} SELECT contig AS seqname, start, \"end\", strand, CAST(family_id AS VARCHAR) AS family, 'p' || ord AS note FROM families")
def gff_parsed(spark, sf_dir):
    rows = formats.parse_gff(formats.gff_text(_features(spark, sf_dir)))
    return rows.select("seqname", "start", "end", "strand", formats.attribute("attrs", "Family").alias("family"), formats.attribute("attrs", "Note").alias("note"))


@query(f"""
WITH {FAMILIES} SELECT ord, 'rep' || family_id AS name, 'class' || (family_id % 3) AS class, CASE WHEN ord % 4 <> 0 THEN CAST(ord % 50 AS INTEGER) - 1 END AS "left", CAST(ord % 50 + 20 AS INTEGER) AS "right", CASE WHEN ord % 3 <> 0 THEN CAST(ord % 9 AS INTEGER) END AS remains FROM families""")
def repeat_attribute_parsed(spark, sf_dir):
    dotted = lambda keep, n: F.when(keep, n.cast("string")).otherwise(".")
    o = F.col("ord")
    value = F.concat_ws(" ", F.concat(F.lit("rep"), F.col("family_id").cast("string")), F.concat(F.lit("class"), (F.col("family_id") % 3).cast("string")), dotted(o % 4 != 0, o % 50), (o % 50 + 20).cast("string"), dotted(o % 3 != 0, o % 9))
    return families(spark, sf_dir).select("ord", annotation.parsed_repeat(value).alias("r")).select("ord", "r.*")


@query(f"WITH {SPANS}, p AS (SELECT a.id AS a, b.id AS b FROM spans a JOIN spans b ON a.\"order\" = b.\"order\" AND a.contig < b.contig AND a.start <= b.\"end\" AND b.start <= a.\"end\") SELECT a, b FROM p")
def touching_pairs(spark, sf_dir):
    s = spans(spark, sf_dir)
    a, b = s.select("order", *[F.col(c).alias(f"a_{c}") for c in ("id", "contig", "start", "end")]), s.select("order", *[F.col(c).alias(f"b_{c}") for c in ("id", "contig", "start", "end")])
    met = a.join(b, "order").filter("a_contig < b_contig").filter(touches(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query(f"""
WITH {FAMILIES} SELECT a.ord AS a, b.ord AS b, least(a."end" - a.start, b."end" - b.start) >= greatest(a."end" - a.start, b."end" - b.start) * (1 - 0.2::DOUBLE) AS alike
FROM families a JOIN families b ON a.family_id = b.family_id AND a.contig = b.contig AND a.ord < b.ord AND abs(a.start - b.start) <= floor((a."end" - a.start) * 0.5) AND abs(a."end" - b."end") <= floor((a."end" - a.start) * 0.5)""")
def close_members(spark, sf_dir):
    f = families(spark, sf_dir)
    side = lambda s: f.select("family_id", "contig", F.col("ord").alias(s), F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"))
    la, lb = F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")
    return intervals.close_pairs(side("a"), side("b"), 0.5, "family_id", "contig", condition=F.col("a") < F.col("b")).select("a", "b", within(0.2, F.least(la, lb), F.greatest(la, lb)).alias("alike"))
