"""Queries that put operators together: clusters and cliques of families, piles' coverage, pictures and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, graphs, identities, intervals, kmers, matrix, ordered, piles, references
from ..sources import formats, reports
from .bindings import DNA, FAMILIES, MARKS, SPANS, dna, families, marks, spans, supplier_graph, table
from .bindings import matrix as matrix_view
from .graph_queries import PILES, _pairs, _placed, _small_piles
from .interval_queries import ANNOTATED, RUNS, SHARED, _annotated, _regions

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {FAMILIES} SELECT family_id, CAST(count(*) AS BIGINT) AS size FROM families GROUP BY 1 HAVING count(*) BETWEEN 2 AND 80")
def family_sizes(spark, sf_dir):
    return piles.sized_families(families(spark, sf_dir), 2, 80)


@query(f"""
WITH {PILES}, o AS (SELECT pair_id, side, pile_id, p.stop - p.start AS plen, g.stop - g.start AS ilen FROM g JOIN piles p USING (contig, run)),
b AS (SELECT a.pair_id, a.plen AS ap, a.ilen AS ai, b.plen AS bp, b.ilen AS bi FROM o a JOIN o b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1)
SELECT pair_id FROM b WHERE least(ap, bp) >= greatest(ap, bp) * 0.05::DOUBLE AND ai >= ap * 0.05::DOUBLE AND bi >= bp * 0.05::DOUBLE""")
def pile_pairs_filtered(spark, sf_dir):
    return piles.filtered_pairs(_placed(spark, sf_dir), pile_diff=0.95, image_diff=0.95)


def _members_of_piles(spark, sf_dir):
    f = families(spark, sf_dir)
    return f.select(F.col("contig").alias("pile_id"), F.col("ord").alias("image_id"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))


@query(f'WITH {FAMILIES} SELECT a.contig AS pile_id, a.ord AS a, b.ord AS b FROM families a JOIN families b ON a.contig = b.contig AND a.ord < b.ord AND a.start <= b."end" AND b.start <= a."end"')
def pile_touching_images(spark, sf_dir):
    return piles.touching_images(_members_of_piles(spark, sf_dir), 64)


@query(f"""
WITH {FAMILIES}, m AS (SELECT contig AS pile_id, start AS pos, 1 AS d FROM families UNION ALL SELECT contig, "end", -1 FROM families), s AS (SELECT pile_id, pos, sum(d) AS d FROM m GROUP BY 1, 2),
r AS (SELECT pile_id, sum(d) OVER w AS deep, lead(pos) OVER w - pos AS n FROM s WINDOW w AS (PARTITION BY pile_id ORDER BY pos))
SELECT pile_id, CAST(sum(n) AS BIGINT) AS covered FROM r WHERE deep >= 2 GROUP BY 1""")
def pile_deep_coverage(spark, sf_dir):
    each = families(spark, sf_dir).select(F.col("contig").alias("pile_id"), "start", "end", F.lit(1).cast("long").alias("depth"), F.lit(True).alias("accepted"))
    return piles.deep_coverage(each)


@query()
def pile_landscape_files(spark, sf_dir):
    found = _small_piles(spark, sf_dir)
    ends = found.groupBy("pile_id").agg(F.min("p_start").alias("start"), F.max("p_end").alias("end")).withColumn("contig", F.element_at(F.split("pile_id", "/"), 2))
    accepted = piles.subpiles(found, share=0.0, target=2.0).filter("accepted").groupBy("pile_id").agg(F.count(F.lit(1)).alias("n"))
    return reports.landscape_json(piles.landscape_features(piles.landscape(found)), ends, accepted, least=1)


def _family_groups(spark, sf_dir):
    """Suppliers as families, by the orders that they share, in communities, with the cliques of those that are none themselves."""
    one = supplier_graph(spark, sf_dir, 26).select("src", "dst", F.col("weight").cast("double").alias("weight"))
    edges = ordered.written(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "family-edges")
    groups = graphs.communities(edges).withColumnRenamed("community", "group_id")
    tested = graphs.clique_test(groups, edges)
    inside = edges.join(groups.select(F.col("node").alias("src"), "group_id"), "src").join(groups.select(F.col("node").alias("dst"), F.col("group_id").alias("other")), "dst").filter("group_id = other")
    open_ = inside.join(tested.filter("not is_clique").select("group_id"), "group_id", "left_semi")
    cliques = graphs.maximal_cliques(open_.select("src", "dst"), least=3)
    # a clique lies within one group; its smallest member tells which
    cliques = cliques.join(groups.select(F.col("node").alias("clique_id"), "group_id"), "clique_id").select("group_id", F.array_join("members", ",").alias("clique_id"), "members")
    return edges, groups, tested, cliques


@query()
def family_group_ranks(spark, sf_dir):
    edges, groups, _, _ = _family_groups(spark, sf_dir)
    return identities.group_ranks(groups, edges)


@query()
def family_clique_memberships(spark, sf_dir):
    return identities.clique_memberships(_family_groups(spark, sf_dir)[3])


@query()
def family_identities(spark, sf_dir):
    edges, groups, tested, cliques = _family_groups(spark, sf_dir)
    named = identities.identities(identities.group_ranks(groups, edges), tested, cliques)
    members = spans(spark, sf_dir).select(F.col("contig").alias("family_id"), F.col("id").alias("ord"), F.col("order").alias("contig"), "start", "end")
    return identities.annotated(members, named).select("family_id", "ord", "contig", "start", "end", "cluster", "clique")


@query(f"""
WITH {ANNOTATED}{RUNS}, own2 AS (SELECT name, "left" AS s, "right" AS e FROM b WHERE "left" IS NOT NULL AND "right" > "left"),
i2 AS (SELECT *, max(e) OVER (PARTITION BY name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM own2),
g2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM i2),
u2 AS (SELECT name, min(s) AS start, max(e) AS stop FROM g2 GROUP BY name, run),
l AS (SELECT name, max(stop) AS len FROM (SELECT name, stop FROM u UNION ALL SELECT name, stop FROM u2) GROUP BY 1),
f AS (SELECT 0 AS side, name, CAST(floor(start * (40.0::DOUBLE / len)) AS INTEGER) AS a, CAST(floor(stop * (40.0::DOUBLE / len)) AS INTEGER) AS z FROM u2 JOIN l USING (name) UNION ALL SELECT 1, name, CAST(floor(start * (40.0::DOUBLE / len)) AS INTEGER), CAST(floor(stop * (40.0::DOUBLE / len)) AS INTEGER) FROM u JOIN l USING (name)),
x AS (SELECT side, name, i, max(CASE WHEN a <= i AND i < z THEN 1 ELSE 0 END) AS hit FROM f, range(40) r(i) GROUP BY 1, 2, 3),
bars AS (SELECT side, name, string_agg(CASE hit WHEN 1 THEN '#' ELSE '-' END, '' ORDER BY i) AS bar FROM x GROUP BY 1, 2),
wide AS (SELECT greatest(6, max(length(name))) AS w FROM l)
SELECT 0 AS kind, '' AS name, rpad('repeat', CAST(w AS INTEGER), ' ') || ' ' || rpad('named coverage', 41, ' ') || 'de novo coverage' AS value FROM wide
UNION ALL SELECT 1, name, rpad(name, CAST(w AS INTEGER), ' ') || ' ' || coalesce(a.bar, repeat('-', 40)) || ' ' || coalesce(b.bar, repeat('-', 40)) FROM l LEFT JOIN (SELECT name, bar FROM bars WHERE side = 0) a USING (name) LEFT JOIN (SELECT name, bar FROM bars WHERE side = 1) b USING (name), wide""")
def annotation_coverage_table(spark, sf_dir):
    """Coverage of each repeat's consensus by the records themselves and by what targets show of them."""
    matches = _annotated(spark, sf_dir)
    own = intervals.union(matches.filter("left is not null and right > left").select("name", F.col("left").alias("start"), F.col("right").alias("end")), "name")
    shown = annotation.consensus_coverage(matches)
    most = own.select("name", "end").union(shown.select("name", "end")).groupBy("name").agg(F.max("end").alias("len"))
    return reports.coverage_table(annotation.coverage_bars(own, most), annotation.coverage_bars(shown, most))


@query(f"""
WITH {MARKS}, r AS (SELECT DISTINCT contig * 1000000000 + start // 60 AS r_id, contig, (start // 60) * 60 AS r_start, (start // 60) * 60 + 90 AS r_end FROM marks),
m AS (SELECT r_id, (start + "end") / 2.0::DOUBLE AS mid, (r_start + r_end) / 2.0::DOUBLE AS middle FROM r JOIN marks USING (contig) WHERE r_start <= start AND "end" <= r_end),
a AS (SELECT r_id, count(*) AS n, round(avg(mid), 4) AS mid, round(avg(abs(mid - middle)), 4) AS off FROM m GROUP BY r_id)
SELECT r.contig || chr(9) || r_start || chr(9) || r_end || chr(9) || coalesce(n, 0) || chr(9) || coalesce(printf('%.4f', mid), '') || chr(9) || coalesce(printf('%.4f', off), '') AS value FROM r LEFT JOIN a USING (r_id)""")
def motif_statistics_lines(spark, sf_dir):
    regions = _regions(spark, sf_dir)
    motifs = marks(spark, sf_dir).select("contig", F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    out = intervals.motif_statistics(regions, motifs, width=64).withColumns({c: F.round(c, 4) for c in ("mean_mid", "mean_off")})
    return reports.tsv_lines(regions.join(out, "r_id"), ("contig", "%d"), ("r_start", "%d"), ("r_end", "%d"), ("n", "%d"), ("mean_mid", "%.4f"), ("mean_off", "%.4f"))


@query()
def matrix_pattern_lines(spark, sf_dir):
    w, h, _ = matrix.factorise(matrix_view(spark, sf_dir), k=3, rounds=1000, tolerance=0.01)
    long = lambda f, index: matrix.pattern_weights(f, index).select("pattern", F.col(index).cast("string").alias("name"), "weight")
    return reports.pattern_lines(long(w, "i"), long(h, "j"))


@query()
def matrix_position_table(spark, sf_dir):
    """Factors of the table of k-mers by hundreds of positions."""
    found = kmers.occurrences(dna(spark, sf_dir), 3).groupBy(F.col("kmer").alias("i"), F.floor(F.col("pos") / 100).cast("long").alias("j")).agg(F.count_distinct("id").cast("double").alias("v"))
    _, h, _ = matrix.factorise(found, k=3, rounds=1000, tolerance=0.01)
    return reports.position_table(h.select(F.col("j").alias("pos"), F.posexplode("w").alias("pattern", "weight")), 3)


@query("""
WITH t AS (SELECT DISTINCT source FROM documents) SELECT a.source AS a, b.source AS b FROM t a JOIN t b ON a.source <= b.source""")
def job_matrix(spark, sf_dir):
    return reports.job_pairs(table(spark, sf_dir, "documents").select("source").distinct(), "source")


@query(f"""
WITH {DNA}, c AS (SELECT id AS contig_id, CAST(length(seq) // 50 + 20 AS BIGINT) AS len FROM dna),
s AS (SELECT id AS contig_id, 2 AS start, substring(seq, 1, 4) AS seq FROM dna WHERE length(seq) >= 40 UNION ALL SELECT id, 15, substring(seq, 5, 4) FROM dna WHERE length(seq) >= 40)
SELECT contig_id, coalesce('nn' || a.seq || repeat('n', 9) || b.seq || repeat('n', CAST(len - 19 AS INTEGER)), repeat('n', CAST(len AS INTEGER))) AS seq
FROM c LEFT JOIN (SELECT * FROM s WHERE start = 2) a USING (contig_id) LEFT JOIN (SELECT * FROM s WHERE start = 15) b USING (contig_id)""")
def contig_text(spark, sf_dir):
    rows = dna(spark, sf_dir)
    lengths = rows.select(F.col("id").alias("contig_id"), (F.floor(F.length("seq") / 50) + 20).cast("long").alias("len"))
    return references.rendered(_segments(spark, sf_dir), lengths)


def _segments(spark, sf_dir):
    rows = dna(spark, sf_dir).filter(F.length("seq") >= 40)
    at = lambda start, first: rows.select(F.col("id").alias("contig_id"), F.lit(start).cast("long").alias("start"), F.lit(start + 4).cast("long").alias("end"), F.substring("seq", first, 4).alias("seq"))
    return at(2, 1).unionByName(at(15, 5))


@query(f"""
WITH {DNA}, p AS (SELECT id AS contig_id, id % 20 AS pos, seq FROM dna)
SELECT contig_id, pos, CASE WHEN length(seq) >= 40 AND pos BETWEEN 2 AND 5 THEN substring(seq, pos - 1, 1) WHEN length(seq) >= 40 AND pos BETWEEN 15 AND 18 THEN substring(seq, pos - 10, 1) ELSE 'n' END AS letter FROM p""")
def contig_letters(spark, sf_dir):
    places = dna(spark, sf_dir).select(F.col("id").alias("contig_id"), (F.col("id") % 20).alias("pos"))
    return references.letter_at(places, _segments(spark, sf_dir), 64)


@query(f"""
WITH {DNA}, k AS (SELECT id, unnest(list_transform(range(length(seq) - 2), lambda i: substring(seq, i + 1, 3))) AS kmer FROM dna WHERE length(seq) >= 3),
c AS (SELECT id, kmer, count(*) AS n FROM k GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY id) AS most FROM c)
SELECT id, CAST(list_sum(list_transform(range(3), lambda i: (instr('ACGT', substring(kmer, i + 1, 1)) - 1) * CAST(4 ** (2 - i) AS BIGINT))) AS INTEGER) AS x, 0 AS y,
  round(list_sum(list_transform(range(3), lambda i: (instr('ACGT', substring(kmer, i + 1, 1)) - 1) * CAST(4 ** (2 - i) AS BIGINT))) / 64.0::DOUBLE, 9) AS h, 1.0::DOUBLE AS s, round(n / most, 9) AS v FROM m""")
def kmer_rainbow(spark, sf_dir):
    found = kmers.rainbow(kmers.counts(dna(spark, sf_dir), 3), 3)
    return found.withColumns({"h": F.round("h", 9), "v": F.round("v", 9)})


@query(f"""
WITH {SPANS}, s AS (SELECT id AS pair_id, start AS top, "end" AS bottom, contig AS l, contig + 1 AS r FROM spans)
SELECT pair_id, lower(hex(CAST(top AS BLOB))) AS value FROM (SELECT pair_id, CAST(top || ' ' || bottom || ' ' || l || ' ' || r AS VARCHAR) AS top FROM s)""")
def trapezoid_rows(spark, sf_dir):
    """Trapezoids through their packed form and back, as text in hexadecimal."""
    traps = spans(spark, sf_dir).select("id", F.col("start").alias("top"), F.col("end").alias("bottom"), F.col("contig").alias("left"), (F.col("contig") + 1).alias("right"))
    back = formats.parse_trapezoids(formats.trapezoid_bytes(traps, "id"), "id")
    return back.select(F.col("id").alias("pair_id"), F.lower(F.hex(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("top", "bottom", "left", "right")]))).alias("value"))


@query(f"""
WITH {PILES} SELECT a_s AS a_start, ac || chr(9) || 'align' || chr(9) || 'hit' || chr(9) || (a_s + 1) || chr(9) || ae || chr(9) || '.' || chr(9) || CASE strand WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '.' END || chr(9) || '.' || chr(9) || 'Target "' || bc || ' ' || (b_s + 1) || ' ' || be || '"' AS value FROM pairs""")
def pair_lines(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("score", F.lit(None).cast("double"))
    return formats.pairs_text(pairs, "a_start")
