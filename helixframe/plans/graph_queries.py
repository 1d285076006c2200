"""Queries over graphs, piles and matrices, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignments, graphs, matrix, ordered, piles
from ..sources import formats
from .bindings import DNA, EDGES, FAMILIES, MATRIX, SPANS, SUPPLIERS, dna, edges, families, part_graph, part_pairs, spans, supplier_graph, table
from .bindings import matrix as matrix_view

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# every node takes the smallest label around it, round by round, until none changes
LABELS = """both_ AS (SELECT src AS u, dst AS v FROM {edges} UNION SELECT dst, src FROM {edges}),
step(turn, u, root) AS (SELECT 0, u, u FROM (SELECT DISTINCT u FROM both_) UNION ALL
  SELECT turn + 1, u, root FROM (SELECT any_value(s.turn) AS turn, s.u, least(any_value(s.root), min(n.root)) AS root, any_value(s.root) AS old, sum(0) AS zero FROM step s JOIN both_ b ON b.u = s.u JOIN step n ON n.u = b.v GROUP BY s.u) WHERE turn < {rounds}),
label AS (SELECT u AS node, min(root) AS component FROM step GROUP BY u)"""


@query(f"WITH RECURSIVE {EDGES}, {LABELS.format(edges='edges', rounds=12)} SELECT node, component FROM label")
def graph_components(spark, sf_dir):
    return graphs.components(edges(spark, sf_dir).select("src", "dst"))


def _doubled(twisted: str, rounds: int = 12) -> str:
    """SQL of the doubled graph: an even number is a node's plus side, an odd one its minus side."""
    return f"""doubled AS (SELECT src * 2 AS src, dst * 2 + CASE twist WHEN 1 THEN 0 ELSE 1 END AS dst FROM {twisted} UNION SELECT src * 2 + 1, dst * 2 + CASE twist WHEN 1 THEN 1 ELSE 0 END FROM {twisted}),
{LABELS.format(edges='doubled', rounds=rounds)},
side AS (SELECT node // 2 AS node, node % 2 AS own, component // 2 AS component, component % 2 AS mark FROM label),
plus AS (SELECT node, component, count(*) AS n, min(own) AS own FROM side WHERE mark = 0 GROUP BY 1, 2),
signed AS (SELECT node, component, CASE own WHEN 0 THEN 1 ELSE -1 END AS strand FROM plus WHERE component NOT IN (SELECT component FROM plus WHERE n > 1))"""


@query(f"""
WITH RECURSIVE twisted AS (SELECT DISTINCT o_custkey AS src, 1000000000 + o_orderkey AS dst, twist FROM (
  SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN -1 ELSE 1 END AS twist FROM orders UNION ALL SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN -1 ELSE 1 END FROM orders WHERE o_totalprice > 490000)),
{_doubled('twisted')} SELECT * FROM signed""")
def graph_signed_components(spark, sf_dir):
    """Customers and their orders, by status; urgency speaks for or against the largest orders' sign, and a customer with one against is contradictory."""
    o = table(spark, sf_dir, "orders")
    ends = (F.col("o_custkey").alias("src"), (1_000_000_000 + F.col("o_orderkey")).alias("dst"))
    status = o.select(*ends, F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("twist"))
    urgent = o.filter("o_totalprice > 490000").select(*ends, F.when(F.col("o_orderpriority") == "1-URGENT", -1).otherwise(1).alias("twist"))
    return graphs.signed_components(status.unionByName(urgent).distinct())


@query(f"""
WITH RECURSIVE twisted AS (SELECT CAST(r_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst, 1 AS twist FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 100 + c_nationkey, 10000000 + c_custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END FROM customer
  UNION ALL SELECT 100 + s_nationkey, 1000 + s_suppkey, CASE WHEN s_acctbal < 0 THEN -1 ELSE 1 END FROM supplier
  UNION ALL SELECT n_regionkey, 1000 + s_suppkey, 1 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal < -800 OR s_acctbal > 5000), {_doubled('twisted')} SELECT * FROM signed""")
def graph_signed_regions(spark, sf_dir):
    """Regions, nations, customers and suppliers, whose signs are those of their accounts; a supplier far in debt contradicts its region."""
    t = lambda name: table(spark, sf_dir, name)
    sign = lambda c: F.when(F.col(c) < 0, -1).otherwise(1)
    far = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).filter("s_acctbal < -800 or s_acctbal > 5000")
    parts = [
        t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey"), 100 + F.col("n_nationkey"), F.lit(1)),
        t("customer").select(100 + F.col("c_nationkey"), 10_000_000 + F.col("c_custkey"), sign("c_acctbal")),
        t("supplier").select(100 + F.col("s_nationkey"), 1000 + F.col("s_suppkey"), sign("s_acctbal")),
        far.select(F.col("n_regionkey"), 1000 + F.col("s_suppkey"), F.lit(1)),
    ]
    edges = [p.toDF("src", "dst", "twist").select(F.col("src").cast("long"), F.col("dst").cast("long"), "twist") for p in parts]
    return graphs.signed_components(edges[0].unionByName(edges[1]).unionByName(edges[2]).unionByName(edges[3]))


@query("""
WITH e AS (SELECT l_orderkey AS src, 1000000000 + l_partkey AS dst, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS kinds, max(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS twist FROM lineitem GROUP BY 1, 2),
p AS (SELECT n FROM (SELECT src AS n FROM e WHERE kinds > 1 UNION ALL SELECT dst FROM e WHERE kinds > 1) GROUP BY n HAVING count(*) > 1)
SELECT src, dst, CAST(twist AS INTEGER) AS twist FROM e WHERE kinds = 1 AND src NOT IN (SELECT n FROM p) AND dst NOT IN (SELECT n FROM p)""")
def graph_consistent_edges(spark, sf_dir):
    """Orders and their parts; a part that an order holds with and without return is seen with both signs."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (1_000_000_000 + F.col("l_partkey")).alias("dst"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("twist"))
    return graphs.consistent_edges(seen)


def _rank_sql(rounds: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(rounds):
        steps.append(f"g{i} AS MATERIALIZED (SELECT dst AS node, sum(part * rank) AS given FROM parts JOIN r{i} ON src = node GROUP BY 1), l{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM parts))")
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(given, 0) + (SELECT lost FROM l{i}) / (SELECT count(*) FROM nodes)) AS rank FROM nodes LEFT JOIN g{i} USING (node))")
    return ", ".join(steps)


@query(f"""
WITH {SUPPLIERS}, parts AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS part FROM graph), nodes AS (SELECT src AS node FROM graph UNION SELECT dst FROM graph), {_rank_sql(40)}
SELECT node, round(rank, 6) AS rank FROM r40""")
def graph_pagerank(spark, sf_dir):
    return graphs.pagerank(supplier_graph(spark, sf_dir), tolerance=1e-8).withColumn("rank", F.round("rank", 6))


def _groups(spark, sf_dir):
    graph = supplier_graph(spark, sf_dir)
    return graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct().withColumn("group_id", F.floor(F.col("node") / 4).cast("long"))


@query(f"""
WITH {SUPPLIERS}, n AS (SELECT src AS node FROM graph UNION SELECT dst FROM graph), g AS (SELECT node, node // 4 AS group_id FROM n),
s AS (SELECT group_id, count(*) AS size FROM g GROUP BY 1), e AS (SELECT a.group_id, count(*) AS n FROM graph JOIN g a ON a.node = src JOIN g b ON b.node = dst WHERE a.group_id = b.group_id GROUP BY 1)
SELECT group_id, CAST(size AS BIGINT) AS size, CAST(coalesce(n, 0) AS BIGINT) AS n_edges, size = 2 OR 2 * coalesce(n, 0) = size * (size - 1) AS is_clique FROM s LEFT JOIN e USING (group_id)""")
def graph_clique_test(spark, sf_dir):
    return graphs.clique_test(_groups(spark, sf_dir), supplier_graph(spark, sf_dir))


@query()
def graph_maximal_cliques(spark, sf_dir):
    return graphs.maximal_cliques(part_graph(spark, sf_dir))


@query()
def graph_communities(spark, sf_dir):
    return graphs.communities(supplier_graph(spark, sf_dir).select("src", "dst"))


@query(f"""
WITH {SUPPLIERS}, n AS (SELECT src AS node FROM graph UNION SELECT dst FROM graph)
SELECT 1 AS kind, '  ' || node || ' [cluster="' || (node // 4) || '" members=1];' AS value FROM n UNION ALL SELECT 2, '  ' || src || ' -> ' || dst || ' [weight=' || printf('%.6f', CAST(weight AS DOUBLE)) || '];' FROM graph""")
def graph_dot_lines(spark, sf_dir):
    nodes = _groups(spark, sf_dir).select("node", F.col("group_id").alias("cluster"), F.lit(1).alias("members"))
    return formats.dot_text(nodes, supplier_graph(spark, sf_dir).withColumn("weight", F.col("weight").cast("double")))


def _pairs(spark, sf_dir):
    s = spans(spark, sf_dir).filter("end > start")
    a = s.select("order", F.col("id").alias("a_id"), F.col("line").alias("a_line"), F.col("contig").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("strand").alias("a_strand"))
    b = s.select("order", F.col("id").alias("b_id"), F.col("line").alias("b_line"), F.col("contig").alias("b_contig"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("strand").alias("b_strand"))
    met = a.join(b, "order").filter("a_id < b_id")
    return met.select((F.col("a_id") * 8 + F.col("b_line")).alias("pair_id"), "a_contig", "a_start", "a_end", "b_contig", "b_start", "b_end", F.when(F.col("a_strand") == F.col("b_strand"), 1).otherwise(-1).alias("strand"))


PILES_OF_PAIRS = """images AS (SELECT pair_id, 0 AS side, ac AS contig, a_s AS start, ae AS stop, strand FROM pairs UNION ALL SELECT pair_id, 1, bc, b_s, be, strand FROM pairs),
i AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop, pair_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM images),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, stop, pair_id, side ROWS UNBOUNDED PRECEDING) AS run FROM i),
piles AS (SELECT contig, run, contig || ':' || min(start) AS pile_id, min(start) AS start, max(stop) AS stop, count(*) AS n FROM g GROUP BY 1, 2)"""
PILES = f"""{SPANS},
pairs AS (SELECT a.id * 8 + b.line AS pair_id, a.contig AS ac, a.start AS a_s, a."end" AS ae, b.contig AS bc, b.start AS b_s, b."end" AS be, CASE WHEN a.strand = b.strand THEN 1 ELSE -1 END AS strand FROM spans a JOIN spans b ON a."order" = b."order" AND a.id < b.id WHERE a."end" > a.start AND b."end" > b.start),
{PILES_OF_PAIRS}"""


@query(f'WITH {PILES} SELECT pile_id, contig, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", CAST(n AS BIGINT) AS n_images FROM piles')
def pile_merge(spark, sf_dir):
    return piles.piles(piles.images(_pairs(spark, sf_dir)))


def _placed(spark, sf_dir):
    found = piles.images(_pairs(spark, sf_dir))
    return piles.placed(found, piles.piles(found))


@query(f"WITH {PILES} SELECT pile_id, CAST(count(*) AS BIGINT) AS depth, CAST(sum(g.stop - g.start) AS BIGINT) AS volume, CAST(min(g.start) AS BIGINT) AS span_start, CAST(max(g.stop) AS BIGINT) AS span_end FROM g JOIN piles p USING (contig, run) GROUP BY 1")
def pile_measures(spark, sf_dir):
    return piles.pile_measures(_placed(spark, sf_dir))


@query(f"""
WITH {PILES}, o AS (SELECT pair_id, side, g.strand, pile_id FROM g JOIN piles p USING (contig, run)),
t AS (SELECT least(a.pile_id, b.pile_id) AS src, greatest(a.pile_id, b.pile_id) AS dst, a.strand AS twist FROM o a JOIN o b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 WHERE a.pile_id <> b.pile_id)
SELECT src, dst, CAST(count(*) AS BIGINT) AS n, CAST(sum(twist) AS BIGINT) AS twist_sum FROM t GROUP BY 1, 2""")
def pile_twists(spark, sf_dir):
    met = piles.twists(_placed(spark, sf_dir), classic=True)
    return met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("twist").alias("twist_sum"))


def _small_piles(spark, sf_dir):
    """Families' members as images of one pile per family and contig."""
    f = families(spark, sf_dir).select(F.concat_ws("/", F.col("family_id").cast("string"), "contig").alias("pile_id"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    ends = f.groupBy("pile_id").agg(F.min("i_start").alias("p_start"), F.max("i_end").alias("p_end"))
    return f.join(ends, "pile_id")


def _seeds_sql(share: float, rounds: int) -> str:
    """SQL of seeds and members of the intervals u (pile_id, s, e, n, key): each round settles what waits for nothing."""
    reach = f"floor((a.e - a.s) * {share}::DOUBLE)"
    steps = [
        f"x AS MATERIALIZED (SELECT a.key AS a, b.key AS b, a.n AS a_n, a.s AS a_s, a.e AS a_e FROM u a JOIN u b USING (pile_id) WHERE abs(a.s - b.s) <= {reach} AND abs(a.e - b.e) <= {reach} AND (-a.n, a.s, a.e) < (-b.n, b.s, b.e))",
        "lost0 AS (SELECT '' AS key WHERE FALSE)",
    ]
    for i in range(rounds):
        steps.append(f"seed{i + 1} AS MATERIALIZED (SELECT key FROM u WHERE key NOT IN (SELECT b FROM x WHERE a NOT IN (SELECT key FROM lost{i})) AND key NOT IN (SELECT key FROM lost{i}))")
        steps.append(f"lost{i + 1} AS MATERIALIZED (SELECT DISTINCT b AS key FROM x WHERE a IN (SELECT key FROM seed{i + 1}))")
    steps.append(f"taken AS (SELECT b AS key, arg_min(a, (-a_n, a_s, a_e)) AS seed FROM x WHERE a IN (SELECT key FROM seed{rounds}) GROUP BY b)")
    steps.append("members AS (SELECT u.*, coalesce(seed, key) AS seed FROM u LEFT JOIN taken USING (key))")
    steps.append('clusters AS (SELECT pile_id, seed, min(s) AS c_s, max(e) AS c_e, CAST(sum(n) AS BIGINT) AS depth FROM members GROUP BY 1, 2)')
    return ", ".join(steps)


@query(f"""
WITH f AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) || '/' || p_type AS pile_id, p_partkey AS s, p_partkey + p_size + 1 AS e FROM part),
u AS (SELECT pile_id, s, e, count(*) AS n, concat_ws(':', pile_id, s, e) AS key FROM f GROUP BY 1, 2, 3), {_seeds_sql(0.5, 8)}
SELECT pile_id, c_s AS start, c_e AS "end", depth FROM clusters""")
def pile_seed_clusters(spark, sf_dir):
    members = piles.seeded(_small_piles(spark, sf_dir), share=0.5)
    made = members.groupBy("pile_id", "s_start", "s_end").agg(F.min("i_start").alias("start"), F.max("i_end").alias("end"), F.sum("n").alias("depth"))
    return made.select("pile_id", "start", "end", "depth")


@query()
def pile_subclusters(spark, sf_dir):
    return piles.subpiles(_small_piles(spark, sf_dir), share=0.5, strictness=2).drop("s_start", "s_end")


@query(f"""
WITH RECURSIVE p AS (SELECT p_partkey AS k, p_brand AS brand, p_brand || '/' || p_type AS contig, p_partkey AS s, p_partkey + p_size + 1 AS e, 1 - 2 * (length(p_type) % 2) AS sign, p_size FROM part),
n AS (SELECT *, lead(contig) OVER w AS contig2, lead(s) OVER w AS s2, lead(e) OVER w AS e2, lead(sign) OVER w AS sign2 FROM p WINDOW w AS (PARTITION BY brand ORDER BY k)),
pairs AS (SELECT k AS pair_id, contig AS ac, s AS a_s, e AS ae, contig2 AS bc, s2 AS b_s, e2 AS be, sign * sign2 * CASE p_size WHEN 50 THEN -1 ELSE 1 END AS strand FROM n WHERE s2 IS NOT NULL),
{PILES_OF_PAIRS},
o AS (SELECT pair_id, side, g.strand, pile_id, contig, piles.start AS p_s, piles.stop AS p_e, g.start AS s, g.stop AS e FROM g JOIN piles USING (contig, run)),
u AS (SELECT pile_id, s, e, count(*) AS n, concat_ws(':', pile_id, s, e) AS key FROM o GROUP BY 1, 2, 3), {_seeds_sql(0.3, 8)},
own AS (SELECT o.*, c_s, c_e FROM o JOIN members m ON m.pile_id = o.pile_id AND m.s = o.s AND m.e = o.e JOIN clusters c ON c.pile_id = m.pile_id AND c.seed = m.seed),
met AS (SELECT a.contig AS ac, a.c_s AS a_s, a.c_e AS a_e, b.contig AS bc, b.p_s AS b_s, b.p_e AS b_e, a.strand FROM own a JOIN o b ON a.pair_id = b.pair_id AND b.side = 1 - a.side
  WHERE least(a.c_e - a.c_s, b.p_e - b.p_s) >= greatest(a.c_e - a.c_s, b.p_e - b.p_s) * (1 - 0.8::DOUBLE) AND a.e - a.s >= (a.c_e - a.c_s) * (1 - 0.8::DOUBLE) AND b.e - b.s >= (b.p_e - b.p_s) * (1 - 0.8::DOUBLE)),
nodes AS (SELECT *, row_number() OVER (ORDER BY contig, s, e, kind) - 1 AS node FROM (SELECT ac AS contig, a_s AS s, a_e AS e, 'sub' AS kind FROM met UNION SELECT bc, b_s, b_e, 'pile' FROM met)),
seen AS (SELECT least(x.node, y.node) AS src, greatest(x.node, y.node) AS dst, strand AS twist FROM met JOIN nodes x ON x.kind = 'sub' AND x.contig = ac AND x.s = a_s AND x.e = a_e JOIN nodes y ON y.kind = 'pile' AND y.contig = bc AND y.s = b_s AND y.e = b_e
  WHERE ac <> bc OR a_s <> b_s OR a_e <> b_e UNION ALL SELECT min(node), max(node), 1 FROM nodes GROUP BY contig, s, e HAVING min(node) < max(node)),
kinds AS (SELECT src, dst, count(DISTINCT twist) AS kinds, max(twist) AS twist FROM seen GROUP BY 1, 2),
poison AS (SELECT n FROM (SELECT src AS n FROM kinds WHERE kinds > 1 UNION ALL SELECT dst FROM kinds WHERE kinds > 1) GROUP BY n HAVING count(*) > 1),
twisted AS (SELECT src, dst, twist FROM kinds WHERE kinds = 1 AND src NOT IN (SELECT n FROM poison) AND dst NOT IN (SELECT n FROM poison)),
{_doubled('twisted', 250)}
SELECT DISTINCT component AS family_id, contig, s AS start, e AS "end", strand FROM signed JOIN nodes USING (node)""")
def pile_families(spark, sf_dir):
    """From pairs to families in one go: images, piles, sub-piles, twists, components with strands."""
    p = part_pairs(spark, sf_dir)
    found = ordered.written(piles.images(p), "images")
    over = ordered.written(piles.placed(found, ordered.written(piles.piles(found), "piles")), "placed")
    members = ordered.written(piles.seeded(over, share=0.3), "members")
    nodes, edges = piles.subpile_twists(over, members, piles.subpiles(over, target=2.0, members=members), pile_diff=0.8, image_diff=0.8)
    return piles.twist_families(nodes, edges)


@query("""
WITH f AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) || '/' || p_type AS pile_id, p_partkey AS s, p_partkey + p_size + 1 AS e FROM part),
t AS (SELECT pile_id, s, e, unnest(range(s + 1, e)) AS pos FROM f WHERE e - s > 1),
h AS (SELECT pile_id, pos, least(pos - s, e - pos) AS height, row_number() OVER (PARTITION BY pile_id, pos ORDER BY least(pos - s, e - pos) DESC) AS k FROM t)
SELECT pile_id, pos, CAST(k AS INTEGER) AS k, height FROM h""")
def pile_landscape(spark, sf_dir):
    return piles.landscape(_small_piles(spark, sf_dir))


@query("""
WITH f AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) || '/' || p_type AS pile_id, p_partkey AS s, p_partkey + p_size + 1 AS e FROM part),
t AS (SELECT pile_id, s, e, unnest(range(s + 1, e)) AS pos FROM f WHERE e - s > 1),
h AS (SELECT pile_id, pos, least(pos - s, e - pos) AS height, row_number() OVER (PARTITION BY pile_id, pos ORDER BY least(pos - s, e - pos) DESC) AS k FROM t),
n AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 THEN lag(height) OVER w ELSE 0 END AS a, CASE WHEN lead(pos) OVER w = pos + 1 THEN lead(height) OVER w ELSE 0 END AS b,
  pos = min(pos) OVER (PARTITION BY pile_id) OR pos = max(pos) OVER (PARTITION BY pile_id) AS edge FROM h WINDOW w AS (PARTITION BY pile_id, k ORDER BY pos))
SELECT pile_id, pos, CAST(k AS INTEGER) AS k, height, CASE WHEN height = 0 AND a + b > 0 OR edge AND height > 0 OR height <= a AND height < b OR height < a AND height <= b THEN CASE WHEN height <> 0 THEN -1.0::DOUBLE / height ELSE -1.0 END
  WHEN height >= a AND height > b OR height > a AND height >= b THEN 1.0 ELSE 0.0 END AS delta FROM n""")
def pile_landscape_features(spark, sf_dir):
    return piles.landscape_features(piles.landscape(_small_piles(spark, sf_dir)))


@query(f"""
WITH RECURSIVE {FAMILIES}, near AS (SELECT DISTINCT a.family_id AS src, b.family_id AS dst FROM families a JOIN families b ON a.contig = b.contig AND a.file_id < b.file_id AND a.start < b."end" AND b.start < a."end"
  AND ((a.start - b.start) ** 2 + (a."end" - b."end") ** 2) < 0.5 * ((greatest(a."end", b."end") - least(a.start, b.start)) / 4.0::DOUBLE) ** 2),
{LABELS.format(edges='near', rounds=30)}
SELECT DISTINCT component, contig, start, "end" FROM families JOIN label ON node = family_id""")
def family_merged(spark, sf_dir):
    members = families(spark, sf_dir)
    return piles.merged_families(members, piles.stitch(members, 0.5, width=32))


# families of three files: a brand's parts of known strand, in blocks of 64 part numbers
STITCHED = f"""parts AS (SELECT * REPLACE (family_id * 10000000 + (ord // 64) * 3 + file_id AS family_id) FROM families WHERE strand <> 0),
pairs AS (SELECT a.family_id AS src, b.family_id AS dst, a.strand * b.strand AS twist, a.ord AS x, b.ord AS y FROM parts a JOIN parts b ON a.contig = b.contig AND a.file_id < b.file_id AND a.start < b."end" AND b.start < a."end"
  AND ((a.start - b.start) ** 2 + (a."end" - b."end") ** 2) < 0.1::DOUBLE * ((greatest(a."end", b."end") - least(a.start, b.start)) / 4.0::DOUBLE) ** 2),
twisted AS (SELECT src, dst, arg_min(twist, (x, y)) AS twist, count(*) AS n, count(*) FILTER (twist = 1) AS plus FROM pairs GROUP BY 1, 2),
{_doubled('twisted', 40)},
whole AS (SELECT node, min(component) AS component FROM side GROUP BY 1),
signs AS (SELECT w.node, w.component, s.strand AS sign FROM whole w LEFT JOIN signed s USING (node, component)),
places AS (SELECT component, contig, start, "end", CASE WHEN min(coalesce(strand * sign, 0)) = max(coalesce(strand * sign, 0)) THEN min(coalesce(strand * sign, 0)) ELSE 0 END AS strand FROM parts JOIN signs ON node = family_id GROUP BY 1, 2, 3, 4)"""


def _stitched(spark, sf_dir):
    block = F.col("family_id") * 10_000_000 + F.floor(F.col("ord") / 64) * 3 + F.col("file_id")
    members = families(spark, sf_dir).filter("strand <> 0").withColumn("family_id", block)
    return piles.stitched_families(members, ordered.written(piles.stitch(members, 0.1, width=32), "links"))


@query(f"""
WITH RECURSIVE {FAMILIES}, {STITCHED}, n AS (SELECT component, count(*) AS n_families, count(sign) = count(*) AS oriented FROM signs GROUP BY 1), m AS (SELECT component, count(*) AS n_members FROM places GROUP BY 1),
b AS (SELECT component, CAST(sum(CASE twist WHEN 1 THEN n - plus ELSE plus END) AS BIGINT) AS n_bad FROM twisted JOIN whole ON node = src GROUP BY 1)
SELECT component, n_families, n_members, n_bad, oriented FROM n JOIN m USING (component) JOIN b USING (component)""")
def family_stitched_components(spark, sf_dir):
    return _stitched(spark, sf_dir)[0]


@query(f'WITH RECURSIVE {FAMILIES}, {STITCHED} SELECT component, contig, start, "end", CAST(strand AS INTEGER) AS strand FROM places')
def family_stitched_members(spark, sf_dir):
    return _stitched(spark, sf_dir)[1]


@query(f"WITH {MATRIX} SELECT j AS i, i AS j, v FROM matrix")
def matrix_transpose(spark, sf_dir):
    return matrix.transpose(matrix_view(spark, sf_dir))


@query(f"WITH {MATRIX} SELECT CAST(count(DISTINCT i) AS BIGINT) AS rows, CAST(count(DISTINCT j) AS BIGINT) AS cols, CAST(count(*) FILTER (v <> 0) AS BIGINT) AS nonzero, round(count(*) FILTER (v <> 0) / (count(DISTINCT i) * count(DISTINCT j)), 9) AS density FROM matrix")
def matrix_density(spark, sf_dir):
    return matrix.density(matrix_view(spark, sf_dir)).withColumn("density", F.round("density", 9))


@query(f"WITH {MATRIX} SELECT round(sqrt(sum(v * v)) / 1000, 3) AS norm FROM matrix")
def matrix_norm(spark, sf_dir):
    return matrix.norm(matrix_view(spark, sf_dir)).select(F.round(F.col("norm") / 1000, 3).alias("norm"))


@query()
def matrix_runs(spark, sf_dir):
    """Three factorisations from different starts, side by side, each with its error and whether it is the best."""
    w, h, errors = matrix.replicated(matrix_view(spark, sf_dir), k=3, runs=3, rounds=1000, tolerance=0.05)
    best = matrix.best_run(w, h, errors, 3)[2]
    ends = spark.createDataFrame([(r, len(e), e[-1], r == best) for r, e in enumerate(errors)], "run int, rounds int, error double, best boolean")
    return matrix.run_table(w, "i", 3).join(ends, "run")  # a row for each run


@query()
def matrix_factors(spark, sf_dir):
    w, _, _ = matrix.factorise(matrix_view(spark, sf_dir), k=3, rounds=1000, tolerance=0.01)
    return matrix.pattern_weights(w, "i")


@query()
def alignment_seeds(spark, sf_dir):
    return alignments.hits(dna(spark, sf_dir).select("id", "seq"), k=16, least=24)


@query(f"""
WITH RECURSIVE {DNA}, sides AS (SELECT id, 1 AS strand, seq FROM dna UNION ALL SELECT id, -1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM dna),
k AS (SELECT id, strand, i AS pos, CASE strand WHEN 1 THEN i ELSE length(seq) - 16 - i END AS fwd, substring(seq, i + 1, 16) AS kmer FROM (SELECT id, strand, seq, unnest(range(length(seq) - 15)) AS i FROM sides WHERE length(seq) >= 16)),
m AS (SELECT t.id AS t_id, q.id AS q_id, q.strand, CAST(floor((t.pos - q.pos) / 32.0) AS BIGINT) AS cell, q.pos AS q_pos FROM k t JOIN k q USING (kmer) WHERE t.strand = 1 AND t.id < q.id),
near AS (SELECT DISTINCT t_id AS src, q_id AS dst FROM (
  SELECT t_id, q_id, strand, cell - b AS band FROM m, (VALUES (0), (1)) AS v(b) GROUP BY ALL HAVING count(DISTINCT q_pos) >= 24)),
{LABELS.format(edges='near', rounds=12)}
SELECT node, component FROM label""")
def alignment_links(spark, sf_dir):
    """Records that local alignment links, directly or through others, under the smallest of their ids."""
    found = alignments.hits(dna(spark, sf_dir).select("id", "seq"), k=16, least=24, reach=None).filter("t_id <> q_id")
    return graphs.components(found.select(F.col("t_id").alias("src"), F.col("q_id").alias("dst")))


@query()
def alignment_hits(spark, sf_dir):
    seqs = dna(spark, sf_dir).select("id", "seq")
    return alignments.local_alignments(alignments.hits(seqs, k=16, least=24), seqs, k=16)
