"""Queries over sequences and k-mers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import kmer_code, oriented, subsequence, wrapped
from ..operators import consensus, kmers, motifs, ordered, piles, references, sequences
from ..sources import formats
from .bindings import DNA, SPANS, dna, spans, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {DNA},
l AS (SELECT length(seq) AS len, count(*) AS n, sum(length(seq) - length(translate(seq, 'GC', ''))) AS gc, sum(length(seq) - length(translate(seq, 'ACGT', ''))) AS acgt FROM dna GROUP BY 1),
w AS (SELECT *, coalesce(sum(len * n) OVER (ORDER BY len DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len * n) OVER () AS total FROM l)
SELECT CAST(sum(n) AS BIGINT) AS n_seqs, CAST(sum(len * n) AS BIGINT) AS size, CAST(min(len) AS BIGINT) AS min_len, CAST(max(len) AS BIGINT) AS max_len,
  round(sum(len * n) / sum(n), 6) AS mean_len, round(sum(gc) / sum(acgt) * 100, 6) AS gc_percent,
  CAST(coalesce(max(CASE WHEN before + len * n >= total / 2 THEN len END), 0) AS BIGINT) AS n50,
  CAST(coalesce(max(CASE WHEN before + len * (n - 1) >= total // 2 AND (before > 0 OR n > 1) THEN len END), 0) AS BIGINT) AS n50_compat
FROM w""")
def seq_stats(spark, sf_dir):
    out = sequences.statistics(dna(spark, sf_dir))
    return out.withColumns({"mean_len": F.round("mean_len", 6), "gc_percent": F.round("gc_percent", 6)})


@query(f"WITH {DNA} SELECT id, CAST(length(seq) AS INTEGER) AS len, length(seq) > 2500 AS strictly FROM dna WHERE length(seq) >= 2500")
def seq_length_filter(spark, sf_dir):
    return sequences.longer_than(dna(spark, sf_dir), 2500, strict=False).select("id", F.length("seq").alias("len"), (F.length("seq") > 2500).alias("strictly"))


@query(f"""
WITH {DNA}, q AS (SELECT id, seq, length(seq) AS n, length(seq) // 500 AS q FROM dna WHERE length(seq) >= 250),
c AS (SELECT *, unnest(CASE WHEN n < 1000 THEN [-1] ELSE range(q) END) AS i FROM q),
p AS (SELECT *, CASE WHEN i < 0 THEN 0 ELSE i * 500 END AS start, CASE WHEN i < 0 OR i = q - 1 THEN n ELSE (i + 1) * 500 END AS stop FROM c)
SELECT CASE WHEN i < 0 THEN CAST(id AS VARCHAR) ELSE id || '_' || start || '-' || stop END AS id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", md5(substring(seq, start + 1, stop - start)) AS digest FROM p""")
def seq_split_windows(spark, sf_dir):
    return sequences.split_windows(dna(spark, sf_dir), window=500, least=250).select("id", "start", "end", F.md5("seq").alias("digest"))


@query(f"""
WITH {DNA}, q AS (SELECT id, seq, length(seq) AS n FROM dna WHERE length(seq) >= 20),
c AS (SELECT *, unnest(CASE WHEN n <= 85 THEN [-1] ELSE range(n // 40) END) AS i FROM q),
p AS (SELECT *, CASE WHEN i < 0 THEN 5 ELSE i * 40 END AS start, CASE WHEN i < 0 THEN n ELSE (i + 1) * 40 END AS stop FROM c)
SELECT id, CAST(count(*) AS BIGINT) AS n, CAST(sum(stop - start) AS BIGINT) AS letters, min(substring(seq, start + 1, stop - start)) AS first FROM p GROUP BY id""")
def seq_fragments(spark, sf_dir):
    return sequences.fragments(dna(spark, sf_dir), 40).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("letters"), F.min("seq").alias("first"))


@query(f"""
WITH {DNA}, s AS (SELECT id, seq, length(seq) // 4 AS s, length(seq) // 2 AS e, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS strand FROM dna)
SELECT id, strand, md5(CASE WHEN strand = -1 THEN reverse(translate(substring(seq, s + 1, e - s), 'ACGTacgt', 'TGCAtgca')) ELSE substring(seq, s + 1, e - s) END) AS digest,
  CAST(length(seq) - e AS BIGINT) AS turned_offset FROM s""")
def seq_subsequences(spark, sf_dir):
    n = F.length("seq")
    s, e = F.floor(n / 4), F.floor(n / 2)
    rows = dna(spark, sf_dir).withColumns({"s": s, "e": e, "strand": F.when(F.col("id") % 2 == 0, 1).otherwise(-1)})
    return rows.select("id", "strand", F.md5(oriented(subsequence("seq", F.col("s"), F.col("e")), F.col("strand"))).alias("digest"), (n - F.col("e")).cast("long").alias("turned_offset"))


@query(f"""
WITH RECURSIVE {DNA}, o AS (SELECT id, length(seq) AS len, row_number() OVER (ORDER BY id) AS k FROM dna WHERE length(seq) >= 500),
w(k, id, len, held, bundle) AS (
  SELECT k, id, len, len, 0 FROM o WHERE k = 1
  UNION ALL
  SELECT o.k, o.id, o.len, CASE WHEN w.held <> 0 AND w.held + o.len > 50000 THEN o.len ELSE w.held + o.len END, CASE WHEN w.held <> 0 AND w.held + o.len > 50000 THEN w.bundle + 1 ELSE w.bundle END
  FROM w JOIN o ON o.k = w.k + 1)
SELECT id, CAST(len AS INTEGER) AS len, CAST(bundle AS BIGINT) AS bundle FROM w""")
def seq_bundles(spark, sf_dir):
    rows = dna(spark, sf_dir).select("id", F.length("seq").alias("len")).filter("len >= 500")
    return ordered.greedy_bundles(rows, "len", 50_000, "id")


@query(f"""
WITH {DNA} SELECT id, CAST(coalesce(sum(length(seq)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", md5(seq) AS digest FROM dna""")
def seq_packed_offsets(spark, sf_dir):
    rows = dna(spark, sf_dir).select("id", F.length("seq").alias("len"), F.md5("seq").alias("digest"))
    return ordered.running_total(rows, "len", "id", name="offset").select("id", "offset", "digest")


@query(f"""
WITH {DNA}, t AS (SELECT id, coalesce(sum(length(seq)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(seq) AS n FROM dna)
SELECT event_id * 101 AS place, id, CAST(event_id * 101 - a AS BIGINT) AS pos FROM events JOIN t ON event_id * 101 >= a AND event_id * 101 < a + n""")
def packed_places(spark, sf_dir):
    """Every event's number, times 101, as a place of the packed documents."""
    lengths = dna(spark, sf_dir).select("id", F.length("seq").alias("len"))
    return references.packed_places(table(spark, sf_dir, "events").select((F.col("event_id") * 101).alias("place")), lengths)


@query(f"""
WITH {DNA} SELECT id, array_to_string(list_transform(range((length(seq) + 59) // 60), lambda i: substring(seq, i * 60 + 1, 60)), chr(10)) AS lines,
  rpad(substring(CAST(id AS VARCHAR), 1, 10), 10, ' ') AS name FROM dna""")
def seq_wrapped_lines(spark, sf_dir):
    return dna(spark, sf_dir).select("id", wrapped("seq", 60).alias("lines"), F.rpad(F.col("id").cast("string"), 10, " ").alias("name"))


@query(f"""
WITH {DNA}, a AS (SELECT id || '_' || i AS id, substring(seq, i * 60 + 1, 60) AS seq FROM (SELECT id, seq, unnest(range(length(seq) // 60)) AS i FROM dna))
SELECT 0 AS kind, '' AS id, count(*) || ' 60' AS line FROM a UNION ALL SELECT 1, id, rpad(substring(id, 1, 10), 10, ' ') || seq FROM a""")
def seq_phylip(spark, sf_dir):
    cut = kmers.windows(dna(spark, sf_dir), 60)
    return sequences.phylip(cut.select(F.concat_ws("_", F.col("id").cast("string"), F.floor(F.col("start") / 60).cast("string")).alias("id"), "seq"))


@query(f"WITH {DNA} SELECT id, CAST(length(seq) AS INTEGER) AS len, md5(seq) AS digest FROM dna WHERE id = (SELECT min(id) FROM dna)")
def seq_first_record(spark, sf_dir):
    return sequences.first_record(dna(spark, sf_dir), "id").select("id", F.length("seq").alias("len"), F.md5("seq").alias("digest"))


@query(f"""
WITH {DNA}, k AS (SELECT id, unnest(list_transform(range(length(seq) - 3), lambda i: substring(seq, i + 1, 4))) AS kmer FROM dna WHERE length(seq) >= 4)
SELECT id, kmer, CAST(count(*) AS BIGINT) AS n, CAST(list_sum(list_transform(range(4), lambda i: (instr('ACGT', substring(kmer, i + 1, 1)) - 1) * CAST(4 ** (3 - i) AS BIGINT))) AS BIGINT) AS code FROM k GROUP BY id, kmer""")
def kmer_counts(spark, sf_dir):
    return kmers.counts(dna(spark, sf_dir), 4).withColumn("code", kmer_code("kmer"))


@query(f"""
WITH {DNA}, k AS (SELECT id, unnest(list_transform(range(length(seq) - 3), lambda i: substring(seq, i + 1, 4))) AS kmer FROM dna WHERE length(seq) >= 4),
c AS (SELECT id, kmer, count(*) AS n FROM k GROUP BY id, kmer),
r AS (SELECT id, kmer, n, sum(n) OVER (PARTITION BY id ORDER BY n, kmer ROWS UNBOUNDED PRECEDING) AS r, sum(n) OVER (PARTITION BY id) AS total, lag(n) OVER (PARTITION BY id ORDER BY n, kmer) AS c_lo FROM c),
t AS (SELECT *, floor(total * 0.95) AS t, r - n AS r_lo FROM r),
p AS (SELECT id, min(CASE WHEN r = t OR c_lo IS NULL THEN n ELSE (c_lo * (r - t) + n * (t - r_lo)) / n END) AS pct FROM t WHERE (r >= t AND r_lo < t) OR (c_lo IS NULL AND t <= r) GROUP BY id)
SELECT id, CAST(sum(n) AS BIGINT) AS n_kmers, CAST(count(*) AS BIGINT) AS distinct_kmers, round(avg(n) / sum(n), 9) AS mean, round(stddev_samp(n) / sum(n), 9) AS stdev, round(any_value(pct) / sum(n), 9) AS percentile
FROM c JOIN p USING (id) GROUP BY id""")
def kmer_statistics(spark, sf_dir):
    out = kmers.count_statistics(kmers.counts(dna(spark, sf_dir), 4), 4)
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "stdev", "percentile")})


@query(f"""
WITH {DNA}, k AS (SELECT id, unnest(list_transform(range(length(seq) - 3), lambda i: substring(seq, i + 1, 4))) AS kmer FROM dna WHERE length(seq) >= 4),
c AS (SELECT id, kmer, count(*) AS n FROM k GROUP BY id, kmer)
SELECT id, round(sum(n) / 256 / sum(n), 9) AS mean, round(sqrt((sum(n * n) - sum(n) * sum(n) / 256) / 255) / sum(n), 9) AS stdev FROM c GROUP BY id""")
def kmer_statistics_filled(spark, sf_dir):
    out = kmers.count_statistics(kmers.counts(dna(spark, sf_dir), 4), 4, fill=True)
    return out.select("id", F.round("mean", 9).alias("mean"), F.round("stdev", 9).alias("stdev"))


@query(f"""
WITH {DNA}, w AS (SELECT id, i * 400 AS start, substring(seq, i * 400 + 1, 400) AS seq FROM (SELECT id, seq, unnest(range(length(seq) // 400)) AS i FROM dna)),
wk AS (SELECT id, start, unnest(list_transform(range(398), lambda i: substring(seq, i + 1, 3))) AS kmer FROM w),
wf AS (SELECT id, start, kmer, count(*) / 398.0 AS f FROM wk GROUP BY 1, 2, 3),
dk AS (SELECT id, unnest(list_transform(range(length(seq) - 2), lambda i: substring(seq, i + 1, 3))) AS kmer FROM dna WHERE length(seq) >= 400),
df AS (SELECT id, kmer, count(*) / sum(count(*)) OVER (PARTITION BY id) AS f FROM dk GROUP BY 1, 2),
s AS (SELECT DISTINCT id, start FROM w),
g AS (SELECT s.id, s.start, df.kmer, df.f - coalesce(wf.f, 0) AS d FROM s JOIN df USING (id) LEFT JOIN wf ON wf.id = s.id AND wf.start = s.start AND wf.kmer = df.kmer)
SELECT id, start, round(sqrt(sum(d * d)), 6) AS distance FROM g GROUP BY id, start""")
def kmer_window_drift(spark, sf_dir):
    rows = dna(spark, sf_dir)
    cut = kmers.windows(rows, 400)
    own = kmers.counts(cut.withColumn("id", F.struct("id", "start")), 3)
    own = kmers.frequencies(own).select("id.id", "id.start", "kmer", "freq")
    whole = kmers.frequencies(kmers.counts(rows.filter(F.length("seq") >= 400), 3)).select("id", "kmer", "freq")
    all_ = cut.select("id", "start").join(whole, "id")
    return kmers.euclidean(all_, own, "id", "start").withColumn("distance", F.round("distance", 6))


@query(f"""
WITH {DNA}, k AS (SELECT id, unnest(list_transform(range(length(seq) - 5), lambda i: substring(seq, i + 1, 6))) AS kmer FROM dna WHERE length(seq) >= 6)
SELECT kmer, CAST(count(DISTINCT id) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY kmer HAVING count(DISTINCT id) >= 2 AND count(DISTINCT id) / (SELECT count(*) FROM dna) <= 0.5""")
def kmer_document_band(spark, sf_dir):
    rows = dna(spark, sf_dir)
    return kmers.in_band(kmers.counts(rows, 6), rows.count(), low=2, high=0.5)


@query(f"""
WITH {DNA}, k AS (SELECT id, i AS pos, substring(seq, i + 1, 3) AS kmer FROM (SELECT id, seq, unnest(range(length(seq) - 2)) AS i FROM dna WHERE length(seq) >= 3)),
e AS (SELECT kmer, pos, count(DISTINCT id) AS n_docs, count(*) AS n FROM k GROUP BY 1, 2),
f AS (SELECT kmer FROM e GROUP BY kmer HAVING sum(n) >= 2 AND sum(n) / (SELECT max(pos) FROM k) <= 100)
SELECT kmer, CAST(pos AS INTEGER) AS pos, CAST(n_docs AS BIGINT) AS n_docs FROM e JOIN f USING (kmer) WHERE n_docs >= 2""")
def kmer_position_matrix(spark, sf_dir):
    return kmers.position_matrix(kmers.place_counts(dna(spark, sf_dir), 3), low=2, high=100.0)


@query(f"""
WITH {DNA}, k AS (SELECT unnest(list_transform(range(length(seq) - 2), lambda i: substring(seq, i + 1, 3))) AS kmer FROM dna WHERE length(seq) >= 3),
c AS (SELECT kmer, count(*) AS n FROM k GROUP BY 1)
SELECT kmer, CAST(n AS BIGINT) AS n,
 CAST(list_sum(list_transform(range(3), lambda i: CASE WHEN substring(kmer, i + 1, 1) IN ('G', 'T') THEN 2 ** (2 - i) ELSE 0 END)) AS INTEGER) AS x,
 CAST(list_sum(list_transform(range(3), lambda i: CASE WHEN substring(kmer, i + 1, 1) IN ('C', 'G') THEN 2 ** (2 - i) ELSE 0 END)) AS INTEGER) AS y FROM c""")
def kmer_chaos_cells(spark, sf_dir):
    found = kmers.counts(dna(spark, sf_dir), 3).groupBy("kmer").agg(F.sum("n").alias("n"))
    return kmers.chaos_cells(found, 3)


PWM = [[0.8, 0.1, 0.05, 0.05], [0.1, 0.7, 0.1, 0.1], [0.05, 0.05, 0.8, 0.1], [0.1, 0.1, 0.1, 0.7], [0.9, 0.0, 0.05, 0.05], [0.25, 0.25, 0.25, 0.25]]


def _score(rows) -> str:
    top = sum(max(r) for r in PWM)
    return "round((" + " + ".join(f"CASE substring(w, {p + 1}, 1) WHEN 'A' THEN {r[0]}::DOUBLE WHEN 'C' THEN {r[1]}::DOUBLE WHEN 'G' THEN {r[2]}::DOUBLE WHEN 'T' THEN {r[3]}::DOUBLE ELSE 0 END" for p, r in enumerate(rows)) + f") / {top}::DOUBLE, 9)"


@query(f"""
WITH {DNA}, w AS (SELECT id, i AS start, substring(seq, i + 1, 6) AS w FROM (SELECT id, seq, unnest(range(length(seq) - 5)) AS i FROM dna WHERE length(seq) >= 6)),
h AS (SELECT id, start, 1 AS strand, {_score(PWM)} AS score, w AS word FROM w UNION ALL SELECT id, start, -1, {_score([[r[3], r[2], r[1], r[0]] for r in reversed(PWM)])}, reverse(translate(w, 'ACGT', 'TGCA')) FROM w)
SELECT id, CAST(start AS BIGINT) AS start, CAST(start + 6 AS BIGINT) AS "end", strand, score, word FROM h WHERE score >= 0.9""")
def pwm_scan(spark, sf_dir):
    return motifs.scan(dna(spark, sf_dir), PWM, 0.9)


@query(f"""
WITH {DNA}, b AS (SELECT i AS pos, substring(seq, i + 1, 1) AS b FROM (SELECT seq, unnest(range(length(seq))) AS i FROM dna))
SELECT CAST(pos AS INTEGER) AS pos, CAST(count(*) FILTER (b = 'A') AS BIGINT) AS A, CAST(count(*) FILTER (b = 'C') AS BIGINT) AS C, CAST(count(*) FILTER (b = 'G') AS BIGINT) AS G, CAST(count(*) FILTER (b = 'T') AS BIGINT) AS T FROM b GROUP BY 1""")
def pwm_column_counts(spark, sf_dir):
    return motifs.column_counts(dna(spark, sf_dir))


@query(f"""
WITH {DNA}, b AS (SELECT source AS family_id, i AS pos, substring(seq, i + 1, 1) AS letter FROM (SELECT source, seq, unnest(range(length(seq))) AS i FROM dna)),
c AS (SELECT family_id, pos, letter, count(*) AS n FROM b GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY family_id, pos ORDER BY n DESC, letter) AS k, sum(n) OVER (PARTITION BY family_id, pos) AS depth FROM c)
SELECT family_id, CAST(pos AS INTEGER) AS pos, letter, CAST(least(93, floor(-10 * log10(1 - n / (depth + 1.0::DOUBLE)))) AS INTEGER) AS quality, CAST(depth AS BIGINT) AS depth,
  CASE WHEN least(93, floor(-10 * log10(1 - n / (depth + 1.0::DOUBLE)))) >= 3 THEN letter ELSE lower(letter) END AS shown FROM r WHERE k = 1""")
def family_consensus(spark, sf_dir):
    return sequences.consensus(dna(spark, sf_dir).withColumnRenamed("source", "family_id"), least_quality=3)


def _order_members(spark, sf_dir):
    """A nation's customers as members of a family: a letter for the priority of each order, as they came."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    letter = F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ACGTN")
    each = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", letter.alias("letter")))).alias("at"))
    return each.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("family_id"), F.array_join(F.transform("at", lambda x: x["letter"]), "").alias("seq"))


@query()
def family_aligned_consensus(spark, sf_dir):
    """Members differ in length; they are aligned with their family's centre first."""
    return consensus.aligned_consensus(_order_members(spark, sf_dir), least_quality=3, k=4)


@query()
def family_consensus_fastq(spark, sf_dir):
    return consensus.fastq(consensus.aligned_consensus(_order_members(spark, sf_dir), least_quality=3, k=4))


def _members(spark, sf_dir):
    """Documents as members of their source's family, each as long as its sequence."""
    return dna(spark, sf_dir).select(F.col("source").alias("family_id"), F.col("id").alias("ord"), F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"))


@query(f"""
WITH {DNA}, m AS (SELECT source, id, length(seq) AS len, max(length(seq)) OVER (PARTITION BY source) AS longest FROM dna),
s AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY md5('7-' || id), id) AS n FROM m WHERE len >= floor(longest * 0.1)) SELECT source, id, CAST(n AS INTEGER) AS n FROM s WHERE n <= 5""")
def family_sample(spark, sf_dir):
    """Five long members of each family by a seeded hash: a limit that is the operator's own."""
    return piles.sampled_members(_members(spark, sf_dir), 5, 0.1, 7).select(F.col("family_id").alias("source"), F.col("ord").alias("id"), "n")


@query(f"""
WITH {DNA}, m AS (SELECT source, id, length(seq) AS len, max(length(seq)) OVER (PARTITION BY source) AS longest, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS member FROM dna)
SELECT source, id, CAST(len AS INTEGER) AS len, CAST(member AS INTEGER) AS member, 'family' || printf('%06d', CAST(substring(source, 4) AS INTEGER)) || '_member' || printf('%04d', member) AS name FROM m WHERE len >= floor(longest * 0.1)""")
def family_long_members(spark, sf_dir):
    found = piles.long_members(_members(spark, sf_dir), 0.1)
    name = piles.member_name(F.substring("family_id", 4, 9).cast("int"), F.col("member"))
    return found.select(F.col("family_id").alias("source"), F.col("ord").alias("id"), F.col("len").cast("int").alias("len"), "member", name.alias("name"))


@query("""
WITH s AS (SELECT event_id, user_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh, ts FROM events)
SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM s""")
def consecutive_runs(spark, sf_dir):
    return sequences.runs_of_equal(table(spark, sf_dir, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "run")


@query(f"""
WITH {DNA} SELECT id, 'chr' || (id % 7) AS chr, CAST(id * 100 AS BIGINT) AS "offset", CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS strand, CAST(length(seq) AS INTEGER) AS len FROM dna""")
def fasta_header_ranges(spark, sf_dir):
    n = F.col("id").cast("string")
    descr = F.concat(F.lit("range=chr"), (F.col("id") % 7).cast("string"), F.lit(":"), (F.col("id") * 100 + 1).cast("string"), F.lit("-"), (F.col("id") * 100 + F.length("seq")).cast("string"), F.lit(" 5'pad=0 strand="), F.when(F.col("id") % 2 == 0, "+").otherwise("-"), F.lit(" n="), n)
    rows = dna(spark, sf_dir).withColumn("descr", descr)
    return formats.located(rows).select("id", "chr", "offset", "strand", F.length("seq").alias("len"))




@query(f"""
WITH {DNA}, k AS (SELECT id, unnest(list_transform(range(length(seq) - 2), lambda i: substring(seq, i + 1, 3))) AS kmer FROM dna WHERE length(seq) >= 3),
c AS (SELECT id, kmer, count(*) AS n FROM k GROUP BY 1, 2), f AS (SELECT kmer, n / sum(n) OVER (PARTITION BY id) AS freq FROM c)
SELECT kmer, round(sum(freq), 6) AS weight FROM f GROUP BY 1""")
def kmer_total_weights(spark, sf_dir):
    return kmers.total_weights(kmers.counts(dna(spark, sf_dir), 3)).withColumn("weight", F.round("weight", 6))


@query(f"""
WITH {DNA}, k AS (SELECT id, unnest(list_transform(range(length(seq) - 5), lambda i: substring(seq, i + 1, 6))) AS kmer FROM dna WHERE length(seq) >= 6),
c AS (SELECT id, kmer, count(*) AS n FROM k GROUP BY 1, 2), b AS (SELECT kmer FROM c GROUP BY 1 HAVING count(*) >= 2 AND count(*) / (SELECT count(*) FROM dna) <= 0.5),
f AS (SELECT kmer, id, n / sum(n) OVER (PARTITION BY id) AS freq FROM c)
SELECT kmer AS i, id AS j, round(freq, 9) AS v FROM f WHERE kmer IN (SELECT kmer FROM b)""")
def kmer_sequence_matrix(spark, sf_dir):
    rows = dna(spark, sf_dir)
    return kmers.sequence_matrix(kmers.counts(rows, 6), rows.count(), low=2, high=0.5).withColumn("v", F.round("v", 9))


def _placed(spark, sf_dir):
    """Line items as features on the sequences whose number their supplier has."""
    return spans(spark, sf_dir).select(F.col("id").alias("feature_id"), "contig", "start", "end", "strand", F.col("order").alias("family_id"), F.col("line").alias("ord"))


PLACED = f"""{DNA}, {SPANS}, f AS (SELECT s.*, CASE WHEN strand = -1 THEN reverse(translate(substring(seq, s.start + 1, s."end" - s.start), 'ACGTacgt', 'TGCAtgca')) ELSE substring(seq, s.start + 1, s."end" - s.start) END AS part FROM spans s JOIN dna d ON d.id = s.contig)"""


@query(f"WITH {PLACED} SELECT id AS feature_id, contig, start, \"end\", strand, part AS seq FROM f")
def feature_sequences(spark, sf_dir):
    found = references.extracted(_placed(spark, sf_dir), dna(spark, sf_dir), width=1000)
    return found.select("feature_id", "contig", "start", "end", "strand", "seq")


@query(f"""
WITH {PLACED}, m AS (SELECT *, "end" - start AS len, max("end" - start) OVER w AS longest, count(*) OVER w AS n, row_number() OVER (PARTITION BY "order" ORDER BY line, id, contig, start, "end") - 1 AS member FROM f WINDOW w AS (PARTITION BY "order")),
v AS (SELECT *, count(*) FILTER (len >= floor(longest * 0.5)) OVER (PARTITION BY "order") AS valid FROM m)
SELECT id AS feature_id, '>family' || printf('%06d', "order") || '_member' || printf('%04d', member) || ' ' || contig || ':' || start || '-' || "end" || ' ' || CASE strand WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '.' END || ' (' || n || ' members - ' || valid || ' members within 0.50 of maximum length)' || CASE WHEN part = '' THEN '' ELSE chr(10) || array_to_string(list_transform(range((length(part) + 59) // 60), lambda i: substring(part, i * 60 + 1, 60)), chr(10)) END AS value
FROM v WHERE len >= floor(longest * 0.5)""")
def family_fasta_lines(spark, sf_dir):
    found = references.extracted(_placed(spark, sf_dir), dna(spark, sf_dir), width=1000)
    return references.member_records(found, 0.5).select("feature_id", formats.record_text(60).alias("value"))


@query(f"""
WITH {DNA}, r AS (SELECT id, length(seq) // 3 AS a, length(seq) AS n, md5(reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))) AS turned, md5(reverse(seq)) AS reversed FROM dna)
SELECT id, CAST(n - a AS BIGINT) AS turned_offset, turned, reversed FROM r""")
def seq_reversed(spark, sf_dir):
    rows = dna(spark, sf_dir).select("id", "seq", F.floor(F.length("seq") / 3).cast("long").alias("end"), F.length("seq").cast("long").alias("len"))
    turned = references.reversed_segments(rows, complement=True).withColumn("digest", F.md5("seq"))
    plain = references.reversed_segments(rows, complement=False).select("id", F.md5("seq").alias("reversed"))
    return turned.join(plain, "id").select("id", F.col("start").alias("turned_offset"), F.col("digest").alias("turned"), "reversed")


@query(f"""
WITH {DNA}, t AS (SELECT id, '>a' || id || ' first' || chr(10) || seq || chr(10) || '>b' || id || chr(10) || substring(seq, 1, length(seq) // 2) || chr(10) AS text, seq FROM dna)
SELECT id, 'a' || id AS name, 'first' AS descr, md5(seq) AS digest FROM t UNION ALL SELECT id, 'b' || id, '', md5(substring(seq, 1, length(seq) // 2)) FROM t""")
def fasta_literal(spark, sf_dir):
    n = F.col("id").cast("string")
    text = F.concat(F.lit(">a"), n, F.lit(" first\n"), wrapped("seq", 60), F.lit("\n>b"), n, F.lit("\n"), wrapped(F.expr("left(seq, length(seq) div 2)"), 60), F.lit("\n"))
    return formats.literal_fasta(dna(spark, sf_dir).select("id", text.alias("text")), "text", "id").select("id", F.col("name"), "descr", F.md5("seq").alias("digest"))
