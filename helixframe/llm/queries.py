"""Queries over the synthetic tables, one for each operator, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, common, decontaminate, html_text, jaccard, langid, mixing, packing, quality, repeats, resampling, sharding, topk, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_rows(spark, 500)
    folder = common.scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, payloads=False).drop("url")


def op2_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_rows(spark, 1000)
    docs = table(spark, sf_dir, "documents")
    held_out = quality.held_out("doc_id", 4, 2)
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), percent=75, words=5)


def op5_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_rows(spark, 500)
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), threshold=50)


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_rows(spark, 1000)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.held_out("doc_id", 5, 0)
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.join(labels, "doc_id"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_rows(spark, 1000)
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_rows(spark, 1000)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op10_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_rollup_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_rows(spark, 1000)
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=5, least=100, covered=100, first=2000)


def op12_apportioned_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=150, most=2)


def op13_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_rows(spark, 1000)
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, percent=10, shortest=20, seed=2024)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, lower(sha1(b)) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM g
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
near AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
step(turn, u, root) AS (SELECT 0, u, u FROM (SELECT DISTINCT u FROM near) UNION ALL
  SELECT turn + 1, u, root FROM (SELECT any_value(m.turn) AS turn, near.u AS u, min(m.root) AS root FROM near JOIN step m ON m.u = near.v GROUP BY near.u) WHERE turn < 40),
label AS (SELECT u AS doc_id, min(root) AS root FROM step GROUP BY u)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN label USING (doc_id)
"""

REPEATS_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
t AS (SELECT doc_id, c, substring(x, 1000 * c + 1, 1098) AS y FROM (SELECT doc_id, x, unnest(range((length(x) + 999) // 1000)) AS c FROM h)),
w AS (SELECT doc_id, 500 * c + j AS i, substring(y, 2 * j + 1, 100) AS s FROM (SELECT doc_id, c, y, unnest(range(length(y) // 2 - 49)) AS j FROM t WHERE length(y) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE doc_id > first),
r AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS kept_from FROM u),
c AS (SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY run) AS kept FROM k JOIN h USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN c USING (doc_id)
"""

COLLOCATIONS_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
c AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
a AS (SELECT lang, k, string_split(phrase, ' ') AS ws, phrase, f AS a FROM c WHERE k > 1 AND f >= 100),
s AS (
  SELECT a.lang, a.phrase, a.a, l.f AS l, r.f AS r, CAST(n.n AS HUGEINT) AS n, j,
         (1000 * CAST(a.a AS HUGEINT) * CAST(n.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM a) a
  JOIN c l ON l.lang = a.lang AND l.phrase = array_to_string(ws[1:j], ' ')
  JOIN c r ON r.lang = a.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')
  JOIN n ON n.lang = a.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM a), (SELECT unnest(range(2, 5)) AS m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
WHERE rank <= 2000
"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size, md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, sum(size) AS source_size, count(*) AS many, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS number FROM d GROUP BY source),
t AS (SELECT *, CAST([5, 2, 1][1 + (number - 1) % 3] AS DOUBLE) AS weight, 2 * source_size AS most FROM s),
u AS (
  SELECT *, (sum(source_size) OVER () * 150 / 100.0 - coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
v AS (SELECT *, least(CAST(most AS DOUBLE), weight * coalesce(min(CASE WHEN level * weight <= most THEN level END) OVER (), CAST('inf' AS DOUBLE))) AS target FROM u),
seats AS (SELECT *, floor(sum(target) OVER () / 16 + 0.5) AS seats, greatest(1, CAST(ceil((source_size + many) / 1000000.0) AS BIGINT)) AS shards FROM v),
q AS (
  SELECT number, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, number, k) AS place, seats
  FROM (SELECT *, unnest(range(0, CAST(ceil(target / 16 + 2) AS BIGINT))) AS k FROM seats)),
blocks AS (SELECT number, count(*) AS blocks FROM q WHERE place <= seats GROUP BY number),
e AS (SELECT d.*, number, source_size, target, coalesce(blocks, 0) AS blocks, CAST('0x' || key[1:8] AS BIGINT) % shards AS shard
  FROM d JOIN seats ON d.source IS NOT DISTINCT FROM seats.source LEFT JOIN blocks USING (number)),
h AS (SELECT number, shard, blocks, sum(size) AS words FROM e GROUP BY ALL),
g AS (
  SELECT number, shard, row_number() OVER (PARTITION BY number ORDER BY words / (2 * k + 1) DESC, shard, k) AS place, blocks
  FROM (SELECT *, unnest(range(0, CAST(ceil(words / 8 + 2) AS BIGINT))) AS k FROM h)),
quota AS (SELECT number, shard, count(*) AS quota FROM g WHERE place <= blocks GROUP BY ALL),
m AS (
  SELECT e.*, words, least(16 * coalesce(quota, 0), 2 * words) AS out, sum(size) OVER (PARTITION BY number, shard ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM e JOIN h USING (number, shard) LEFT JOIN quota USING (number, shard))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (out // words) * size + greatest(0, least(size, out % words - before)) END AS BIGINT) AS taken
FROM m
"""

RESAMPLING_SQL = r"""
WITH byte AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS no, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT no, word, count(*) AS n FROM (SELECT no, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
spelled AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
bucket AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))), lambda c, v: xor(t[1 + (xor(c, v) & 255)], c >> 8)), 4294967295) % 10000 AS bucket
  FROM spelled, byte),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN bucket USING (word) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN bucket USING (word) GROUP BY 1),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM dw) + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM bw) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
g AS (SELECT no, sum(n * gain) AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY no),
c AS (
  SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM d LEFT JOIN g USING (no)),
f AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id, n_features) AS rank FROM f)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND rank <= (SELECT 10 * count(*) // 100 FROM f WHERE n_features >= 20) THEN rank END AS rank
FROM r
"""

QUERIES: dict[str, Query] = {
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_vector_shards": op2_vector_shards,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_style_tree_text": op5_style_tree_text,
    "op6_radix_repeats": op6_radix_repeats,
    "op7_subword_quality": op7_subword_quality,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ball_tree_top_k": op10_ball_tree_top_k,
    "op11_rollup_collocations": op11_rollup_collocations,
    "op12_apportioned_mix": op12_apportioned_mix,
    "op13_prefix_crc_resampling": op13_prefix_crc_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc_round_trip": WARC_SQL,
    "op4_jaccard_join": JACCARD_SQL,
    "op6_radix_repeats": REPEATS_SQL,
    "op10_ball_tree_top_k": TOP_K_SQL,
    "op11_rollup_collocations": COLLOCATIONS_SQL,
    "op12_apportioned_mix": MIX_SQL,
    "op13_prefix_crc_resampling": RESAMPLING_SQL,
}
