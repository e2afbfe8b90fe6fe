"""One query per corpus operator, ``(spark, sf_dir) -> DataFrame`` over whole tables, and the
SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, minhash, toxicity, urls
from .centroids import cluster_vectors
from .common import numbered, table
from .exact_dedup import exact_duplicates
from .hard_negatives import hard_negatives
from .mixing import mix, word_count
from .packing import pack_documents
from .secrets import RULES, find_secrets, listed, tight
from .simhash import near_duplicates
from .topk import top_k, whole_numbers
from .warc import read_archives, resolved, write_archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_packing(spark, sf_dir):
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_warc(spark, sf_dir):
    path = write_archives(table(spark, sf_dir, "pages"))
    rows = resolved(read_archives(spark, path))
    return rows.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast("long").alias("refers_to"))


@query
def op5_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op6_mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op7_topk(spark, sf_dir):
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("id % 100 = 0"), vectors, 10)


ORACLES["op7_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query
def op8_simhash(spark, sf_dir):
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_exact_dedup(spark, sf_dir):
    rows = exact_duplicates(table(spark, sf_dir, "documents"), largest=True)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# DuckDB's sha1 takes text, which is the payload here; base32 goes by five bits of 40-bit groups.
ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, strlen(h) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
    list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, 1 + 10 * CAST(floor(i / 8) AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d"""

ORACLES["op10_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
WINDOW g AS (PARTITION BY t)"""


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=fold != 0)
    scored = toxicity.score(docs, model).select("doc.doc_id", "score")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _secrets_sql() -> str:
    """Matches and the gaps between them, as lists; a match starts where all before it ends."""
    lists, spans = [], []
    for place, r in enumerate(RULES):
        pattern = tight(r).replace("'", "''")
        lists.append(f"regexp_split_to_array(t, '{pattern}') AS g{place}, regexp_extract_all(t, '{pattern}', 0) AS m{place}, regexp_extract_all(t, '{pattern}', {r.group}) AS v{place}")
        start = f"CAST(list_sum([length(x) FOR x IN g{place}[1:i]]) + coalesce(list_sum([length(x) FOR x IN m{place}[1:i - 1]]), 0) AS BIGINT)"
        span = f"{{'s': {start}, 'p': {place}, 'k': '{r.kind}', 'e': {start} + length(m{place}[i])}}"
        spans.append(f"[{span} FOR i IN range(1, len(m{place}) + 1) IF length(v{place}[i]) >= {r.least}]")
    base = [x for x, r in zip(spans, RULES) if r.base]
    listed = "coalesce(array_to_string([x.k || ':' || x.s || ':' || x.e FOR x IN list_sort({})], ','), '')"
    counts = ", ".join(f"CAST(len([x FOR x IN b IF x.k = '{r.kind}']) AS BIGINT) AS n_{r.kind}" for r in RULES if r.base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, {', '.join(lists)} FROM d),
f AS (SELECT doc_id, {' || '.join(base)} AS b, {' || '.join(spans)} AS a FROM l)
SELECT doc_id, {counts}, sha256({listed.format('b')}) AS base_sha256, {listed.format('a')} AS spans FROM f"""


ORACLES["op5_secrets"] = _secrets_sql()


@query
def op3_line_dedup(spark, sf_dir):
    docs = numbered(table(spark, sf_dir, "documents"))
    gone = line_dedup.dropped_lines(docs, exact_chars=1)
    rows = docs.select("doc.doc_id", F.size(F.split(F.coalesce("doc.text", F.lit("")), "\n")).alias("lines"), "file", "row")
    rows = rows.join(gone, ["file", "row"], "left")
    return rows.select("doc_id", "lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"))


@query
def op4_url_filter(spark, sf_dir):
    judged = urls.judge(table(spark, sf_dir, "pages"))
    return judged.withColumnRenamed("id", "page_id")


@query
def op11_centroids(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _centroids_sql() -> str:
    """Five rounds, each an assignment and new centroids; distances are exact in doubles."""
    parts = ["""v AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT e, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40))"""]
    for i in range(6):
        square = " + ".join(f"list_inner_product(CAST({x}.e AS DOUBLE[]), CAST({y}.e AS DOUBLE[])){sign}" for x, y, sign in (("v", "v", ""), ("c", "c", " - 2 * list_inner_product(CAST(v.e AS DOUBLE[]), CAST(c.e AS DOUBLE[]))")))
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, min({{'d': CAST({square} AS BIGINT), 'c': c.c}}) AS m FROM v, c{i} c GROUP BY vec_id)")
        if i < 5:
            mean = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (
  SELECT c, list(x ORDER BY p) AS e FROM (SELECT m.c AS c, p, {mean} AS x FROM (SELECT m, unnest(e) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY m.c, p) GROUP BY c) n ON n.c = c.c)""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a5 JOIN c5 c ON c.c = m.c"""


ORACLES["op11_centroids"] = _centroids_sql()


@query
def op13_hard_negatives(spark, sf_dir):
    vec_id, label = F.col("vec_id"), F.col("label")
    label = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, label)


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5
), n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3"""


@query
def op12_minmax(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLES["op12_minmax"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS x FROM w
), t AS MATERIALIZED (SELECT doc_id, len(x) AS n, unnest(x) AS y FROM s),
e AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.y = b.y AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)
), r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)
SELECT doc_id, len(x) AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM s JOIN (SELECT a, min(b) AS least_id FROM r GROUP BY a) ON a = doc_id"""
