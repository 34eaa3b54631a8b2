"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.llm import chat, embeddings, jaccard, licenses, mixing, negatives, packing, pieces, quality, records, urls, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# every seat by its quotient, and positions by one window per source: the plain reading of the definition
ORACLE["op3_source_mix"] = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source),
weighted AS (SELECT *, (no - 1) % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM totals),
placed AS (
  SELECT *, row_number() OVER o AS place, coalesce(sum(cap) OVER b, 0)::BIGINT AS given,
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS weight_left
  FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / weight, no), b AS (ORDER BY cap::DOUBLE / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - given)::DOUBLE / weight_left AS level FROM placed),
chosen AS (SELECT place AS first_place, level AS best FROM levels WHERE level * weight <= cap ORDER BY place LIMIT 1),
targets AS (
  SELECT no, source, source_size, total, CASE WHEN place < first_place THEN cap::DOUBLE ELSE weight * best END AS target,
    ((source_size + 15) // 16)::BIGINT AS n_blocks
  FROM levels CROSS JOIN chosen),
seats AS (
  SELECT no, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, no) AS rank, total
  FROM targets, generate_series(1, 3 * n_blocks + 8) AS g(k) WHERE target > 0),
quotas AS (SELECT no, count(*) AS quota FROM seats WHERE rank <= greatest(1, round(total / 16.0)) GROUP BY no),
plan AS (
  SELECT t.*, least(coalesce(quota, 0), 3 * n_blocks) AS quota, greatest(n_blocks, 1) AS nb,
    ('0x' || substr(md5('mix-1:' || coalesce(source, '')), 1, 8))::BIGINT % greatest(n_blocks, 1) AS first_block
  FROM targets t LEFT JOIN quotas USING (no)),
runs AS (
  SELECT doc_id, size, source_size, target, quota // nb AS passes, n_blocks, first_block, first_block + quota % nb AS stop,
    sum(size) OVER (PARTITION BY no ORDER BY md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, (passes * size
    + greatest(0, least(16 * least(stop, n_blocks) - start, size) - greatest(16 * first_block - start, 0))
    + greatest(0, least(16 * greatest(stop - n_blocks, 0) - start, size) - greatest(-start, 0)))::BIGINT AS taken
FROM runs
"""


#: a conversation whose texts hold the template's own control strings
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(TRICKY, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(added)))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, verdict)")
    return urls.judge_urls(table(spark, sf_dir, "pages"), listed)


ORACLE["op6_url_filter"] = """
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (
  SELECT p.page_id, p.host, p.path, max({'n': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) AS best
  FROM (SELECT *, row_number() OVER () AS k FROM parts) p
  LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.k, p.page_id, p.host, p.path)
SELECT page_id, host, path, CASE WHEN best.rule IS NOT NULL THEN best.rule END AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""


@query
def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.write_records(table(spark, sf_dir, "documents"), TOKENIZER)
    back = records.read_records(records.with_starts(index))
    return back.select(F.col("record_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "lang", "rejected_by")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op10_warc"] = """
WITH bodies AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
firsts AS (SELECT payload_digest, max(page_id) AS first_id FROM bodies WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM bodies LEFT JOIN firsts USING (payload_digest)
"""


@query
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.decode_ids(pieces.encode_texts(table(spark, sf_dir, "documents"), PIECES), PIECES)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(table(spark, sf_dir, "embeddings"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=label)


# every anchor with every row
ORACLE["op13_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) for c in embedding] AS x, row_number() OVER () AS k
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
anchors AS (SELECT * FROM usable WHERE vec_id % 100 = 0),
scored AS (
  SELECT a.k AS anchor, a.vec_id AS anchor_id, r.k AS other, r.vec_id AS other_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM anchors a JOIN usable r ON a.k <> r.k AND len(a.x) = len(r.x)),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST) <= 5),
found AS (
  SELECT p.anchor, p.other AS positive, p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id NULLS LAST) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""
