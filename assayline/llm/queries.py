"""The numbered queries: thin steps from the given tables to the operators and back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import (
    bwt_dedup,
    hard_negatives,
    license_signatures,
    raking,
    rule_quality,
    secret_ledger,
    simhash_vptree,
    spelling_variants,
    tile_decontamination,
    topk_search,
    trust_propagation,
    warc_bundles,
    zstd_language,
)
from assayline.llm.common import known_to_workers
from assayline.session import checkpoint_dir, materialise

Query = Callable[[SparkSession, str], DataFrame]

HELD_OUT = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    known_to_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as responses: one attempt each."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("request_id"), F.lit(1).alias("attempt"), F.col("text").alias("raw"), "lang", "source")


def op1_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    versions = responses(spark, folder)
    ledger = materialise(secret_ledger.scan_unseen(versions, secret_ledger.empty_ledger(spark)))
    found = secret_ledger.findings_by_version(versions, ledger)
    base = [r.kind for r in secret_ledger.BASE_RULES]
    of = lambda *kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select(
        F.col("request_id").alias("doc_id"),
        *counts,
        F.sha2(secret_ledger.spans_text(of(*base)).cast("binary"), 256).alias("base_sha256"),
        secret_ledger.spans_text(F.col("findings")).alias("spans"),
        "blob",
    )


def op2_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.floor(256 * x.cast("double")).cast("double")))
    vectors = table(spark, folder, "embeddings").select("vec_id", scaled.alias("embedding"))
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


OP2_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def op3_license_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return license_signatures.scan_licenses(responses(spark, folder)).withColumnRenamed("request_id", "doc_id")


def op4_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("request_id"), F.col("url").alias("uri"), F.col("html").alias("raw"))
    archive = f"{checkpoint_dir(spark)}/bundles-{uuid.uuid4().hex}"
    warc_bundles.write_bundles(pages, archive)
    return warc_bundles.read_bundles(spark, archive, payloads=False).select(
        F.col("request_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# Forty groups of four hexadecimal digits hold 160 bits; five such digits are four base32 ones.
OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex,
         min(page_id) OVER (PARTITION BY payload) AS first_id
  FROM p
), b AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS words FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((words[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""


def op5_tile_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = tile_decontamination.contaminated(responses(spark, folder), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("request_id", "doc_id")


def op6_simhash_vptree(spark: SparkSession, folder: str) -> DataFrame:
    prints = simhash_vptree.fingerprints(responses(spark, folder))
    linked = simhash_vptree.near_duplicate_classes(prints)
    return linked.select(F.col("request_id").alias("doc_id"), simhash_vptree.hexadecimal().alias("fingerprint"), "component_id")


def op7_trust_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return trust_propagation.judge_urls(table(spark, folder, "pages"))


def topic_of(raw: str) -> Column:
    """A coarse kind of content; the tables carry no topic."""
    text = F.coalesce(F.col(raw), F.lit(""))
    return (
        F.when(text.rlike(r"(?i)licen[cs]e|copyright"), "notice")
        .when(text.rlike(r"[0-9]{3}"), "record")
        .when(text.rlike(r"[|#$%&*]{3}|!!"), "markup")
        .otherwise("prose")
    )


def op8_raking(spark: SparkSession, folder: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("raw", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    rows = responses(spark, folder).select("request_id", "source", "lang", topic_of("raw").alias("topic"), words.alias("tokens"))
    mixed = raking.mixing_probabilities(rows, margins=["source", "lang", "topic"], tokens="tokens", keep=0.5)
    return mixed.withColumnRenamed("request_id", "doc_id")


def op9_zstd_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = responses(spark, folder).withColumn("held_out", F.crc32(F.col("request_id").cast("string").cast("binary")) % 4 == HELD_OUT)
    content = zstd_language.learn_dictionaries(docs.filter("NOT held_out AND lang IS NOT NULL"))
    return zstd_language.identify_language(docs.select("request_id", "held_out", "raw"), content).select(
        F.col("request_id").alias("doc_id"), "held_out", "lang_pred", "score", "rejected"
    )


def op10_bwt_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = bwt_dedup.cut_repeats(responses(spark, folder))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        F.col("request_id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.floor(256 * x.cast("double")).cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), scaled.alias("embedding"))
    return hard_negatives.mine_negatives(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP11_SQL = """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM ok a JOIN ok c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same) WHERE r <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS r
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE r <= 10
"""


def op12_rule_quality(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("request_id").cast("string").cast("binary")) % 5 == 0
    docs = responses(spark, folder).select("request_id", held_out.alias("held_out"), "raw")
    judged = materialise(rule_quality.with_statistics(docs))
    verdicts = table(spark, folder, "labels").select(F.col("doc_id").alias("request_id"), F.col("quality").alias("accepted"))
    ensemble = rule_quality.fit_rules(judged.filter("NOT held_out").join(verdicts, "request_id"))
    return rule_quality.score_responses(judged, ensemble).withColumnRenamed("request_id", "doc_id")


def op13_permuterm_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.count_words(responses(spark, folder), slip_every=31))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_ledger,
        op2_topk_search,
        op3_license_signatures,
        op4_warc_bundles,
        op5_tile_decontamination,
        op6_simhash_vptree,
        op7_trust_propagation,
        op8_raking,
        op9_zstd_language,
        op10_bwt_dedup,
        op11_hard_negatives,
        op12_rule_quality,
        op13_permuterm_variants,
    )
}
ORACLES: dict[str, str] = {"op2_topk_search": OP2_SQL, "op4_warc_bundles": OP4_SQL, "op11_hard_negatives": OP11_SQL}
