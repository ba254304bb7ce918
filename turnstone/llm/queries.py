"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, exact_dedup, language_id, license_scan, mixing, packing, pii, secret_scan, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def _digest(spans, kinds):
    base = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return [
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
    ]


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_digest(F.col("spans"), secret_scan.KINDS[:3]))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_documents(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_links(_table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_digest(F.col("spans"), pii.KINDS[:4]))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.transform("base", lambda x: x["label"])
    own = F.transform("found", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, own)).alias("labels"),
        F.when(F.size("base") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0)))
        .alias("score"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents")).drop("queue")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_language_id,
        op3_secret_scan,
        op4_mix_sources,
        op5_warc,
        op6_simhash,
        op7_embedding_dedup,
        op8_pii,
        op9_license_scan,
        op10_packing,
        pipeline,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
             q AS (SELECT *, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS top,
                          row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS rn FROM p)
        SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN n >= 1000 AND rn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND rn > 1 THEN top END AS refers_to
        FROM q
    """,
}
