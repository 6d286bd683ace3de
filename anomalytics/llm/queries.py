"""Registered queries of the operators, one ``opN_<name>`` each, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalytics.llm import (bpe, collocations, decontaminate, jaccard_join, language_id, line_dedup, lm_score, mixing, secret_scan,
                             topk, url_filter, warc, whitening)
from anomalytics.llm.common import held_out, read_table
from anomalytics.llm.list_history import captures_of, changes_of

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out("doc_id", 5)))
    return language_id.identify(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 5).alias("held_out"), "lang_pred", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.url_filter(captures_of(pages), changes_of(pages))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(read_table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda kind: F.size(of(kind)).cast("long").alias(f"n_{kind}")
    base = [kind for kind, *_ in secret_scan.BASE_RULES]
    return found.select(
        F.col("id").alias("doc_id"), *[count(kind) for kind in base],
        F.sha2(secret_scan.joined(of(*base)).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_encode(docs, path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.lm_score(read_table(spark, sf_dir, "documents"), ~held_out("doc_id", 10))
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 10).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"),
                        "whitened", "explained", "identity_error")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_language_id, op2_jaccard_join, op3_topk, op4_url_filter, op5_decontaminate, op6_secret_scan, op7_bpe,
        op8_lm_score, op9_warc, op10_line_dedup, op11_mix, op12_whitening, op13_collocations)}
