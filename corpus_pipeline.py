"""Corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the
columns of ``docs``. ``run`` writes every stage's result as Parquet and reads it again for the next. A stage lets the
shuffle files of the stages before it be deleted before it fills the disks itself.

Rows without an id: they pass the language stage like any other row; line dedup, near-duplicate removal and
decontamination, which name documents by id, leave them as they are. The stages read the columns doc_id, text and
lang (n_chars is set anew where a text changes); other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anomalytics.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from anomalytics.llm.common import held_out, prepare, read_table, release, scratch_path

#: the language stage rejects a text whose phrases are shorter than this on the average: no learned language tells it
MIN_PHRASE = 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; texts without a letter and texts that no language explains go."""
    release(spark)
    model = language_id.fit(docs.where(~held_out("doc_id", 5)))
    found = language_id.identify(docs, model, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("phrase_len") >= MIN_PHRASE)).select(
        *[F.col(f"`kept_{c}`").alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; the largest id that holds such a line keeps it."""
    release(spark)
    kept = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("_ld_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                               .otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    A document is its id and its text: rows that share an id but hold unlinked texts are judged on their own, and a
    row goes only if a linked or equal text stays. Null, empty and other texts without words, and rows without an id,
    all stay; of rows equal in id and text one stays. Very long texts are compared whole. An empty table stays empty.
    """
    release(spark)
    text_hash = F.xxhash64("text")
    named = docs.where(F.col("doc_id").isNotNull()).select(
        F.struct(F.col("doc_id").alias("id"), text_hash.alias("text")).alias("_pl_doc"), F.col("text").alias("_pl_text"))
    found = jaccard_join.jaccard_join(named, "_pl_doc", "_pl_text")
    first = (found.where((F.col("n_shingles") > 0) & (F.col("id") == F.col("component_id"))).select("id.id", "id.text").distinct()
             .select(F.col("id").alias("_pl_id"), F.col("text").alias("_pl_hash"), F.lit(True).alias("_pl_first")))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    repeated = Window.partitionBy("doc_id", text_hash).orderBy("text")
    judged = docs.join(first, (F.col("doc_id") == F.col("_pl_id")) & (text_hash == F.col("_pl_hash")), "left")
    rest = judged.where(~alone & F.col("_pl_first")).withColumn("_pl_row", F.row_number().over(repeated)).where("_pl_row = 1")
    return judged.where(alone).select(*docs.columns).unionByName(rest.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    release(spark)
    found = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    leaks = found.select(F.col("id").alias("_pl_id")).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col("_pl_id"), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, checked by decoding them again."""
    release(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, outputs=("ids",)).withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated), ("bpe", encode)]

#: cross-parsing and byte-level BPE have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
