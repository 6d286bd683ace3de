"""Rows of MBs reach Python a few at a time, whatever a task reads."""

import pyarrow as pa
from pyspark.sql import functions as F

from anomalytics.llm import common, lm_score


def test_batches_of_long_rows_are_bounded_by_bytes(spark, tmp_dir):
    common.prepare(spark)
    mb = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda _: F.repeat(F.lit("x"), 1000))
    spark.range(0, 30, 1, 1).select(mb.alias("texts")).write.parquet(f"{tmp_dir}/long")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    found = [r.n for r in spark.read.parquet(f"{tmp_dir}/long").mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 30e6 and max(found) < 2 * common.BATCH_BYTES


def test_lm_chunks_are_read_few_at_a_time(spark, monkeypatch):
    before, seen = spark.conf.get(common.READER_SETTING), {}

    def noted(df, name):
        seen[name] = int(spark.conf.get(common.READER_SETTING))
        return common.materialize(df, name)

    monkeypatch.setattr(lm_score, "materialize", noted)
    docs = spark.createDataFrame([(i, f"one two w{i % 7}") for i in range(40)], "doc_id bigint, text string")
    sliced = lm_score.lm_score(docs, F.col("doc_id") % 10 != 0, filter_bits=0).count()
    assert sliced == 40 and spark.conf.get(common.READER_SETTING) == before
    assert seen["lm-answers"] == seen["lm-scored"] == common.READER_ROWS < int(before)
