"""Line dedup with two Bloom filters: hashes seen once and hashes seen twice.

1. Every task hashes the keys of its lines (each key once per document) and marks them in a once-seen and a
   twice-seen filter, which are folded over all tasks (``seen_twice``).
2. Only lines that hit the twice-seen filter are shuffled, as (id, SHA-256 of the key).
3. The suspects are counted exactly (distinct documents per key) and the keeper is chosen; documents then drop
   their lines of confirmed keys.

The filter has a fixed number of bits (``filter_bits``), so what is collected and broadcast is bounded by that
parameter at any input size. A filter that gets too full only sends more suspects to the exact step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalytics.llm.common import ASCII_SPACE, free_worker, lower_ascii, materialize, prepare
from anomalytics.llm.seen_twice import collect_bits, fold, hits, marks


def _line_keys(text: str | None, min_chars: int) -> list[bytes]:
    """Keys of the lines that are long enough: stripped, A-Z in lower case."""
    if not text:
        return []
    stripped = (line.strip(ASCII_SPACE) for line in text.split("\n"))
    return [line.encode("utf-8", "surrogatepass").lower() for line in stripped if len(line) >= min_chars]


def _hash64(keys: list[bytes]) -> np.ndarray:
    """First 8 bytes of the SHA-256 of each key."""
    return np.frombuffer(b"".join([hashlib.sha256(k).digest()[:8] for k in keys]), dtype="<u8")


def twice_seen_filter(docs: DataFrame, text_col: str, min_chars: int, filter_bits: int) -> bytes:
    """The folded twice-seen filter of all line keys (``filter_bits / 8`` bytes)."""
    def mark(batches):
        free_worker()
        found = [_hash64(list(keys)) for batch in batches for text in batch.column(0).to_pylist()
                 if (keys := set(_line_keys(text, min_chars)))]
        yield from marks(np.concatenate(found) if found else np.empty(0, np.uint64), filter_bits)

    return collect_bits(fold(docs.select(text_col), mark, filter_bits), filter_bits)


def suspected_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, filter_bits: int) -> DataFrame:
    """(id, key SHA-256) of each distinct key of a document that hits the twice-seen filter."""
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen_filter(docs, text_col, min_chars, filter_bits))

    def probe(batches):
        free_worker()
        seen = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            ids, out_row, out_key = batch.column(0), [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                keys = list(set(_line_keys(text, min_chars)))
                if not keys:
                    continue
                for k in np.flatnonzero(hits(_hash64(keys), seen, filter_bits)):
                    out_row.append(row)
                    out_key.append(hashlib.sha256(keys[k]).digest())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out_row, pa.int64())),
                                              pa.array(out_key, pa.binary())], names=["id", "key"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(probe, f"id {id_type}, key binary")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5, filter_bits: int = 1 << 27) -> DataFrame:
    r"""Drop lines whose key occurs in at least ``min_docs`` documents, except in the largest id that holds it.

    A text is split at \n; a line's key is the line without ASCII white space at its ends, A-Z in lower case. Only
    keys of at least ``min_chars`` code points count. Returns every column of ``docs`` (``text_col`` without the
    dropped lines), and ``_ld_lines`` (lines before dropping) and ``_ld_dropped``.

    * A null or empty text is one empty line: nothing is dropped, the text stays as it is.
    * A row with a null id takes no part: it is neither counted nor changed.
    * Rows that repeat an id count as one document; each loses the same keys.
    * Other columns are passed through unread, whatever their names are (names that begin with ``_ld_`` are the
      operator's own). An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    suspects = materialize(suspected_lines(docs, id_col, text_col, min_chars, filter_bits), "line-suspects")
    confirmed = materialize(
        suspects.where("id is not null").groupBy("key")
        .agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs).select("key", "keeper"), "line-confirmed")
    doomed = (suspects.join(confirmed, "key").where(F.col("id") != F.col("keeper"))
              .groupBy("id").agg(F.collect_set("key").alias("_ld_keys"))      # at most a document's own lines
              .withColumnRenamed("id", "_ld_id"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    strip = lambda line: F.btrim(line, F.lit(ASCII_SPACE))
    keep = lambda line: ~((F.length(strip(line)) >= min_chars) & F.array_contains(
        F.col("_ld_keys"), F.unhex(F.sha2(lower_ascii(strip(line)).cast("binary"), 256))))
    return (
        docs.join(doomed, F.col(id_col) == F.col("_ld_id"), "left")
        .withColumn("_ld_all", F.split(text, "\n", -1))
        .withColumn("_ld_kept", F.when(F.col("_ld_keys").isNotNull(), F.filter("_ld_all", keep)))
        .withColumn("_ld_lines", F.size("_ld_all").cast("long"))
        .withColumn("_ld_dropped", F.when(F.col("_ld_kept").isNull(), 0)
                    .otherwise(F.size("_ld_all") - F.size("_ld_kept")).cast("long"))
        .withColumn(text_col, F.when(F.col("_ld_dropped") == 0, F.col(text_col))
                    .otherwise(F.array_join("_ld_kept", "\n")))
        .drop("_ld_id", "_ld_keys", "_ld_all", "_ld_kept")
    )
