"""Exact top-k inner-product search with MaxScore.

The terms of a query are its vector components. A shard of candidates keeps, for every term, its postings (the
component of each of its vectors) and the least and greatest value in them. A posting's contribution to a score is
counted above the term's least possible one, so contributions are never negative and a term's bound is the greatest
of them. For a query with the current k-th score as threshold:

* the terms with the smallest bounds whose sum cannot lift a vector over the threshold are non-essential;
* the postings of the other, essential, terms are traversed and summed;
* vectors that could still reach the threshold are probed in the non-essential terms, largest bound first, as long as
  they stay competitive.

Shards are worked on in blocks, so the threshold rises while a shard is read. Every shard returns its own best k, and
the shards' lists are merged. Shards and query blocks have bounded sizes; each query block meets each shard once,
through an equality join on the shard number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anomalytics.llm.common import free_worker, materialize, prepare

SHARD_ROWS, QUERY_ROWS, BLOCK_ROWS, PROBE_TERMS = 16_384, 2_048, 4_096, 8


def quantised(vector_col: str, scale: int = 256):
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    col = F.col(vector_col)
    fine = col.isNotNull() & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _packed(rows: DataFrame, id_col: str, n_groups: int, salt: int) -> DataFrame:
    """(part int, ids binary, matrix binary, width int): the vectors of a hash group in one row."""
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        vectors = table.column("v").to_pylist()
        width = max(map(len, vectors))
        matrix = np.zeros((len(ids), width), dtype="<i8")
        for row, v in zip(matrix, vectors, strict=True):
            row[:len(v)] = v
        order = np.argsort(ids, kind="stable")
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()),
                         "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                         "matrix": pa.array([matrix[order].tobytes()], pa.binary()),
                         "width": pa.array([width], pa.int32())})

    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(n_groups)).cast("int")
    return rows.select(part.alias("part"), F.col(id_col).cast("long").alias("id"), F.col("v")).groupBy("part").applyInArrow(
        pack, "part int, ids binary, matrix binary, width int")


def _best(shard_ids: np.ndarray, shard: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query index, id, score) of the k best of the shard for every query (ties at the k-th place are all kept)."""
    width = min(shard.shape[1], queries.shape[1])
    shard, queries = shard[:, :width], queries[:, :width]
    most = float(np.abs(shard).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    kind = np.float64 if most < 2 ** 53 else np.int64        # float products are exact below 2 ** 53
    postings = np.ascontiguousarray(shard.T).astype(kind)     # term -> component of each vector
    low, high = postings.min(axis=1, initial=0), postings.max(axis=1, initial=0)
    n = len(shard_ids)
    for q, (own, query) in enumerate(zip(query_ids, queries.astype(kind), strict=True)):
        floor = np.minimum(query * low, query * high)         # least contribution of each term
        bound = np.maximum(query * low, query * high) - floor
        order = np.argsort(bound)                             # smallest bound first
        below = np.cumsum(bound[order])
        base = floor.sum()
        ids, scores, threshold = np.empty(0, np.int64), np.empty(0, kind), None
        for start in range(0, n, BLOCK_ROWS):
            block = slice(start, min(n, start + BLOCK_ROWS))
            cut = 0 if threshold is None else int(np.searchsorted(below, threshold - base, side="left"))
            essential = order[cut:]
            partial = query[essential] @ postings[essential, block]
            alive = np.arange(block.start, block.stop)
            while cut > 0:
                spare = floor[order[:cut]].sum() + below[cut - 1]          # most that the unread terms can add
                competitive = partial + spare >= threshold
                alive, partial = alive[competitive], partial[competitive]
                if not alive.size:
                    break
                step = order[max(0, cut - PROBE_TERMS):cut]
                partial = partial + query[step] @ postings[np.ix_(step, alive)]
                cut -= step.size
            if not alive.size:
                continue
            other = shard_ids[alive] != own
            ids, scores = np.concatenate([ids, shard_ids[alive[other]]]), np.concatenate([scores, partial[other]])
            if scores.size >= k:
                threshold = np.partition(scores, scores.size - k)[scores.size - k]
                ids, scores = ids[scores >= threshold], scores[scores >= threshold]
        if scores.size:
            best = np.lexsort((ids, -scores))[:k]
            yield q, ids[best], scores[best].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with the other vectors.

    Components are quantised to floor(scale * x). Ties go to the smaller id.

    * Vectors that are null, or hold a null or non-finite component, and rows with a null id take no part.
    * Rows that repeat an id count once (one of them). Equal vectors of different ids are ties.
    * Vectors of different lengths meet in the components that both have (missing ones count as 0); an empty vector
      scores 0. Other columns are not read. Without vectors or queries the result is empty.
    """
    prepare(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        return (df.select(F.col(id_col), quantised(vector_col, scale).alias("v"))
                .where(F.col(id_col).isNotNull() & F.col("v").isNotNull()).groupBy(id_col).agg(F.first("v").alias("v")))

    candidates, asked = materialize(usable(vectors), "topk-vectors"), materialize(usable(queries), "topk-queries")
    n_shards = max(1, -(-candidates.count() // SHARD_ROWS))
    n_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    shards = _packed(candidates, id_col, n_shards, 1)
    blocks = (_packed(asked, id_col, n_blocks, 2).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("part"), F.col("ids").alias("q_ids"),
        F.col("matrix").alias("q_matrix"), F.col("width").alias("q_width")))

    def search(batches):
        free_worker()
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                shard = np.frombuffer(row["matrix"], "<i8").reshape(len(ids), row["width"])
                asked = np.frombuffer(row["q_matrix"], "<i8").reshape(len(q_ids), row["q_width"])
                found = list(_best(ids, shard, q_ids, asked, k))
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "query_id": np.concatenate([np.full(len(i), q_ids[q]) for q, i, _ in found]),
                        "vec_id": np.concatenate([i for _, i, _ in found]),
                        "score": np.concatenate([s for _, _, s in found])})

    met = shards.join(blocks, "part").select("ids", "matrix", "width", "q_ids", "q_matrix", "q_width")
    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
