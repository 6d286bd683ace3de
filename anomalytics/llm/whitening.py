"""Embedding whitening from a polarisation covariance.

Entries become whole numbers. The first pass adds up every dimension, exactly. The second adds up exact squares of the
centred values of every dimension and of every sum of two dimensions: 2 Cov(a, b) = Var(a + b) - Var(a) - Var(b), so
differences of variances give all covariances, and no product of two dimensions is ever formed. Values are centred on
the whole part of the mean; its fraction is taken off exactly from the sums. Numerators and denominators stay whole
until one division gives each entry of the matrix that goes to ``eigh``. What is collected is one number for each pair
of dimensions; the components, ``dimensions x components`` doubles, travel with the task.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalytics.llm.common import free_worker, prepare

SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 53)       # of a scaled entry that is still exact


@dataclass(frozen=True)
class Whitening:
    """The fitted transform over ``n`` vectors: sums of x by dimension, components (columns) and their eigenvalues."""
    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    covariance: np.ndarray


def _whole(column: pa.Array, scale: int, offset: int) -> np.ndarray:
    """rows x dimensions of longs."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return (np.floor(flat * scale).astype(np.int64) + offset).reshape(len(column), -1)


def _squares(y: np.ndarray) -> list[int]:
    """Exact sums of squares of the columns; Python's whole numbers where 64 bits could be too few."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 62:
        return np.einsum("ij,ij->j", y, y).tolist()
    wide = y.astype(object)
    return (wide * wide).sum(axis=0).tolist()


def usable(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Rows whose vector takes part; see ``whiten``."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * scale) >= LARGEST))
    some = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    longest = some.agg(F.max(F.size(v))).first()[0]
    return some.where(F.size(v) == F.lit(longest or 0))


def _added(rows: DataFrame, run, names: list[str]) -> list:
    """Sums of what ``run`` yields in the column q, by the columns ``names``."""
    made = rows.mapInArrow(run, ", ".join(f"{x} int" for x in names) + ", q decimal(38,0)")
    return made.groupBy(*names).agg(F.sum("q").alias("q")).collect()        # dimensions (pairs of them) at most


def _rows_of(keys: dict[str, list[int]], totals: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({**{k: pa.array(v, pa.int32()) for k, v in keys.items()},
                                       "q": pa.array([Decimal(x) for x in totals], pa.decimal128(38, 0))})


def fit(rows: DataFrame, vector_col: str, components: int, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The whitening of ``rows`` (see ``usable``); None if no direction varies."""
    column = rows.select(vector_col)

    def add(batches):
        free_worker()
        totals, n = None, 0
        for batch in batches:
            if len(batch):
                own = _whole(batch.column(0), scale, offset).astype(object).sum(axis=0)
                totals, n = own if totals is None else totals + own, n + len(batch)
        if n:
            yield _rows_of({"a": [-1, *range(len(totals))]}, [n, *totals.tolist()])

    found = {row.a: int(row.q) for row in _added(column, add, ["a"])}
    n, d = found.get(-1, 0), len(found) - 1
    if n == 0:
        return None
    sums = tuple(found[a] for a in range(d))
    centre = np.array([s // n for s in sums], dtype=np.int64)

    def polarise(batches):
        free_worker()
        single, pairs = [0] * d, [[0] * (d - 1 - a) for a in range(d)]
        for batch in batches:
            if len(batch):
                y = _whole(batch.column(0), scale, offset) - centre
                single = [p + q for p, q in zip(single, _squares(y), strict=True)]
                for a in range(d - 1):
                    pairs[a] = [p + q for p, q in zip(pairs[a], _squares(y[:, a + 1:] + y[:, a:a + 1]), strict=True)]
        if any(single):
            yield _rows_of({"a": list(range(d)), "b": list(range(d))}, single)
            for a in range(d - 1):
                yield _rows_of({"a": [a] * (d - 1 - a), "b": list(range(a + 1, d))}, pairs[a])

    squares = {(row.a, row.b): int(row.q) for row in _added(column, polarise, ["a", "b"])}
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]           # sums of the centred values
    spread = lambda square, total: n * square - total * total  # noqa: E731      n^2 times a variance
    single = [spread(squares.get((a, a), 0), rest[a]) for a in range(d)]
    covariance = np.zeros((d, d))
    for a in range(d):
        covariance[a, a] = single[a] / n ** 2
        for b in range(a + 1, d):
            both = spread(squares.get((a, b), 0), rest[a] + rest[b])
            covariance[a, b] = covariance[b, a] = (both - single[a] - single[b]) // 2 / n ** 2
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(components, int((values > max(values[0], 0.0) * d * np.finfo(float).eps).sum()))
    if keep == 0:
        return None
    vectors = vectors[:, :keep] * np.where(vectors[np.abs(vectors[:, :keep]).argmax(axis=0), range(keep)] < 0, -1.0, 1.0)
    return Whitening(n, sums, np.ascontiguousarray(vectors), values[:keep].copy(), sum(single) / n ** 2, covariance)


def _projector(model: Whitening, scale: int, offset: int):
    """(whitened, centred values n x - S as whole numbers) of an Arrow column."""
    n = model.n
    centre = np.array([s // n for s in model.sums], dtype=np.int64)
    rest = [s - n * int(c) for s, c in zip(model.sums, centre, strict=True)]
    fraction, base = np.array([r / n for r in rest]), model.vectors / np.sqrt(model.values)

    def run(column):
        y = _whole(column, scale, offset) - centre
        wide = y if n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 61 else y.astype(object)
        return (y - fraction) @ base, n * wide - np.array(rest, dtype=wide.dtype)

    return run


def _deviations(centred: np.ndarray) -> list[int]:
    top = int(np.abs(centred).max(initial=0))
    wide = centred if top * top * centred.shape[1] < 1 << 62 else centred.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def identity_error(rows: DataFrame, vector_col: str, model: Whitening, scale: int = SCALE, offset: int = OFFSET) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    project, k = _projector(model, scale, offset), len(model.values)

    def run(batches):
        free_worker()
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if len(batch):
                z, _ = project(batch.column(0))
                total += z.T @ z
                mean += z.sum(axis=0)
        a, b = np.indices((k + 1, k)).reshape(2, -1)                 # row k holds the sums
        yield pa.RecordBatch.from_pydict({"a": a.astype(np.int32), "b": b.astype(np.int32),
                                          "q": np.vstack([total, mean]).ravel()})

    made = rows.select(vector_col).mapInArrow(run, "a int, b int, q double").groupBy("a", "b").agg(F.sum("q").alias("q"))
    found = np.zeros((k + 1, k))
    for row in made.collect():                                       # components squared
        found[row.a, row.b] = row.q / model.n
    mean = found[k]                                                  # 0 but for rounding: the values are centred before
    return float(np.abs(found[:k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error) of every row and component.

    An entry c becomes x = floor(scale c) + offset. ``n`` vectors are fitted; ``deviation`` is the sum over dimensions
    of (n x - S)^2, exact; ``whitened`` is x - S / n projected on the component over the root of its eigenvalue;
    ``explained`` is the eigenvalue's share of the trace. A component's sign is such that its largest entry is positive.

    * Vectors that are null or empty, hold null, NaN or infinite entries or entries too large to be exact (2^53 after
      scaling), or are shorter than the longest, take no part and have no rows. Null and repeated ids stay, row by row.
    * Directions that do not vary (eigenvalue 0 but for rounding) are no components: equal vectors, a single vector or
      an empty table give an empty result. Equal eigenvalues: any of their bases, the same for all rows.
    * Very many dimensions: what is collected is their pairs, d (d + 1) / 2 numbers. Other columns are not read.
    """
    prepare(vectors.sparkSession)
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = usable(vectors, vector_col, scale).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    model = fit(rows, "v", components, scale, offset)
    names = "id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    if model is None:
        return vectors.sparkSession.createDataFrame(
            [], f"id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error, project = identity_error(rows, "v", model, scale, offset), _projector(model, scale, offset)

    def run(batches):
        free_worker()
        for batch in batches:
            if len(batch):
                z, centred = project(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([Decimal(x) for x in _deviations(centred)], pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))],
                    names=["id", "deviation", "z"])

    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return (
        rows.mapInArrow(run, f"id {id_type}, deviation decimal(38,0), z array<double>")
        .select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
        .select("id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")).select(*names))
