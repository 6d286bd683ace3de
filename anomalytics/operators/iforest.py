"""Isolation Forest in DataFrame functions (Liu, Ting, Zhou, ICDM 2008).

* D1 features: five numeric columns, nulls -> 0, as DOUBLE.
* D2 standardise: mean 0, population std 1 (std 0 -> divide by 1); one
  aggregation pass, then literals.
* D3 fit: every random choice is a hash, so that any engine grows the same
  trees. A row's md5 digest gives two whole numbers a and b; tree t draws the
  psi = min(256, n) rows with the smallest (a + t b) mod p. A cut set for about
  4 psi candidates a tree keeps all others out of the shuffle (explode and
  filter inside whole-stage codegen). All trees grow together, one level a job:
  the bounds of every open node are aggregated over the written sample. The md5
  digest of (seed, tree, node) picks the feature among those that vary and the
  threshold in (min, max]; the depth limit is ceil(log2 psi). The model is a
  node table of at most T (2 psi - 1) rows - its size bound is fixed by T and
  psi, not by the data.
* D4 score: the node table is collected (bounded, see above) and becomes a
  forest of spark.ml, whose compiled trees are walked for every row, so rows
  never leave the JVM. A leaf's path length, its depth plus c(size), is counted in whole ``UNIT``s: sums are
  exact in any order. s = 2^(-E[h(x)] / c(psi)); higher = more anomalous. Rows
  are anomalies when s is above the exact (1 - contamination) quantile of s.

An isolation tree asks on which side of a uniform point of (min, max) a value
lies, which scaling a feature does not change: the detector grows its trees on
the raw features.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from anomalytics import config
from anomalytics.operators.quantiles import exact_percentiles
from anomalytics.session import materialize, scratch_path

EULER_GAMMA = 0.5772156649015329
UNIT = 1_000_000_000           # of a path length
PRIME = 1_125_899_906_842_597  # of the sampling hash

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, size long, depth int, leaf boolean"
)


def average_path_units(n: Column) -> Column:
    """c(n) in units: average path length of an unsuccessful BST search over n points."""
    x = n.cast("double")
    c = 2.0 * (F.log(x - 1.0) + EULER_GAMMA) - 2.0 * (x - 1.0) / x
    return F.when(n <= 1, F.lit(0)).when(n == 2, F.lit(UNIT)).otherwise(F.round(c * float(UNIT))).cast("long")


def _hex(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def _md5(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def feature_table(df: DataFrame, features=config.FEATURE_COLUMNS, id_col: str = "order_id") -> DataFrame:
    """Id + features as DOUBLE with nulls replaced by 0."""
    return df.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])


@dataclass(frozen=True)
class Scaler:
    """D2 fitted: per-feature mean and scale (population std; 1 for a constant feature)."""
    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    n: int

    def columns(self) -> list:
        return [((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, m, s in zip(self.features, self.means, self.scales)]


def fit_scaler(df: DataFrame, features=config.FEATURE_COLUMNS) -> Scaler:
    """One aggregation pass: count, mean and population std of every feature."""
    features = tuple(features)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in features:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    m = df.agg(*aggs).first()
    means = tuple(float(m[f"m_{c}"] or 0.0) for c in features)
    scales = tuple(float(m[f"s_{c}"]) if m[f"s_{c}"] and m[f"s_{c}"] > 0 else 1.0 for c in features)
    return Scaler(features, means, scales, int(m["n"]))


def standardize(df: DataFrame, features=config.FEATURE_COLUMNS, id_col: str = "order_id",
                keep: tuple[str, ...] = (), scaler: Scaler | None = None) -> DataFrame:
    """(x - mean) / population std per feature; a constant feature is divided by 1."""
    sc = scaler or fit_scaler(df, features)
    return df.select(id_col, *keep, *sc.columns())


def _sample(data: DataFrame, n_trees: int, psi: int, seed: int, frac: float) -> DataFrame:
    """Per tree, the psi rows (id, x) with the smallest hash (ties by id, then features); one rule at every size.

    Every row is tested against every tree's cut inside whole-stage codegen (explode + filter); about 4*psi rows per
    tree survive, and only they are shuffled and ranked.
    """
    digest = _md5(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
    cand = (
        data.withColumn("a", _hex(digest, 1, 13) % PRIME).withColumn("b", _hex(digest, 14, 13) % (PRIME - 1) + 1)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
        .withColumn("h", (F.col("a") + F.col("tree") * F.col("b")) % F.lit(PRIME))
        .where(F.col("h") < F.lit(int(frac * PRIME)))
    )
    w = Window.partitionBy("tree").orderBy("h", "id", "x")
    return cand.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= psi).drop("rk", "a", "b")


def _split(row, tree: int, node: int, seed: int) -> tuple[int, float]:
    """(feature, threshold) of a node that holds rows between ``row.lo`` and ``row.hi``; feature -1: nothing varies."""
    varying = [i for i, (low, high) in enumerate(zip(row.lo, row.hi)) if high > low]
    if not varying:
        return -1, 0.0
    digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    feature = varying[int(digest[:8], 16) % len(varying)]
    low, high = row.lo[feature], row.hi[feature]
    between = low + (int(digest[8:16], 16) + 0.5) / 4294967296.0 * (high - low)
    return feature, min(between, high) if between > low else high     # both sides get a row where doubles are scarce


def _walk(x: Column, start: Column, arrays: dict[str, list], levels: int) -> Column:
    """The place in the node arrays that the feature array ``x`` comes to from the place ``start``. Siblings are
    neighbours; ``left`` is the place of the first of them, under 0 where no split is known."""
    if levels == 0:
        return start
    left, feature, threshold = (_literal(arrays[k], kind) for k, kind in (("left", "int"), ("feature", "int"), ("threshold", "double")))

    def down(k: Column, _: Column) -> Column:
        beyond = F.when(F.get(x, F.get(feature, k)) < F.get(threshold, k), F.lit(0)).otherwise(F.lit(1))
        return F.when(F.get(left, k) < 0, k).otherwise(F.get(left, k) + beyond)

    return F.aggregate(_literal(list(range(levels)), "int"), start, down)


def _grow(sample: DataFrame, n_trees: int, n_features: int, seed: int, max_depth: int) -> list[tuple]:
    """The rows of the node table, one job a level over the sample (tree, x). Node k's children are 2 k + 1 and 2 k + 2.

    Each job walks the splits that are known, and adds up the rows, least and largest values of every open node; what
    comes back is a row for each, T 2^depth at most.
    """
    nodes, found = [(t, 0, 0) for t in range(n_trees)], {}              # (tree, node, depth) by place
    arrays = {"left": [-2] * n_trees, "feature": [-1] * n_trees, "threshold": [0.0] * n_trees}
    for depth in range(max_depth + 1):
        x = [F.get("x", i) for i in range(n_features)]
        here = (sample.withColumn("place", _walk(F.col("x"), F.col("tree"), arrays, depth))
                .where(F.get(_literal(arrays["left"], "int"), F.col("place")) == -2).groupBy("place")
                .agg(F.count(F.lit(1)).alias("size"), F.array(*[F.min(c) for c in x]).alias("lo"), F.array(*[F.max(c) for c in x]).alias("hi")))
        for row in sorted(here.collect(), key=lambda r: r.place):
            tree, node, _ = nodes[row.place]
            feature, threshold = _split(row, tree, node, seed) if depth < max_depth else (-1, 0.0)
            found[row.place] = (tree, node, feature, threshold, *((-1, -1) if feature < 0 else (2 * node + 1, 2 * node + 2)),
                                row["size"], depth, feature < 0)
            arrays["feature"][row.place], arrays["threshold"][row.place] = feature, threshold
            arrays["left"][row.place] = -1 if feature < 0 else len(nodes)
            if feature >= 0:
                nodes += [(tree, 2 * node + 1, depth + 1), (tree, 2 * node + 2, depth + 1)]
                for key, empty in (("left", -2), ("feature", -1), ("threshold", 0.0)):
                    arrays[key] += [empty, empty]
        if -2 not in arrays["left"]:
            break
    return [found[place] for place in sorted(found)]


def fit(df: DataFrame, features=config.FEATURE_COLUMNS, id_col: str = "order_id",
        n_trees: int = config.N_TREES, max_samples: int = config.MAX_SAMPLES,
        seed: int = config.FOREST_SEED, n: int | None = None) -> DataFrame:
    """D3: the forest as a node table (tree, node, feature, threshold, left, right, size, depth, leaf)."""
    features = tuple(features)
    n = df.count() if n is None else n
    if n == 0:
        raise ValueError("cannot fit an isolation forest on no rows")
    psi = min(max_samples, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    data = df.select(F.col(id_col).alias("id"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))
    frac = min(1.0, 4.0 * psi / n)
    while True:
        # the written sample holds at most T * psi rows; it is full exactly when every tree drew psi rows
        sample = materialize(_sample(data, n_trees, psi, seed, frac))
        if frac >= 1.0 or sample.count() == n_trees * psi:
            break
        frac = min(1.0, frac * 2)   # a tree drew fewer than psi candidates: widen and redraw
    nodes = _grow(sample.select("tree", "x"), n_trees, len(features), seed, max_depth)
    columns = [f.name for f in StructType.fromDDL(NODE_SCHEMA)]
    table = pa.table({c: list(v) for c, v in zip(columns, zip(*nodes))})       # Arrow: one batch, no row by row conversion
    return df.sparkSession.createDataFrame(table).select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(NODE_SCHEMA)])


def _literal(values: list, kind: str) -> Column:
    """A literal array. Its bytes go to the JVM at once; ``F.lit`` of a list would send each value on its own and
    leave an expression of as many literals to the optimiser."""
    gateway = SparkContext._active_spark_context._gateway
    code, view, element = {"int": (">i4", "asIntBuffer", gateway.jvm.int), "bigint": (">i8", "asLongBuffer", gateway.jvm.long),
                           "double": (">f8", "asDoubleBuffer", gateway.jvm.double)}[kind]
    array = gateway.new_array(element, len(values))
    getattr(gateway.jvm.java.nio.ByteBuffer.wrap(np.array(values, dtype=code).tobytes()), view)().get(array)
    return Column(gateway.jvm.org.apache.spark.sql.functions.lit(array))


def ml_forest(spark: SparkSession, nodes: list, n_trees: int, n_features: int) -> RandomForestRegressionModel:
    """The forest as a model of spark.ml whose prediction is the mean, over the trees, of the path length in units.

    spark.ml walks its trees in compiled code, where expressions over the node table are interpreted at some 100 ns a
    step. ``nodes`` are rows of the node table with ``units``, the path length of a leaf; they are written in spark.ml's
    saved form and loaded. Its splits send x <= t left, ours x < t: t is the next double below.
    """
    path = scratch_path(spark, "forest")
    nodes = sorted(nodes, key=lambda r: (r["tree"], r["node"]))
    trees, rows = sorted({r["tree"] for r in nodes}), []
    for tree, of_tree in itertools.groupby(nodes, key=lambda r: r["tree"]):
        of_tree = list(of_tree)
        number = {r["node"]: i for i, r in enumerate(of_tree)}                 # from 0, children behind their parents
        for i, r in enumerate(of_tree):
            leaf = r["leaf"]
            split = {"featureIndex": -1 if leaf else r["feature"], "numCategories": -1,
                     "leftCategoriesOrThreshold": [] if leaf else [math.nextafter(r["threshold"], -math.inf)]}
            rows.append((trees.index(tree), {
                "id": i, "prediction": float(r["units"]), "impurity": 0.0, "impurityStats": [0.0, 0.0, 0.0], "rawCount": r["size"],
                "gain": -1.0 if leaf else 0.0, "leftChild": -1 if leaf else number[r["left"]],
                "rightChild": -1 if leaf else number[r["right"]], "split": split}))
    schema = pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct([
        ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
        ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
        ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
                             ("numCategories", pa.int32())]))]))])
    columns = {f.name: pa.array(list(v), f.type) for f, v in zip(schema, zip(*rows))}
    spark.createDataFrame(pa.table(columns, schema=schema)).write.parquet(f"{path}/data")

    def metadata(name: str, params: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{name}", "timestamp": 0, "sparkVersion": spark.version,
                           "uid": name, "paramMap": {"impurity": "variance", **params}, "defaultParamMap": {}, **more})

    of_trees = [(t, metadata("DecisionTreeRegressionModel", {}, numFeatures=n_features), 1.0) for t in range(n_trees)]
    spark.createDataFrame(of_trees, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    of_forest = metadata("RandomForestRegressionModel", {"numTrees": n_trees}, numFeatures=n_features, numTrees=n_trees)
    spark.createDataFrame([(of_forest,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestRegressionModel.load(path)


def score(df: DataFrame, model: DataFrame, psi: int, features=config.FEATURE_COLUMNS,
          id_col: str = "order_id", out: str = "anomaly_probability",
          scaler: Scaler | None = None, n_trees: int = config.N_TREES) -> DataFrame:
    """Append the anomaly score s in (0, 1] to every row of ``df`` (all columns kept).

    A map-only step in the JVM. Features are taken as in D1 (nulls -> 0); with a ``scaler`` (of a forest that was
    grown on standardised features) they are standardised in place.
    """
    features = tuple(features)
    # a tree of psi leaves has at most 2 * psi - 1 nodes, and tree ids are 0 .. n_trees - 1: fetch at most
    # one row past the bound, so a malformed model is refused without ever being collected whole
    bound = n_trees * (2 * psi - 1)
    of_leaf = F.when(F.col("leaf"), F.col("depth").cast("long") * UNIT + average_path_units(F.col("size"))).otherwise(F.lit(0))
    nodes = [r.asDict() for r in model.withColumn("units", of_leaf.cast("long")).limit(bound + 1).collect()]
    trees = {r["tree"] for r in nodes}
    if len(nodes) > bound or not trees or max(trees) >= n_trees:
        raise ValueError(f"forest has no trees, more than {n_trees} trees or {bound} nodes")
    means, scales = (scaler.means, scaler.scales) if scaler else ([0.0] * len(features), [1.0] * len(features))
    raw = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    inputs = [(x - F.lit(m)) / F.lit(s) if scaler else x for x, m, s in zip(raw, means, scales)]
    x, mean = "_forest_x", "_forest_mean"
    while x in df.columns or mean in df.columns:
        x, mean = x + "_", mean + "_"
    walk = ml_forest(df.sparkSession, nodes, len(trees), len(features)).setFeaturesCol(x).setPredictionCol(mean)
    walked = walk.transform(df.withColumn(x, array_to_vector(F.array(*inputs))))
    total = F.round(F.col(mean) * len(trees)).cast("long")      # whole units, far under 2^53: the mean's rounding is undone
    most = F.lit(len(trees)) * F.greatest(average_path_units(F.lit(psi)), F.lit(1))
    return walked.withColumn(out, F.pow(F.lit(2.0), -total / most)).drop(x, mean)


def label(scored: DataFrame, contamination: float = config.CONTAMINATION,
          col: str = "anomaly_probability", n: int | None = None) -> tuple[DataFrame, float]:
    """Cut at the exact (1 - contamination) quantile: label -1 (anomaly) / 1 and a boolean.

    ``n``, when known, is the number of scored rows (every row gets a score), which saves a count.
    """
    (cut,) = exact_percentiles(scored, col, [1.0 - contamination], n=n)
    is_anom = F.col(col) > F.lit(cut)
    return scored.select(
        "*",
        F.when(is_anom, F.lit(-1)).otherwise(F.lit(1)).alias("anomaly_score"),
        is_anom.alias("is_anomaly_ml"),
    ), cut
