"""Isolation Forest properties (fit and score are Spark jobs)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anomalytics.operators import iforest
from anomalytics.operators.detector import with_isolation_forest

FEATS = ("a", "b")


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(0, 1, (2000, 2))
    far = rng.uniform(8, 10, (20, 2)) * rng.choice([-1, 1], (20, 2))
    X = np.vstack([normal, far])
    pdf = pd.DataFrame({"order_id": np.arange(len(X)), "a": X[:, 0], "b": X[:, 1]})
    return spark.createDataFrame(pdf), set(range(2000, 2020))


def _fit_score(df, parts):
    d = df.repartition(parts)
    model = iforest.fit(d, FEATS, n_trees=30, seed=42)
    nodes = model.toPandas()
    psi = min(256, d.count())
    scored = iforest.score(d, model, psi, FEATS).select("order_id", "anomaly_probability").toPandas()
    return nodes.sort_values(["tree", "node"]).reset_index(drop=True), scored.set_index("order_id").sort_index()


def test_same_result_for_any_partitioning(planted):
    df, _ = planted
    n1, s1 = _fit_score(df, 1)
    for parts in (4, 17):
        n2, s2 = _fit_score(df, parts)
        pd.testing.assert_frame_equal(n1, n2)
        assert np.array_equal(s1["anomaly_probability"].to_numpy(), s2["anomaly_probability"].to_numpy())


def test_planted_points_score_highest_and_scores_in_range(planted):
    df, far = planted
    _, s = _fit_score(df, 4)
    assert ((s["anomaly_probability"] > 0) & (s["anomaly_probability"] <= 1)).all()
    top = set(s["anomaly_probability"].sort_values(ascending=False).index[:20])
    assert len(top & far) >= 18


def _walk(nodes, tree, x):
    t = nodes[nodes["tree"] == tree].set_index("node")
    k = 0
    while not t.loc[k, "leaf"]:
        k = t.loc[k, "left"] if x[t.loc[k, "feature"]] < t.loc[k, "threshold"] else t.loc[k, "right"]
    size = t.loc[k, "size"]
    c = 0.0 if size <= 1 else (1.0 if size == 2 else 2 * (math.log(size - 1) + 0.5772156649015329) - 2 * (size - 1) / size)
    return t.loc[k, "depth"] + c


def test_score_equals_plain_walk(spark, planted):
    df, _ = planted
    nodes, _ = _fit_score(df, 2)
    X = np.array([[0.1, -0.2], [9.0, 9.0], [-1.5, 2.0]])
    c = 2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256
    want = [2 ** (-np.mean([_walk(nodes, t, x) for t in range(30)]) / c) for x in X]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "order_id int, a double, b double")
    got = iforest.score(points, spark.createDataFrame(nodes, iforest.NODE_SCHEMA), 256, FEATS)
    assert np.allclose([r.anomaly_probability for r in got.orderBy("order_id").collect()], want, atol=1e-8)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_nulls_are_zero_and_one_row_forest(spark):
    rows = [("x", None, 1.0), ("y", 0.0, 1.0), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "order_id string, a double, b double")
    model = iforest.fit(df, FEATS, n_trees=5)
    got = {r.order_id: r.anomaly_probability for r in iforest.score(df, model, 3, FEATS, n_trees=5).collect()}
    assert got["x"] == got["y"] < got[None]
    one = df.where("order_id = 'x'")
    assert iforest.score(one, iforest.fit(one, FEATS, n_trees=5), 1, FEATS, n_trees=5).first()["anomaly_probability"] == 1.0


def test_thresholds_split_every_node(planted):
    df, _ = planted
    nodes, _ = _fit_score(df, 3)
    sizes = {(r.tree, r.node): r.size for r in nodes.itertuples()}
    for r in nodes[~nodes["leaf"]].itertuples():
        assert sizes[r.tree, r.left] + sizes[r.tree, r.right] == r.size and r.depth < 8
    assert all(nodes[nodes["leaf"] & (nodes["depth"] < 8)]["size"] >= 1)


def test_contamination_share(planted):
    df, _ = planted
    res = with_isolation_forest(df.withColumnRenamed("a", "total_amount").withColumnRenamed("b", "total_items"),
                                features=("total_amount", "total_items"), n_trees=30)
    n = res.scored.count()
    flagged = res.scored.where(F.col("is_anomaly_ml")).count()
    assert flagged <= math.ceil(0.05 * n) and flagged >= 0.04 * n
    labels = {r[0] for r in res.scored.select("anomaly_score").distinct().collect()}
    assert labels <= {-1, 1}


def test_affine_change_keeps_ranking(planted):
    df, _ = planted
    _, s1 = _fit_score(df, 3)
    z1 = iforest.standardize(df, FEATS)
    z2 = iforest.standardize(df.select("order_id", (F.col("a") * 3 + 7).alias("a"), (F.col("b") * 0.5 - 2).alias("b")), FEATS)
    a = z1.orderBy("order_id").toPandas()
    b = z2.orderBy("order_id").toPandas()
    assert np.allclose(a[list(FEATS)].to_numpy(), b[list(FEATS)].to_numpy(), atol=1e-9)


def test_in_task_scaling_equals_spark_scaling(planted):
    df, _ = planted
    scaler = iforest.fit_scaler(df, FEATS)
    z = iforest.standardize(df, FEATS, scaler=scaler)
    model = iforest.fit(z, FEATS, n_trees=20, seed=7)
    a = iforest.score(z, model, 256, FEATS).select("order_id", "anomaly_probability").toPandas()
    b = iforest.score(df, model, 256, FEATS, scaler=scaler).select("order_id", "anomaly_probability").toPandas()
    a = a.sort_values("order_id").reset_index(drop=True)
    b = b.sort_values("order_id").reset_index(drop=True)
    assert np.array_equal(a["anomaly_probability"].to_numpy(), b["anomaly_probability"].to_numpy())


def test_pool_path_full_samples_and_partition_free(planted):
    # 4 * T * psi = 384 < n = 2020, so the uniform pool is drawn and written before the per-tree samples
    df, _ = planted
    fits = []
    for parts in (1, 5):
        nodes = iforest.fit(df.repartition(parts), FEATS, n_trees=3, max_samples=32, seed=11).toPandas()
        fits.append(nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    pd.testing.assert_frame_equal(fits[0], fits[1])
    leaves = fits[0][fits[0]["leaf"]]
    assert leaves.groupby("tree")["size"].sum().tolist() == [32, 32, 32]
    assert fits[0].groupby("tree").size().max() <= 2 * 32 - 1


def test_oversized_model_is_refused(spark, planted):
    df, _ = planted
    # psi = 2 and one tree allow at most 3 nodes; a 4-node table is refused before it is used
    rows = [(0, k, -1, 0.0, -1, -1, 1, 0, True) for k in range(4)]
    model = spark.createDataFrame(rows, iforest.NODE_SCHEMA)
    with pytest.raises(ValueError):
        iforest.score(df, model, 2, FEATS, n_trees=1)
    with pytest.raises(ValueError):   # a tree id beyond n_trees
        iforest.score(df, model.where("node = 0").selectExpr("1 AS tree", "node", "feature", "threshold", "left",
                                                             "right", "size", "depth", "leaf"), 2, FEATS, n_trees=1)


def test_scores_of_odd_values_come_from_compiled_trees(spark, planted):
    # NaN is the largest value, a value at a threshold goes right, -0.0 is 0.0; no lambda is interpreted row by row
    df, _ = planted
    nodes, _ = _fit_score(df, 2)
    at = nodes[~nodes["leaf"]].iloc[:4]["threshold"].tolist()
    values = [float("nan"), float("inf"), -float("inf"), -0.0, 0.0, *at]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in values for b in values)]
    model = spark.createDataFrame(nodes, iforest.NODE_SCHEMA)
    got = iforest.score(spark.createDataFrame(rows, "order_id int, a double, b double"), model, 256, FEATS, n_trees=30)
    assert got.columns == ["order_id", "a", "b", "anomaly_probability"]
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    c = 2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256
    found = {r.order_id: r.anomaly_probability for r in got.collect()}
    for i, a, b in rows[::5]:
        x = [math.inf if math.isnan(v) else v for v in (a, b)]      # no threshold is beyond both
        assert abs(found[i] - 2 ** (-np.mean([_walk(nodes, t, x) for t in range(30)]) / c)) < 1e-8
