"""Whole jobs, and state in tasks that does not grow with the tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from defectflow.operators import metrics

SF = "/root/testdata/sf0.001"


def test_classified_triage_covers_every_finding(spark):
    from defectflow.plans.catalog import ORACLES, QUERIES

    out = QUERIES["triage_classified"](spark, SF).agg(F.sum("rows").alias("rows"), F.sum("learned").alias("learned")).first()
    assert out.rows == out.learned == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert "% 7 = 0" not in ORACLES["triage_classified"]


def test_model_outputs_leave_the_worker_call_by_call():
    from defectflow.operators.providers import _batched

    calls = []

    def factory():
        def model(texts):
            calls.append(len(texts))
            return [[float(len(t))] for t in texts]
        return model

    out = _batched(factory, "array<double>", 2, {}).func(iter([pd.Series(["a", "bb", "ccc", "dd", "e"])]))
    assert len(next(out)) == 2 and calls == [2]
    assert [v for part in out for v in part] == [[3.0], [2.0], [1.0]]


def test_static_scores_take_some_pairs_at_a_time(spark):
    def factory():
        def model(tokens):
            assert len(tokens) <= 1_024
            return [[1.0, float(len(t))] for t in tokens]
        return model

    rows = spark.range(3_000, numPartitions=1).select("id", F.concat(F.lit("p"), "id").alias("p"), F.concat(F.lit("r"), "id").alias("r"))
    out = metrics.bertscore(rows, ["id"], "p", "r", factory=factory).agg(F.count("*").alias("n"), F.avg("f1").alias("f1")).first()
    assert out.n == 3_000 and out.f1 == pytest.approx(1.0)


def test_alignment_meets_forms_within_a_row(spark):
    rows = [(1, "big dogs run", "large dog ran fast"), (2, "a b a b", "b a b a"), (3, "", "x"), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, p string, r string")
    words = spark.createDataFrame([("big", 1), ("large", 1), ("run", 2), ("ran", 2)], "word string, group int")
    out = metrics.meteor(df, ["id"], "p", "r", synonyms=words)
    assert {r.id: (r.matches, r.chunks) for r in out.collect()} == {1: (3, 1), 2: (4, 4), 3: (0, 0), 4: (0, 0)}
    plan = metrics.meteor(df, ["id"], "p", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan  # no row for each token


def test_overlap_scores_from_one_pass(spark):
    rows = [(1, "the running dogs ran", "the dog runs and ran"), (2, "one", "one"), (3, "", None), (4, "a b a b c", "b a b c c")]
    df = spark.createDataFrame(rows, "id int, p string, r string")
    both = metrics.rouge_scores(df, ["id"], "p", "r")
    apart = {"rouge1": metrics.rouge_n(df, ["id"], "p", "r", 1), "rouge2": metrics.rouge_n(df, ["id"], "p", "r", 2), "rougeL": metrics.rouge_l(df, ["id"], "p", "r")}
    for name, one in apart.items():
        assert {tuple(r) for r in both.where(F.col("metric") == name).drop("metric").collect()} == {tuple(r) for r in one.collect()}
    assert both._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 2


def test_stems_are_remembered_up_to_a_bound():
    from defectflow.functions import stemming

    assert stemming._remembered("running", True) == stemming.porter_stem("running", True)
    assert stemming._remembered.cache_info().maxsize == 1 << 17


def test_distances_of_near_and_far_points():
    from defectflow.operators.blocks import distances

    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(40, 6)), 1e6 + rng.normal(size=(40, 6)) * 1e-3))
    y = np.concatenate((x[::3], rng.normal(size=(20, 6))))
    plain = np.linalg.norm(x[:, None] - y[None], axis=2)
    assert distances(x, y) == pytest.approx(plain, rel=1e-9, abs=1e-12) and (distances(x, y)[plain == 0] == 0).all()


def test_all_pairs_are_not_shuffled(spark):
    from defectflow.operators import clustering as cl
    from defectflow.operators.agglomeration import merge_tree

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3) + 4 * (i % 3)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>, l int")
    scored = cl.silhouette_exact(df, "v", ["l"], block_rows=16)
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()  # blocks used to meet by a join
    points, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    gap = np.linalg.norm(points[:, None] - points[None], axis=2)
    sums = np.stack([gap[:, label == c].sum(axis=1) for c in range(3)], axis=1)
    own = sums[np.arange(90), label] / 29
    sums[np.arange(90), label] = np.inf
    other = sums.min(axis=1) / 30
    assert scored.first().silhouette == pytest.approx(((other - own) / np.maximum(own, other)).mean(), abs=1e-12)
    usable = df.select("id", "v", F.lit(1.0).alias("w"))
    few, many = (merge_tree(usable, "ward", last).merges.orderBy("step").toPandas() for last in (1, 1_024))
    assert (few[["low", "high"]] == many[["low", "high"]]).all().all() and np.allclose(few.height, many.height)


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_trees_without_a_table_of_distances(spark, linkage, monkeypatch):
    from defectflow.operators import agglomeration

    rng = np.random.default_rng(5)
    points = np.concatenate((rng.normal(size=(150, 3)), rng.normal(size=(70, 3)) * 0.2 + 6, [[30.0, 0.0, 0.0]]))
    df = spark.createDataFrame([(i, [float(x) for x in p], float(1 + i % 3)) for i, p in enumerate(points)], "id long, v array<double>, w double")
    written = []
    keep = agglomeration.scratch_path
    monkeypatch.setattr(agglomeration, "scratch_path", lambda s, purpose: written.append((purpose, keep(s, purpose))) or written[-1][1])
    whole = agglomeration.merge_tree(df, linkage).merges.orderBy("step").toPandas()
    assert [purpose for purpose, _ in written] == ["tree-points"]  # a row of it held the distances to all clusters
    # Clusters in pieces, points written again, every merge found by the executors.
    monkeypatch.setattr(agglomeration._LinkageRounds, "piece", 7)
    monkeypatch.setattr(agglomeration._LinkageRounds, "loose", 5)
    tree = agglomeration.merge_tree(df, linkage, 1)
    merges = tree.merges.orderBy("step").toPandas()
    assert (merges[["low", "high"]] == whole[["low", "high"]]).all().all() and np.allclose(merges.height, whole.height, rtol=1e-9)
    assert len([p for p, _ in written if p == "tree-points"]) > 3 and {f.name for f in spark.read.parquet(written[-1][1]).schema} == {"leaf", "run", "vector", "w"}
    assert sorted(r.labels[0] for r in tree.leaf_labels([4]).collect())[-1] == 3


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_trees_of_equal_heights(spark, linkage):
    from defectflow.operators.agglomeration import merge_tree

    df = spark.createDataFrame([(9 * x + y, [float(x), float(y)], 1.0) for x in range(9) for y in range(9)], "id long, v array<double>, w double")
    merges = merge_tree(df, linkage, 1).merges.orderBy("step").toPandas()
    assert len(merges) == 80 and merges["size"].max() == 81 and merges.height[:32].tolist() == [1.0] * 32
    made = {}
    for m in merges.itertuples():  # no cluster comes before its parts
        assert made.get(m.low, 1) + made.pop(m.high, 1) == m.size
        made[m.low] = m.size


def test_written_forest(spark, tmp_path):
    from defectflow.operators import models
    from defectflow.operators.forest import Forest

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 0.7 * (i % 3)], f"class {i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>, rec string")
    # One fit: the very forest that the driver would hold.
    held = models.predict_recommendation(df, "v", models.train_classifier(df, "v", "rec", trees=7, depth=6))
    written = models.predict_recommendation(df, "v", Forest.write(df, "v", "rec", trees=7, depth=6))
    assert held.columns == written.columns and sorted(held.collect()) == sorted(written.collect())
    # Three fits of two or three trees: as many trees, each of them whole.
    forest = Forest.write(df, "v", "rec", trees=7, path=str(tmp_path / "forest"), held=450)
    nodes = spark.read.parquet(forest.path)
    assert sorted(r.tree for r in nodes.select("tree").distinct().collect()) == list(range(7))
    assert nodes.groupBy("tree").agg((F.max("id") + 1 == F.count("*")).alias("dense")).where("not dense").count() == 0
    out = models.predict_recommendation(df.union(spark.createDataFrame([(-1, None, None)], df.schema)), "v", forest)
    assert out.where("predicted_recommendation = rec").count() > 180 and out.where("id = -1").first().predicted_recommendation is None


def test_equal_texts_teach_once(spark):
    from defectflow.plans.catalog import monitoring, topics
    from defectflow.sources.demo import findings

    rows = findings(spark, SF)
    plan = monitoring.text_centroids(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("count(1)") > plan.rindex("densify")  # texts are brought together below their embedding
    seen = []
    fit = topics.models.train_classifier
    try:
        topics.models.train_classifier = lambda df, *a, **k: seen.append(df) or fit(df, *a, **k)
        topics.taught_classifier(rows)
    finally:
        topics.models.train_classifier = fit
    assert seen[0].agg(F.sum("copies")).first()[0] == rows.count() and seen[0].count() < 200


def test_single_tree_sees_every_row(spark):
    from defectflow.operators import models

    df = spark.createDataFrame([([float(i), float(i % 2)], f"class {i}", 1.0) for i in range(12)], "v array<double>, rec string, w double")
    out = models.predict_recommendation(df, "v", models.train_classifier(df, "v", "rec", trees=1, weight="w"))
    assert out.where("predicted_recommendation = rec").count() == 12


def test_labels_stay_in_python(spark):
    from defectflow.plans.training import train_topics, training_rows

    df = spark.createDataFrame([(i, f"valve stuck {'x' * (i % 9)}" if i % 5 else "") for i in range(60)], "id int, description string")
    out = training_rows(train_topics(df, "id", k=3, cells=6)).select("id", "cluster", "topic")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # embedded and labelled in one step
    assert {r.id for r in out.where("cluster is null").collect()} == {i for i in range(60) if not i % 5}


def test_many_distinct_vectors_are_not_all_compared(spark, monkeypatch):
    from defectflow.operators import clustering as cl

    df = spark.createDataFrame([(i, [float(i % 40), 1.0]) for i in range(400)], "id long, v array<double>")
    asked = []
    monkeypatch.setattr(cl, "bounded_table", lambda table, n, f=cl.bounded_table: asked.append(n) or f(table, n))
    assert cl.topic_tree(df, "id", "v", "micro", cells=10).sizes.sum() == 400 and not asked
    assert len(cl.topic_tree(df, "id", "v", "micro", cells=64).sizes) == 40 and asked == [64]


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 1e4), (1e-12, 0.0), (1e20, 0.0)])
@pytest.mark.parametrize("even", [True, False])
def test_nearest_clusters_are_exact_in_single_precision(scale, offset, even):
    import tracemalloc

    from defectflow.operators.agglomeration import _nearest_of_all

    rng = np.random.default_rng(4)
    points = (rng.normal(size=(700, 12)) + offset) * scale
    points[300:340] = points[100:140]
    points[500] = points[400] + 1e-9 * scale
    sizes, keys = np.ones(700) if even else rng.integers(1, 6, 700).astype(float), rng.permutation(700)
    gap = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2)) * np.sqrt(2.0 * sizes[:, None] * sizes / (sizes[:, None] + sizes))
    np.fill_diagonal(gap, np.inf)
    at = np.argsort(keys)
    want = keys[at[gap[:, at].argmin(axis=1)]]
    slices = [(keys[i : i + 256], points[i : i + 256], sizes[i : i + 256]) for i in range(0, 700, 256)]
    got = _nearest_of_all(keys, points, sizes, iter(slices))
    assert (got["c"] == keys).all() and (np.where(got["low"] == keys, got["high"], got["low"]) == want).all()
    np.testing.assert_allclose(got["height"], gap.min(axis=1), rtol=1e-12, atol=0)
    if scale == 1.0 and offset == 0:
        many = rng.normal(size=(4_096, 12))
        part = [(np.arange(4_096), many, np.ones(4_096) if even else rng.integers(1, 6, 4_096).astype(float))]
        tracemalloc.start()
        _nearest_of_all(np.arange(4_096), many, part[0][2], iter(part))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < (5.2e6 if even else 6.8e6)  # 5.9 and 8.0 MB in double precision
