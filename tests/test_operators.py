import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectflow.functions.rules import parse_steps
from defectflow.functions.vectors import cosine_similarity, euclidean_distance, hash_embedding, l2_normalize
from defectflow.operators import clustering as cl, metrics, models, monitoring as mon, stats
from defectflow.operators.lookups import keyed_join, top_per_group
from defectflow.operators.providers import embed_text, embed_token_table, generate_text
from defectflow.operators.topics import Centroids, cluster_centroids, nearest_centroid, nearest_centroid_blocked


def vectors(spark, points, labels=None):
    rows = [(i, [float(x) for x in p], int(labels[i]) if labels is not None else 0) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int")


def cloud(n=60, dims=4, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dims)) * 4
    return centers[rng.integers(0, 5, n)] + rng.normal(size=(n, dims))


# vectors -------------------------------------------------------------------

def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), (None, [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(l2_normalize(F.col("a")).alias("u"), l2_normalize(F.col("b")).alias("z"),
                     euclidean_distance(F.col("a"), F.col("b")).alias("d"),
                     cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].u == [0.6, 0.8] and rows[0].z == [0.0, 0.0] and rows[0].d == 5.0 and rows[0].c == 0.0
    assert rows[1].u is None and rows[1].d is None and rows[1].c is None
    assert rows[2].c == pytest.approx(2 ** -0.5)


def test_hash_embedding_of_empty_and_repeated_text(spark):
    df = spark.createDataFrame([("leak leak pump",), ("",), (None,)], "t string")
    rows = [np.array(r.v) for r in df.select(hash_embedding(F.col("t")).alias("v")).collect()]
    assert sorted(rows[0][rows[0] > 0]) == pytest.approx([1 / 3, 2 / 3]) and len(rows[0]) == 384
    assert not rows[1].any() and not rows[2].any()


def test_nearest_centroid_narrow_and_blocked_agree(spark):
    points = cloud(120)
    df = vectors(spark, np.concatenate([points, points[:30]]))
    table = spark.createDataFrame([(int(i), [float(x) for x in p]) for i, p in enumerate(points[::7])], "cluster_id int, centroid array<double>")
    near = {r.id: (r.cluster_id, round(r.distance, 9)) for r in nearest_centroid(df, "v", table).collect()}
    many = {r.id: (r.cluster_id, round(r.distance, 9)) for r in nearest_centroid_blocked(df, "v", table, 16).collect()}
    gaps = np.linalg.norm(np.concatenate([points, points[:30]])[:, None] - points[::7][None], axis=2)
    assert near == many == {i: (int(g.argmin()), round(float(g.min()), 9)) for i, g in enumerate(gaps)}
    held = nearest_centroid(df, "v", Centroids.from_table(table))
    assert {r.id: (r.cluster_id, round(r.distance, 9)) for r in held.collect()} == near
    with pytest.raises(ValueError, match="CentroidIndex"):
        Centroids.from_table(table, max_rows=3)


def indexed(points, table, tmp_path):
    """Lookups in this process, cell by cell."""
    from defectflow.operators import centroid_index as ci

    index = ci.CentroidIndex.write(table, f"file://{tmp_path}/index")
    return index, ci.look_up(points, ci._Cells(index.path), index.ids, index.centers, index.radii)


@pytest.mark.parametrize("spread", [0.3, 30.0])
def test_index_of_many_centroids_is_exact(spark, tmp_path, monkeypatch, spread):
    from defectflow.operators import centroid_index as ci

    rng = np.random.default_rng(4)
    places = rng.normal(size=(3_000, 3)) * np.array([spread, 5, 1]) + rng.integers(0, 4, (3_000, 1)) * 20
    places[1_000:1_900] = places[7]  # a third of all centroids are one point
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(places)], "cluster_id int, centroid array<double>")
    points = np.concatenate([rng.normal(size=(400, 3)) * 30, places[:100], places[1_500:1_510]])
    monkeypatch.setattr(ci, "_SLICE", 50)
    monkeypatch.setattr(ci, "_HELD_BYTES", 20_000)
    monkeypatch.setattr(ci, "_GAPS", 5_000)
    index, (ids, gaps) = indexed(points, table, tmp_path)
    wanted = np.sqrt(((points[:, None] - places[None]) ** 2).sum(axis=2))
    assert ids.tolist() == wanted.argmin(axis=1).tolist() and gaps == pytest.approx(wanted.min(axis=1))
    assert 30 <= len(index.ids) <= 55  # equal centroids chosen as centers are one
    again = ci.CentroidIndex.load(spark, index.path)
    assert (again.radii == index.radii).all() and (again.centers == index.centers).all()
    rows = nearest_centroid(vectors(spark, points), "v", again).collect()
    assert [(r.id, r.cluster_id) for r in sorted(rows)] == list(enumerate(ids.tolist()))


def test_index_reads_few_cells_where_centroids_lie_apart(spark, tmp_path):
    from defectflow.operators import centroid_index as ci

    rng = np.random.default_rng(5)
    places = rng.uniform(0, 1_000, size=(2_500, 2))
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(places)], "cluster_id int, centroid array<double>")
    index = ci.CentroidIndex.write(table, f"file://{tmp_path}/index")
    cells = ci._Cells(index.path)
    read = set()
    slices = cells.slices
    cells.slices = lambda cell: read.add(cell) or slices(cell)
    points = rng.uniform(0, 50, size=(50, 2))
    ids, _ = ci.look_up(points, cells, index.ids, index.centers, index.radii)
    assert ids.tolist() == ((points[:, None] - places[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    assert len(read) < len(index.ids) / 3
    with pytest.raises(ValueError, match="empty"):
        ci.CentroidIndex.write(table.limit(0))


def test_nearest_centroid_ties_and_nulls(spark):
    table = spark.createDataFrame([(5, [1.0, 0.0]), (2, [-1.0, 0.0]), (9, [1.0, 0.0])], "cluster_id int, centroid array<double>")
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None)], "id int, v array<double>")
    rows = {r.id: r for r in nearest_centroid(df, "v", table).collect()}
    assert rows[0].cluster_id == 2 and rows[1].cluster_id == 5 and rows[1].distance == 0.0 and rows[2].cluster_id is None
    with pytest.raises(ValueError):
        Centroids.from_table(table.limit(0))


def test_centroids_with_copies(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0], 3.0), (0, [5.0, 7.0], 1.0), (1, [2.0, 2.0], 2.0)], "c int, v array<double>, w double")
    out = {r.cluster_id: (r.centroid, r.size) for r in cluster_centroids(df, "c", "v", "w").collect()}
    assert out == {0: ([2.0, 4.0], 4), 1: ([2.0, 2.0], 2)}


# joins and rankings --------------------------------------------------------

def test_keyed_join_keeps_every_row(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 5000}") for i in range(9000)] + [(9001, None)]
    df = spark.createDataFrame(rows, "id long, k string")
    table = spark.createDataFrame([("hot", 1), (None, -1)] + [(f"k{i}", i) for i in range(0, 5000, 2)], "k string, x int")
    held = {r.k: r.x for r in table.collect()}
    got = keyed_join(df, table, ["k"])
    assert got.columns == ["id", "k", "x"]
    assert {r.id: r.x for r in got.collect()} == {i: held.get(k) for i, k in rows}
    inner = keyed_join(df, table, ["k"], "inner")
    assert {r.id: r.x for r in inner.collect()} == {i: held[k] for i, k in rows if k in held}


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(i, None if i < 500 else "a") for i in range(1000)], "id long, s string")
    split = stats.stratified_split(df, "s", "id").groupBy("s", "split").count().collect()
    assert {(r.s, r.split): r["count"] for r in split} == {
        (s, name): n for s in (None, "a") for name, n in (("train", 350), ("val", 75), ("test", 75))}
    values = df.withColumn("x", F.col("id").cast("double"))
    medians = {r.s: r.q0 for r in stats.exact_quantiles(values, ["s"], "x", [0.5]).collect()}
    assert medians == {None: 249.5, "a": 749.5}


def test_describe_without_values(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    for df in (empty, empty.limit(0)):
        rows = stats.describe(df, "x").collect()
        assert len(rows) == 1 and rows[0]["count"] == 0 and rows[0]["mean"] is None and rows[0]["p50"] is None


def test_steps_with_amounts_and_long_numbers(spark):
    texts = ["Actions: 1. a 99999999999. b", "1. Torque to 5. Nm 2. Check", "[STEPS:2] Actions: 1. x 2. y", "99999999999. z", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parse_steps(F.col("t")).alias("p"))
    got = {r.i: ([(s.step, s.action) for s in r.p.steps], r.p.consistent) for r in df.collect()}
    assert got == {
        0: ([(1, "a 99999999999. b")], False), 1: ([(1, "Torque to 5. Nm"), (2, "Check")], False),
        2: ([(1, "x"), (2, "y")], True), 3: ([], False), 4: ([], False)}


def test_alignment_scores_in_any_script(spark):
    from defectflow.operators.metrics import bertscore, meteor

    same, other = "утечка масла у насоса café", "caf cr me"
    pairs = spark.createDataFrame([(0, same, same), (1, "café crème", other), (2, "", "a")], "i int, p string, r string")
    assert {r.i: round(r.f1, 6) for r in bertscore(pairs, ["i"], "p", "r").collect()}[0] == 1.0
    scores = {r.i: r for r in meteor(pairs, ["i"], "p", "r", stemmer=False).collect()}
    assert scores[0].matches == 5 and scores[1].matches == 0 and scores[2].score == 0
    lengths = bertscore(pairs, ["i"], "p", "r", factory=lambda: lambda tokens: [[1.0, len(t)] for t in tokens])
    assert {r.i: round(r.f1, 6) for r in lengths.collect()}[0] == 1.0


def test_top_per_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g"))
    out = top_per_group(df, ["g"], [F.desc("id")], 4).collect()
    values = {}
    for r in df.collect():
        values.setdefault(r.g, []).append(r.id)
    assert {(r.g, r["rank"], r.id) for r in out} == {
        (g, i + 1, x) for g, xs in values.items() for i, x in enumerate(sorted(xs, reverse=True)[:4])}


# statistics ----------------------------------------------------------------

def test_exact_quantiles_beyond_the_sketch(spark):
    rng = np.random.default_rng(3)
    heavy = np.concatenate([np.full(20_000, 1.5), rng.normal(size=40_000)])  # a third of the rows are one value
    small = rng.normal(size=11)
    rows = [("a", float(x)) for x in heavy] + [("b", float(x)) for x in small] + [("c", 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    out = {r.g: [r[f"q{i}"] for i in range(5)] for r in stats.exact_quantiles(df, ["g"], "x", probs, accuracy=500).collect()}
    assert out["a"] == pytest.approx(np.quantile(heavy, probs)) and out["b"] == pytest.approx(np.quantile(small, probs))
    assert out["c"] == [2.0] * 5


def test_describe_and_counts(spark):
    df = spark.createDataFrame([(3,), (4,), (4,), (5,), (None,)], "n int")
    row = stats.describe(df, "n").first()
    assert (row["count"], row["mean"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]) == (4, 4.0, 3.0, 3.75, 4.0, 4.25, 5.0)
    assert row["std"] == pytest.approx(np.std([3, 4, 4, 5], ddof=1))
    assert [tuple(r) for r in stats.value_counts(df, "n").collect()] == [(4, 2), (3, 1), (5, 1)]
    assert [r.n for r in stats.value_counts(df, "n", by="key").collect()] == [3, 4, 5]


def test_split_sizes_are_exact_and_stable(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 11).alias("s"))
    out = stats.stratified_split(df, "s", "id")
    sizes = {(r.s, r.split): r["count"] for r in out.groupBy("s", "split").count().collect()}
    for r in df.groupBy("s").count().collect():
        n = r["count"]
        cut = [int(np.floor(n * 0.70 + 0.5)), int(np.floor(n * 0.85 + 0.5))]
        assert [sizes.get((r.s, k), 0) for k in ("train", "val", "test")] == [cut[0], cut[1] - cut[0], n - cut[1]]
    again = stats.stratified_split(df.repartition(13), "s", "id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert sum(r.rows for r in stats.split_report(out).collect()) == 3000


def test_tiny_strata(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, s string")
    out = {r.id: r.split for r in stats.stratified_split(df.where("s is not null"), "s", "id").collect()}
    assert set(out) == {1, 2, 3} and out[1] == "train"


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("c"))
    first = [r.id for r in stats.seeded_sample(df, "id", 5).collect()]
    assert first == [r.id for r in stats.seeded_sample(df.repartition(5), "id", 5).collect()] and len(set(first)) == 5
    assert [r.id for r in stats.head(df, 3, "id").collect()] == [0, 1, 2]
    groups = stats.group_samples(df, "c", "id", 5).groupBy("c").count().collect()
    assert {(r.c, r["count"]) for r in groups} == {(0, 5), (1, 5), (2, 5)}


# clustering ----------------------------------------------------------------

def agglomerate(points, linkage, k):
    """Plain agglomeration from the definition of each linkage."""
    groups = [[i] for i in range(len(points))]
    heights = []

    def gap(a, b):
        if linkage == "ward":
            d = points[a].mean(axis=0) - points[b].mean(axis=0)
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * (d @ d))
        pairs = np.linalg.norm(points[a][:, None] - points[b][None], axis=2)
        return pairs.mean() if linkage == "average" else pairs.max()

    cut = None
    while len(groups) > 1:
        if len(groups) == k:
            cut = sorted(sorted(g) for g in groups)
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda ij: gap(groups[ij[0]], groups[ij[1]]))
        heights.append(gap(groups[i], groups[j]))
        groups[i] += groups.pop(j)
    return cut, heights


@pytest.mark.parametrize("linkage", cl.LINKAGES)
def test_trees_match_plain_agglomeration(spark, linkage):
    points = cloud(45)
    df = vectors(spark, points)
    # As many cells as points: every cell is a point.
    tree = cl.topic_tree(df, "id", "v", "micro", cells=45, linkage=linkage)
    cut, heights = agglomerate(points, linkage, 7)
    assert [h[2] for h in tree.history] == pytest.approx(heights)
    out = tree.label(df, "v", [7], "c").select("id", F.col("c")[0].alias("c")).collect()
    groups = [sorted(r.id for r in out if r.c == c) for c in range(7)]
    assert sorted(groups) == cut and [g[0] for g in groups] == sorted(g[0] for g in groups)
    merges = tree.merge_table(spark)
    assert merges.count() == 44 and cl.last_merges(merges, 30).count() == 30
    assert merges.orderBy(F.desc("step")).first()["size"] == 45


@pytest.mark.parametrize("linkage, last", [("ward", 1), ("ward", 12), ("ward", 256), ("average", 1), ("average", 20), ("complete", 3)])
def test_exact_method_matches_plain_agglomeration(spark, linkage, last):
    points = np.concatenate([cloud(45), cloud(45)[:6]])  # six points occur twice
    df = vectors(spark, points)
    tree = cl.topic_tree(df, "id", "v", "exact", linkage=linkage, last=last)
    cut, heights = agglomerate(points, linkage, 7)
    merges = tree.merge_table().orderBy("step").collect()
    assert [m.distance for m in merges] == pytest.approx([h for h in heights if h > 1e-9])
    assert [m.step for m in merges] == list(range(44)) and merges[-1]["size"] == 51
    used = [x for m in merges for x in (m.left, m.right)]
    assert sorted(used) == list(range(45 + 43))  # every cluster but the last is merged once
    out = tree.label(df, "v", [7, 3], "c").collect()
    groups = [sorted(r.id for r in out if r.c[0] == c) for c in range(7)]
    assert sorted(groups) == cut and [g[0] for g in groups] == sorted(g[0] for g in groups)
    assert len({(r.c[0], r.c[1]) for r in out}) == 7 and {r.c[1] for r in out} == {0, 1, 2}


def test_method_is_the_callers_choice(spark):
    df = vectors(spark, cloud(30))
    for bad in ({"method": "exact", "cells": 5}, {"method": "micro"}, {"method": "fast"}, {"method": "exact", "linkage": "single"}):
        with pytest.raises(ValueError):
            cl.topic_tree(df, "id", "v", **bad)
    nulls = df.withColumn("v", F.when(F.col("id") > 3, F.col("v")))
    labels = {r.id: r.cluster for r in cl.ward_cluster(nulls, "id", "v", 4).collect()}
    assert [labels[i] for i in range(4)] == [None] * 4 and {labels[i] for i in range(4, 30)} == {0, 1, 2, 3}


def test_micro_clusters_cover_all_rows_and_stay_close(spark):
    points = cloud(600, 4)
    df = vectors(spark, points)
    rough = cl.topic_tree(df, "id", "v", "micro", cells=60)
    assert rough.sizes.sum() == 600 and len(rough.sizes) <= 60
    heights = [h[2] for h in rough.history]
    assert heights == sorted(heights)

    def scatter(labels):
        return sum(((points[labels == c] - points[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels))

    whole = cl.topic_tree(df, "id", "v", "exact")
    found = [np.array([r.c[0] for r in t.label(df, "v", [5], "c").orderBy("id").collect()]) for t in (rough, whole)]
    assert scatter(found[0]) <= 1.1 * scatter(found[1])


def test_copies_weigh_in(spark):
    points = cloud(30)
    repeated = np.concatenate([points, np.repeat(points[:1], 20, axis=0)])
    weighted = vectors(spark, points).withColumn("w", F.when(F.col("id") == 0, 21).otherwise(1))
    a = cl.topic_tree(vectors(spark, repeated), "id", "v", "exact").merge_table()
    b = cl.topic_tree(weighted, "id", "v", "exact", weight="w").merge_table()
    assert [m.distance for m in a.orderBy("step").collect()] == pytest.approx([m.distance for m in b.orderBy("step").collect()])


def silhouette(points, labels, power):
    gap = np.linalg.norm(points[:, None] - points[None], axis=2) ** power
    scores = []
    for i, own in enumerate(labels):
        inside = [gap[i, j] for j in range(len(points)) if labels[j] == own and j != i]
        if not inside:
            scores.append(0.0)
            continue
        a = np.mean(inside)
        b = min(np.mean(gap[i][labels == c]) for c in set(labels) if c != own)
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(scores)


def test_silhouettes(spark):
    points = np.concatenate([cloud(50), cloud(50)[:20]])
    labels = np.random.default_rng(5).integers(0, 4, 70)
    labels[69] = 9  # a singleton
    df = vectors(spark, points, labels).withColumn("two", (F.col("id") % 2).cast("int"))
    two = np.arange(70) % 2
    exact = {r.labeling: (r.silhouette, r.rows) for r in cl.silhouette_exact(df, "v", ["label", "two"], block_rows=16).collect()}
    square = {r.labeling: r.silhouette for r in cl.silhouette_squared(df, "v", ["label", "two"]).collect()}
    assert exact["label"] == (pytest.approx(silhouette(points, labels, 1)), 70)
    assert exact["two"] == (pytest.approx(silhouette(points, two, 1)), 70)
    assert square == {"label": pytest.approx(silhouette(points, labels, 2)), "two": pytest.approx(silhouette(points, two, 2))}
    some = df.withColumn("label", F.when(F.col("id") != 3, F.col("label")))  # rows without a label are left out
    rest = np.arange(70) != 3
    for score, power in ((cl.silhouette_exact, 1), (cl.silhouette_squared, 2)):
        row = score(some, "v", ["label"]).first()
        assert (row.silhouette, row["rows"]) == (pytest.approx(silhouette(points[rest], labels[rest], power)), 69)


def test_silhouettes_of_very_many_clusters(spark):
    """More clusters than any table of them was once allowed to have; most points are alone or in pairs."""
    n = 100_300
    rows = spark.range(n).select(
        "id", F.array((F.col("id") * 3).cast("double"), (F.col("id") % 7).cast("double")).alias("v"),
        F.when(F.col("id") < 2_000, (F.col("id") / 2).cast("int")).otherwise(F.col("id").cast("int")).alias("label"))
    out = cl.silhouette_squared(rows, "v", ["label"], block_rows=4_096).first()
    points = np.stack([np.arange(2_100) * 3.0, np.arange(2_100) % 7.0], axis=1)
    labels = np.where(np.arange(2_100) < 2_000, np.arange(2_100) // 2, np.arange(2_100))
    # Only the first 2,000 points are in pairs; their nearest clusters lie among the first 2,100 points.
    gap = ((points[:2_000, None] - points[None]) ** 2).sum(axis=2)
    total = 0.0
    for i in range(2_000):
        sums = np.bincount(labels, gap[i])
        counts = np.bincount(labels)
        means = np.where(counts > 0, sums / np.maximum(counts, 1), np.inf)
        own, means[labels[i]] = sums[labels[i]], np.inf
        a, b = own, means.min()
        total += (b - a) / max(a, b)
    assert (out.silhouette, out["rows"]) == (pytest.approx(total / n), n)
    few = rows.where("id < 3000")
    plain = cl.silhouette_exact(few, "v", ["label"]).first()
    near, counts = np.sqrt(((np.stack([np.arange(3_000) * 3.0, np.arange(3_000) % 7.0], 1)[:2_000, None]
                             - np.stack([np.arange(3_000) * 3.0, np.arange(3_000) % 7.0], 1)[None]) ** 2).sum(axis=2)), None
    labels = np.where(np.arange(3_000) < 2_000, np.arange(3_000) // 2, np.arange(3_000))
    counts, total = np.bincount(labels), 0.0
    for i in range(2_000):
        sums = np.bincount(labels, near[i])
        means = np.where(counts > 0, sums / np.maximum(counts, 1), np.inf)
        a, means[labels[i]] = sums[labels[i]], np.inf
        total += (means.min() - a) / max(a, means.min())
    assert (plain.silhouette, plain["rows"]) == (pytest.approx(total / 3_000), 3_000)


def test_sweep_balance_drilldown(spark):
    points = cloud(40)
    df = vectors(spark, points)
    tree = cl.topic_tree(df, "id", "v", "exact")
    sweep = {r.k: r.silhouette for r in cl.k_sweep(df, "id", "v", 5, 8, metric="euclidean").collect()}
    for k, score in sweep.items():
        labels = np.array([r.c[0] for r in tree.label(df, "v", [k], "c").orderBy("id").collect()])
        assert score == pytest.approx(silhouette(points, labels, 1)) and -1 <= score <= 1
    down = cl.topic_drilldown(df, tree, "v", 7, 15).collect()
    assert len({r.parent for r in down}) == 7 and len({r.child for r in down}) == 15 == len(down)
    assert sum(r["size"] for r in down) == 40
    row = cl.cluster_balance(spark.createDataFrame([(0,), (0,), (0,), (1,)], "c int"), "c").first()
    assert (row.clusters, row.min_size, row.max_size, row.largest_share, row.singletons) == (2, 1, 3, 0.75, 1)


def test_projection_keeps_the_widest_directions(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(50, 3)) * [10, 3, 0.1]
    rows = cl.project_2d(vectors(spark, points), "v").orderBy("id").collect()
    assert abs(np.corrcoef([r.x for r in rows], points[:, 0])[0, 1]) > 0.99
    assert abs(np.corrcoef([r.y for r in rows], points[:, 1])[0, 1]) > 0.99


# models --------------------------------------------------------------------

def test_classifier_and_labels(spark, tmp_path):
    from defectflow.sources.stages import load_classifier, save_classifier

    points = np.concatenate([np.random.default_rng(0).normal(size=(30, 3)) + shift for shift in (0, 8)])
    df = vectors(spark, points).withColumn("rec", F.when(F.col("id") < 30, "repair").otherwise("monitor"))
    assert {(r.rec, r.label_index) for r in models.label_index(df, "rec").collect()} == {("monitor", 0), ("repair", 1)}
    indexed = models.label_index(df, "rec")
    back = models.index_to_label(indexed, "label_index", ["monitor", "repair"], "again")
    assert back.where("again <> rec").count() == 0
    model = models.train_classifier(df, "v", "rec", trees=10)
    save_classifier(model, str(tmp_path / "forest"))
    out = models.predict_recommendation(df, "v", load_classifier(spark, str(tmp_path / "forest")))
    assert out.where("predicted_recommendation <> rec").count() == 0
    with pytest.raises(FileNotFoundError):
        load_classifier(spark, str(tmp_path / "absent"))


def test_supplied_models_see_distinct_texts(spark):
    calls = spark.sparkContext.accumulator(0)

    def embedder():
        def run(texts):
            calls.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]
        return run

    df = spark.createDataFrame([(i, "hot" if i % 3 else f"text {i % 50}") for i in range(300)] + [(300, None)], "id int, t string")
    rows = embed_text(df, "t", embedder).collect()
    assert len(rows) == 301 and all(r.embedding == ([float(len(r.t)), 1.0] if r.t else None) for r in rows)
    assert calls.value == df.where("t is not null").select("t").distinct().count()
    out = generate_text(df, "t", lambda: (lambda prompts, suffix="": [p.upper() + suffix for p in prompts]), suffix="!").where("id = 1").first()
    assert out.structured_output == "HOT!"


def test_token_table(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vector array<double>")
    df = spark.createDataFrame([(1, ["a", "a", "b", "zz"]), (2, ["zz"])], "id int, t array<string>")
    out = {r.id: r.embedding for r in embed_token_table(df, "id", "t", table).collect()}
    assert out[1] == pytest.approx([2 / 3, 1 / 3]) and out[2] is None


# scores --------------------------------------------------------------------

PAIRS = [
    (0, "Inspect pump seal", "Check pump seal"), (1, "same words here", "same words here"), (2, "", "reference"),
    (3, "nothing shared", "other tokens"), (4, "a b a b c", "b a b a a"), (5, "leaking pumps", "leak pump"), (6, None, None),
]


def pair_table(spark, rows=PAIRS):
    return spark.createDataFrame(rows, "id int, p string, r string")


def scores(df, column="f1"):
    return {r.id: r[column] for r in df.collect()}


def test_rouge_examples(spark):
    one = scores(metrics.rouge_n(pair_table(spark), ["id"], "p", "r", 1))
    two = scores(metrics.rouge_n(pair_table(spark), ["id"], "p", "r", 2))
    assert one[0] == pytest.approx(2 / 3) and two[0] == pytest.approx(1 / 2)
    assert one[1] == two[1] == 1.0 and one[2] == one[3] == one[6] == 0.0
    assert one[4] == pytest.approx(4 / 5) and one[5] == 1.0
    assert scores(metrics.rouge_n(pair_table(spark), ["id"], "p", "r", 1, stemmer=False))[5] == 0.0
    mean = metrics.mean_scores(metrics.rouge_n(pair_table(spark), ["id"], "p", "r", 1)).first()
    assert mean.pairs == 7 and mean.f1 == pytest.approx(np.mean(list(one.values())))


def test_rouge_l_against_dynamic_programming(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randrange(0, 90))), " ".join(rng.choices("abcde", k=rng.randrange(0, 90)))) for i in range(40)]

    def common(a, b):
        above = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
            above = row
        return above[-1]

    out = {r.id: r for r in metrics.rouge_l(pair_table(spark, rows), ["id"], "p", "r").collect()}
    for i, p, r in rows:
        p, r = p.split(), r.split()
        hit = common(p, r)
        assert out[i].precision == pytest.approx(hit / len(p) if p else 0) and out[i].recall == pytest.approx(hit / len(r) if r else 0)


def test_meteor(spark):
    def plain(p, r):
        p, r = list(enumerate(p.split())), list(enumerate(r.split()))
        n, m, pairs = len(p), len(r), []
        for i, x in reversed(p):
            for j, y in reversed(r):
                if x == y:
                    pairs.append((i, j))
                    r.remove((j, y))
                    break
        pairs.sort()
        if not pairs:
            return 0.0
        chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
        precision, recall = len(pairs) / n, len(pairs) / m
        return precision * recall / (0.9 * precision + 0.1 * recall) * (1 - 0.5 * (chunks / len(pairs)) ** 3)

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdefg", k=rng.randrange(1, 30))), " ".join(rng.choices("abcdefg", k=rng.randrange(1, 30)))) for i in range(30)]
    out = scores(metrics.meteor(pair_table(spark, rows), ["id"], "p", "r", stemmer=False), "score")
    assert out == {i: pytest.approx(plain(p, r)) for i, p, r in rows}
    stemmed = scores(metrics.meteor(pair_table(spark), ["id"], "p", "r"), "matches")
    assert stemmed[5] == 2 and stemmed[2] == 0
    table = spark.createDataFrame([("check", "look"), ("inspect", "look")], "word string, group string")
    assert scores(metrics.meteor(pair_table(spark), ["id"], "p", "r", synonyms=table), "matches")[0] == 3


def test_bertscore(spark):
    out = {r.id: r for r in metrics.bertscore(pair_table(spark), ["id"], "p", "r").collect()}
    assert len(out) == 7 and out[1].f1 == pytest.approx(1.0) and out[2].f1 == 0.0 and out[6].f1 == 0.0
    table = spark.createDataFrame([("inspect", [1.0, 0.0]), ("check", [1.0, 1.0]), ("pump", [0.0, 1.0])], "token string, vector array<double>")
    row = {r.id: r for r in metrics.bertscore(pair_table(spark), ["id"], "p", "r", table).collect()}[0]
    assert row.precision == pytest.approx((2 ** -0.5 + 1) / 2) and row.recall == pytest.approx((2 ** -0.5 + 1) / 2)


def test_gap_and_steps(spark):
    df = spark.createDataFrame([("val", 0.9), ("val", 0.7), ("test", 0.6)], "s string, m double")
    row = metrics.generalization_gap(df, "s", ["m"]).first()
    assert (row.val, row.test, row.gap) == (pytest.approx(0.8), 0.6, pytest.approx(0.2))
    steps = spark.createDataFrame([("t", ["a", "b", "b"], ["a", "c"]), ("t", ["a"], ["a"])], "topic string, p array<string>, e array<string>")
    row = metrics.critical_step_scores(steps, "p", "e", "topic").first()
    assert (row.precision, row.recall, row.rows) == (0.75, 0.75, 2)
    row = metrics.critical_step_scores(steps, "p", "e", "topic", ["c"]).first()
    assert (row.precision, row.recall) == (0.0, 0.0)


# monitoring ----------------------------------------------------------------

def test_review_flags_and_corrections(spark):
    train = spark.createDataFrame([(0, float(x)) for x in range(101)], "c int, d double")
    limits = mon.confidence_thresholds(train, "c", "d", 0.95)
    assert limits.first().threshold == 95.0
    new = spark.createDataFrame([(1, 0, 95.0), (2, 0, 95.1), (3, 7, 0.0)], "id int, c int, d double")
    assert {r.id: r.needs_review for r in mon.flag_low_confidence(new, "c", "d", limits).collect()} == {1: False, 2: True, 3: True}
    changes = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (9, "x", 1)], "id int, label string, at int")
    latest = mon.latest_corrections(changes, "id", "label", F.col("at"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    assert sorted(map(tuple, mon.apply_corrections(rows, "id", "label", latest).collect())) == [(1, "new", True), (2, "b", False)]
