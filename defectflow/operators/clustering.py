"""Topic discovery: hierarchical clustering by a method that the caller names.

``exact`` builds the tree of the distinct vectors on the executors, with any
linkage (``agglomeration.py``). The work is quadratic in the distinct vectors.
``micro`` condenses the rows to a stated number of k-means cells and builds the
tree of the cells; its work is linear. The number of rows never picks the method.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from defectflow.functions.vectors import to_matrix
from defectflow.operators.agglomeration import LINKAGES, distance_matrix, merge_matrix, merge_tree, vector_hash
from defectflow.operators.blocks import Slices, against_all, distances, pair_blocks
from defectflow.operators.lookups import bounded_table, top_per_group
from defectflow.operators.sums import vector_means, vector_sums
from defectflow.operators.topics import Centroids, nearest_rows
from defectflow.session import scratch_path, write_and_reread

METHODS = ("exact", "micro")


def _merge_tree(means: np.ndarray, sizes: np.ndarray, linkage: str) -> list[tuple[int, int, float, int]]:
    """Merge history of a bounded number of cells."""
    sizes = sizes.astype(float)
    return merge_matrix(distance_matrix(means, sizes, linkage), sizes, linkage)


@dataclass
class TopicTree:
    """The cells of the method ``micro``, how often and where they occur, and their merge history."""

    micro: Centroids
    sizes: np.ndarray
    first_ids: np.ndarray
    history: list[tuple[int, int, float, int]]

    def cut(self, k: int) -> np.ndarray:
        """Label of every micro-cluster at ``k`` clusters, numbered by smallest member id."""
        m = len(self.sizes)
        parent = list(range(2 * m - 1))
        for step, (left, right, _, _) in enumerate(self.history[: max(m - k, 0)]):
            parent[left] = parent[right] = m + step
        roots = []
        for node in range(m):
            while parent[node] != node:
                node = parent[node]
            roots.append(node)
        roots = np.array(roots)
        order = sorted(set(roots), key=lambda r: self.first_ids[roots == r].min())
        number = {root: i for i, root in enumerate(order)}
        return np.array([number[r] for r in roots], dtype="int32")

    def label_sets(self, vector: Column, ks: list[int]) -> Column:
        """Clusters of a vector at every ``k``, as an array in the order of ``ks``."""
        table, matrix = np.stack([self.cut(k) for k in ks], axis=1), self.micro.matrix

        @F.arrow_udf("array<int>")
        def label(v: pa.Array) -> pa.Array:
            points, valid = to_matrix(v)
            found = table[nearest_rows(points, matrix)[0]] if len(points) else table[:0]
            ends = np.concatenate([[0], np.cumsum(valid) * table.shape[1]]).astype("int32")
            return pa.ListArray.from_arrays(
                pa.array(ends), pa.array(found.reshape(-1)), mask=None if valid.all() else pa.array(~valid)
            )

        return label(vector)

    def label(self, df: DataFrame, vector: str, ks: list[int], output: str) -> DataFrame:
        """Add the clusters of a vector column at every ``k``, as an array. A narrow map."""
        return df.withColumn(output, self.label_sets(F.col(vector), ks))

    def merge_table(self, spark) -> DataFrame:
        """``(step, left, right, distance, size)``, one row per merge."""
        rows = [(i, *h) for i, h in enumerate(self.history)]
        return spark.createDataFrame(rows, "step int, left int, right int, distance double, size long")


def _usable(df: DataFrame, identifier: str, vector: str, weight: str | None) -> DataFrame:
    mass = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.where(F.col(vector).isNotNull()).select(
        F.col(identifier).alias("id"), F.col(vector).cast("array<double>").alias("v"), mass.alias("w")
    )


def _cells(usable: DataFrame, cells: int, seed: int, max_iter: int, tol: float):
    """The k-means cells as ``(model, sizes, first ids)``.

    With no more distinct vectors than cells, each is a cell, as k-means would
    have it.
    """
    distinct = usable.groupBy(vector_hash(F.col("v")).alias("h")).agg(F.first("v").alias("v"))
    # Where some rows alone have more distinct vectors than cells, the rest need not be compared.
    some = usable.select("v").limit(4 * cells).toArrow()["v"].combine_chunks()
    many = len(np.unique(to_matrix(some)[0], axis=0)) > cells if len(some) else False
    few = None if many else bounded_table(distinct.select("v"), cells)
    if few is not None:
        centers, _ = to_matrix(few.column("v").combine_chunks())
        centers = centers[np.lexsort(centers.T[::-1])]
    else:
        # The assembler stores mostly-zero vectors sparsely, also in the cache.
        dense = usable.select("w", array_to_vector("v").alias("dense"))
        features = VectorAssembler(inputCols=["dense"], outputCol="features").transform(dense)
        fitted = KMeans(k=cells, seed=seed, maxIter=max_iter, tol=tol, weightCol="w").fit(features)
        centers = np.array(fitted.clusterCenters())
    start = Centroids(np.arange(len(centers), dtype="int32"), centers)
    sums = vector_sums(usable, [start.nearest(F.col("v"))["cluster_id"]], F.col("v"), F.col("w"), F.col("id"))
    found = sums.select("key", F.col("n").alias("size"), F.col("first").alias("first_id"),
                        vector_means().alias("mean")).toArrow().sort_by("key").combine_chunks()
    means, _ = to_matrix(found.column("mean").combine_chunks())
    model = Centroids(np.arange(len(means), dtype="int32"), means)
    return model, found.column("size").to_numpy(), found.column("first_id").to_numpy()


def topic_tree(df: DataFrame, identifier: str, vector: str, method: str, cells: int | None = None,
               linkage: str = "ward", seed: int = 42, weight: str | None = None, max_iter: int = 100,
               tol: float = 1e-6, last: int = 1_024):
    """Build the merge tree of a table of vectors; ``weight`` counts copies of a row.

    ``method`` is ``"exact"`` or ``"micro"``; the latter needs ``cells``, the number
    of k-means cells that stand for the rows and are merged by the driver.
    The ``last`` clusters of ``exact`` are merged by the driver, which shortens the
    rounds of few clusters and changes no result.
    """
    if method == "micro":
        return topic_trees(df, identifier, vector, cells, (linkage,), seed, weight, max_iter, tol)[linkage]
    if method != "exact":
        raise ValueError(f"method must be one of {METHODS}")
    if linkage not in LINKAGES or cells is not None:
        raise ValueError("the exact method has no cells, and one of the known linkages")
    return merge_tree(_usable(df, identifier, vector, weight), linkage, last)


def topic_trees(df: DataFrame, identifier: str, vector: str, cells: int, linkages=LINKAGES, seed: int = 42,
                weight: str | None = None, max_iter: int = 100, tol: float = 1e-6) -> dict[str, TopicTree]:
    """Trees of several linkages over one set of ``cells`` k-means cells.

    Average and complete linkage see each cell as its mean.
    """
    if not cells or cells < 2:
        raise ValueError("the micro method needs the number of cells")
    model, sizes, first_ids = _cells(_usable(df, identifier, vector, weight), cells, seed, max_iter, tol)
    return {name: TopicTree(model, sizes, first_ids, _merge_tree(model.matrix, sizes, name)) for name in linkages}


def ward_cluster(df: DataFrame, identifier: str, vector: str, k: int = 7, method: str = "exact",
                 cells: int | None = None, seed: int = 42) -> DataFrame:
    """Add ``cluster``: Ward clustering into ``k`` groups."""
    tree = topic_tree(df, identifier, vector, method, cells, seed=seed)
    return tree.label(df, vector, [k], "cluster").withColumn("cluster", F.col("cluster")[0])


def linkage_compare(df: DataFrame, identifier: str, vector: str, k: int = 7, method: str = "exact",
                    cells: int | None = None) -> DataFrame:
    """Cluster sizes under each linkage: ``(linkage, cluster, size)``; ``cells`` are those of the method ``micro``."""
    if method == "micro":
        rows = []
        for name, tree in topic_trees(df, identifier, vector, cells).items():
            sizes = np.bincount(tree.cut(k), weights=tree.sizes)
            rows += [(name, i, int(n)) for i, n in enumerate(sizes)]
        return df.sparkSession.createDataFrame(rows, "linkage string, cluster int, size long")
    parts = [
        topic_tree(df, identifier, vector, method, cells, linkage).leaf_labels([k])
        .groupBy(F.lit(linkage).alias("linkage"), F.col("labels")[0].alias("cluster")).agg(F.sum("size").cast("long").alias("size"))
        for linkage in LINKAGES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def last_merges(merges: DataFrame, n: int = 30) -> DataFrame:
    """The last ``n`` merges, which is what a truncated dendrogram shows."""
    return merges.orderBy(F.desc("step")).limit(n)


def topic_drilldown(df: DataFrame, tree, vector: str, parents: int = 7, children: int = 15) -> DataFrame:
    """Rows per (parent topic, child topic) of one tree cut twice."""
    return (
        tree.label(df.select(vector), vector, [parents, children], "_l")
        .select(F.col("_l")[0].alias("parent"), F.col("_l")[1].alias("child"))
        .groupBy("parent", "child").agg(F.count(F.lit(1)).alias("size"))
    )


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size")).orderBy(cluster)


def cluster_balance(df: DataFrame, cluster: str) -> DataFrame:
    """Smallest and largest cluster, largest share, number of singletons."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        (F.max("size") / F.sum("size")).alias("largest_share"),
        F.sum((F.col("size") == 1).cast("long")).alias("singletons"),
    )


def cluster_keywords(df: DataFrame, cluster: str, tokens: Column, n: int = 10, weight: str = "count") -> DataFrame:
    """Top terms per cluster by count or by TF-IDF over clusters.

    Tokens are counted map-side, so the shuffle carries distinct terms.
    """
    counts = df.select(F.col(cluster), F.explode(tokens).alias("term")).groupBy(cluster, "term").agg(
        F.count(F.lit(1)).alias("count")
    )
    if weight == "count":
        scored = counts.withColumn("score", F.col("count").cast("double"))
    elif weight == "tfidf":
        clusters = df.agg(F.count_distinct(cluster)).scalar()
        spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
        scored = counts.join(spread, "term").withColumn("score", F.col("count") * F.log(clusters / F.col("_df")))
    else:
        raise ValueError("weight must be 'count' or 'tfidf'")
    top = top_per_group(scored, [cluster], [F.desc("score"), F.col("term")], n)
    return top.select(cluster, "rank", "term", "count", "score")


def project_2d(df: DataFrame, vector: str) -> DataFrame:
    """Add principal-component coordinates ``x`` and ``y`` for plotting."""
    features = df.withColumn("_f", array_to_vector(F.col(vector)))
    model = PCA(k=2, inputCol="_f", outputCol="_p").fit(features)
    xy = vector_to_array(F.col("_p"))
    return model.transform(features).withColumns({"x": xy[0], "y": xy[1]}).drop("_f", "_p")


# Silhouettes ---------------------------------------------------------------

def _labelled(df: DataFrame, vector: str, clusters: list[str]) -> DataFrame:
    """Distinct points with all labels: ``key (h, l), vector, tag (l, w)``; ``rows`` of a silhouette counts these only.

    Equal points with equal labels are one point of their number ``w``.
    """
    good = F.col(vector).isNotNull()
    for c in clusters:
        good = good & F.col(c).isNotNull()
    points = df.where(good).select(
        F.col(vector).cast("array<double>").alias("v"), F.array(*[F.col(c).cast("int") for c in clusters]).alias("l")
    ).groupBy("v", "l").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hashed = F.sha2(F.to_json(F.struct("v", "l")), 256).alias("h")
    # Written once: the points are read for several blocks.
    return write_and_reread(points.select(
        F.struct(hashed, "l", "w").alias("key"), F.col("v").alias("vector"), F.struct("l", "w").alias("tag")
    ), "points")


def _mean_scores(scored: DataFrame, clusters: list[str]) -> DataFrame:
    """``labeling, silhouette, rows`` from ``w`` and the scores ``s`` of every labeling."""
    names = F.array(*[F.lit(c) for c in clusters])
    return (
        scored.select("w", F.posexplode("s").alias("which", "x"))
        .groupBy("which").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("silhouette"), F.sum("w").cast("long").alias("rows"))
        .select(F.element_at(names, F.col("which") + 1).alias("labeling"), "silhouette", "rows")
    )


def _score(inside: float, outside: float, mass: float) -> float:
    """The silhouette of a point from its mean distances to its own cluster of ``mass`` points and to the nearest other."""
    top = max(inside, outside)
    return (outside - inside) / top if mass > 1 and np.isfinite(outside) and top > 0 else 0.0


def silhouette_squared(df: DataFrame, vector: str, clusters: list[str], block_rows: int = 1_024) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, for several labelings.

    The sum of squared distances to a cluster follows from its size, vector sum and
    sum of squared norms, so blocks of points meet blocks of clusters, of any number,
    and only the best cluster of a block leaves a task. Linear in the rows where the clusters are few.
    Returns one row per entry of ``clusters``, whatever the number of labelings.
    """
    keyed, width = _labelled(df, vector, clusters), len(clusters)
    sums = vector_sums(keyed, [F.col("tag")["l"][i] for i in range(width)], F.col("vector"), F.col("tag")["w"])
    held = write_and_reread(sums.select(
        F.struct("which", F.col("key").alias("name")).alias("key"), F.col("sums").alias("vector"),
        F.struct("which", F.col("key").alias("name"), "n", "squares").alias("tag"),
    ), "cluster-sums")

    def nearest(keys, x, _tags, _names, total, tags):
        which, name, n, squares = (np.array([t[c] for t in tags]) for c in ("which", "name", "n", "squares"))
        label = np.array([k["l"] for k in keys]).reshape(len(keys), -1)
        own, mass, best = np.full((len(keys), width), -1.0), np.zeros((len(keys), width)), np.full((len(keys), width), np.inf)
        norms, row = (x * x).sum(axis=1), np.arange(len(keys))
        for i in range(width):
            at = np.flatnonzero(which == i)
            at = at[np.argsort(name[at])]
            if not len(at):
                continue
            means = x @ (-2.0 * total[at] / n[at, None]).T  # to each cluster, less the point's own norm
            means += squares[at] / n[at]
            place = np.minimum(np.searchsorted(name[at], label[:, i]), len(at) - 1)
            mine = row[name[at][place] == label[:, i]]
            place = place[mine]
            own[mine, i] = np.maximum(means[mine, place] + norms[mine], 0.0) * n[at[place]]
            mass[mine, i] = n[at[place]]
            means[mine, place] = np.inf
            best[:, i] = np.maximum(means.min(axis=1) + norms, 0.0)
        return {"h": [k["h"] for k in keys], "w": [k["w"] for k in keys],
                "found": pa.array(list(np.concatenate((own, mass, best), axis=1)), pa.list_(pa.float64()))}

    found = pair_blocks(keyed, held, nearest, "h string, w double, found array<double>", block_rows)

    @F.arrow_udf("array<double>")
    def scores(parts: pa.Array) -> pa.Array:
        out = []
        for part in parts:
            cells = np.array(part.values.to_pylist()).reshape(-1, 3, width)
            own, mass, best = cells[:, 0].max(axis=0), cells[:, 1].max(axis=0), cells[:, 2].min(axis=0)
            out.append([_score(o / max(m - 1, 1), b, m) for o, m, b in zip(own, mass, best)])
        return pa.array(out, pa.list_(pa.float64()))

    merged = found.groupBy("h", "w").agg(F.collect_list("found").alias("parts"))  # one part for each block of clusters
    return _mean_scores(merged.select("w", scores("parts").alias("s")), clusters)


def silhouette_exact(df: DataFrame, vector: str, clusters: list[str], block_rows: int = 1_024) -> DataFrame:
    """Mean silhouette under plain Euclidean distance, for several labelings.

    The measure needs every pair of distinct points, so work is quadratic in
    them. Equal points with equal labels are folded into one weighted point
    first; tasks read the written points slice by slice next to their own rows, so points are shuffled
    once and only scores leave a task, however many clusters there are: the more there are, the fewer
    rows are compared at once. ``silhouette_squared`` is its relative for large tables.
    """
    keyed, width = _labelled(df, vector, clusters), len(clusters)
    path = scratch_path(df.sparkSession, "silhouette-points")
    keyed.select("vector", "tag").sortWithinPartitions("tag.l").write.parquet(path)
    points = Slices(path, block_rows)

    def tags(batch):
        tag = batch["tag"]
        return np.asarray(tag.field("l").flatten()).reshape(-1, width), tag.field("w").to_numpy()

    def fold(batch):
        label, weight = tags(batch)
        x, _ = to_matrix(batch["vector"])
        names, mass = [np.zeros(0, "int32")] * width, [np.zeros(0)] * width
        for part in points.read(["tag"]):
            labels, weights = tags(part)
            for i in range(width):
                name, place = np.unique(np.concatenate((names[i], labels[:, i])), return_inverse=True)
                names[i], mass[i] = name, np.bincount(place, np.concatenate((mass[i], weights)))
        step = min(1_024, max(1, 4_000_000 // sum(map(len, names))))
        scores = np.empty((len(x), width))
        for start in range(0, len(x), step):
            at = slice(start, start + step)
            scores[at] = mean_gaps(x[at], label[at], names, mass)
        return {"w": weight, "s": pa.array(list(scores), pa.list_(pa.float64()))}

    def mean_gaps(x, label, names, mass):
        sums = [np.zeros((len(x), len(name))) for name in names]
        for part in points.read(["vector", "tag"]):
            labels, weights = tags(part)
            gap = distances(x, to_matrix(part["vector"])[0]) * weights
            kinds, place = np.unique(labels, axis=0, return_inverse=True)
            by_kind = grouped(gap, place.reshape(-1))[1]
            for i in range(width):
                found, total = grouped(by_kind, np.searchsorted(names[i], kinds[:, i]))
                sums[i][:, found] += total
        out, row = np.zeros((len(x), width)), np.arange(len(x))
        for i in range(width):
            mine = np.searchsorted(names[i], label[:, i])
            own = mass[i][mine]
            inside = sums[i][row, mine] / np.maximum(own - 1, 1)
            means = sums[i] / mass[i]
            means[row, mine] = np.inf
            outside = means.min(axis=1)
            top = np.maximum(inside, outside)
            good = (own > 1) & np.isfinite(outside) & (top > 0)
            out[good, i] = (outside[good] - inside[good]) / top[good]
        return out

    def grouped(cells, place):
        """Sums of the columns of equal places."""
        order = np.argsort(place, kind="stable")
        found, starts = np.unique(place[order], return_index=True)
        return found, np.add.reduceat(cells[:, order], starts, axis=1)

    scored = against_all(keyed.select("vector", "tag"), fold, "w double, s array<double>")
    return _mean_scores(scored, clusters)


def k_sweep(df: DataFrame, identifier: str, vector: str, k_min: int = 5, k_max: int = 19, metric: str = "squared",
            method: str = "exact", cells: int | None = None) -> DataFrame:
    """``(k, silhouette)`` for every K, from one tree cut at each K.

    The metric ``"euclidean"`` compares all pairs of distinct points.
    """
    tree = topic_tree(df, identifier, vector, method, cells)
    ks = list(range(k_min, k_max + 1))
    labelled = tree.label(df.select(vector), vector, ks, "_l").select(
        vector, *[F.col("_l")[i].alias(str(k)) for i, k in enumerate(ks)]
    )
    score = {"euclidean": silhouette_exact, "squared": silhouette_squared}[metric]
    return score(labelled, vector, [str(k) for k in ks]).select(
        F.col("labeling").cast("int").alias("k"), "silhouette", "rows"
    )
