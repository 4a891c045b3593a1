"""Topic centroids and nearest-centroid assignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from defectflow.functions.vectors import to_matrix
from defectflow.operators.blocks import pair_blocks
from defectflow.operators.lookups import bounded_table
from defectflow.operators.sums import vector_means, vector_sums
from defectflow.session import write_and_reread


def cluster_centroids(df: DataFrame, cluster: str, vector: str, weight: str | None = None) -> DataFrame:
    """``(cluster_id, centroid, size)``: the mean vector of every cluster.

    ``weight`` counts copies of a row.
    """
    mass = F.col(weight) if weight else None
    sums = vector_sums(df, [F.col(cluster)], F.col(vector), mass)
    return sums.select(
        F.col("key").alias("cluster_id"), vector_means().alias("centroid"), F.col("n").cast("long").alias("size")
    )


@dataclass
class Centroids:
    """A checked, bounded centroid set held by the tasks; ``CentroidIndex`` has no bound."""

    ids: np.ndarray
    matrix: np.ndarray

    @classmethod
    def from_table(cls, table: DataFrame, max_rows: int = 2_048) -> "Centroids":
        """The centroids of a table that has ``max_rows`` rows at most."""
        rows = bounded_table(table.select("cluster_id", "centroid"), max_rows)
        if rows is None:
            raise ValueError(f"over {max_rows} centroids: use a CentroidIndex")
        if rows.num_rows == 0:
            raise ValueError("the centroid table is empty")
        rows = rows.sort_by("cluster_id").combine_chunks()
        matrix, _ = to_matrix(rows.column("centroid").combine_chunks())
        return cls(rows.column("cluster_id").to_numpy().astype("int32"), matrix)

    def nearest(self, vector):
        """Column ``struct<cluster_id, distance>``; ties go to the lowest id."""
        ids, matrix = self.ids, self.matrix

        @F.arrow_udf("struct<cluster_id:int,distance:double>")
        def assign(v: pa.Array) -> pa.Array:
            points, valid = to_matrix(v)
            place, gap = nearest_rows(points, matrix) if len(points) else (np.zeros(0, int), np.zeros(0))
            out_id, out_gap = np.zeros(len(valid), dtype="int32"), np.zeros(len(valid))
            out_id[valid], out_gap[valid] = ids[place], gap
            return pa.StructArray.from_arrays(
                [pa.array(out_id, mask=~valid), pa.array(out_gap, mask=~valid)], ["cluster_id", "distance"]
            )

        return assign(vector)


def nearest_rows(points: np.ndarray, matrix: np.ndarray, cells: int = 1_000_000):
    """Index of and distance to the nearest row of ``matrix``, for each point.

    Candidates come from one matrix product; where rounding leaves more than
    one, the distances are taken again by plain subtraction.
    """
    place = np.zeros(len(points), dtype=int)
    norms = (matrix * matrix).sum(axis=1)
    step = max(1, cells // len(matrix))
    for start in range(0, len(points), step):
        x = points[start:start + step]
        own = (x * x).sum(axis=1)
        gap = x @ matrix.T
        gap *= -2.0
        gap += norms
        low = gap.min(axis=1)
        chosen = gap.argmin(axis=1)
        close = (gap <= (low + 1e-9 * (own + norms.max()))[:, None]).sum(axis=1) > 1
        for i in np.flatnonzero(close):
            chosen[i] = ((matrix - x[i]) ** 2).sum(axis=1).argmin()
        place[start:start + step] = chosen
    return place, np.sqrt(((points - matrix[place]) ** 2).sum(axis=1))


def nearest_centroid(df: DataFrame, vector: str, centroids) -> DataFrame:
    """Add ``cluster_id`` and ``distance`` of the nearest centroid, a narrow map on batches and streams.

    ``centroids`` is a ``CentroidIndex``, a bounded set of ``Centroids``, or a table
    ``(cluster_id, centroid)`` of any size, which is indexed first. The caller
    chooses; the number of centroids does not.
    """
    if isinstance(centroids, DataFrame):
        from defectflow.operators.centroid_index import CentroidIndex

        centroids = CentroidIndex.write(centroids)
    return df.withColumn("_near", centroids.nearest(F.col(vector))).select(*df.columns, "_near.cluster_id", "_near.distance")


def nearest_centroid_blocked(df: DataFrame, vector: str, centroids: DataFrame, block_rows: int = 1_024) -> DataFrame:
    """Nearest centroid among any number of centroids.

    Distinct vectors and centroids are packed into blocks; each task compares
    one block of each and keeps the best centroid per vector, so the rows that
    leave a task are vectors, never vector-centroid pairs.
    """
    distinct = df.select(F.col(vector).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    points = write_and_reread(distinct.withColumn("_h", F.sha2(F.to_json(F.struct("_v")), 256)), "points")
    left = points.select(F.col("_h").alias("key"), F.col("_v").alias("vector"), F.lit(0).alias("tag"))
    right = centroids.select(
        F.col("cluster_id").cast("string").alias("key"), F.col("centroid").alias("vector"),
        F.col("cluster_id").cast("int").alias("tag"),
    )

    def best_of_block(keys, x, _tags, _other_keys, y, ids):
        order = np.argsort(ids, kind="stable")
        place, gap = nearest_rows(x, y[order])
        return {"key": keys, "cluster_id": ids[order][place], "distance": gap}

    found = pair_blocks(left, right, best_of_block, "key string, cluster_id int, distance double", block_rows)
    best = found.groupBy("key").agg(F.min(F.struct("distance", "cluster_id")).alias("_b"))
    table = best.select(
        F.col("key").alias("_h"), F.col("_b.cluster_id").alias("cluster_id"), F.col("_b.distance").alias("distance")
    )
    hashed = df.withColumn("_h", F.when(F.col(vector).isNotNull(), F.sha2(F.to_json(F.struct(F.col(vector).alias("_v"))), 256)))
    return hashed.join(table, "_h", "left").select(*df.columns, "cluster_id", "distance")
