"""Nearest centroid among any number of them: an exact index in coarse cells that tasks read as they need it."""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from defectflow.functions.vectors import to_matrix
from defectflow.operators.topics import nearest_rows
from defectflow.session import scratch_path, write_and_reread

_HELD_BYTES = 32 << 20  # of cells that a Python worker remembers
_SLICE = 8_192  # centroids of a cell compared at once
_GAPS = 1_000_000  # distances to cell centers held at once


class _Cells:
    """Reads the cells of one index in a task; remembers the latest of them up to a bound."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.held: OrderedDict[int, list] = OrderedDict()
        self.size = 0

    def _read(self, cell: int):
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/cells/cell={cell}"))
        for info in found:
            if info.path.endswith(".parquet"):
                with self.fs.open_input_file(info.path) as file:
                    for batch in pq.ParquetFile(file).iter_batches(_SLICE, columns=["cluster_id", "centroid"]):
                        ids = batch.column(0).to_numpy()
                        order = np.argsort(ids, kind="stable")
                        yield ids[order], to_matrix(batch.column(1))[0][order]

    def slices(self, cell: int):
        if cell in self.held:
            self.held.move_to_end(cell)
            yield from self.held[cell]
            return
        kept, size = [], 0
        for ids, matrix in self._read(cell):
            size += matrix.nbytes + ids.nbytes
            if size <= _HELD_BYTES // 4:
                kept.append((ids, matrix))
            yield ids, matrix
        if size <= _HELD_BYTES // 4:  # larger cells are read again each time, slice by slice
            self.held[cell] = kept
            self.size += size
            while self.size > _HELD_BYTES:
                _, old = self.held.popitem(last=False)
                self.size -= sum(m.nbytes + ids.nbytes for ids, m in old)


_OPEN: dict[str, _Cells] = {}


def _cells_of(path: str) -> _Cells:
    """One reader per index and Python worker; only the latest index is remembered."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = _Cells(path)
    return _OPEN[path]


@dataclass
class CentroidIndex:
    """Centroids in files of coarse cells, and the directory of the cells.

    The directory has a center and a radius for each cell, and about as many cells as the
    square root of the number of centroids. Looking up a vector compares it with the directory, reads the nearest
    cell, and then every cell that may hold a centroid as near as the best one so
    far: by the triangle inequality none is nearer than its center's distance less its radius. So results are
    exact, whatever the cells are. A lookup is a narrow map at every size, on batches and streams.

    Tasks open the files by pyarrow's file systems (local or mounted folders, hdfs, s3, gs).
    """

    path: str
    ids: np.ndarray
    centers: np.ndarray
    radii: np.ndarray

    @classmethod
    def write(cls, centroids: DataFrame, path: str | None = None) -> "CentroidIndex":
        """Index a table ``(cluster_id, centroid)`` under ``path``, or under a path of its own in the shared folder.

        Rows without a centroid are left out; of equal centroids the lowest id is found.
        Cells are ranges of written partitions, so a large cell is written by several tasks.
        """
        spark = centroids.sparkSession
        path = path or scratch_path(spark, "centroid-index")
        rows = write_and_reread(centroids.where("centroid is not null").select(
            F.col("cluster_id").cast("int").alias("cluster_id"), F.col("centroid").cast("array<double>").alias("centroid")
        ), "centroids")
        count = rows.count()
        if not count:
            raise ValueError("the centroid table is empty")
        chosen = rows.orderBy(F.xxhash64("cluster_id"), "cluster_id").limit(math.ceil(math.sqrt(count))).select("centroid")
        centers, _ = to_matrix(chosen.toArrow().column(0).combine_chunks())
        centers = np.unique(centers, axis=0)

        @F.arrow_udf("struct<cell:int,gap:double>")
        def nearest_center(v: pa.Array) -> pa.Array:
            points, _ = to_matrix(v)
            place, gap = nearest_rows(points, centers) if len(points) else (np.zeros(0, int), np.zeros(0))
            return pa.StructArray.from_arrays([pa.array(place.astype("int32")), pa.array(gap)], ["cell", "gap"])

        placed = rows.withColumn("_near", nearest_center("centroid")).select("cluster_id", "centroid", "_near.*")
        placed = write_and_reread(placed, "placed-centroids")
        radii = placed.groupBy("cell").agg(F.max("gap").alias("radius")).collect()  # a row for each cell
        table = [(r["cell"], r["radius"], json.dumps(centers[r["cell"]].tolist())) for r in radii]
        directory = spark.createDataFrame(table, "cell int, radius double, center string")
        dealt = placed.select("cluster_id", "centroid", "cell").repartitionByRange("cell", "cluster_id")
        dealt.sortWithinPartitions("cell", "cluster_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        directory.coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CentroidIndex":
        rows = spark.read.parquet(f"{path}/directory").orderBy("cell").collect()
        centers = np.array([json.loads(r["center"]) for r in rows], "float64")
        return cls(path, np.array([r["cell"] for r in rows]), centers, np.array([r["radius"] for r in rows]))

    def nearest(self, vector: Column) -> Column:
        """Column ``struct<cluster_id, distance>``; ties go to the lowest id."""
        path, names, centers, radii = self.path, self.ids, self.centers, self.radii

        @F.arrow_udf("struct<cluster_id:int,distance:double>")
        def assign(v: pa.Array) -> pa.Array:
            points, valid = to_matrix(v)
            out_id, out_gap = np.zeros(len(valid), dtype="int32"), np.zeros(len(valid))
            if len(points):
                out_id[valid], out_gap[valid] = look_up(points, _cells_of(path), names, centers, radii)
            return pa.StructArray.from_arrays([pa.array(out_id, mask=~valid), pa.array(out_gap, mask=~valid)], ["cluster_id", "distance"])

        return assign(vector)


def look_up(points: np.ndarray, cells: _Cells, names: np.ndarray, centers: np.ndarray, radii: np.ndarray):
    """Id of and distance to the nearest centroid of each point."""
    best_id, best = np.full(len(points), np.iinfo("int32").max), np.full(len(points), np.inf)

    def visit(at: np.ndarray, cell: int) -> None:
        x = points[at]
        for ids, matrix in cells.slices(int(names[cell])):
            place, gap = nearest_rows(x, matrix)
            found = ids[place]
            better = (gap < best[at]) | ((gap == best[at]) & (found < best_id[at]))
            best[at[better]], best_id[at[better]] = gap[better], found[better]

    norms = (centers * centers).sum(axis=1)
    step = max(1, _GAPS // len(centers))
    for start in range(0, len(points), step):
        x = points[start : start + step]
        own = (x * x).sum(axis=1)
        gap = x @ centers.T
        gap *= -2.0
        gap += norms
        gap += own[:, None]
        np.sqrt(np.maximum(gap, 0.0, out=gap), out=gap)
        # A product of rounding errors may look like a gap: what it can be off by is taken from every bound.
        least = gap - radii * (1 + 1e-9) - 1e-6 * np.sqrt(own + norms.max())[:, None]
        first = gap.argmin(axis=1)
        rows = np.arange(start, start + len(x))
        for cell in np.unique(first):
            visit(rows[first == cell], cell)
        for cell in np.argsort(least.min(axis=0)):
            again = (least[:, cell] <= best[rows]) & (first != cell)
            if again.any():
                visit(rows[again], cell)
    return best_id, best
