"""Per-group vector sums, added up inside the tasks before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from defectflow.functions.vectors import from_matrix, to_matrix


def vector_sums(df: DataFrame, keys: list[Column], vector: Column, weight: Column | None = None,
                first: Column | None = None) -> DataFrame:
    """Sums per value of each key column, all keys in one pass.

    Returns ``which, key, n, sums, squares, first``: place of the key column,
    its value, total weight, weighted vector sum, weighted sum of squared norms
    and smallest ``first``. Each Arrow batch is reduced to one row per value it
    holds, so the shuffle carries values times batches, not rows, however
    large a group is. Missing keys and vectors are left out.
    """
    source = df.select(
        F.array(*[k.cast("int") for k in keys]).alias("keys"), vector.cast("array<double>").alias("v"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
        (F.lit(0) if first is None else first).alias("first"),
    )
    first_type = source.schema["first"].dataType.simpleString()
    width = len(keys)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch["v"].is_valid())
            if batch.num_rows == 0:
                continue
            points, _ = to_matrix(batch["v"])
            weights = batch["w"].to_numpy()
            norms = weights * (points * points).sum(axis=1)
            flat = batch["keys"].flatten()
            for which in range(width):
                column = flat.take(pa.array(np.arange(which, len(flat), width)))
                known = np.asarray(column.is_valid())
                if known.any():
                    rows = np.flatnonzero(known)
                    names, place = np.unique(column.drop_null().to_numpy(), return_inverse=True)
                    yield part(which, names, place, rows, points, weights, norms, batch["first"])

    def part(which, names, place, rows, points, weights, norms, firsts):
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(names)))
        chosen = rows[order]
        sums = np.add.reduceat(points[chosen] * weights[chosen][:, None], starts, axis=0)
        smallest = pa.table({"p": place, "f": firsts.take(pa.array(rows))}).group_by("p").aggregate([("f", "min")])
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(names), which, dtype="int32")), pa.array(names.astype("int32")),
            pa.array(np.bincount(place, weights=weights[rows], minlength=len(names))),
            from_matrix(sums, np.ones(len(names), dtype=bool)),
            pa.array(np.bincount(place, weights=norms[rows], minlength=len(names))),
            smallest.sort_by("p")["f_min"].combine_chunks(),
        ], ["which", "key", "n", "sums", "squares", "first"])

    partial = source.mapInArrow(
        reduce, f"which int, key int, n double, sums array<double>, squares double, first {first_type}"
    )
    return partial.groupBy("which", "key").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("_s"), F.sum("squares").alias("squares"),
        F.min("first").alias("first"),
    ).select("which", "key", "n", vector_to_array("_s").alias("sums"), "squares", "first")


def vector_means() -> Column:
    """Mean vector of a row of ``vector_sums``."""
    return F.transform("sums", lambda x: x / F.col("n"))
