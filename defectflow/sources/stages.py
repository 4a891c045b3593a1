"""Hand-off tables, models and centroids between jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from defectflow.session import write_and_reread

from defectflow.sources.findings import path_exists


def write_stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A stage table as Parquet, which keeps empty text apart from missing text."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _require(spark: SparkSession, path: str, what: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{what} not found at {path}")


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    _require(spark, path, "stage table")
    return spark.read.parquet(path)


def save_centroids(centroids: DataFrame, path: str) -> None:
    centroids.write.mode("overwrite").parquet(path)


def load_centroids(spark: SparkSession, path: str) -> DataFrame:
    _require(spark, path, "centroid table")
    return spark.read.parquet(path)


def save_classifier(model: PipelineModel, path: str) -> None:
    """Forest and label names together."""
    model.write().overwrite().save(path)


def load_classifier(spark: SparkSession, path: str) -> PipelineModel:
    _require(spark, path, "classifier")
    return PipelineModel.load(path)


def _bucket(identifier: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(identifier), F.lit(buckets)).cast("int").alias("bucket")


def upsert_stage(changes: DataFrame, path: str, identifier: str, recency: list[str], buckets: int = 64) -> None:
    """Put the latest row of each id into a stage table that is partitioned by buckets of the id.

    Rows of the table and of ``changes`` are compared by the columns ``recency``; of
    equal ones the change wins. Only buckets that hold a changed id are read and
    written again, by dynamic partition overwrite, so running the same changes
    again changes nothing. The number of buckets is set by the first write.
    """
    spark = changes.sparkSession
    columns = changes.columns
    rows = changes.withColumns({"bucket": _bucket(identifier, buckets), "_new": F.lit(True)})
    if path_exists(spark, path):
        touched = rows.select("bucket").distinct()
        old = spark.read.parquet(path).join(touched, "bucket", "left_semi").select(*columns, "bucket")
        rows = rows.unionByName(old.withColumn("_new", F.lit(False)))
    latest = F.max_by(F.struct(*columns), F.struct(*recency, "_new")).alias("_row")
    merged = rows.groupBy(F.col(identifier).alias("_id"), "bucket").agg(latest).select("_row.*", "bucket")
    merged = write_and_reread(merged, "upsert")  # the table is read above and written below
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def publish(spark: SparkSession, registry: str, name: str, save: Callable[[str], None]) -> str:
    """Save a new version of a model or centroid table and register it; returns its path.

    The registry is a table ``(name, version, path)``. A version is registered
    after it has been saved, so a reader never sees half of one.
    """
    version = _latest(spark, registry, name)[0] + 1
    path = f"{registry.rstrip('/')}/{name}/v{version}"
    save(path)
    row = spark.createDataFrame([(name, version, path)], "name string, version int, path string")
    row.coalesce(1).write.mode("append").parquet(f"{registry.rstrip('/')}/versions")
    return path


def _latest(spark: SparkSession, registry: str, name: str) -> tuple[int, str | None]:
    table = f"{registry.rstrip('/')}/versions"
    if not path_exists(spark, table):
        return 0, None
    row = spark.read.parquet(table).where(F.col("name") == name).agg(F.max(F.struct("version", "path")).alias("r")).first()
    return (row["r"]["version"], row["r"]["path"]) if row["r"] else (0, None)


def published(spark: SparkSession, registry: str, name: str) -> str:
    """The path of the latest version."""
    path = _latest(spark, registry, name)[1]
    if path is None:
        raise FileNotFoundError(f"no version of {name} in {registry}")
    return path
