"""Flattening and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from defectflow.sources.findings import path_exists


def flatten_results(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested result records to the six flat output columns."""
    return df.select(
        *keep,
        F.col("original_input.description").alias("DESCRIPTION"),
        F.col("original_input.priority").alias("PRIORITY"),
        F.col("original_input.initial_recommendation").alias("INITIAL_RECOMMENDATION"),
        F.col("predicted_recommendation").alias("PREDICTED_RECOMMENDATION"),
        F.col("topic_category").alias("TOPIC_CATEGORY"),
        F.col("structured_output").alias("STRUCTURED_OUTPUT"),
    )


def result_view(flat: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The four columns shown to a reader."""
    return flat.select(
        *keep, F.col("DESCRIPTION").alias("description"), F.col("INITIAL_RECOMMENDATION").alias("initial_rec"),
        F.col("PREDICTED_RECOMMENDATION").alias("predicted_rec"), F.col("STRUCTURED_OUTPUT").alias("action_plan"),
    )


def summary_view(flat: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Shortened description and topic next to the prediction."""
    return flat.select(
        *keep, F.substring("DESCRIPTION", 1, 50).alias("DESCRIPTION"),
        F.col("PREDICTED_RECOMMENDATION").alias("PREDICTED_REC"),
        F.substring("TOPIC_CATEGORY", 1, 30).alias("TOPIC"),
    )


def versioned_path(spark, path: str) -> str:
    """The path itself if free, else the first free ``_v1``, ``_v2``, …"""
    if not path_exists(spark, path):
        return path
    stem, dot, suffix = path.rpartition(".")
    if not dot or "/" in suffix:
        stem, suffix = path, ""
    version = 1
    while path_exists(spark, f"{stem}_v{version}{dot and suffix and '.' + suffix}"):
        version += 1
    return f"{stem}_v{version}{dot and suffix and '.' + suffix}"


def write_results(df: DataFrame, path: str, if_exists: str = "overwrite") -> tuple[DataFrame, str]:
    """Write flat results as CSV with a header; returns the frame and the path.

    The output is a folder of part files, one per task. ``if_exists`` is
    ``overwrite``, ``error`` or ``version``.
    """
    if if_exists not in ("overwrite", "error", "version"):
        raise ValueError("if_exists must be 'overwrite', 'error' or 'version'")
    target = versioned_path(df.sparkSession, path) if if_exists == "version" else path
    mode = "overwrite" if if_exists == "overwrite" else "errorifexists"
    df.write.mode(mode).option("header", True).option("escape", '"').csv(target)
    return df, target
