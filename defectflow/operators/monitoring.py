"""Watching a topic model in use: mix, drift, review flags, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from defectflow.operators.lookups import keyed_join
from defectflow.operators.stats import exact_quantiles


def topic_counts_over_time(df: DataFrame, ts: str, topic: str, every: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rows per time window and topic, batch or stream."""
    span = F.window(F.col(ts), every, slide) if slide else F.window(F.col(ts), every)
    return df.groupBy(span.alias("window"), F.col(topic)).agg(F.count(F.lit(1)).alias("count")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), topic, "count"
    )


def topic_distribution(df: DataFrame, ts: str, topic: str, every: str = "1 day", slide: str | None = None) -> DataFrame:
    """Topic counts per window with each topic's share of its window.

    The share is taken over the counts, so a window is at most one row per topic.
    """
    counts = topic_counts_over_time(df, ts, topic, every, slide)
    whole = F.sum("count").over(Window.partitionBy("window_start"))
    return counts.withColumn("share", F.col("count") / whole)


def centroid_drift(df: DataFrame, ts: str, topic: str, distance: str, every: str = "30 days", baseline: int = 0,
                   median: bool = True) -> DataFrame:
    """Mean (and exact median) centroid distance per window and topic, and the
    change of the mean since the topic's ``baseline``-th window."""
    rows = df.select(F.window(F.col(ts), every)["start"].alias("window_start"), F.col(topic), F.col(distance))
    means = rows.groupBy("window_start", topic).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(distance).alias("mean_distance")
    )
    if median:
        medians = exact_quantiles(rows, ["window_start", topic], distance, [0.5])
        means = keyed_join(means, medians.withColumnRenamed("q0", "median_distance"), ["window_start", topic])
    order = Window.partitionBy(topic).orderBy("window_start")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.nth_value("mean_distance", baseline + 1).over(whole)
    return means.withColumn("drift", F.col("mean_distance") - first)


def confidence_thresholds(df: DataFrame, topic: str, distance: str, quantile: float = 0.95) -> DataFrame:
    """Per topic, the distance beyond which an assignment needs review."""
    return exact_quantiles(df, [topic], distance, [quantile]).withColumnRenamed("q0", "threshold")


def flag_low_confidence(df: DataFrame, topic: str, distance: str, thresholds: DataFrame) -> DataFrame:
    """Add ``threshold`` and ``needs_review``; topics without one need review."""
    joined = keyed_join(df, thresholds, [topic])
    return joined.withColumn("needs_review", F.coalesce(F.col(distance) > F.col("threshold"), F.lit(True)))


def latest_corrections(corrections: DataFrame, identifier: str, label: str, *recency: Column) -> DataFrame:
    """Newest correction per id, by partial maxima (of strings, so Spark sorts within tasks)."""
    return corrections.groupBy(identifier).agg(F.max_by(F.col(label), F.struct(*recency)).alias("corrected_label"))


def apply_corrections(df: DataFrame, identifier: str, label: str, latest: DataFrame) -> DataFrame:
    """Engineer corrections win over labels; ``was_corrected`` marks them."""
    joined = df.join(latest, identifier, "left")
    return joined.select(
        *[F.coalesce("corrected_label", F.col(label)).alias(label) if c == label else F.col(c) for c in df.columns],
        F.col("corrected_label").isNotNull().alias("was_corrected"),
    )


def distance_sketches(df: DataFrame, ts: str, topic: str, distance: str, every: str = "30 days", k: int = 200) -> DataFrame:
    """``window_start, topic, rows, total, sketch`` per time window and topic.

    ``sketch`` is a KLL quantile sketch of ``k`` (about 1.33 % rank error at 200), of
    a size that hardly depends on the rows; sums and sketches of any parts of the
    rows can be merged by ``merged_sketches``.
    """
    rows = df.where(F.col(distance).isNotNull()).select(
        F.window(F.col(ts), every)["start"].alias("window_start"), F.col(topic), F.col(distance).cast("double").alias("_d")
    )
    return rows.groupBy("window_start", topic).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_d").alias("total"), F.kll_sketch_agg_double("_d", F.lit(k)).alias("sketch")
    )


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of many parts as one for each group of ``by``."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketched_thresholds(sketches: DataFrame, topic: str, quantile: float = 0.95) -> DataFrame:
    """``confidence_thresholds`` from sketches: per topic, the distance beyond which an assignment needs review."""
    merged = merged_sketches(sketches, [topic])
    return merged.select(topic, F.kll_sketch_get_quantile_double("sketch", F.lit(quantile)).alias("threshold"))


def sketched_drift(sketches: DataFrame, topic: str, baseline: int = 0) -> DataFrame:
    """``centroid_drift`` from sketches: exact rows and means, medians within the sketch's rank error."""
    merged = merged_sketches(sketches, ["window_start", topic])
    means = merged.select(
        "window_start", topic, "rows", (F.col("total") / F.col("rows")).alias("mean_distance"),
        F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median_distance"),
    )
    whole = Window.partitionBy(topic).orderBy("window_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return means.withColumn("drift", F.col("mean_distance") - F.nth_value("mean_distance", baseline + 1).over(whole))
