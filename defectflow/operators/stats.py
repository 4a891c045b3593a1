"""Counts, descriptive statistics, exact quantiles, seeded splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from defectflow.operators.lookups import keyed_join, seeded_key, top_per_group


def value_counts(df: DataFrame, column: str, by: str = "count") -> DataFrame:
    """Rows per value, nulls left out, ordered by ``count`` (descending) or ``key``."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(column) if by == "key" else counts.orderBy(F.desc("count"), column)


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float],
                    accuracy: int = 10_000) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: columns ``q0, q1, …``.

    A mergeable sketch brackets each quantile between two values; only values
    in the bracket are ranked, after being counted per distinct value. Values
    under the bracket are counted as one. The bracket is three times the
    sketch's guaranteed rank error, and groups smaller than the sketch are
    ranked whole, so the result is exact and no task sorts a whole group.
    """
    keys = group or ["_all"]
    base = df.where(F.col(value).isNotNull())
    if not group:
        base = base.withColumn("_all", F.lit(0))
    base = base.select(*keys, F.col(value).cast("double").alias("_v"))
    out = _ranked(base, keys, _sketch(base, keys, probs, accuracy), probs, accuracy)
    return out.select(*group, *[f"q{i}" for i in range(len(probs))])


def _sketch(base: DataFrame, keys: list[str], probs: list[float], accuracy: int, *more: Column) -> DataFrame:
    """Count, extremes, sketched brackets and any further aggregates per group."""
    margin = 3.0 / accuracy
    lows = F.percentile_approx("_v", [max(p - margin, 0.0) for p in probs], accuracy)
    highs = F.percentile_approx("_v", [min(p + margin, 1.0) for p in probs], accuracy)
    return base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        lows.alias("_lows"), highs.alias("_highs"), *more,
    )


def _ranked(base: DataFrame, keys: list[str], sketch: DataFrame, probs: list[float], accuracy: int) -> DataFrame:
    """Rank the values inside each bracket and interpolate."""
    margin = 3.0 / accuracy
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            F.when((F.col("_n") <= accuracy) | F.lit(p - margin <= 0), F.col("_min"))
            .otherwise(F.col("_lows")[i]).alias("lo"),
            F.when((F.col("_n") <= accuracy) | F.lit(p + margin >= 1), F.col("_max"))
            .otherwise(F.col("_highs")[i]).alias("hi"),
            ((F.col("_n") - 1) * F.lit(p)).alias("h"),
        )
        for i, p in enumerate(probs)
    ])
    counted = (
        keyed_join(base, sketch.select(*keys, brackets.alias("_b")), keys, "inner")
        .select(*keys, "_v", F.explode("_b").alias("_b"))
        .where(F.col("_v") <= F.col("_b.hi"))
        .groupBy(*keys, F.col("_b.i").alias("_i"), F.col("_b.h").alias("_h"),
                 F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    order = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v"))
    ranked = counted.withColumn(
        "_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    # The value at zero-based rank r is the first whose running count passes r.
    picked = ranked.groupBy(*keys, "_i", "_h").agg(
        F.min(F.when(F.col("_upto") > F.floor("_h"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil("_h"), F.col("_v"))).alias("_z"),
    ).withColumn("_q", F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_h") - F.floor("_h")))
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probs))
    ])


def describe(df: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, std (n-1), min, quartiles, max.

    Two passes. Without values the count is 0 and the rest null.
    """
    probs, accuracy = [0.25, 0.5, 0.75], 10_000
    base = df.where(F.col(value).isNotNull()).select(F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v"))
    sketch = _sketch(base, [], probs, accuracy, F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"))
    sketch = sketch.withColumn("_all", F.lit(0))
    held = df.sparkSession.createDataFrame(sketch.toArrow(), sketch.schema)  # one row
    quartiles = _ranked(base, ["_all"], held, probs, accuracy)
    return held.join(quartiles, "_all", "left").select(
        F.col("_n").alias("count"), "mean", "std", F.col("_min").alias("min"), F.col("q0").alias("p25"),
        F.col("q1").alias("p50"), F.col("q2").alias("p75"), F.col("_max").alias("max"),
    )


def seeded_sample(df: DataFrame, identifier: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded order; a per-partition top-k, not a full sort."""
    return df.orderBy(seeded_key(F.col(identifier), seed), identifier).limit(n)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows in an explicit order (files have none of their own)."""
    return df.orderBy(*order).limit(n)


def group_samples(df: DataFrame, group: str, identifier: str, n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` seeded rows of each group, numbered by ``rank``."""
    keyed = df.withColumn("_key", seeded_key(F.col(identifier), seed))
    return top_per_group(keyed, [group], [F.col("_key"), F.col(identifier)], n).drop("_key")


def stratified_split(df: DataFrame, stratum: str, identifier: str, seed: int = 42,
                     shares=(0.70, 0.85), names=("train", "val", "test"), prefix: int = 3) -> DataFrame:
    """Add ``split``: exact shares per stratum, whatever the partitioning.

    Row ``r`` of a stratum, in seeded order, goes to the first split whose
    rounded share reaches ``r``. The cut keys come from counts per key prefix;
    only the prefixes a cut falls into are ranked. Marking the rows is then a
    comparison with the cut keys of their stratum: no shuffle of the data and
    no task holding a whole stratum.
    """
    keyed = df.withColumn("_key", seeded_key(F.col(identifier), seed))
    slim = keyed.select(F.col(stratum).alias("_s"), "_key", F.substring("_key", 1, prefix).alias("_p"))
    counts = slim.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = (
        counts.withColumn("_upto", F.sum("_c").over(running))
        .withColumn("_n", F.sum("_c").over(Window.partitionBy("_s")))
    )
    # One row per stratum and cut: the prefix the cut lies in and the rank there.
    cuts = (
        upto.withColumn("_t", F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.round(F.col("_n") * F.lit(s)).cast("long").alias("r"))
            for i, s in enumerate(shares)
        ])))
        .where((F.col("_t.r") > F.col("_upto") - F.col("_c")) & (F.col("_t.r") <= F.col("_upto")))
        .select("_s", "_p", F.col("_t.i").alias("_i"), (F.col("_t.r") - F.col("_upto") + F.col("_c")).alias("_r"))
        .groupBy("_s", "_p").agg(F.collect_list(F.struct("_i", "_r")).alias("_cuts"))
    )
    inside = Window.partitionBy("_s", "_p").orderBy("_key")
    cut_keys = (
        keyed_join(slim, cuts, ["_s", "_p"], "inner")
        .withColumn("_rank", F.row_number().over(inside))
        .withColumn("_cut", F.explode("_cuts"))
        .where(F.col("_cut._r") == F.col("_rank"))
        .groupBy("_s").agg(*[
            F.max(F.when(F.col("_cut._i") == i, F.col("_key"))).alias(f"_cut{i}") for i in range(len(shares))
        ])
        .withColumnRenamed("_s", stratum)
    )
    marked = keyed_join(keyed, cut_keys, [stratum], "left")
    split = F.when(F.col("_key") <= F.col("_cut0"), names[0])
    for i in range(1, len(shares)):
        split = split.when(F.col("_key") <= F.col(f"_cut{i}"), names[i])
    return marked.select(*df.columns, split.otherwise(names[-1]).alias("split"))


def split_report(df: DataFrame, *by: str) -> DataFrame:
    """Rows per split (and further columns) and their share of all rows in percent."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy("split", *by).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "percent", F.round(F.col("rows") * 100.0 / total, 4)
    )


def shape_report(df: DataFrame) -> DataFrame:
    """Row count, column count and column names of a table, as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(",".join(df.columns)).alias("names")
    )


def mean_difference(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Mean of two measures and of their difference."""
    return df.agg(
        F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"),
        (F.avg(before) - F.avg(after)).alias("mean_removed"),
    )
