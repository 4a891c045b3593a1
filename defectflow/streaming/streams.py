"""Structured Streaming forms of triage and topic counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from defectflow.operators.monitoring import distance_sketches, topic_counts_over_time
from defectflow.plans.triage import triage
from defectflow.sources.stages import upsert_stage


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None,
                max_files: int | None = None, **options) -> DataFrame:
    """Files arriving in a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_topic_counts(stream: DataFrame, ts: str, topic: str, every: str = "1 day", slide: str | None = None,
                        delay: str = "1 hour") -> DataFrame:
    """Windowed topic counts with a watermark; rows later than it may be dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return topic_counts_over_time(timed, ts, topic, every, slide)


def stream_triage(stream: DataFrame, centroids, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """``triage`` over a stream: no state and no aggregation."""
    return triage(stream, centroids, keep=keep, **options)


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet",
                    **options) -> StreamingQuery:
    """Process what is there into files and stop."""
    return (
        df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
        .trigger(availableNow=True).start(path)
    )


def write_available_complete(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode result as one Parquet table, rewritten per batch on the executors."""

    def replace(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        df.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


@dataclass
class WindowRun:
    """What a run over closed windows left: its watermark, the groups still held as state, the most that were held, and the groups dropped."""

    watermark: str | None
    state_rows: int
    most_state_rows: int
    dropped: int


def run_closed_counts(stream: DataFrame, ts: str, topic: str, path: str, checkpoint: str, every: str = "1 day",
                      slide: str | None = None, delay: str = "1 hour") -> WindowRun:
    """Append the counts of every window that has closed to a table, process what is there, and stop.

    A window closes when the watermark (the latest time seen, less ``delay``)
    reaches its end; it is written once and its state dropped. Rows that arrive for
    closed windows are left out (``late_counts`` tells how many); windows still
    open when the input ends stay in the state (``open_counts`` flushes them).
    """
    query = write_available(stream_topic_counts(stream, ts, topic, every, slide, delay), path, checkpoint)
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p.stateOperators]
    held = [p.stateOperators[0].numRowsTotal for p in progress]
    return WindowRun(
        progress[-1].eventTime.get("watermark") if progress else None, held[-1] if held else 0, max(held, default=0),
        sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress),
    )


def open_counts(rows: DataFrame, watermark: str, ts: str, topic: str, every: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts of the windows that the watermark has not reached, from all rows that were streamed.

    No row of such a window can have been late, so with the closed windows this
    is the whole result at the end of the input.
    """
    counts = topic_counts_over_time(rows.withColumn(ts, F.col(ts).cast("timestamp")), ts, topic, every, slide)
    return counts.where(F.col("window_end") > F.lit(watermark).cast("timestamp"))


def late_counts(rows: DataFrame, closed: DataFrame, watermark: str, ts: str, topic: str, every: str = "1 day",
                slide: str | None = None) -> DataFrame:
    """``window_start, window_end, topic, late``: how many rows each closed window went without."""
    counts = topic_counts_over_time(rows.withColumn(ts, F.col(ts).cast("timestamp")), ts, topic, every, slide)
    every_row = counts.where(F.col("window_end") <= F.lit(watermark).cast("timestamp"))
    written = closed.select("window_start", "window_end", F.col(topic), F.col("count").alias("_written"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("window_start", "window_end", topic)]
    joined = every_row.alias("a").join(written.alias("b"), same, "left")
    late = (F.col("count") - F.coalesce("_written", F.lit(0))).alias("late")
    return joined.select("a.window_start", "a.window_end", f"a.{topic}", late).where("late > 0")


def write_distance_sketches(stream: DataFrame, ts: str, topic: str, distance: str, path: str, checkpoint: str,
                            every: str = "30 days", k: int = 200) -> StreamingQuery:
    """Append the distance sketches of each micro-batch to a state table, process what is there, and stop.

    A batch writes its own folder, named by its number, so one that is run again
    after a failure replaces what it wrote. Late rows are merged like others.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        sketches = distance_sketches(batch.withColumn(ts, F.col(ts).cast("timestamp")), ts, topic, distance, every, k)
        sketches.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_corrections(stream: DataFrame, identifier: str, recency: list[str], path: str, checkpoint: str,
                      buckets: int = 64) -> StreamingQuery:
    """Keep the latest correction of each id in a state table, process what is there, and stop.

    A batch that is run again after a failure finds its own rows and changes nothing.
    """

    def merge(batch: DataFrame, _epoch: int) -> None:
        upsert_stage(batch, path, identifier, recency, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
