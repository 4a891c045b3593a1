"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space; words are the maximal runs of anything else.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def without_spaces(text: Column) -> Column:
    """The text without ASCII white space."""
    for mark in SPACES:
        text = F.replace(text, F.lit(mark))
    return text


def count_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def distinct_names(columns: list[str]) -> None:
    """Refuse result columns that would bear one name."""
    lower = [c.lower() for c in columns]
    if len(set(lower)) != len(lower):
        raise ValueError(f"columns would share a name: {sorted(columns)}")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be none of the table's columns."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


_BITS_PER_MAP = 8 * 4096  # fixed by bitmap_construct_agg


def key_filter(keys: DataFrame, bits: int) -> DataFrame:
    """A bit map of ``bits`` bits of the hashes of all columns of ``keys``, in rows of 4 KB.

    Its size does not depend on the number of keys, so it may be broadcast.
    """
    if not 0 < bits <= 1 << 30 or bits % _BITS_PER_MAP:
        raise ValueError(f"bits must be a multiple of {_BITS_PER_MAP}, 2**30 at most")
    slots = keys.select(F.pmod(F.xxhash64(*keys.columns), F.lit(bits)).alias("_slot"))
    return slots.groupBy(F.expr(f"_slot div {_BITS_PER_MAP}").alias("_map")).agg(
        F.bitmap_construct_agg(F.col("_slot") % _BITS_PER_MAP).alias("_bits")
    )


def maybe_among(rows: DataFrame, keys: list[str], filter_map: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with a column ``name``: false where the key is surely not among those of the filter."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marked = rows.withColumns({"_slot": slot, "_map": F.floor(slot / _BITS_PER_MAP)})
    marked = marked.join(F.broadcast(filter_map), "_map", "left")
    place = F.col("_slot") % _BITS_PER_MAP
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return marked.withColumn(name, found).select(*rows.columns, name)


def parts(batches: Iterator[pa.RecordBatch], chars: int, column: str = "_text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of Arrow batches with their texts: about ``chars`` characters, or one text if that is longer."""
    for batch in batches:
        texts: list[str | None] = []
        begin = size = 0
        for k, value in enumerate(batch.column(column)):
            texts.append(value.as_py())
            size += len(texts[-1] or "")
            if size >= chars or k == batch.num_rows - 1:
                yield batch.slice(begin, k + 1 - begin), texts
                begin, size, texts = k + 1, 0, []


def bit_map(keys: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits, set at the low bits of the 64-bit keys in the one column of ``keys``.

    ``bits`` is a power of two; the size does not depend on the number of keys, so it may pass the driver.
    """
    slots = keys.select(F.col(keys.columns[0]).bitwiseAND(bits - 1).alias("_slot"))
    # Keys are shuffled, eight bytes each, and not the maps of every task.
    slots = slots.withColumn("_map", F.expr(f"_slot div {_BITS_PER_MAP}")).repartition("_map")
    maps = slots.groupBy("_map").agg(F.bitmap_construct_agg(F.col("_slot") % _BITS_PER_MAP).alias("_bits"))
    held = np.zeros(bits // 8, "uint8")
    for row in maps.collect():  # 4 KB each, no more than the bits need
        at = row["_map"] * (_BITS_PER_MAP // 8)
        held[at : at + _BITS_PER_MAP // 8] = np.frombuffer(row["_bits"], "uint8")
    return held


def in_bit_map(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in the bit map; false is certain."""
    slot = (keys.view("uint64") & np.uint64(8 * len(held) - 1)).astype("int64")
    return (held[slot >> 3] >> (slot & 7).astype("uint8")) & 1 > 0


def discard(table: DataFrame) -> None:
    """Delete the files of a written hand-off after its last reader has run."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
