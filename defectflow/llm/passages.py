"""Repeated passages by sparse suffix arrays over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from defectflow.llm.common import free_names
from defectflow.llm.ngram_join import WordCodes
from defectflow.session import write_and_reread

_GRAM = 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class WordHashes:
    """Hashes of any run of words of one text, from one array of prefix sums."""

    def __init__(self, text: str, codes: WordCodes):
        self.words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space only
        n = len(self.words)
        values = codes.of(self.words)
        with np.errstate(over="ignore"):
            powers = np.full(n + 1, _STEP)
            powers[:1] = 1
            self.powers = np.multiply.accumulate(powers)
            sums = np.zeros(n + 1, "uint64")
            np.cumsum(_mix(values) * self.powers[:n], out=sums[1:])
        self.sums = sums

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of words ``starts .. ends``; equal runs agree wherever they stand."""
        # Words stand by their distance from the end of the text: that is brought to a common place.
        shift = self.powers[len(self.words) - starts]
        return _mix((self.sums[ends] - self.sums[starts]) * shift * _inverse_power(len(self.words)))

    def segments(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Minimiser hash, first and last window start, and whole-segment hash of each segment.

        A window of ``window`` words selects the smallest of its 16-word hashes,
        the first of equals; windows next to each other with one selected place
        form a segment.
        """
        n = len(self.words) - window + 1
        if n < 1:
            return (np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "uint64"))
        starts = np.arange(len(self.words) - _GRAM + 1)
        grams = self.runs(starts, starts + _GRAM)
        view = np.lib.stride_tricks.sliding_window_view(grams, window - _GRAM + 1)
        place = np.concatenate([
            view[i : i + 65_536].argmin(1) + np.arange(i, min(i + 65_536, n)) for i in range(0, n, 65_536)
        ])
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], n) - 1
        return grams[place[first]], first, last, self.runs(first, last + window)


def _inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(pow(int(_STEP), -1, 1 << 64), n, 1 << 64))


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50
) -> DataFrame:
    """Passages of ``min_words`` words or more that stand in two documents or more.

    Returns ``id_col, n_words, repeated_words, spans, copies`` for every document
    that holds one: ``spans`` are the stretches ``(start, words)`` of windows of
    ``min_words`` words that also stand in another document, ``copies`` those of
    windows that stand in one with a smaller id, which is what a cut removes.
    Words are separated by ASCII white space and compared as they are, by 64-bit
    hashes.

    Sparse suffix arrays. Each window of ``min_words`` words selects its least
    16-word hash, so equal windows select the same suffix wherever they stand, and
    about one suffix in eighteen is kept. Suffixes are brought together by that
    hash, and neighbours are compared over all windows that selected them, to the
    left and to the right: alike in the whole segment first, then, where texts
    part within it, window by window. Equal segments are compared once, by one of
    them.

    All comparisons are minima and maxima of ids per hash, with partial
    aggregates, so that a passage in very many documents needs no task of its own;
    the outcome returns to the rows by plain joins of written tables. One
    document's spans are put together in one row. Ids are whole numbers; a repeat
    inside one document does not count, nor do rows that repeat an id. Null texts,
    texts of fewer words and null ids have no passages. An empty table gives an
    empty result.
    """
    if min_words <= _GRAM:
        raise ValueError(f"min_words must exceed {_GRAM}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(
        "id is not null"
    )
    suffixes = write_and_reread(rows.mapInArrow(
        lambda batches: _suffixes(batches, min_words), "key bigint, chunk bigint, id bigint, first int, last int"
    ), "passages-suffixes")
    edge = F.struct("id", "first", "last")
    chunks = suffixes.groupBy("key", "chunk").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.min(edge).alias("seen")
    )
    chunks = write_and_reread(chunks, "passages-chunks")
    keys = chunks.groupBy("key").agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.count("*").alias("_n"))
    keys = write_and_reread(keys.where("_low <> _high").select("key", "_n"), "passages-keys")
    near = write_and_reread(chunks.join(keys, "key"), "passages-near")

    # Segments whose neighbours part within them: compared window by window.
    asked = near.where("_n > 1").groupBy(F.col("seen.id").alias("id")).agg(
        F.collect_list(F.struct("chunk", "seen.first", "seen.last", "low", "high")).alias("asked")
    )
    windows = rows.join(asked, "id").mapInArrow(
        lambda batches: _windows(batches, min_words), "chunk bigint, place int, low bigint, high bigint, window bigint"
    )
    windows = write_and_reread(windows.dropDuplicates(["chunk", "place"]), "passages-windows")
    shared = windows.groupBy("window").agg(F.min("low").alias("first"), F.max("high").alias("_last"))
    shared = write_and_reread(shared.where("first <> _last").select("window", "first"), "passages-shared")
    parts = windows.join(shared, "window").groupBy("chunk").agg(
        F.collect_list(F.struct("place", "first")).alias("hits")
    )
    same = near.where("_n = 1").select(
        "chunk", F.transform(F.sequence(F.lit(0), F.col("seen.last") - F.col("seen.first")), lambda p: F.struct(
            p.cast("int").alias("place"), F.col("low").alias("first")
        )).alias("hits")
    )
    hits = write_and_reread(parts.unionByName(same), "passages-hits")
    found = suffixes.join(hits, "chunk").select("id", F.explode("hits").alias("hit"), F.col("first").alias("begin"))
    found = found.groupBy("id").agg(F.collect_set(F.struct(
        (F.col("begin") + F.col("hit.place")).alias("start"), (F.col("hit.first") < F.col("id")).alias("copy")
    )).alias("starts"))

    span = "array<struct<start:int,words:int>>"

    @F.arrow_udf(f"struct<spans:{span},copies:{span},words:bigint>")
    def spans(starts: pa.Array) -> pa.Array:
        return _spans(starts, min_words)

    found = found.withColumn("_s", spans("starts"))
    sizes = suffixes.groupBy("id").agg((F.max("last") + min_words).cast("long").alias("n_words"))
    return found.join(sizes, "id").select(
        F.col("id").alias(id_col), "n_words", F.col("_s.words").alias("repeated_words"), F.col("_s.spans").alias("spans"),
        F.col("_s.copies").alias("copies"),
    )


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with every passage left only in the document with the smallest id that holds it."""
    found = repeated_passages(docs, id_col, text_col, min_words).where("size(copies) > 0")
    cut_id, held = free_names(docs, "cut_id", "copies")
    rows = docs.join(
        found.select(F.col(id_col).alias(cut_id), F.col("copies").alias(held)), F.col(id_col).cast("long") == F.col(cut_id), "left",
    )

    @F.pandas_udf("string")
    def cut(texts, copies):
        import re

        out = []
        for text, spans in zip(texts, copies, strict=True):
            if text is not None and spans is not None and len(spans):
                words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                kept, at = [], 0
                for s in spans:
                    kept.append(text[at : words[s["start"]][0]])
                    at = words[s["start"] + s["words"] - 1][1]
                text = "".join([*kept, text[at:]])
            out.append(text)
        import pandas as pd

        return pd.Series(out)

    return rows.withColumn(text_col, cut(F.col(text_col), F.col(held))).select(*docs.columns)


def _spans(starts: pa.Array, width: int, held: int = 1 << 20) -> pa.Array:
    """``spans, copies, words`` of rows of window starts; about ``held`` starts at once, none of them a Python object."""
    ends, out, begin = np.cumsum(np.asarray(starts.value_lengths())), [], 0
    while begin < len(starts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + held, "right")))
        part = starts.slice(begin, end - begin)
        cells, row = part.flatten(), np.repeat(np.arange(len(part)), np.asarray(part.value_lengths()))
        at, copy = cells.field("start").to_numpy(), cells.field("copy").to_numpy(zero_copy_only=False)
        whole, words = _merged(row, at, len(part), width)
        copies, _ = _merged(row[copy], at[copy], len(part), width)
        out.append(pa.StructArray.from_arrays([whole, copies, pa.array(words)], ["spans", "copies", "words"]))
        begin = end
    span = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("spans", span), ("copies", span), ("words", pa.int64())]))


def _merged(row: np.ndarray, start: np.ndarray, rows: int, width: int) -> tuple[pa.Array, np.ndarray]:
    """The stretches that windows of ``width`` words cover in each row, and how many words they have together."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + width)))[: len(row)])
    words = start[np.append(first[1:], len(row))[: len(first)] - 1] + width - start[first]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=rows))))
    cells = pa.StructArray.from_arrays([pa.array(c.astype("int32")) for c in (start[first], words)], ["start", "words"])
    total = np.bincount(row[first], words, rows).astype("int64")
    return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), cells), total


def _suffixes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()
    for batch in batches:
        held = []
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            value = text.as_py() or ""
            grams, first, last, whole = WordHashes(value, codes).segments(window)
            held.append((grams, whole, np.full(len(grams), key), first.astype("int32"), last.astype("int32")))
        columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else []
        if columns and len(columns[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.view("int64") if c.dtype == "uint64" else c) for c in columns],
                ["key", "chunk", "id", "first", "last"],
            )


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()
    for batch in batches:
        for text, asked in zip(batch.column("text"), batch.column("asked"), strict=True):
            hashes = WordHashes(text.as_py() or "", codes)
            out = []
            for one in asked.as_py():
                starts = np.arange(one["first"], one["last"] + 1)
                if one["last"] + window > len(hashes.words):
                    continue  # another row with the same id
                found = hashes.runs(starts, starts + window).view("int64")
                n = len(starts)
                out.append((np.full(n, one["chunk"]), np.arange(n, dtype="int32"), np.full(n, one["low"]),
                            np.full(n, one["high"]), found))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                    ["chunk", "place", "low", "high", "window"],
                )
