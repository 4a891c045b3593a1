"""Exact duplicates by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from defectflow.llm.common import distinct_names, free_names, key_filter, maybe_among, whole, without_spaces
from defectflow.session import write_and_reread


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    prefix: int = 128,
    filter_bits: int = 1 << 26,
) -> DataFrame:
    """Which rows hold equal texts, and which one of each group stays.

    Texts are equal when they agree once ASCII white space is deleted; null is
    the empty text. Of equal texts the one with most code points in its original
    form stays, then the smallest id. Rows come back one for one as ``id_col,
    keep_id, group_size, kept`` and the columns named in ``carry``.

    Refinement: (1) rows are counted by length and by the hash of the first
    ``prefix`` characters within a length, which also settles every length that
    occurs once; (2) only rows of a (length, prefix) group with two rows or more
    have their whole content hashed; (3) those are grouped by the full hash.
    Which groups survive (1) reaches the second scan as a bit map of
    ``filter_bits`` bits, so what is broadcast is bounded by ``filter_bits / 8``
    bytes at any size, no text is shuffled, and a chance hit in the map only
    costs one needless hash. Groups are counted with partial aggregates; the
    answer returns to the rows by a plain join of two written tables, which
    adaptive execution splits when one group is large.

    Rows that repeat an id and a text count as rows of their group and all get
    the same answer. A null id is ordered before others. Empty tables give empty
    results. Columns of ``docs`` that are not named are never touched.
    """
    distinct_names([id_col, "keep_id", "group_size", "kept", *carry])
    text = whole(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(c) for c in carry]).alias("_carry"),
        without_spaces(text).alias("_text"), F.length(text).alias("_chars"),
    ).withColumns({"_length": F.length("_text"), "_head": F.xxhash64(F.substring("_text", 1, prefix))})

    groups = rows.groupBy("_length", "_head").count().where("count > 1")
    survivors = key_filter(groups.select("_length", "_head"), filter_bits)
    marked = maybe_among(rows, ["_length", "_head"], survivors, filter_bits, "_shared")
    full = F.when(F.col("_shared"), F.unhex(F.sha2("_text", 256)))
    hashed = write_and_reread(marked.select("_id", "_carry", "_length", "_chars", full.alias("_full")), "dedup-hash")

    shared = hashed.where("_full is not null")
    best = shared.groupBy("_length", "_full").agg(
        F.min(F.struct((-F.col("_chars")).alias("n"), F.col("_id").alias("id"))).alias("_best"),
        F.count("*").alias("_rows"),
    ).where("_rows > 1")
    best = write_and_reread(best, "dedup-best")
    answer = shared.join(best, ["_length", "_full"], "left").select(
        "_id", "_carry",
        F.when(F.col("_rows").isNull(), F.col("_id")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("_rows", F.lit(1)).cast("long").alias("group_size"),
    ).unionByName(
        hashed.where("_full is null").select(
            "_id", "_carry", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
        )
    )
    return answer.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *[F.col("_carry")[c].alias(c) for c in carry],
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all columns.

    Rows that repeat both id and text are one document: one of them stays. Rows
    that repeat an id with different texts are different documents. Null ids and
    texts, empty tables and clashing names are those of :func:`exact_dedup`; columns may
    have any names.
    """
    content, place, kept_id, kept_content = free_names(docs, "content", "place", "kept_id", "kept_content")
    rows = docs.withColumn(content, F.sha2(without_spaces(whole(F.col(text_col))), 256))
    kept = exact_dedup(rows, id_col, text_col, carry=[content]).where("kept")
    kept = kept.select(F.col(id_col).alias(kept_id), F.col(content).alias(kept_content)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(content) == F.col(kept_content))
    order = Window.partitionBy(id_col, content).orderBy(F.length(whole(F.col(text_col))).desc(), F.col(text_col))
    ranked = rows.join(kept, same, "left_semi").withColumn(place, F.row_number().over(order))
    return ranked.where(F.col(place) == 1).select(*docs.columns)
