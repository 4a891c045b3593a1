"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from defectflow.llm.common import count_words, free_names
from defectflow.session import write_and_reread

_CHUNK = 1024  # blocks added up in one window when block sums are accumulated


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_repeats: int = 3,
    seed: int = 17,
    shards: int | None = None,
    shard_words: int = 4_000_000,
    block_words: int = 20_000,
    max_blocks: int = 1 << 20,
) -> DataFrame:
    """How often each document enters the mix, and in which output shards.

    Sources in code point order, null last, bear ``weights`` in turn and share
    the words of all documents by weight. No source is read more than
    ``max_repeats`` times: what it cannot give is shared again by weight among
    the others. Returns one row per row of ``docs``: ``id_col, source_rank, size,
    source_size, target, taken, copies, draws``, where ``draws`` lists ``(epoch,
    shard, place)`` of each copy; ``place`` orders the rows inside a shard.

    Method. A source is cut into random blocks of about ``block_words`` words by
    the hash of the id (larger blocks when there would be more than
    ``max_blocks``). Its target becomes a quota of blocks: whole passes, then the
    first blocks of one more pass, whose last block is taken document by
    document. A splitting tree deals the quotas: every node hands half of its
    block draws to its left child, a multivariate hypergeometric sample over the
    sources, so that each shard gets an exact quota of every source. Shards then
    own disjoint runs of the permuted blocks.

    Shuffles carry ids and counts, never texts. Sums are partial aggregates; a
    source that holds most rows meets others only by block, and blocks are of
    equal size. What is handled per source is one row per source, in one task.

    Null or empty texts have size 0 and are taken 0 words. Repeated rows each
    count. A source of size 0 has target 0. The same input and seed give the same
    mix, whatever the partitions. An empty table gives an empty result.
    """
    if min(weights) <= 0:
        raise ValueError("weights must be positive")
    sized = write_and_reread(
        docs.select(
            F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
            count_words(F.col(text_col)).alias("size"),
        ),
        "mix-sizes",
    )
    total_words, total_rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    block = max(block_words, -(-(total_words + total_rows) // max_blocks))
    if shards is None:
        shards = max(1, -(-total_words // shard_words))
    levels = max(0, (shards - 1).bit_length())

    sources = write_and_reread(_targets(sized, list(weights), max_repeats, total_words, block), "mix-sources")
    placed = sized.join(sources, F.col("_source").eqNullSafe(F.col("_name"))).select(
        "_id", "size", "source_rank", "source_size", "target", "_passes",
        F.pmod(F.xxhash64(F.lit(seed), "_id"), F.col("_blocks")).alias("_block"),
        F.xxhash64(F.lit(seed + 1), "_id").alias("_key"),
    )
    placed = write_and_reread(placed, "mix-placed")
    blocks = _block_quotas(placed, sources)
    quotas = blocks.groupBy("source_rank").agg(F.sum("_draws").alias("_quota"), F.max("_held").alias("_held"))
    held = sources.select("source_rank", "_passes").join(quotas, "source_rank")
    owners = _owners(_tree(quotas, levels, seed), held, seed)

    plan = blocks.join(owners, ["source_rank", "_index"], "left").select(
        "source_rank", "_block", "_partial", "_open", "_owners"
    )
    rows = placed.join(plan, ["source_rank", "_block"], "left")
    through = Window.partitionBy("source_rank", "_block").orderBy("_key", "_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    nearer = 2 * F.sum("size").over(through) - F.col("size") <= 2 * F.col("_open")
    rows = rows.withColumn("_extra", (F.col("_partial") == "all") | ((F.col("_partial") == "part") & nearer))
    drawn = F.filter("_owners", lambda d: (d["epoch"] < F.col("_passes")) | F.col("_extra"))
    return rows.withColumn("copies", (F.col("_passes") + F.col("_extra").cast("long"))).select(
        F.col("_id").alias(id_col), "source_rank", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies",
        F.transform(
            F.coalesce(drawn, F.array().cast("array<struct<epoch:bigint,shard:bigint>>")),
            lambda d: F.struct(
                d["epoch"].alias("epoch"), d["shard"].alias("shard"),
                F.xxhash64(F.lit(seed + 2), F.col("_key"), d["epoch"]).alias("place"),
            ),
        ).alias("draws"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, shuffled within shards.

    A row appears once per copy. Rows that repeat an id follow the one of them
    with most copies.
    """
    mix = mix_sources(docs, id_col=id_col, **options)
    name, held, draw = free_names(docs, "mix_id", "mix", "draw")
    draws = mix.groupBy(F.col(id_col).alias(name)).agg(F.max(F.struct("copies", "draws")).alias(held))
    rows = docs.join(draws.where(F.col(held)["copies"] > 0), F.col(id_col).eqNullSafe(F.col(name)))
    rows = rows.withColumn(draw, F.explode(F.col(held)["draws"]))
    shard, place = F.col(draw)["shard"], F.col(draw)["place"]
    return rows.repartition(shard).sortWithinPartitions(shard, place).select(*docs.columns)


def _targets(sized: DataFrame, weights: list[float], max_repeats: int, total: int, block: int) -> DataFrame:
    """One row per source: weight, target, number of blocks, whole passes."""
    held = sized.groupBy(F.col("_source").alias("_name")).agg(
        F.sum("size").alias("source_size"), F.count("*").alias("_rows")
    )
    ranked = held.withColumn(
        "source_rank", F.row_number().over(Window.orderBy(F.col("_name").asc_nulls_last())).cast("long") - 1
    ).withColumn("_weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")
    )).withColumn("_most", F.col("source_size") * F.lit(float(max_repeats)))
    # Sources fill up in the order of most / weight; the level at which the first one stays below its
    # most is the level of all that do.
    by_level = Window.orderBy("_fill", "source_rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(total)) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    filled = ranked.withColumn("_fill", F.col("_most") / F.col("_weight")).withColumn("_level", level)
    final = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "source_rank", "_level"))).over(
        Window.partitionBy()
    )["_level"]
    filled = filled.withColumn("target", F.least("_most", F.coalesce(final * F.col("_weight"), F.col("_most"))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return filled.withColumn("_passes", passes.cast("long")).select(
        "_name", "source_rank", "source_size", "target", "_passes",
        (F.col("target") - F.col("_passes") * F.col("source_size")).alias("_rest"),
        F.ceil((F.col("source_size") + F.col("_rows")) / F.lit(block)).cast("long").alias("_blocks"),
    )


def _block_quotas(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """Per block: how often it is drawn, and what its last, partial pass takes."""
    sums = placed.groupBy("source_rank", "_block").agg(F.sum("size").alias("_words"))
    sums = write_and_reread(sums.withColumn("_chunk", F.expr(f"_block div {_CHUNK}")), "mix-blocks")
    earlier = Window.partitionBy("source_rank").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sums.groupBy("source_rank", "_chunk").agg(F.sum("_words").alias("_sum"), F.count("*").alias("_n")).select(
        "source_rank", "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_nth"),
        F.sum("_n").over(Window.partitionBy("source_rank")).alias("_held"),
    )
    within = Window.partitionBy("source_rank", "_chunk").orderBy("_block")
    through = within.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum("_words").over(through), F.lit(0))
    blocks = sums.join(chunks, ["source_rank", "_chunk"]).withColumns(
        {"_ahead": ahead, "_index": F.col("_nth") + F.row_number().over(within) - 1}
    )
    blocks = blocks.join(sources.select("source_rank", "_passes", "_rest"), "source_rank").withColumn(
        "_open", F.col("_rest") - F.col("_ahead")
    )
    partial = F.when(F.col("_open") >= F.col("_words"), "all").when(F.col("_open") > 0, "part").otherwise("none")
    partial = F.when(F.col("_rest") <= 0, "none").otherwise(partial)
    blocks = blocks.withColumn("_partial", partial)
    return write_and_reread(blocks.select(
        "source_rank", "_block", "_partial", "_open", "_index", "_held",  # blocks without rows are passed over
        (F.col("_passes") + (F.col("_partial") != "none").cast("long")).alias("_draws"),
    ), "mix-quotas")


def _tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """``shard, source_rank, count``: the leaves of the splitting tree.

    A node is one row with its quota of every source. Going through the draws of
    a node one by one, each goes left with the odds of the places that are left,
    which makes the left quotas multivariate hypergeometric.
    """
    nodes = quotas.agg(
        F.sort_array(F.collect_list(F.struct("source_rank", F.col("_quota").alias("count")))).alias("quotas")
    ).select(F.lit(1).cast("long").alias("node"), "quotas")
    longs = "array<bigint>"
    size = F.aggregate("quotas", F.lit(0).cast("long"), lambda n, q: n + q["count"])
    for level in range(levels):
        def split(state, quota):
            draws = F.when(quota["count"] > 0, F.sequence(F.lit(1).cast("long"), quota["count"]))
            start = F.struct(
                state["left"].alias("left"), state["open"].alias("open"), F.lit(0).cast("long").alias("taken"),
                state["out"].alias("out"),
            )

            def one(s, _):
                luck = F.xxhash64(F.lit(seed), F.lit(levels), F.col("node"), s["open"])
                goes = (F.pmod(luck, s["open"]) < s["left"]).cast("long")
                return F.struct(
                    (s["left"] - goes).alias("left"), (s["open"] - 1).alias("open"),
                    (s["taken"] + goes).alias("taken"), s["out"].alias("out"),
                )

            return F.aggregate(F.coalesce(draws, F.array().cast(longs)), start, one, lambda s: F.struct(
                s["left"].alias("left"), s["open"].alias("open"), F.concat(s["out"], F.array(s["taken"])).alias("out"),
            ))

        first = F.struct(F.floor(size / 2).alias("left"), size.alias("open"), F.array().cast(longs).alias("out"))
        halves = nodes.withColumn("_left", F.aggregate("quotas", first, split, lambda s: s["out"]))

        def child(right):
            return F.struct(
                (F.col("node") * 2 + int(right)).alias("node"),
                F.zip_with("quotas", "_left", lambda q, x: F.struct(
                    q["source_rank"].alias("source_rank"), (q["count"] - x if right else x).alias("count")
                )).alias("quotas"),
            )

        nodes = halves.select(F.explode(F.array(child(False), child(True))).alias("_child")).select("_child.*")
        nodes = nodes.repartition(2 ** (level + 1), "node") if level % 4 == 3 else nodes
    return write_and_reread(nodes, "mix-tree").select(
        (F.col("node") - 2**levels).alias("shard"), F.inline("quotas")
    )


def _owners(leaves: DataFrame, held: DataFrame, seed: int) -> DataFrame:
    """Per block the shards that draw it, one for each pass.

    The shards of a source own runs of its draws in order. Every whole pass goes
    through the blocks from another one on, the partial pass from the first.
    """
    earlier = Window.partitionBy("source_rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = leaves.withColumn("_start", F.coalesce(F.sum("count").over(earlier), F.lit(0))).where("count > 0")
    runs = runs.join(held, "source_rank")
    draws = runs.select(
        "source_rank", "_held", "_passes", "shard",
        F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("count") - 1)).alias("_draw"),
    ).withColumn("epoch", F.expr("_draw div _held"))
    turn = F.when(
        F.col("epoch") < F.col("_passes"), F.pmod(F.xxhash64(F.lit(seed), "source_rank", "epoch"), F.col("_held"))
    ).otherwise(0)
    place = F.pmod(F.col("_draw") + turn, F.col("_held"))
    return draws.groupBy("source_rank", place.alias("_index")).agg(
        F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("_owners")
    )
