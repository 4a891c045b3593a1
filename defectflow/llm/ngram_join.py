"""Jaccard join of documents on word shingles by T-occurrence search (DivideSkip)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from defectflow.llm.common import discard, free_names, key_filter, maybe_among
from defectflow.llm.links import components
from defectflow.session import write_and_reread

WIDTH = 5
_SLOTS = 1 << 18  # of the frequency sketch
_SIGN_BITS = 1024  # at least
_FILTER_BITS = 1 << 26
_MULTIPLIERS = [np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
)]
_LIST_BLOCK = 1 << 16  # rows of one list held while leaders are named
_BLOCK = 4096  # rows of one list in a block when pairs are sought
_STEP = 1024
_NEAREST = 2
_TOGETHER = 1 << 18  # rows of the lists of one component that a task compares
_HELD = 1 << 20  # open pairs that are held before they are counted; twice as many counted ones are
_FEW = 4  # open pairs for each row of a list
_PAIRS = "a bigint, b bigint, n_a bigint, n_b bigint, k bigint"


class WordCodes(dict):
    """Eight bytes for every word; a bounded number of them are remembered."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_digest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "u8")


def shingles(text: str | None, codes: WordCodes) -> np.ndarray:
    """The sorted distinct 64-bit codes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return np.zeros(0, "uint64")
    found = codes.of(words)
    width = min(WIDTH, len(found))
    mixed = np.full(len(found) - width + 1, width, "uint64")
    for i in range(width):
        mixed += found[i : i + len(mixed)] * _MULTIPLIERS[i]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def _needed(n, m):
    """The least intersection at which sets of ``n`` and ``m`` link: 100 i >= 75 (n + m - i)."""
    return -(-3 * (n + m) // 7)


def link_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents that are joined by links of Jaccard similarity 0.75 or more.

    Returns ``id_col, n_shingles, component_id, set_id`` for every row: the size
    of its set of five-word shingles (the whole sequence for one to four words,
    none without words), the smallest id that can be reached over links, and the
    smallest id with the very same set. Ids are whole numbers. Rows without words
    link with nothing; rows that repeat an id count as one document. Null ids stay
    alone. An empty table gives an empty result.

    T-occurrence search, in Spark's terms. Shingles have one order, rare ones
    first. A set of ``n`` must share ``t = ceil(3 (n + m) / 7)`` shingles with a
    partner of ``m``, so of its inverted lists the last ``t - 1``, the long ones,
    need no merging: a partner must occur in one of the others. Only those short
    lists are shuffled (a quarter of the shingles, a seventh when a set is the
    smaller one). They are merged by Spark's sort, which is a merge of runs with a
    heap, and give the candidates; the long lists are probed by binary search for
    every candidate, and pairs with enough shingles stay. Sets are compared by
    64-bit codes.

    The merge counts in how many short lists a candidate occurs. Of two sets, take
    the one whose short lists end at the rarer shingle: what they share beyond is
    in its long lists, so ``t`` less the number of its long lists must have been
    met. Candidates with fewer occurrences go, and so do those whose parity signs
    (a bit for each slot, about four slots a shingle) differ too often.

    How dense groups stay linear: equal sets are one set from the start. A first
    round links each set to the nearest leaders of its lists only. While lists
    hold many pairs of sets that are not yet in one component, and their number
    falls, another round leads each set to other leaders, outside of its component.
    The last round takes all such pairs that are left. Lists in which the same component has most
    rows go to the same task, about 260,000 rows at a time, so that a pair that meets in many of them is counted there
    and sent once; it is not sent if the lists that one of the two has elsewhere are too few to make up what it lacks.
    No list is collected: a long one is cut into blocks at random, and a task gets
    two blocks at a time. Tables are deleted after their last reader.
    The order comes from counts of all shingles in a table of fixed size; that
    table (2 MB) is all that is broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    weights = docs.sparkSession.sparkContext.broadcast(_weights(rows))
    signed = write_and_reread(rows.select("id", "text").mapInArrow(
        lambda batches: _signatures(batches, weights.value),
        "id bigint, n bigint, key_a bigint, key_b bigint, sign binary, prefix array<bigint>",
    ), "join-signatures")
    same = signed.where("n > 0 and id is not null").groupBy("n", "key_a", "key_b").agg(F.min("id").alias("set_id"))
    same = write_and_reread(same, "join-sets")
    sets = signed.join(same.select(F.col("set_id").alias("id"), "n", "key_a", "key_b"), ["id", "n", "key_a", "key_b"])
    lists = sets.select("id", F.explode("prefix").alias("token")).repartition("token").sortWithinPartitions("token", "id")
    shared = write_and_reread(lists.mapInArrow(_leaders, "token bigint, id bigint, leader bigint"), "join-lists")
    signs = write_and_reread(sets.select("id", "n", "sign").dropDuplicates(["id"]), "join-signs")
    near = shared.where("leader <> id").groupBy("id", "leader").count()
    by_count = Window.partitionBy("id").orderBy(F.col("count").desc(), "leader")
    near = near.withColumn("_k", F.row_number().over(by_count)).where(f"_k <= {_NEAREST}")
    near = near.select(F.col("id").alias("a"), F.col("leader").alias("b"), F.col("count").alias("k"))
    nearest = sizes = write_and_reread(near, "join-nearest")
    for side in ("a", "b"):
        sizes = sizes.join(signs.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}")), side)

    links = _verify(_met(sizes), signs, rows)
    discard(nearest)
    placed, mixed, least = _open_lists(shared, signs, links)
    while least:
        led = _verify(_led(placed.join(mixed, "token")), signs, rows)
        links = links.unionByName(led)
        for table in (placed, mixed):
            discard(table)
        placed, mixed, least = _open_lists(shared, signs, links, least)
    discard(shared)

    rest = placed.join(_grouped(mixed), "token").withColumn("total", F.count("*").over(Window.partitionBy("id")))
    rest = _block_pairs(rest).mapInArrow(_open_pairs, _PAIRS)
    rest = rest.groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))
    links = links.unionByName(_verify(_met(rest), signs, rows))
    for table in (placed, mixed, signs):
        discard(table)
    classes = components(write_and_reread(links, "join-links")).withColumnRenamed("node", "set_id")
    known = write_and_reread(same.join(classes, "set_id", "left").select(
        "n", "key_a", "key_b", "set_id", F.coalesce("component_id", "set_id").alias("component_id")
    ), "join-classes")
    whole = signed.select("id", "n", "key_a", "key_b")
    with_words = whole.where("n > 0 and id is not null").join(known, ["n", "key_a", "key_b"])
    alone = whole.where("n = 0 or id is null").withColumns({"set_id": F.col("id"), "component_id": F.col("id")})
    return with_words.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "set_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, and rows without words."""
    classes, (stay,) = link_near_copies(docs, id_col, text_col), free_names(docs, "stay")
    kept = classes.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(stay)).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(stay)), "left_semi")


def _open_lists(shared: DataFrame, signs: DataFrame, links: DataFrame, before: int | None = None) -> tuple:
    """Rows of the lists with size and component, the lists that hold two components or more, and their open pairs.

    Open are pairs of sets in different components. The number is 0 when they are
    few, or when a round has not made them fewer by a tenth: then all can be taken.
    """
    found = write_and_reread(components(links), "join-components")
    state = signs.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
    placed = shared.select("token", "id").join(state, "id")
    placed = placed.select("token", "id", "n", F.coalesce("component_id", "id").alias("component"))
    placed = write_and_reread(placed, "join-placed")
    discard(found)
    size, squares = F.sum("count"), F.sum(F.col("count") * F.col("count"))
    # One shuffle for both groupings.
    mixed = placed.select("token", "component").repartition("token").groupBy("token", "component").count().groupBy("token").agg(
        F.count("*").alias("_components"), size.alias("_size"), (size * size - squares).alias("_open"),
        F.max(F.struct("count", "component"))["component"].alias("_most"),
    ).where("_components > 1")
    mixed = mixed.select("token", "_size", "_open", "_most", F.ceil(F.col("_size") / _BLOCK).alias("_blocks"))
    mixed = write_and_reread(mixed, "join-mixed")
    held, pairs = mixed.agg(F.sum(F.col("_size").cast("double")), F.sum(F.col("_open").cast("double")) / 2).first()
    pairs = int(pairs or 0)
    few = pairs <= _FEW * int(held or 0) or (before is not None and pairs > 0.9 * before)
    return placed, mixed, 0 if few else pairs


def _grouped(mixed: DataFrame) -> DataFrame:
    """The lists with the component that has most rows in each, and in how many parts the lists of that one are compared."""
    rows = F.sum(F.col("_size") * F.col("_blocks"))
    parts = mixed.groupBy("_most").agg(F.ceil(rows / _TOGETHER).alias("_parts")).where("_parts > 1")
    found = mixed.join(write_and_reread(parts, "join-parts"), "_most", "left")
    return found.select("token", "_blocks", "_most", F.coalesce("_parts", F.lit(1).cast("long")).alias("_parts"))


def _led(lists: DataFrame) -> DataFrame:
    """Each set with the leaders outside of its component that it meets most, in an order of leaders by hash."""
    seen = lists.select("token", "id", "n", "component").repartition("token")
    seen = seen.sortWithinPartitions("token", F.xxhash64("component", "id"))
    near = seen.mapInArrow(_leaders_outside, _PAIRS).groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))
    near = near.where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    near = near.withColumn("_k", F.row_number().over(Window.partitionBy("a").orderBy(F.col("k").desc(), "b")))
    near = near.where(f"_k <= {_NEAREST}")
    turned = F.col("a") > F.col("b")
    return near.select(*(
        F.when(turned, F.col(f"{x}{w}")).otherwise(F.col(f"{x}{v}")).alias(f"{x}{v}")
        for x in ("", "n_") for v, w in (("a", "b"), ("b", "a"))
    )).distinct()


def _met(pairs: DataFrame) -> DataFrame:
    """Pairs of sizes that can link, which occur together in as many short lists as they must."""
    n, m = F.col("n_a"), F.col("n_b")
    least = F.ceil(3 * (n + m) / 7) - F.greatest(F.ceil(3 * n / 4), F.ceil(3 * m / 4)) + 1
    return pairs.where((4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (F.col("k") >= least))


# Steps inside tasks ----------------------------------------------------------

def _weights(rows: DataFrame) -> np.ndarray:
    """For each slot of the sketch 0, or the bit length of its count if that is well above the mean."""

    def count(batches):
        codes, held = WordCodes(), np.zeros(_SLOTS, "int64")
        for batch in batches:
            for text in batch.column(0):
                slots = (shingles(text.as_py(), codes) >> np.uint64(46)).astype("int64")
                held += np.bincount(slots, minlength=_SLOTS) if len(slots) > _SLOTS // 8 else 0
                if len(slots) <= _SLOTS // 8:
                    np.add.at(held, slots, 1)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], ["slot", "n"])

    counts = rows.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # one row per slot at most
    sums = np.zeros(_SLOTS, "int64")
    sums[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    mean = sums.mean()
    usual = mean + 6 * np.sqrt(mean) + 6
    return np.where(sums > usual, 1 + np.log2(np.maximum(sums - mean, 1)) * 2, 0).astype("uint8")


def _signatures(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()
    for batch in batches:
        n, keys, signs, prefixes = [], [], [], []
        for text in batch.column("text"):
            found = shingles(text.as_py(), codes)
            size = len(found)
            n.append(size)
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            bits = _SIGN_BITS << max(0, (2 * size // _SIGN_BITS).bit_length())
            odd = np.bincount((found & np.uint64(bits - 1)).astype("int64"), minlength=bits) & 1
            signs.append(np.packbits(odd.astype("uint8")).tobytes())
            rank = weights[(found >> np.uint64(46)).astype("int64")]
            order = np.argsort(rank, kind="stable") if rank.any() else np.arange(size)
            prefixes.append(found[order[: size - -(-3 * size // 4) + 1]] if size else found)
        keys = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
            pa.array(signs, pa.binary()),
            pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype("int32")),
                pa.array(np.concatenate([*prefixes, np.zeros(0, "uint64")]).view("int64")),
            ),
        ], ["id", "n", "key_a", "key_b", "sign", "prefix"])


def _code_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()
    for batch in batches:
        found = [shingles(t.as_py(), codes).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "codes"])


def _pieces(
    batches: Iterator[pa.RecordBatch], key: str = "token", most: int | None = _LIST_BLOCK
) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows in pieces that end where a token (``key``) ends, or after a block of one token's rows.

    A piece that goes on within a token begins with the last row of the one before. Without ``most`` none does.
    """
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        held = {c: np.concatenate((held[c], new[c])) for c in new} if held else new
        token = held[key]
        if not len(token):
            continue
        cut = int(np.searchsorted(token == token[-1], True)) if token[0] != token[-1] else 0
        if cut:
            yield {c: v[:cut] for c, v in held.items()}
            held = {c: v[cut:] for c, v in held.items()}
        elif most is not None and len(token) > most:
            yield held
            held = {c: v[-1:] for c, v in held.items()}
    if held and len(held[key]):
        yield held


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lists with two sets or more; leader: the first of the list, or of its piece."""
    for piece in _pieces(batches):
        token = piece["token"]
        change = np.concatenate(([True], token[1:] != token[:-1], [True]))
        keep = ~(change[:-1] & change[1:])
        if not keep.any():
            continue
        token, ids = token[keep], piece["id"][keep]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        leader = np.repeat(ids[starts], np.diff(np.append(starts, len(ids))))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, ids, leader)], ["token", "id", "leader"])


def _block_pairs(lists: DataFrame) -> DataFrame:
    """Rows of one block of a list, or of two, which ``token`` then names; ``task`` has those of many lists of one component.

    ``block`` is -1 if the list has no other, -2 if a block meets itself.
    """
    rows = lists.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    rows = rows.withColumns({
        "token": F.xxhash64("token", low, high), "block": F.when(low != high, F.col("block")).when(F.col("_blocks") > 1, -2).otherwise(-1),
    })
    task = F.xxhash64("_most", F.pmod("token", F.col("_parts"))).alias("task")
    rows = rows.select(task, "token", "id", "n", "component", "block", "total")
    return rows.repartition("task").sortWithinPartitions("task", "token", "n", "id")


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates that are in different components and of sizes that can link, with their number in the lists of a task.

    Those go that cannot occur together as often as they must, even if they meet in every list
    that one of them has in other tasks.
    """
    for piece in _pieces(batches, "task", None):
        token, component = piece["token"], piece["component"]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        mixed = np.maximum.reduceat(component, starts) != np.minimum.reduceat(component, starts)
        ends = np.append(starts[1:], len(token))
        ids, first, place = np.unique(piece["id"], return_index=True, return_inverse=True)
        sizes = piece["n"][first]
        elsewhere = piece["total"][first] - np.bincount(place[piece["block"] == -1], minlength=len(ids))
        held, count, found, whole = [], 0, (np.zeros(0, "int64"), np.zeros(0, "int64")), True
        for start, end in zip(starts[mixed], ends[mixed], strict=True):
            for i in range(start, end, _STEP):
                for j in range(i, end, _STEP):
                    left, right = _allowed(piece, slice(i, min(i + _STEP, end)), slice(j, min(j + _STEP, end)))
                    held.append(place[left] * len(ids) + place[right])
                    count += len(left)
                    if count >= _HELD:
                        found, held, count = _added(found, held), [], 0
                    if len(found[0]) > 2 * _HELD:
                        yield from _sent(*found, ids, sizes)
                        found, whole = (found[0][:0], found[1][:0]), False
        pair, k = _added(found, held)
        if whole and len(pair):
            a, b = np.divmod(pair, len(ids))
            n, m = sizes[a], sizes[b]
            least = _needed(n, m) - np.maximum(-(-3 * n // 4), -(-3 * m // 4)) + 1  # as in _met
            can = k + np.minimum(elsewhere[a], elsewhere[b]) >= least
            pair, k = pair[can], k[can]
        yield from _sent(pair, k, ids, sizes)


def _added(found: tuple[np.ndarray, np.ndarray], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, as numbers, and how often they occur, with those of ``held``, which are not counted yet."""
    pair = np.concatenate([found[0][:0], *held])
    held.clear()
    pair, k = np.unique(pair, return_counts=True)
    if not len(found[0]):
        return pair, k
    pair, k = np.concatenate((found[0], pair)), np.concatenate((found[1], k))
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    return pair[starts], np.add.reduceat(k[order], starts)


def _sent(pair: np.ndarray, k: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(pair), _LIST_BLOCK):
        a, b = np.divmod(pair[at : at + _LIST_BLOCK], len(ids))
        found = (ids[a], ids[b], sizes[a], sizes[b], k[at : at + _LIST_BLOCK])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype("int64")) for x in found], ["a", "b", "n_a", "n_b", "k"])


def _leaders_outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its list's first row or, within that one's component, with the first row outside; with the number."""
    for piece in _pieces(batches):
        token, component, n = piece["token"], piece["component"], piece["n"]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        within = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(token))))
        first = starts[within]
        outside = component != component[first]
        second = np.minimum.reduceat(np.where(outside, np.arange(len(token)), len(token)), starts)[within]
        leader = np.where(outside, first, second)
        led = leader < len(token)
        if led.any():
            leader = leader[led]
            yield _counted(piece["id"][led], piece["id"][leader], n[led], n[leader])


def _counted(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.RecordBatch:
    """The distinct pairs with the number of times that they occur."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[: len(a)]
    k = np.diff(np.append(starts, len(a)))
    found = (a[starts], b[starts], n_a[order][starts], n_b[order][starts], k)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b", "n_a", "n_b", "k"])


def _allowed(rows: dict[str, np.ndarray], left: slice, right: slice) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs (smaller, larger) of two stretches of one list; rows are sorted by size, then id."""
    n, m = rows["n"][left][:, None], rows["n"][right][None]
    good = (rows["component"][left][:, None] != rows["component"][right][None]) & (4 * n >= 3 * m)
    block = rows["block"]
    good &= (block[left][:, None] != block[right][None]) | (block[left][:, None] < 0)
    if left == right:
        good &= np.arange(good.shape[0])[:, None] < np.arange(good.shape[1])[None]
    i, j = np.nonzero(good)
    return i + left.start, j + right.start


def _verify(pairs: DataFrame, signs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link: by parity signs, then by probing one set with the other.

    Texts are read again for the sets of likely pairs alone; a bit map of their
    ids leaves the others where they are.
    """
    n, m = F.col("n_a"), F.col("n_b")
    counted = pairs = write_and_reread(pairs.select("a", "b", "n_a", "n_b"), "join-counted")
    for side in ("a", "b"):
        pairs = pairs.join(signs.select(F.col("id").alias(side), F.col("sign").alias(f"sign_{side}")), side)

    @F.arrow_udf("long")
    def differ(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), "uint8"), np.frombuffer(y.as_buffer(), "uint8")
            if len(x) > len(y):
                x, y = y, x
            y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)  # the parities of fewer slots
            out.append(int(np.bitwise_count(x ^ y).sum()))
        return pa.array(out, pa.int64())

    # The symmetric difference is n + m - 2 i, and i is at least 3 (n + m) / 7.
    likely = pairs.where(differ("sign_a", "sign_b") * 7 <= n + m)
    listed = likely = write_and_reread(likely.select("a", "b"), "join-likely")
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    wanted = write_and_reread(wanted, "join-wanted")
    texts = maybe_among(rows, ["id"], key_filter(wanted, _FILTER_BITS), _FILTER_BITS, "_maybe").where("_maybe")
    texts = texts.drop("_maybe").join(wanted.hint("merge"), "id", "left_semi")
    codes = write_and_reread(texts.mapInArrow(_code_sets, "id bigint, codes binary"), "join-codes")
    for side in ("a", "b"):
        likely = likely.join(codes.select(F.col("id").alias(side), F.col("codes").alias(f"codes_{side}")), side)

    def probe(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("codes_a"), batch.column("codes_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "uint64"), np.frombuffer(y.as_buffer(), "uint64")
                if len(a) > len(b):
                    a, b = b, a
                common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) else 0
                good.append(common > 0 and common >= _needed(len(a), len(b)))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    found = likely.select("a", "b", "codes_a", "codes_b").mapInArrow(probe, "a bigint, b bigint")
    found = write_and_reread(found, "join-verified")
    for table in (counted, listed, wanted, codes):
        discard(table)
    return found
