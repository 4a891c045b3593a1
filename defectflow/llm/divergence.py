"""How far the words of a source stray from its language: iceberg prefix refinement and exact divergences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from defectflow.llm.common import bit_map, discard, in_bit_map, parts, whole
from defectflow.session import scratch_path, write_and_reread

SCALE = 1_000_000_000
# Terms are runs of ASCII letters and of all that is not ASCII; A to Z are lower-cased, all else is a gap.
_LOWERED = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_CHUNK = 1 << 22  # characters whose terms are held together
_ROWS_PER_FILE = 8
_OPEN_BITS = 1 << 26
_FIRST = 4  # bytes of the first prefixes
_WIDE = 32  # bytes of neighbouring terms compared at once
_NUMBERS = ("size", "same", "docs", "doc", "n")
_POSTINGS = "lang string, sources array<string>, terms binary, " + ", ".join(f"{c} binary" for c in _NUMBERS)
_HELD = 1 << 20  # counts that a task adds up before it sends them
_SENT = 1 << 15  # terms that are Python objects, or rows that are sent, at once
_CELLS = 1 << 20  # of a block of counts, terms by sources


def _postings(docs: DataFrame) -> DataFrame:
    """One row for each language of a chunk of documents.

    ``sources`` of its documents; its distinct ``terms`` in order and without gaps, the
    bytes of each (``size``) and how many of them it shares with the term before (``same``);
    in how many documents it is (``docs``), in which (``doc``) and how often (``n``). Numbers are
    packed as 32-bit integers.
    """

    def index(batches):
        for part, texts in parts(batches, _CHUNK):
            langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
            for lang in dict.fromkeys(langs):
                chosen = [k for k, other in enumerate(langs) if other == lang]
                found, sizes = _terms([(texts[k] or "").encode() for k in chosen])
                if not len(found):
                    continue
                found = found.dictionary_encode()
                order = pc.sort_indices(found.dictionary).to_numpy()
                terms = found.dictionary.take(pa.array(order))
                place = np.empty(len(order), "int64")
                place[order] = np.arange(len(order))
                pair = place[found.indices.to_numpy()] * len(chosen) + np.repeat(np.arange(len(chosen)), sizes)
                pair, n = np.unique(pair, return_counts=True)
                size = pc.binary_length(terms).to_numpy().astype("int64")
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms), b"")
                numbers = (size, _shared([joined[0].as_py()], size), np.bincount(pair // len(chosen)), pair % len(chosen), n)
                arrays = [pa.array([lang], pa.string()), pa.array([[sources[k] for k in chosen]], pa.list_(pa.string()))]
                arrays += [joined, *(pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in numbers)]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "sources", "terms", *_NUMBERS])

    return docs.mapInArrow(index, _POSTINGS)


def _written(postings: DataFrame) -> DataFrame:
    """Postings as a table of small files: Spark reads what a file has of a column at once, and these rows are long."""
    path = scratch_path(postings.sparkSession, "term-postings")
    postings.write.option("maxRecordsPerFile", _ROWS_PER_FILE).parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)


def _terms(coded: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of the texts, one after the other, and how many each text has."""
    lowered = b" ".join([*coded, b""]).translate(_LOWERED)
    cells = np.frombuffer(b" " + lowered, "uint8")
    inside = cells != 0x20
    borders = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = borders[::2], borders[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype("int32")
    found = pa.BinaryArray.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(cells[inside])])
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *[len(c) + 1 for c in coded]])))
    return found, sizes


def _shared(terms: list[bytes], size: np.ndarray) -> np.ndarray:
    """How many bytes each of the sorted terms, given one by one or joined, shares with the one before."""
    terms = b"".join(terms)
    begin = np.cumsum(size) - size
    cells = np.frombuffer(terms + bytes(_WIDE), "uint8")
    most = np.minimum(size, np.concatenate(([0], size[:-1])))
    same = np.zeros(len(size), "int64")
    going = np.flatnonzero(most > 0)
    for k in range(_WIDE):
        going = going[cells[begin[going] + k] == cells[begin[going - 1] + k]]
        same[going] += 1
        going = going[most[going] > k + 1]
        if not len(going):
            break
    for k in going.tolist():
        x, y = begin[k - 1], begin[k]
        while same[k] < most[k] and terms[x + same[k]] == terms[y + same[k]]:
            same[k] += 1
    return same


class _Chunk:
    """A row of postings, numbers as arrays."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        self.lang, self.sources, self.terms = batch.column("lang")[k].as_py(), batch.column("sources")[k], batch.column("terms")[k].as_py()
        self.size, self.same, self.docs, self.doc, self.n = (
            np.frombuffer(batch.column(c)[k].as_buffer(), "<i4") for c in _NUMBERS)
        self.start = np.cumsum(self.size, dtype="int64") - self.size
        self.seed = xxhash.xxh3_64_intdigest(self.lang.encode())

    def groups(self, length: int) -> np.ndarray:
        """Whether each term begins a prefix of ``length`` bytes; terms that end by then are groups of their own."""
        ends = self.size <= length
        new = (self.same < length) | ends
        new[1:] |= ends[:-1]
        new[0] = True
        return new

    def keys(self, at: np.ndarray, length: int | None = None) -> np.ndarray:
        """Two 64-bit words for the prefix of each term, others where the term goes on than where it ends."""
        terms, seed, out = self.terms, self.seed, np.empty((len(at), 2), "<i8")
        for k in range(0, len(at), _SENT):
            some = at[k : k + _SENT]
            size = self.size[some] if length is None else np.minimum(self.size[some], length)
            goes_on = (self.size[some] > size).tolist()
            begin = self.start[some].tolist()
            cut = zip(begin, (self.start[some] + size).tolist(), goes_on, strict=True)
            found = [xxhash.xxh3_128_digest(terms[b:e] + b" " if more else terms[b:e], seed) for b, e, more in cut]
            out[k : k + _SENT] = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        return out

    def words(self) -> pa.Array:
        """The terms one by one."""
        offsets = np.append(self.start, len(self.terms)).astype("int32")
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.size), [None, pa.py_buffer(offsets), pa.py_buffer(self.terms)])


def _chunks(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield _Chunk(batch, k)


def _refine(postings: DataFrame, length: int, before: int, alive) -> DataFrame:
    """``a, b, open, docs``: how many documents have each prefix of ``length`` bytes, by its key ``(a, b)``.

    Only terms whose prefix of ``before`` bytes is alive and did not end there are
    looked at. Terms of ``length`` bytes or less are whole (not open).
    """

    def count(batches):
        for chunk in _chunks(batches):
            going = chunk.size > before
            if alive is not None and going.any():
                new = chunk.groups(before)
                parent = np.flatnonzero(new & going)
                living = np.zeros(len(going), bool)
                living[parent] = in_bit_map(alive.value, chunk.keys(parent, before)[:, 0])
                going &= living[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            if not going.any():
                continue
            first = np.flatnonzero(chunk.groups(length) & going)  # a prefix is looked at as a whole or not at all
            group = np.searchsorted(first, np.arange(len(going)), "right") - 1
            n = np.zeros(len(first), "int64")
            alone = np.diff(np.append(first, len(going))) == 1
            n[alone] = chunk.docs[first[alone]]
            several = going & ~alone[group]
            if several.any():
                among = np.repeat(several, chunk.docs)
                of = np.repeat(group, chunk.docs)[among]
                width = int(chunk.doc.max()) + 1
                pair = np.unique(of * width + chunk.doc[among])  # a document counts once for a prefix
                n += np.where(alone, 0, np.bincount(pair // width, minlength=len(first)))
            key = chunk.keys(first, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(chunk.size[first] > length), pa.array(n)], ["a", "b", "open", "docs"])

    found = postings.mapInArrow(count, "a bigint, b bigint, open boolean, docs bigint")
    return found.groupBy("a", "b", "open").agg(F.sum("docs").alias("docs"))


def frequent_terms(postings: DataFrame, least: int) -> DataFrame:
    """``a, b, docs``: the keys of all terms in ``least`` documents of their language or more.

    Iceberg refinement: a term is in no more documents than each of its prefixes.
    Each level counts the distinct documents of longer prefixes, of those terms only
    whose shorter prefix reached ``least``; terms that end are complete. Prefixes travel as
    128-bit keys. Which of them go on is handed to the tasks as a bit map of fixed size (8 MB): what
    it lets through by chance is counted and dropped at the next level.
    """
    spark = postings.sparkSession
    whole_terms, before, length, alive = [], 0, _FIRST, None
    while True:
        level = _refine(postings, length, before, alive).where(F.col("docs") >= least)
        level = write_and_reread(level, f"terms-{length}")
        whole_terms.append(level.where("not open").select("a", "b", "docs"))
        held = bit_map(level.where("open").select("a"), _OPEN_BITS)
        if not held.any():
            break
        if alive is not None:
            alive.unpersist()
        alive = spark.sparkContext.broadcast(held)
        before, length = length, length + max(2, length // 2)
    found = whole_terms[0]
    for part in whole_terms[1:]:
        found = found.unionByName(part)
    return write_and_reread(found, "terms-kept")


def _added_up(chunks, alive: np.ndarray, places: dict[tuple[str, str], int]):
    """Counts of the terms that may be kept, some chunks at a time: one row for each term.

    Terms are held once a chunk, as Arrow strings, and never become Python objects.
    """
    held, size = [], 0
    for chunk in chunks:
        key = chunk.keys(np.arange(len(chunk.size)))
        stays = in_bit_map(alive, np.ascontiguousarray(key[:, 0]))
        if not stays.any():
            continue
        place_of = np.array([places[chunk.lang, source] for source in chunk.sources.as_py()], "int64")
        at = np.repeat(stays, chunk.docs)
        row = np.cumsum(stays) - 1
        pair = np.repeat(row, chunk.docs)[at] * len(places) + place_of[chunk.doc[at]]
        pair, where = np.unique(pair, return_inverse=True)
        n = np.bincount(where, chunk.n[at], len(pair)).astype("int64")
        terms = chunk.words().filter(pa.array(stays))
        held.append((key[stays], terms, pair // len(places), (pair % len(places)).astype("int32"), n, chunk.lang))
        size += len(pair)
        if size >= _HELD:
            yield from _packed(held, len(places))
            held, size = [], 0
    if held:
        yield from _packed(held, len(places))


def _packed(held: list[tuple], width: int):
    """One row for each term of the held chunks, :data:`_SENT` rows at once."""
    sizes = [len(h[0]) for h in held]
    key = np.concatenate([h[0] for h in held])
    terms = pa.concat_arrays([h[1] for h in held])
    order = np.lexsort((key[:, 1], key[:, 0]))
    fresh = np.concatenate(([True], (key[order[1:]] != key[order[:-1]]).any(axis=1)))
    first = order[fresh]  # where each term is found
    number = np.empty(len(order), "int64")
    number[order] = np.cumsum(fresh) - 1
    before = np.cumsum([0, *sizes])
    cell = np.concatenate([number[h[2] + k] * width + h[3] for h, k in zip(held, before, strict=False)])
    n = np.concatenate([h[4] for h in held])
    lang = pa.array([h[5] for h in held], pa.string()).take(pa.array(np.searchsorted(before, first, "right") - 1))
    held.clear()
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    cell, n = cell[starts], np.add.reduceat(n, starts)
    for k in range(0, len(first), _SENT):
        rows = first[k : k + _SENT]
        ends = np.searchsorted(cell, np.arange(k, k + len(rows) + 1) * width)
        cells = pa.StructArray.from_arrays(
            [pa.array((cell[ends[0] : ends[-1]] % width).astype("int32")), pa.array(n[ends[0] : ends[-1]])], ["place", "n"])
        yield pa.RecordBatch.from_arrays([
            pa.array(key[rows, 0]), pa.array(key[rows, 1]), lang.slice(k, len(rows)), terms.take(pa.array(rows)),
            pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype("int32")), cells),
        ], ["a", "b", "lang", "term", "cells"])


def _counts(postings: DataFrame, kept: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """``lang, term, place, n`` of the kept terms where they occur; ``place`` is that of the language and source in ``groups``.

    A task adds up what it reads and sends one row for each term, with the counts of all sources.
    """
    spark = postings.sparkSession
    alive = spark.sparkContext.broadcast(bit_map(kept.select("a"), _OPEN_BITS))
    places = spark.sparkContext.broadcast({group: k for k, group in enumerate(groups)})
    kind = "a bigint, b bigint, lang string, term binary, cells array<struct<place:int,n:bigint>>"

    def count(batches):
        return _added_up(_chunks(batches), alive.value, places.value)

    found = postings.mapInArrow(count, kind).join(kept.select("a", "b"), ["a", "b"], "left_semi")
    found = found.select("a", "b", "lang", "term", F.inline("cells")).groupBy("a", "b", "lang", "term", "place")
    return write_and_reread(found.agg(F.sum("n").alias("n")).drop("a", "b"), "term-counts")


def _chance(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE (n + 2) / (total + 2 terms))``, in decimals, which cannot overflow."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    below = F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _spread(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; both are about ``SCALE`` at most, so a long holds it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _both(batches):
    """For each pair of sources, what terms in both of them change: see :func:`source_divergence`."""

    def spread(p, q):
        return (p - q) ** 2 // (p + q)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs):
            cells = batch.column("found").filter(pa.array(langs == lang))
            sizes = cells.value_lengths().to_numpy()
            cells = cells.flatten()
            encoded = cells.field("source").dictionary_encode()
            codes, names = encoded.indices.to_numpy(), np.array(encoded.dictionary.to_pylist(), object)
            p, rest = cells.field("p").to_numpy(), cells.field("p0").to_numpy()
            p0 = np.zeros(len(names), "int64")
            p0[codes] = rest
            sums = np.zeros((len(names), len(names)), "int64")
            row = np.repeat(np.arange(len(sizes)), sizes)
            step = max(1, _CELLS // len(names))
            for begin in range(0, len(sizes), step):
                at = (row >= begin) & (row < begin + step)
                block = np.tile(p0, (min(step, len(sizes) - begin), 1))
                block[row[at] - begin, codes[at]] = p[at]
                for k in range(len(names) - 1):
                    one, others = block[:, k, None], block[:, k + 1 :]
                    change = spread(one, others) - spread(one, p0[k + 1 :]) - spread(p0[k], others) + spread(p0[k], p0[k + 1 :])
                    sums[k, k + 1 :] += change.sum(axis=0)
            a, b = np.triu_indices(len(names), 1)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(a), pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(sums[a, b]),
            ], ["lang", "source", "item", "value"])


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10, top: int = 10,
) -> DataFrame:
    """How the terms of each source of a language differ from the other sources and from the language.

    Terms are runs of ASCII letters and of all characters that are not ASCII; only A to Z are
    lower-cased. A language keeps its ``V`` terms that are in ``least`` of its
    rows or more (:func:`frequent_terms`). With the count ``n`` of a kept term in a
    source, or in the language, and the sum ``N`` of those counts, its chance is
    ``p = 1 + floor(10^9 (n + 2) / (N + 2 V))``; two chances are
    ``floor((p - q)^2 / (p + q))`` apart. Returns ``lang, source, part, item, value, rank``:
    part ``pair`` has for each other source of the language the sum over all kept
    terms, part ``term`` the terms of the source that are more likely there than
    in the language and furthest from it, ``top`` of them. Ranks go by falling value,
    then by item in the order of UTF-8.

    All whole numbers, so that results are exact; until they are counted, terms go by 128-bit keys of their text. A sum over all ``V`` terms never looks
    at terms that neither source has: with ``p0`` for a count of 0 it is
    ``V f(p0, q0)``, plus for the terms of each source ``f(p, q0) - f(p0, q0)``, taken
    from a histogram of its counts, plus for terms in both
    ``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``, added up inside the tasks over blocks of terms by sources.

    The text is read once: postings of chunks of about four million characters are
    written and every level reads those. Nothing of a language or source is held
    in one task, but for the sources of one term and the list of all sources, which is handed to the
    tasks; the result has a row for every two of them.
    Null languages, sources and texts count as empty; a source without terms is a
    group as well, all of whose values follow from ``p0`` (0 if no term is kept).
    Repeated rows count as rows of their own. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = docs.select(whole(F.col(lang_col)).alias("lang"), whole(F.col(source_col)).alias("source"), F.col(text_col).cast("string").alias("_text"))
    # The result has a row for every two groups of a language, so their list is short next to it.
    listed = sorted(map(tuple, rows.select("lang", "source").distinct().collect()))
    postings = _written(_postings(rows))
    counts = _counts(postings, frequent_terms(postings, least), listed)
    discard(postings)

    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    terms = in_lang.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("place").agg(F.sum("n").alias("total"))
    table = [(k, lang, source) for k, (lang, source) in enumerate(listed)]
    groups = docs.sparkSession.createDataFrame(table, "place int, lang string, source string")
    groups = groups.join(totals, "place", "left").join(terms, "lang", "left")
    groups = groups.select("place", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = groups.withColumn("p0", _chance(F.lit(0), F.col("total"), F.col("terms")))
    groups = write_and_reread(groups, "term-groups")
    chances = counts.join(groups.drop("lang"), "place").withColumn("p", _chance(F.col("n"), F.col("total"), F.col("terms")))

    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    in_lang = in_lang.join(lang_totals, "lang").select("lang", "term", _chance(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    nearer = chances.join(in_lang, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
        _spread(F.col("p"), F.col("q")).alias("value"),
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    nearer = nearer.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("all_terms"))
    pairs = groups.select("lang", "source", "p0").join(others, "lang").where("source <> item")
    apart = pairs.select("lang", "source", "item", (F.col("all_terms") * _spread(F.col("p0"), F.col("q0"))).alias("value"))
    steps = chances.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    alone = steps.join(others.drop("all_terms"), "lang").where("source <> item").select(
        "lang", "source", "item",
        (F.col("m") * (_spread(F.col("p"), F.col("q0")) - _spread(F.col("p0"), F.col("q0")))).alias("value"),
    ).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    found = chances.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("found"))
    shared = found.where(F.size("found") > 1).select("lang", "found").mapInArrow(
        _both, "lang string, source string, item string, value bigint"
    ).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = [F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item"), F.col("value")]
    values = apart.unionByName(alone).unionByName(alone.select(*turned)).unionByName(shared).unionByName(shared.select(*turned))
    values = values.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = values.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    return ranked.unionByName(nearer).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
