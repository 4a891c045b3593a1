"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
_UNIT = re.compile(" *[^ ]+| +")
_BATCH_CHARS = 2_000_000
_INDEX_BYTES = 1 << 19  # of distinct units that are indexed at once
_CACHED_UNITS = 400_000
_SHORT = 40  # symbols up to which units are relaxed side by side


class PieceVocabulary:
    """Pieces of a BPE model with byte fallback, ready for matching.

    Read with the public library from the serialised model; matching, merging
    and decoding are done here.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(source.get_piece_size())
        normal = [
            i for i in ids
            if not (source.is_control(i) or source.is_unknown(i) or source.is_byte(i) or source.is_unused(i))
        ]
        byte_ids = [i for i in ids if source.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the model needs byte fallback")
        pieces = {i: source.id_to_piece(i) for i in normal}
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces.values()):
            raise ValueError("pieces of this model cross word borders")
        self.bytes_of = {i: p.replace(_SPACE, " ").encode() for i, p in pieces.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.bytes_of |= {i: " ⁇ ".encode() if source.is_unknown(i) else b"" for i in ids if i not in self.bytes_of}
        self.ids = np.array(normal, "int32")
        # The cost of a piece by id + 1, 0 standing for no piece. Pieces of one score share a cost.
        self.costs = np.full(len(ids) + 1, _NO_EDGE, "int64")
        scores = sorted({-source.get_score(i) for i in normal})
        self.costs[self.ids + 1] = np.searchsorted(scores, [-source.get_score(i) for i in normal])
        self.byte_table = np.array(byte_ids, "<i4")
        coded = [self.bytes_of[i] for i in normal]
        self.lengths = np.array([len(p) for p in coded])
        self.longest = int(self.lengths.max())
        self.words = -(-self.longest // 8)
        pad = self.words * 8
        self.low = _words_of([p.ljust(pad, b"\0") for p in coded], self.words)
        self.high = _words_of([p.ljust(pad, b"\xff") for p in coded], self.words)

    def edges(self, raw: np.ndarray) -> np.ndarray:
        """Every occurrence of every piece: row ``start``, column ``length`` holds its id + 1.

        The ranges of suffixes are dealt to the rows of their positions, which
        sorts the edges by position by counting.
        """
        suffixes, keys = self._suffix_array(raw)
        first = np.searchsorted(keys[0], self.low[0], "left")
        last = np.searchsorted(keys[0], self.high[0], "right")
        for k in np.flatnonzero((self.lengths > 8) & (last > first)):
            low, high = first[k], last[k]
            for word in range(1, -(-int(self.lengths[k]) // 8)):
                part = keys[word][low:high]
                low, high = (
                    low + np.searchsorted(part, self.low[word][k], "left"),
                    low + np.searchsorted(part, self.high[word][k], "right"),
                )
            first[k], last[k] = low, high
        del keys  # the table takes their room
        counts = np.maximum(last - first, 0)
        places = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        table = np.zeros((len(raw) + 1, self.longest + 1), "uint16" if len(self.costs) <= 1 << 16 else "int32")
        table[suffixes[places], np.repeat(self.lengths, counts)] = np.repeat(self.ids + 1, counts)
        return table

    def _suffix_array(self, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Starts of characters, sorted by what follows up to the end of the unit; the sorted text by eights.

        Sorted by eight bytes; only those that are equal and go on are sorted by the next eight.
        """
        size = len(raw)
        padded = np.concatenate((raw, np.zeros(8 * self.words + 8, "uint8"))).astype("uint64")
        eights = np.zeros(size + 8 * self.words, "uint64")
        for i in range(8):
            eights = (eights << np.uint64(8)) | padded[i : i + len(eights)]
        del padded
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        marks = np.flatnonzero(raw == 0xFF)
        left = np.repeat(marks, np.diff(np.concatenate(([0], np.searchsorted(starts, marks, "right"))))) - starts
        starts, left = starts[left > 0], left[left > 0].astype("int32")

        def word(chosen, i):
            """The eight bytes after ``8 i``, without what follows the mark of the unit."""
            return eights[starts[chosen] + 8 * i] & _MASKS[np.clip(left[chosen] - 8 * i, -1, 7) + 1]

        first = word(slice(None), 0)
        order = np.argsort(first)
        keys = [first[order]]
        group = np.cumsum(np.concatenate(([False], keys[0][1:] != keys[0][:-1])))
        for i in range(1, self.words):
            twin = group[1:] == group[:-1]
            tied = np.flatnonzero((np.concatenate((twin, [False])) | np.concatenate(([False], twin))) & (left[order] >= 8 * i))
            next_word, rank = np.unique(word(order[tied], i), return_inverse=True)
            inner = group[tied] * max(len(next_word), 1) + rank
            by = np.argsort(inner)
            order[tied], inner = order[tied[by]], inner[by]
            fresh = np.zeros(len(group), bool)
            fresh[tied[1:]] = (inner[1:] != inner[:-1]) & (group[tied[1:]] == group[tied[:-1]])
            group += np.cumsum(fresh)
            keys.append(word(order, i))
        return starts[order], keys

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as little-endian 32-bit numbers."""
        coded = [u.encode() for u in units]
        raw = np.frombuffer(b"\xff".join([*coded, b""]), "uint8")  # no byte of UTF-8 is 0xFF
        table = self.edges(raw)
        borders = np.cumsum([0, *[len(c) + 1 for c in coded]])
        begins = (raw & 0xC0) != 0x80  # characters, and the mark after each unit
        symbols = np.diff(np.searchsorted(np.flatnonzero(begins), borders)) - 1
        self._relax(np.flatnonzero(symbols <= _SHORT), borders, begins, table)
        for i in np.flatnonzero(symbols > _SHORT):
            self._relax_long(int(borders[i]), int(borders[i + 1]) - 1, begins, table)
        cuts = np.flatnonzero(begins)
        starts = cuts[:-1][raw[cuts[:-1]] != 0xFF]
        ends = cuts[1:][raw[cuts[:-1]] != 0xFF]
        lengths = ends - starts
        pieces = table[starts, np.minimum(lengths, self.longest)].astype("int64")
        whole = pieces > 0
        room = np.where(whole, 1, lengths)  # characters without a piece are written byte by byte
        places = np.repeat(starts, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        ids = np.where(np.repeat(whole, room), np.repeat(pieces - 1, room), self.byte_table[raw[places]]).astype("<i4")
        at = np.concatenate(([0], np.cumsum(room)))[np.searchsorted(starts, borders)] * 4
        out, at = ids.tobytes(), at.tolist()
        return [out[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _relax(self, chosen: np.ndarray, borders: np.ndarray, begins: np.ndarray, table: np.ndarray) -> None:
        """Join pairs of neighbours along edges, in all chosen units side by side.

        In each round every unit joins the pair whose edge costs least, the
        leftmost of equals; a unit without such a pair is done.
        """
        mine = np.zeros(len(begins) + 1, "int8")
        np.add.at(mine, borders[chosen], 1)
        np.add.at(mine, borders[chosen + 1], -1)
        cuts = np.flatnonzero(begins & (np.cumsum(mine, dtype="int8")[:-1] > 0))
        unit = np.searchsorted(borders, cuts, "right").astype("int32")

        def offers(k):
            """The cost of the pairs that begin at cuts ``k``, and where, as one number."""
            far = np.minimum(k + 2, len(cuts) - 1)
            length = cuts[far] - cuts[k]
            fits = (far == k + 2) & (unit[far] == unit[k]) & (length <= self.longest)
            cost = np.full(len(k), _NO_EDGE, "int64")
            cost[fits] = self.costs[table[cuts[k[fits]], length[fits]]]
            return cost << 32 | cuts[k]

        offer = offers(np.arange(len(cuts)))
        while len(cuts):
            heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            best = np.minimum.reduceat(offer, heads)
            going = best >> 32 < _NO_EDGE
            if not going.any():
                break
            begin = best[going] & 0xFFFFFFFF
            middle = np.searchsorted(cuts, begin) + 1
            begins[cuts[middle]] = False
            stay = np.repeat(going, np.diff(np.append(heads, len(cuts))))
            stay[middle] = False
            cuts, unit, offer = cuts[stay], unit[stay], offer[stay]
            joined = np.searchsorted(cuts, begin)  # only a new symbol and the one before it have new neighbours
            offer[joined] = offers(joined)
            joined = joined[joined > 0] - 1
            offer[joined] = offers(joined)

    def _relax_long(self, begin: int, end: int, begins: np.ndarray, table: np.ndarray) -> None:
        """The same in one unit of many symbols, with a heap."""
        cuts = (begin + np.flatnonzero(begins[begin:end])).tolist() + [end]
        last = len(cuts) - 1
        before, after = list(range(-1, last)), [*range(1, last + 1), last]
        alive = [True] * last

        def offer(k):
            far = after[after[k]] if after[k] < last else k
            if far > k and cuts[far] - cuts[k] <= self.longest:
                cost = self.costs[table[cuts[k], cuts[far] - cuts[k]]]
                if cost < _NO_EDGE:
                    heapq.heappush(queue, (int(cost), k, after[k], far))

        queue: list[tuple[int, int, int, int]] = []
        for k in range(last - 1):
            offer(k)
        while queue:
            _, k, middle, far = heapq.heappop(queue)
            if not alive[k] or after[k] != middle or after[middle] != far:
                continue  # a neighbour has been joined meanwhile
            alive[middle] = False
            begins[cuts[middle]] = False
            after[k], before[far] = far, k
            offer(k)
            if before[k] >= 0:
                offer(before[k])


_NO_EDGE = 1 << 20
_MASKS = np.array([0, *[(1 << 64) - (1 << 8 * (7 - k)) for k in range(8)]], "uint64")  # by the bytes kept


def _words_of(rows: list[bytes], words: int) -> list[np.ndarray]:
    table = np.frombuffer(b"".join(rows), ">u8").reshape(len(rows), words).astype("uint64")
    return [np.ascontiguousarray(table[:, i]) for i in range(words)]


@lru_cache(1)
def _encoder(model: bytes) -> Encoder:
    """One encoder per Python worker; its units are remembered from task to task."""
    return Encoder(PieceVocabulary(model))


class Encoder:
    """Encodes batches of texts; remembers a bounded number of units between batches."""

    def __init__(self, vocabulary: PieceVocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_units(t.replace(_SPACE, " ")) if t else [] for t in texts]
        used = set().union(*split)
        new = list(used - self.known.keys())
        if len(self.known) + len(new) > _CACHED_UNITS:  # keep what this batch uses
            self.known = {u: self.known[u] for u in used - set(new)}
        size = begin = 0
        for k, unit in enumerate(new):
            size += len(unit) + 2
            if size >= _INDEX_BYTES or k == len(new) - 1:
                part = new[begin : k + 1]
                self.known.update(zip(part, self.vocabulary.encode_units([" " + u for u in part]), strict=True))
                begin, size = k + 1, 0
        found = self.known.__getitem__
        return [b"".join(map(found, units)) for units in split]


def _units(text: str) -> list[str]:
    """The units of a text, each without the space that it begins with; the first has one put before it."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return [u[1:] for u in _UNIT.findall(" " + text)]
    return text.split(" ")


def encode(
    docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), model_path: str = TOKENIZER
) -> DataFrame:
    """The ``keep`` columns with the piece ``ids`` of every text.

    The result equals the library's encoding with the same model. A batch of
    texts is cut into units (a run of spaces with the word after it; no piece
    goes further). The distinct units of a batch are joined, and a suffix array
    of that text is built by sorting eight bytes, then ties by the next eight, over as many bytes as the longest
    piece has. Binary search finds the range of suffixes of every piece; the
    ranges give all edges, which are sorted by position. Relaxing follows the
    order of a BPE model: of the pairs of neighbours that an edge spans, the one
    with the best score is joined first, the leftmost of equals.

    A narrow map. A task holds one batch of about two million characters, or one
    text if that is longer. Null texts have null ids, empty ones an empty list.
    The model file is read by the driver; executors get its bytes.
    """
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*rows.drop("_text").schema, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encoder = _encoder(model.value)
        for batch in batches:
            begin = size = 0
            texts: list[str | None] = []
            for k, value in enumerate(batch.column("_text")):
                texts.append(value.as_py())
                size += len(texts[-1] or "")
                if size >= _BATCH_CHARS or k == batch.num_rows - 1:
                    part = batch.slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c) for c in keep], _id_lists(encoder.encode([t or "" for t in texts]), texts)],
                        [*keep, "ids"],
                    )
                    begin, size, texts = k + 1, 0, []

    return rows.mapInArrow(run, schema)


def _id_lists(coded: list[bytes], texts: list[str | None]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype("int32")
    values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([t is None for t in texts]))


def decode(
    encoded: DataFrame, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",), model_path: str = TOKENIZER,
    text_col: str = "text",
) -> DataFrame:
    """The ``keep`` columns with the text of the piece ids.

    Gives back the encoded text, but for U+2581, which the model itself uses for
    a space. Bytes that are no UTF-8 become U+FFFD; null ids or an id outside of
    the vocabulary give null.
    """
    rows = encoded.select(*keep, F.col(ids_col).cast("array<int>").alias("_ids"))
    schema = T.StructType([*rows.drop("_ids").schema, T.StructField(text_col, T.StringType())])
    with open(model_path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        bytes_of = _encoder(model.value).vocabulary.bytes_of
        for batch in batches:
            texts = []
            for value in batch.column("_ids"):
                try:
                    text = b"".join([bytes_of[i] for i in value.values.to_pylist()]) if value.is_valid else None
                except KeyError:
                    text = None
                texts.append(None if text is None else text.removeprefix(b" ").decode(errors="replace"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, text_col]
            )

    return rows.mapInArrow(run, schema)
