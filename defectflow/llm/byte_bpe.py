"""Byte-level BPE: all distinct pieces of a batch are merged together, rank by rank."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from defectflow.llm.common import distinct_names, parts

#: How the vocabulary's library cuts texts into pieces; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BATCH_CHARS = 1 << 20  # split at once
_CORPUS_CHARS = 1 << 24  # of texts whose new pieces are merged together
_CORPUS_PIECES = 1 << 18
_REPLAY_BYTES = 1 << 21  # of distinct pieces under one index
_CACHED_PIECES = 1 << 19
_CACHED_BYTES = 1 << 23
_OUT_ROWS = 512  # of a batch of results
_FEW = 16  # places merged one by one
_NONE = 1 << 30  # stands for no token


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class MergeReplay:
    """Replays the merges of a vocabulary over many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.first = np.array([ranks[bytes([b])] for b in range(256)], "int32")
        self.pairs: dict[int, int] = {}  # two tokens to the token that they make together
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        keys = np.array(sorted(self.pairs), "int64")
        self._keys = np.append(keys, -1)
        self._made = np.array([*map(self.pairs.get, keys.tolist()), _NONE], "int32")

    def _make(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or ``_NONE``; tokens below 0 make none."""
        key = left.astype("int64") << 32 | right
        at = np.searchsorted(self._keys[:-1], key)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._made[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece as 32-bit integers; a piece that is a token itself is left whole."""
        ranks = self.ranks
        out: list[bytes | None] = [ranks[p].to_bytes(4, "little") if p in ranks else None for p in pieces]
        open_ = [k for k, ids in enumerate(out) if ids is None]
        begin = size = 0
        for k, at in enumerate(open_):
            size += len(pieces[at])
            if size >= _REPLAY_BYTES or k == len(open_) - 1:
                part = open_[begin : k + 1]
                for place, ids in zip(part, self._replay([pieces[i] for i in part]), strict=True):
                    out[place] = ids
                begin, size = k + 1, 0
        return out

    def _replay(self, pieces: list[bytes]) -> list[bytes]:
        """One inverted index for all pieces: from the token that a pair makes to the places of such pairs.

        Ranks are taken in order from a heap. A merge unlinks one place, and only the
        pairs with its two neighbours are looked up and put into the index again.
        """
        data = np.frombuffer(b"".join(pieces), "uint8")
        ends = np.cumsum([len(p) + 1 for p in pieces])
        size = int(ends[-1])
        inside = np.ones(size, bool)
        inside[ends - 1] = False
        token = np.full(size + 1, -1, "int32")  # pairs never reach over the end of a piece
        token[:-1][inside] = self.first[data]
        after, before = np.arange(1, size + 2), np.arange(-1, size)
        makes = np.full(size + 1, _NONE, "int32")
        makes[:-1] = self._make(token[:-1], token[1:])
        state = _Index(token, after, before, makes)
        state.add(np.flatnonzero(makes != _NONE))
        while state.queue:
            rank, places = state.take()
            if len(places) < _FEW or not self._merge_all(state, rank, places):
                self._merge_each(state, rank, places.tolist())
        ids = token[token >= -1][:-1]
        cuts = 4 * np.flatnonzero(ids == -1)
        packed = ids.astype("<i4").tobytes()
        return [packed[a:b] for a, b in zip([0, *(cuts[:-1] + 4).tolist()], cuts.tolist(), strict=True)]

    def _merge_all(self, state: _Index, rank: int, places: np.ndarray) -> bool:
        """Merge all places of a rank at once; refuse where a merge opens an earlier rank."""
        token, after, before, makes = state.token, state.after, state.before, state.makes
        chained = np.concatenate(([False], after[places[:-1]] == places[1:]))  # overlaps its left neighbour: a run takes every other
        if chained.any():
            count = np.arange(len(places))
            places = places[(count - np.maximum.accumulate(np.where(chained, 0, count))) % 2 == 0]
        follower = after[places]
        right, left = after[follower], before[places]
        merged = np.full(len(places), rank, "int32")
        beside = np.concatenate(([False], right[:-1] == places[1:]))  # its left neighbour is merged as well
        made_right = self._make(merged, token[right])
        made_left = np.where(left >= 0, self._make(np.where(beside, rank, token[left]), merged), _NONE)
        left = np.where(beside, np.roll(places, 1), left)
        if min(made_right.min(), made_left.min()) < rank:
            return False
        token[places], token[follower] = rank, -2
        after[places], before[right] = right, places
        makes[follower] = _NONE
        makes[places] = made_right
        inner = left >= 0
        makes[left[inner]] = made_left[inner]
        changed = np.concatenate((places, left[inner & ~beside]))
        state.add(changed[makes[changed] != _NONE])
        return True

    def _merge_each(self, state: _Index, rank: int, places: list[int]) -> None:
        """Merge the places of a rank one after the other; an earlier rank that becomes possible goes first."""
        token, after, before, makes = state.views
        pairs, index = self.pairs, state.index
        for k, at in enumerate(places):
            if makes[at] != rank:
                continue  # its right neighbour has just been merged with the one before
            follower = after[at]
            token[at], token[follower], makes[follower] = rank, -2, _NONE
            follower = after[at] = after[follower]
            before[follower] = at
            earlier = False
            for left, right in ((before[at], at), (at, follower)):
                if left >= 0:
                    a, b = token[left], token[right]
                    made = pairs.get(a << 32 | b, _NONE) if a >= 0 and b >= 0 else _NONE
                    makes[left] = made
                    if made != _NONE:
                        if made in index:
                            index[made].append(left)
                        else:
                            index[made] = [left]
                            heapq.heappush(state.queue, made)
                        earlier |= made < rank
            if earlier and k + 1 < len(places):
                if rank not in index:
                    heapq.heappush(state.queue, rank)
                index.setdefault(rank, []).extend(places[k + 1 :])
                break


class _Index:
    """The linked symbols of all pieces, and the places of pairs by the token that they make."""

    def __init__(self, token: np.ndarray, after: np.ndarray, before: np.ndarray, makes: np.ndarray):
        self.token, self.after, self.before, self.makes = token, after, before, makes
        self.views = [memoryview(x) for x in (token, after, before, makes)]
        self.index: dict[int, list] = {}
        self.queue: list[int] = []

    def add(self, places: np.ndarray) -> None:
        made = self.makes[places]
        order = np.argsort(made, kind="stable")
        places, made = places[order], made[order]
        starts = np.flatnonzero(np.concatenate(([True], made[1:] != made[:-1])))[: len(made)]
        cuts = [*starts.tolist(), len(made)]
        for k, rank in enumerate(made[starts].tolist()):
            found = places[cuts[k] : cuts[k + 1]]
            if rank in self.index:
                self.index[rank].append(found)
            else:
                self.index[rank] = [found]
                heapq.heappush(self.queue, rank)

    def take(self) -> tuple[int, np.ndarray]:
        """The least rank with its places that still make it, from left to right."""
        rank = heapq.heappop(self.queue)
        held = self.index.pop(rank)
        places = np.unique(np.concatenate([np.atleast_1d(x) for x in held]) if len(held) > 1 else np.atleast_1d(held[0]))
        return rank, places[self.makes[places] == rank]


class Pieces(dict):
    """Numbers for pieces, in the order in which they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Encoder:
    """Encodes texts; remembers a bounded number of pieces from one replay to the next."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = MergeReplay(ranks)
        self.pattern = regex.compile(pattern)
        self.number, self.ids = Pieces(), []

    def split(self, text: str) -> np.ndarray:
        """The numbers of the pieces of a text."""
        return np.fromiter(map(self.number.__getitem__, self.pattern.findall(text)), "int32")

    def waiting(self) -> int:
        """How many pieces have no ids yet."""
        return len(self.number) - len(self.ids)

    def finish(self, split: list[np.ndarray]) -> list[bytes]:
        """The ids of texts that have been split, as little-endian 32-bit integers; one replay for all new pieces."""
        new = list(islice(self.number, len(self.ids), None))
        self.ids += self.replay.encode([p.encode() for p in new])
        out = [b"".join(map(self.ids.__getitem__, numbers.tolist())) for numbers in split]
        if len(self.number) > _CACHED_PIECES or sum(map(len, new)) > _CACHED_BYTES:
            self.number, self.ids = Pieces(), []
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.finish([self.split(t) for t in texts])


@lru_cache(1)
def _encoder(vocabulary: tuple, pattern: str) -> Encoder:
    """One encoder per Python worker; its pieces are remembered from task to task."""
    return Encoder(dict(vocabulary), pattern)


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(tuple(read_ranks(path).items()))  # the vocabulary


def encode(
    docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), ranks_path: str = TOKENIZER,
    pattern: str = PATTERN, ids_col: str = "ids", packed_col: str | None = None,
) -> DataFrame:
    """The ``keep`` columns with the token ``ids`` of every text, as the vocabulary's library gives them.

    ``packed_col`` names a column for the ids as files hold them: little-endian
    unsigned 32-bit integers, one after the other, null for null texts.

    Texts are cut into pieces by ``pattern``; no merge reaches over the end of a
    piece, and a piece that is a token stays whole. The distinct pieces of many
    texts are one corpus: an inverted index leads from each pair of tokens, by
    the token that they make, to all places where it stands, and merges are
    replayed over the whole corpus in the order of their ranks, leftmost first
    within a piece. After a merge only the two pairs next to it are indexed
    again. Special tokens are not known: their strings are ordinary text.

    A narrow map. A corpus is what a task reads until it has sixteen million characters or
    a quarter of a million new pieces; until then only the numbers of pieces are held, not the texts.
    Null texts have null ids, empty ones an empty list; repeated rows each get a row, an
    empty table none. The file of ranks is read by the driver; executors get the
    vocabulary, whose size is fixed.
    """
    added = [ids_col] if packed_col is None else [ids_col, packed_col]
    distinct_names([*keep, *added])
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if packed_col is not None:
        fields.append(T.StructField(packed_col, T.BinaryType()))
    schema = T.StructType([*rows.schema[:-1], *fields])
    ranks = _shared(docs, ranks_path)

    def finished(encoder, held):
        coded = iter(encoder.finish([numbers for _, _, split in held for numbers in split]))
        for columns, nulls, split in held:
            mine = list(islice(coded, len(split)))
            for begin in range(0, len(mine), _OUT_ROWS):
                part, mask = mine[begin : begin + _OUT_ROWS], pa.array(nulls[begin : begin + _OUT_ROWS])
                offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in part]))).astype("int32")
                values = pa.array(np.frombuffer(b"".join(part), "<i4"))
                arrays = [c.slice(begin, _OUT_ROWS) for c in columns] + [pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)]
                if packed_col is not None:
                    arrays.append(pa.array([None if n else c for c, n in zip(part, mask.to_pylist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *added])

    def run(batches):
        encoder = _encoder(ranks.value, pattern)
        held, size = [], 0
        for part, texts in parts(batches, _BATCH_CHARS):
            held.append((part.columns[:-1], [t is None for t in texts], [encoder.split(t or "") for t in texts]))
            size += sum(len(t or "") for t in texts)
            if size >= _CORPUS_CHARS or encoder.waiting() >= _CORPUS_PIECES:
                yield from finished(encoder, held)
                held, size = [], 0
        yield from finished(encoder, held)

    return rows.mapInArrow(run, schema)


def decode(
    encoded: DataFrame, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",), ranks_path: str = TOKENIZER,
    bytes_col: str = "decoded",
) -> DataFrame:
    """The ``keep`` columns with the bytes of the token ids, as binary.

    They are the UTF-8 bytes of the encoded text; single tokens may end within a
    character. Null ids, a null among the ids or an id outside of the vocabulary give null.
    """
    distinct_names([*keep, bytes_col])
    rows = encoded.select(*keep, F.col(ids_col).cast("array<int>").alias("_ids"))
    schema = T.StructType([*rows.schema[:-1], T.StructField(bytes_col, T.BinaryType())])
    ranks = _shared(encoded, ranks_path)

    def run(batches):
        bytes_of = {rank: token for token, rank in ranks.value}
        for batch in batches:
            found = []
            for ids in batch.column("_ids"):
                try:
                    found.append(b"".join([bytes_of[i] for i in ids.values.to_pylist()]) if ids.is_valid else None)
                except KeyError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*keep, bytes_col])

    return rows.mapInArrow(run, schema)
