"""Fill-in-the-middle: texts cut at two ranks that an indexable skip list turns into places."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from defectflow.llm.common import distinct_names, parts

#: A line with its end, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
_FAN = 16  # nodes of a lane under one node of the lane above
_BATCH_CHARS = 1 << 21


class SkipList:
    """The units of one text under express lanes.

    The lowest lane has a node for every unit, every other lane one for each
    ``_FAN`` nodes of the lane below. A node carries what its link passes over:
    a width in units and a width in code points.
    """

    def __init__(self, points: np.ndarray):
        self.lanes = [(np.ones(len(points), "int64"), points)]
        while len(self.lanes[-1][1]) > _FAN:
            starts = np.arange(0, len(self.lanes[-1][1]), _FAN)
            self.lanes.append(tuple(np.add.reduceat(width, starts) for width in self.lanes[-1]))

    def place(self, rank: int) -> int:
        """Code points before the unit of that rank; all of them for the number of units."""
        node = passed = place = 0
        for lane, (units, points) in reversed(list(enumerate(self.lanes))):
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                place += int(points[node])
                node += 1
            if lane:
                node *= _FAN
        return place


def _check_marks(marks: Sequence[str]) -> None:
    """Marks must be found again wherever they stand, so none may overlap another or itself."""
    if len(marks) != 3 or not all(marks):
        raise ValueError("three marks that are not empty are needed")
    for k, a in enumerate(marks):
        for m, b in enumerate(marks):
            if (k != m and a in b) or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks overlap: {a!r}, {b!r}")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = LINES, rate: int = 100, spm: int = 50,
    seed: int = 7, marks: Sequence[str] = MARKS,
) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output`` for every row.

    A text is cut into its ``n`` units (matches of ``units``, which must cover it). The
    first four groups of eight hexadecimal digits of the sha256 of ``seed:id`` are
    four numbers: the first two, modulo ``n + 1``, are the ranks of the cuts; of a
    hundred texts ``rate`` are cut, by the third, and of those ``spm`` put the
    suffix first, by the fourth. With the marks P, S, M, the output is
    ``P prefix S suffix M middle`` (form psm), ``S suffix P prefix M middle`` (spm)
    or the text itself (plain: not chosen, empty, or with a mark inside).

    The ranks become places by descending a skip list of the units (:class:`SkipList`),
    so no unit is ever joined again. A narrow map; a task holds about two million
    characters, or one text if that is longer.

    Null texts count as empty, null ids as an empty id. Rows that repeat an id are
    cut by the same numbers. Other columns are not read. An empty table gives an
    empty result.
    """
    _check_marks(marks)
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    distinct_names(names)
    rows = docs.select(F.col(id_col), F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    long, string = T.LongType(), T.StringType()
    kinds = [long, string, long, long, string]
    schema = T.StructType([rows.schema[0], *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True))])
    unit = re.compile(units)
    p, s, m = marks

    def cut(key: str | None, text: str) -> tuple:
        widths = np.array([len(u) for u in unit.findall(text)], "int64")
        n = len(widths)
        if widths.sum() != len(text):
            raise ValueError("the units must cover the text")
        digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        if not text or h3 % 100 >= rate or any(mark in text for mark in marks):
            return n, "plain", None, None, text
        lanes = SkipList(widths)
        a, b = (lanes.place(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm:
            return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def run(batches):
        for part, texts in parts(batches, _BATCH_CHARS):
            found = [cut(key, text or "") for key, text in zip(part.column("_id").to_pylist(), texts, strict=True)]
            columns = zip(*found, strict=True)
            arrays = [pa.array(c, pa.string() if k is string else pa.int64()) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    return rows.mapInArrow(run, schema)


def restore_middle(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` from; null where one of both is null."""
    _check_marks(marks)
    p, s, m = marks

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = pieces(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).when(form == "plain", output)
