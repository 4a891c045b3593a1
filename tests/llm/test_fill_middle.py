import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import documents, odd_documents
from defectflow.llm.fill_middle import LINES, MARKS, SkipList, fill_in_middle, restore_middle


def plainly(key, text, rate=100, spm=50, seed=7):
    units = re.findall(LINES, text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def lines(seed, n):
    pick = random.Random(seed)
    return "".join(pick.choice(("", "ñ🙂", "a b", "<", "S>", "\r", "x" * 40)) + "\n" for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 255, 256, 257, 5000])
def test_places_of_all_ranks(n):
    widths = np.array([random.Random(n).randrange(30) for _ in range(n)], "int64")
    found = SkipList(widths)
    wanted = np.concatenate(([0], np.cumsum(widths)))
    ranks = range(n + 1) if n < 300 else random.Random(1).sample(range(n + 1), 300) + [0, n]
    assert [found.place(r) for r in ranks] == [wanted[r] for r in ranks]


def test_against_joined_units(spark):
    rows = odd_documents() + [(100 + i, lines(i, i * 7), "en", "s", None, "c", "c", "c") for i in range(60)]
    rows += [(200, "a<P>b\nc", "en", "s", None, "c", "c", "c"), (201, "<\n<\n<\n<", "en", "s", None, "c", "c", "c")]
    rows += [(202, "S>\nP>\n<M\n", "en", "s", None, "c", "c", "c"), (203, "\n" * 50, "en", "s", None, "c", "c", "c")]
    docs = documents(spark, rows)
    got = fill_in_middle(docs).withColumn("back", restore_middle(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        str((r[0], *plainly(r[0], r[1] or ""), r[1] or "")) for r in rows
    )
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates_and_empty_table(spark):
    docs = documents(spark, [(i, lines(i, 9), "en", "s", None, "c", "c", "c") for i in range(300)])
    got = fill_in_middle(docs, rate=30, spm=0, seed=3).collect()
    assert [tuple(r) for r in sorted(got)] == [(i, *plainly(i, lines(i, 9), 30, 0, 3)) for i in range(300)]
    assert {r.form for r in got} == {"plain", "psm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_units_and_marks_that_cannot_work(spark):
    docs = documents(spark, [(1, "a b", "en", "s", None, "c", "c", "c")])
    for marks in (("<P>", "<S>"), ("<P>", "", "<M>"), ("aa", "<S>", "<M>"), ("ab", "bc", "x"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, marks=marks)
    with pytest.raises(Exception, match="cover"):
        fill_in_middle(docs, units="a").collect()
    with pytest.raises(ValueError):
        fill_in_middle(docs.withColumn("N", F.lit(1)), id_col="N")
