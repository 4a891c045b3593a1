"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing names."""

import random

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, target string, ids string"


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(("", "ing", "ed", "s")) for _ in range(n))


def odd_documents():
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "en", "a"), (2, prose(2, 120), "en", "b"), (3, prose(2, 120) + " \n", "en", "a"),
        (4, None, "en", "a"), (5, "", None, None), (6, " \t\n", "en", None), (7, "word", "de", "b"),
        (8, "Word", "de", "b"), (9, long, "en", "a"), (10, long + " end", "en", "é"), (11, prose(3, 80), None, "a"),
        (12, prose(4, 60), "fr", ""), (12, prose(4, 60), "fr", ""), (13, "a b c d", "en", "b"), (14, "a b c d e", "en", "b"),
        (15, "漢字 かな 交じり 🙂 ñ " * 9, "ja", "c"), (16, "x" * 50_000, "en", "c"), (None, "no id at all", "en", "a"),
    ]
    return [(*r, None, "clash", "clash", "clash") for r in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, DOCS)


def texts(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), None, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)
