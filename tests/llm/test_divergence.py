import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import documents, odd_documents
from defectflow.llm import divergence
from defectflow.llm.divergence import _postings, frequent_terms, source_divergence
from defectflow.session import write_and_reread

LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plainly(rows, least=10, top=10):
    """The definition, group by group and term by term."""
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = terms_of(text)
        docs[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (other, s), c in counts.items() if other == lang}

        def chances(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: chances(c) for s, c in groups.items()}
        q = chances(sum(groups.values(), Counter()))
        for source in groups:
            pairs = [(other, sum((p[source][t] - p[other][t]) ** 2 // (p[source][t] + p[other][t]) for t in kept)) for other in groups if other != source]
            near = [(t, (p[source][t] - q[t]) ** 2 // (p[source][t] + q[t])) for t in kept if groups[source][t] and p[source][t] > q[t]]
            for part, found in (("pair", pairs), ("term", near)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, t, v, k) for k, (t, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def sample(seed, n, sources, long=False):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdéñ漢") for _ in range(pick.randrange(1, 30 if long else 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        source = pick.choice(sources)
        text = " ".join(pick.choice(("", "-", "1")) + pick.choice(words[: pick.choice((5, 40, 300))]) for _ in range(pick.randrange(60)))
        rows.append((pick.choice(("en", "EN", None, "")), source, pick.choice((text, text.upper(), text, text, None))))
    return rows


def table(spark, rows):
    return documents(spark, [(i, text, lang, source, None, "c", "c", "c") for i, (lang, source, text) in enumerate(rows)])


def got(docs, **more):
    return sorted(tuple(r) for r in source_divergence(docs, **more).collect())


@pytest.mark.parametrize("seed, sources, long", [(1, ["a", "b", None, "", "é"], False), (2, [f"s{i}" for i in range(30)], True)])
def test_against_the_definition(spark, seed, sources, long):
    rows = sample(seed, 400, sources, long)
    wanted = plainly(rows)
    assert got(table(spark, rows)) == wanted and {w[2] for w in wanted} == {"pair", "term"}


def test_small_chunks_and_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_CHUNK", 300)
    monkeypatch.setattr(divergence, "_CELLS", 20)
    monkeypatch.setattr(divergence, "_HELD", 100)
    rows = sample(3, 200, ["a", "b", "c"], True)
    assert got(table(spark, rows).repartition(7), least=4, top=3) == plainly(rows, 4, 3)


def test_odd_documents(spark):
    rows = [(r[2], r[3], r[1]) for r in odd_documents()]
    assert got(documents(spark)) == plainly(rows)  # no term is kept by most languages: all pairs are 0 apart
    assert got(documents(spark), least=1) == plainly(rows, 1)
    assert got(documents(spark).limit(0)) == []


def test_no_kept_term_and_one_source(spark):
    assert got(table(spark, [("en", "a", "x y"), ("en", "b", None), ("de", "a", "")])) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    rows = [("en", "a", "same")] * 12
    assert got(table(spark, rows)) == plainly(rows) == []


def test_prefixes_in_many_documents_whose_terms_are_in_few(spark):
    # Every prefix of "commonstart" is frequent, but each longer term is in one document only.
    rows = [("en", "a", f"commonstart{'x' * (i % 5)}{chr(97 + i % 26)}{'y' * i} ok") for i in range(60)]
    rows += [("en", "b", "commonstart commonstartling ab a")] * 10
    docs = table(spark, rows).select(F.col("lang"), F.col("source"), F.col("text").alias("_text"))
    postings = write_and_reread(_postings(docs), "test")
    kept = frequent_terms(postings, 10)
    assert sorted(r.docs for r in kept.collect()) == [10, 10, 10, 10, 60]
    counts = divergence._counts(postings, kept, [("en", "a"), ("en", "b")])
    found = counts.groupBy("term").agg(F.sum("n").alias("n"))
    assert {bytes(r.term).decode(): r.n for r in found.collect()} == {"ok": 60, "commonstart": 10, "commonstartling": 10, "ab": 10, "a": 10}


@pytest.mark.parametrize("seed", range(4))
def test_prefixes_of_a_chunk(seed):
    pick = random.Random(seed)
    terms = sorted({bytes(pick.choice(b"ab\xc3") for _ in range(pick.choice((1, 3, 5, 40, 80)))) for _ in range(300)}
                   | {b"a" * n for n in (31, 32, 33, 34, 64)} | {b"a" * 33 + b"b"})
    size = np.array([len(t) for t in terms])
    same = divergence._shared(terms, size)
    assert same.tolist() == [0] + [len(os.path.commonprefix([a, b])) for a, b in itertools.pairwise(terms)]
    numbers = (size, same, np.ones(len(terms)), np.arange(len(terms)), np.ones(len(terms)))
    arrays = [pa.array(["en"]), pa.array([["s"] * len(terms)])]
    arrays += [pa.array([x], pa.binary()) for x in (b"".join(terms), *(x.astype("<i4").tobytes() for x in numbers))]
    chunk = divergence._Chunk(pa.RecordBatch.from_arrays(arrays, ["lang", "sources", "terms", *divergence._NUMBERS]), 0)
    for length in (1, 2, 4, 6, 33, 90):
        new = chunk.groups(length)
        key = [(t[:length], len(t) > length) for t in terms]
        assert new.tolist() == [True] + [a != b for a, b in itertools.pairwise(key)]
        digests = [tuple(k) for k in chunk.keys(np.arange(len(terms)), length).tolist()]
        assert len(set(digests)) == len(set(key)) and all((a == b) == (x == y) for (a, x), (b, y) in itertools.pairwise(zip(key, digests)))
    assert [tuple(k) for k in chunk.keys(np.arange(len(terms))).tolist()] == [tuple(k) for k in chunk.keys(np.arange(len(terms)), 90).tolist()]


def test_level_counts_fall_and_prune(spark):
    rows = sample(4, 300, ["a"], True)
    docs = table(spark, rows).select(F.coalesce("lang", F.lit("")).alias("lang"), F.lit("a").alias("source"), F.col("text").alias("_text"))
    postings = write_and_reread(_postings(docs), "test")
    counted = Counter()
    for lang, _, text in rows:
        counted.update({(lang or "", t.encode()[:6], len(t.encode()) > 6) for t in terms_of(text)})
    every = divergence._refine(postings, 6, 0, None)
    assert sorted(r.docs for r in every.collect()) == sorted(counted.values())
    assert every.where("docs < 10").count()  # what the levels leave out
    alive = spark.sparkContext.broadcast(divergence.bit_map(
        divergence._refine(postings, 2, 0, None).where("open and docs >= 10").select("a"), divergence._OPEN_BITS))
    later = divergence._refine(postings, 6, 2, alive)
    assert later.count() < every.count()
    wanted = sorted(n for (_, prefix, _), n in counted.items() if n >= 10 and len(prefix) > 2)
    assert sorted(r.docs for r in later.where("docs >= 10").collect()) == wanted


def test_terms_of_a_chunk_never_become_python_objects():
    import re

    texts = ["Ab" * 40 + " " + "ab" * 41 + " ab abc Ä\xa0Ä äb　c", "", "1 2 3", "é", "ÀB z Z[`{@a\x7f\x00b", "x" * 90]
    coded = [t.encode() for t in texts]
    found, sizes = divergence._terms(coded)
    want = [re.findall(rb"[a-z\x80-\xff]+", c.lower()) for c in coded]
    assert found.to_pylist() == [t for w in want for t in w] and sizes.tolist() == [len(w) for w in want]
    found, sizes = divergence._terms([b"", b"7"])
    assert len(found) == 0 and sizes.tolist() == [0, 0]


def test_counts_of_many_terms_are_held_without_python_objects():
    import tracemalloc

    terms = sorted(f"term{k}".encode() for k in range(100_000))
    arrays = [pa.array(["en"]), pa.array([["a", "b", "a"]])]
    size = np.array([len(t) for t in terms])
    doc = np.tile([0, 1, 2], len(terms))
    numbers = (size, divergence._shared(terms, size), np.full(len(terms), 3), doc, doc + 1)
    arrays += [pa.array([x], pa.binary()) for x in (b"".join(terms), *(x.astype("<i4").tobytes() for x in numbers))]
    batch = pa.RecordBatch.from_arrays(arrays, ["lang", "sources", "terms", *divergence._NUMBERS])
    every = np.full(divergence._OPEN_BITS // 8, 255, "uint8")
    tracemalloc.start()
    found = list(divergence._added_up(divergence._chunks([batch] * 4), every, {("en", "a"): 0, ("en", "b"): 1}))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20 and max(len(b) for b in found) <= 1 << 15
    rows = pa.Table.from_batches(found).to_pylist()
    assert sorted(r["term"] for r in rows) == terms
    assert all(r["lang"] == "en" and r["cells"] == [{"place": 0, "n": 16}, {"place": 1, "n": 8}] for r in rows)
