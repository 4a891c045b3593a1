import numpy as np
import pytest

from cases import documents, prose, texts
from defectflow.llm.passages import cut_passages, repeated_passages


def plain(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    holders = {}
    for i, w in words:
        for s in range(len(w) - width + 1):
            holders.setdefault(tuple(w[s : s + width]), set()).add(i)
    out = {}
    for i, w in words:
        every, copies = np.zeros(len(w), bool), np.zeros(len(w), bool)
        for s in range(len(w) - width + 1):
            held = holders[tuple(w[s : s + width])]
            if len(held) > 1:
                every[s : s + width] = True
            if min(held) < i:
                copies[s : s + width] = True
        if every.any():
            out[i] = (len(w), every, copies)
    return out


def cover(n, spans):
    out = np.zeros(n, bool)
    for s in spans:
        assert not out[s.start : s.start + s.words].any()
        out[s.start : s.start + s.words] = True
    return out


def corpus():
    passage, other = prose(1, 70), prose(2, 130).split()
    out = [prose(100 + i, 90) for i in range(25)]
    out += [f"{prose(200 + i, i)} {passage} {prose(300 + i, 3 * i)}" for i in range(12)]
    out += [" ".join([prose(400 + i, 9), *other[5 * i : 5 * i + 60]]) for i in range(10)]  # partners of different reach
    out += [prose(3, 49), prose(3, 49), prose(4, 50), prose(4, 50) + " x", "same " * 200, "same " * 51]
    out += [passage + " " + passage, prose(5, 60) + " " + prose(5, 60), "\t" + prose(6, 55).replace(" ", "\n"), prose(6, 55)]
    return out


@pytest.mark.parametrize("width", [50, 20])
def test_spans_match_all_windows(spark, width):
    rows = list(enumerate(corpus()))
    want = plain(rows, width)
    got = {r.doc_id: r for r in repeated_passages(texts(spark, [t for _, t in rows]), min_words=width).collect()}
    assert set(got) == set(want)
    for i, (n, every, copies) in want.items():
        r = got[i]
        assert r.n_words == n and r.repeated_words == every.sum()
        assert (cover(n, r.spans) == every).all() and (cover(n, r.copies) == copies).all()


def test_cut_leaves_each_passage_once(spark):
    docs = texts(spark, corpus())
    cut = cut_passages(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = {r.doc_id: r.text for r in cut.collect()}
    assert sum(prose(1, 70) in t for t in left.values()) == 1
    rows = docs.collect()
    untouched = set(left) - set(plain([(r.doc_id, r.text) for r in rows], 50))
    assert all(left[r.doc_id] == r.text for r in rows if r.doc_id in untouched)


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in repeated_passages(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    want = plain(rows, 50)
    assert set(got) == set(want) == {1, 2, 3, 9, 10}
    assert got[9].copies == [] and got[10].copies[0].words == 30_000
    assert repeated_passages(docs.limit(0)).count() == 0 and cut_passages(docs.limit(0)).count() == 0


def test_many_starts_are_merged_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    from defectflow.llm.passages import _spans

    rng, kind = np.random.default_rng(3), pa.list_(pa.struct([("start", pa.int32()), ("copy", pa.bool_())]))
    sizes = rng.integers(0, 200, 4_000)
    cells = pa.StructArray.from_arrays([pa.array(rng.integers(0, 2_000, sizes.sum()).astype("int32")), pa.array(rng.random(sizes.sum()) < 0.3)], ["start", "copy"])
    starts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype("int32")), cells)
    tracemalloc.start()
    got = _spans(starts, 50, 1 << 14)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # as dictionaries, 400,000 starts take over 100 MB
    for k in (0, 1, 17, 3_999):
        one, found = starts[k].as_py(), got[k].as_py()
        for name, chosen in (("spans", one), ("copies", [s for s in one if s["copy"]])):
            want = np.zeros(2_050, bool)
            for s in chosen:
                want[s["start"] : s["start"] + 50] = True
            covered = np.zeros(2_050, bool)
            for a, b in zip(found[name], [*found[name][1:], None]):
                covered[a["start"] : a["start"] + a["words"]] = True
                assert b is None or a["start"] + a["words"] < b["start"]
            assert (covered == want).all()
        assert found["words"] == sum(s["words"] for s in found["spans"])
    assert _spans(pa.array([], kind), 50).to_pylist() == [] and _spans(pa.array([[]], kind), 50).to_pylist() == [{"spans": [], "copies": [], "words": 0}]
