from hashlib import sha256

import pytest

from cases import documents
from defectflow.llm.exact_dedup import drop_copies, exact_dedup


def norm(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r)
    out = []
    for group in groups.values():
        best = min(group, key=lambda r: (-len(r.text or ""), -1 if r.doc_id is None else r.doc_id)).doc_id
        out += [(r.doc_id, best, len(group), r.doc_id == best) for r in group]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 26])
def test_groups_match_a_plain_grouping(spark, bits):
    docs = documents(spark)
    got = exact_dedup(docs, filter_bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs.collect())


def test_carried_columns_and_names(spark):
    docs = documents(spark).withColumnRenamed("n_chars", "size")
    got = exact_dedup(docs, carry=["text", "target"]).collect()
    assert {norm(r.text) for r in got} == {norm(r.text) for r in docs.collect()} and {r.target for r in got} == {"clash"}
    with pytest.raises(ValueError):
        exact_dedup(docs, carry=["kept"])


def test_rows_that_stay(spark):
    docs = documents(spark)
    stay = drop_copies(docs)
    assert stay.columns == docs.columns
    rows = stay.collect()
    assert len(rows) == len({norm(r.text) for r in docs.collect()})
    assert 3 in [r.doc_id for r in rows] and 1 not in [r.doc_id for r in rows]  # most code points win


def test_prefix_alone_does_not_decide(spark):
    same = "y" * 500
    docs = documents(spark, [(i, same + e, "en", "a", None, None, None, None) for i, e in enumerate("abca")])
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0}
    assert len({sha256((same + e).encode()).hexdigest() for e in "abca"}) == 3


def test_empty_table(spark):
    empty = documents(spark).limit(0)
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0


def test_copies_of_repeated_ids_and_names_in_use(spark):
    from defectflow.llm.exact_dedup import drop_copies

    rows = [(1, "aa", 5, "x", 7), (2, "aa", 6, "y", 8), (2, "bb", 7, "z", 9), (2, "b b", 8, "z", 9), (3, "bb ", 1, "q", 2), (None, None, 0, "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _content int, content string, place int")
    docs = docs.withColumnRenamed("_content", "kept_id")
    got = drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[3], rows[5]]))
