import random
import re

import pytest

from cases import WORDS, documents, prose, texts
from defectflow.llm import ngram_join
from defectflow.llm.links import components
from defectflow.llm.ngram_join import drop_near_copies, link_near_copies


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def plain_classes(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (key, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            same = key is not None and key == sets[j][0]
            if same or a and b and None not in (key, sets[j][0]) and 100 * len(a & b) >= 75 * len(a | b):
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(top(i), []).append(sets[i][0])
    return {key: min(g, key=lambda k: (k is None, k)) for g in groups.values() for key in g}


def edited(text, share, seed):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + "x" if pick.random() < share else w for w in text.split())


def near_copies():
    out = [prose(1000 + i, 12 + i % 60) for i in range(60)]
    for base in range(6):
        text = prose(base, 30 + 25 * base)
        out += [edited(text, share, 7 * base + i) for i, share in enumerate((0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1))]
    long = prose(77, 300).split()
    out += [" ".join(long[k : k + 100]) for k in range(0, 200, 9)]  # a chain: each links to the next ones only
    passage = prose(99, 40)
    out += [f"{prose(500 + i, 6)} {passage} {prose(700 + i, i % 9)}" for i in range(40)]
    return out


def check(docs, rows):
    want = plain_classes(rows)
    got = link_near_copies(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for key, text in rows:
        size.setdefault(key, set()).add(len(plain_set(text)))
    for r in got:
        assert r.component_id == want[r.doc_id], r
        assert r.n_shingles in size[r.doc_id]


@pytest.mark.parametrize(("block", "few"), [(4096, 4), (3, 0)])
def test_links_match_all_pairs(spark, monkeypatch, block, few):
    monkeypatch.setattr(ngram_join, "_BLOCK", block)
    monkeypatch.setattr(ngram_join, "_FEW", few)
    rows = list(enumerate(near_copies()))
    random.Random(1).shuffle(rows)
    check(texts(spark, [t for _, t in sorted(rows)]), sorted(rows))


def test_pieces_of_long_lists_do_not_matter(spark):
    rows = list(enumerate([edited(prose(3, 60), 0.02, i) for i in range(80)]))
    check(texts(spark, [t for _, t in rows]), rows)


def test_lists_that_span_batches():
    import numpy as np
    import pyarrow as pa

    token = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    rows = pa.table({"token": token, "id": np.arange(500)})
    small = [b for b in rows.to_batches(max_chunksize=7)]
    one = pa.Table.from_batches(ngram_join._leaders(iter(rows.to_batches())))
    many = pa.Table.from_batches(ngram_join._leaders(iter(small)))
    assert one.sort_by("id").equals(many.sort_by("id"))


def test_leaders_outside_of_the_component():
    import numpy as np
    import pyarrow as pa

    pick = np.random.default_rng(2)
    token, component = np.sort(pick.integers(0, 30, 400)), pick.integers(0, 3, 400)
    ids = pick.permutation(400)
    rows = pa.table({"token": token, "id": ids, "n": ids + 5, "component": component})
    want = {}
    for x in range(400):
        of_list = [y for y in range(400) if token[y] == token[x]]
        outside = [y for y in of_list if component[y] != component[x]]
        if outside:
            first = of_list[0] if of_list[0] in outside else outside[0]
            want[int(ids[x]), int(ids[first])] = 1
    found = pa.Table.from_batches(ngram_join._leaders_outside(iter(rows.to_batches(max_chunksize=9)))).to_pylist()
    assert {(r["a"], r["b"]): r["k"] for r in found} == want
    assert all(r["n_a"] == r["a"] + 5 and r["n_b"] == r["b"] + 5 for r in found)


def test_a_pair_of_many_lists_is_sent_once(spark):
    # 40 lists with a component of 30 sets and 5 sets outside of it, and one list without that component.
    rows = [(t, i, 10 + i % 2, 0 if i < 30 else i) for t in range(40) for i in range(35)]
    rows += [(99, i, 10, i) for i in (31, 33, 50)]
    total = {i: sum(r[1] == i for r in rows) for i in range(60)}
    placed = spark.createDataFrame([(*r, total[r[1]]) for r in rows], "token bigint, id bigint, n bigint, component bigint, total bigint")
    mixed = spark.createDataFrame([(t, 35, 1, 0) for t in range(40)] + [(99, 3, 1, 50)], "token bigint, _size bigint, _blocks bigint, _most bigint")
    for at_once in (1 << 17, 200):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ngram_join, "_TOGETHER", at_once)
            pairs = ngram_join._block_pairs(placed.join(ngram_join._grouped(mixed), "token"))
            found = pairs.mapInArrow(ngram_join._open_pairs, ngram_join._PAIRS).collect()
        want = {(a, b): 40 for a in range(35) for b in range(30, 35) if a < b}
        want[31, 33] += 1
        want |= {(31, 50): 1, (33, 50): 1}  # too few for sets of ten
        got = {}
        for r in found:
            pair = (min(r.a, r.b), max(r.a, r.b))
            got[pair] = got.get(pair, 0) + r.k
        assert {p: k for p, k in got.items() if k > 1} == {p: k for p, k in want.items() if k > 1}
        assert len(found) <= (len(want) + 1 if at_once > 200 else len(rows) // 200 * len(want) + 8 * len(want))


def test_open_pairs_are_counted_some_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    pick = np.random.default_rng(3)
    token = np.sort(pick.integers(0, 20, 600))
    ids = pick.integers(0, 60, 600)
    rows = sorted({(int(t), int(40 + i % 3), int(i)) for t, i in zip(token, ids)})
    token, n, ids = (np.array(x) for x in zip(*rows))
    rows = pa.table({"task": token // 10, "token": token, "id": ids, "n": n, "component": ids % 4, "block": np.full(len(ids), -1), "total": np.bincount(ids)[ids] + (ids == 5)})
    want = {}
    for t in range(20):
        of_list = [(int(x), int(y)) for x, y in zip(n[token == t], ids[token == t])]
        for i, a in enumerate(of_list):
            for b in of_list[i + 1 :]:
                if a[1] % 4 != b[1] % 4 and 4 * a[0] >= 3 * b[0]:
                    want[a[1], b[1]] = want.get((a[1], b[1]), 0) + 1
    for held in (1 << 21, 50):
        monkeypatch.setattr(ngram_join, "_HELD", held)
        got = {}
        for r in pa.Table.from_batches(ngram_join._open_pairs(iter(rows.to_batches(max_chunksize=7)))).to_pylist():
            got[r["a"], r["b"]] = got.get((r["a"], r["b"]), 0) + r["k"]
            assert r["n_a"] == 40 + r["a"] % 3 and r["n_b"] == 40 + r["b"] % 3
        for (a, b), k in want.items():
            n, m = 40 + a % 3, 40 + b % 3
            if k >= -(-3 * (n + m) // 7) - max(-(-3 * n // 4), -(-3 * m // 4)) + 1:
                assert got[a, b] == k
        assert all(k <= want[pair] for pair, k in got.items()) and (held < 100 or len(got) < len(want))


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(docs, rows)
    stay = drop_near_copies(docs)
    assert stay.columns == docs.columns
    want = plain_classes(rows)
    assert sorted(r.doc_id for r in stay.where("doc_id is not null").collect()) == sorted(
        k for k, _ in rows if k is not None and want[k] == k
    )
    assert link_near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    pick = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(40, 41), (41, 41)]
    pairs += [(pick.randrange(1000, 1400), pick.randrange(1000, 1400)) for _ in range(250)]
    pick.shuffle(pairs)
    got = {r.node: r.component_id for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
