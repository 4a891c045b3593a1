import re
from collections import Counter, defaultdict

import pytest

from cases import documents, prose
from defectflow.llm.mixing import mix_sources, mixed_rows


def targets(sizes, weights, most):
    """The contract, read literally: share, cap, share the excess again until none is above."""
    total, names = sum(sizes.values()), sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(total)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def corpus(spark):
    rows = []
    for i in range(600):
        source = ("big", "big", "big", "tiny", "é", None, "")[i % 7] if i % 35 else "rare"
        rows.append((i, prose(i, 5 + i * 7 % 90), "en", source, None, None, None, None))
    return documents(spark, rows)


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_targets_words_and_shards(spark, shards):
    docs = corpus(spark)
    sizes, source_of, size_of = defaultdict(int), {}, {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        sizes[r.source] += n
        source_of[r.doc_id], size_of[r.doc_id] = r.source, n
    want = targets(sizes, (5, 2, 1), 3)
    rows = mix_sources(docs, shards=shards, block_words=300).collect()
    assert len(rows) == 600
    taken = Counter()
    for r in rows:
        source = source_of[r.doc_id]
        assert r.size == size_of[r.doc_id] and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source], rel=1e-9)
        assert r.taken <= 3 * r.size and r.copies == len(r.draws) and r.taken == r.copies * r.size
        taken[source] += r.taken
    for source, words in want.items():
        assert abs(taken[source] - words) <= 95  # the longest document
    quotas = Counter((d.shard) for r in rows for d in r.draws)
    assert set(quotas) <= set(range(8))
    if shards == 8:
        assert min(quotas.values()) > 0.5 * max(quotas.values())


def test_same_mix_whatever_the_partitions(spark):
    docs = corpus(spark)
    one = mix_sources(docs.repartition(1), shards=4, block_words=300)
    two = mix_sources(docs.repartition(7), shards=4, block_words=300)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_rows_of_the_mix(spark):
    docs = corpus(spark)
    wanted = Counter({r.doc_id: r.copies for r in mix_sources(docs, block_words=300).collect() if r.copies})
    mixed = mixed_rows(docs, block_words=300)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == wanted


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark)
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert mix_sources(docs.limit(0)).count() == 0
    assert mixed_rows(docs.limit(0)).count() == 0
