import random
import re
from collections import Counter

import numpy as np
import pytest

from cases import documents, prose, texts
from defectflow.llm.quality_rules import COUNTS, _chi2_cdf, _chi2_quantile, quality_rules, text_counts


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(n - 1 for n in Counter(lines).values()), len(covered), len(re.findall("[A-Z]", text)),
    )


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 30, "line one\nline one\n \n \nline one\nother",
    "# * $ %& |<> Ünï code   x", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0", "A\x1fB\x1cC d", prose(5, 400) + "\n" + prose(5, 40),
    "\n".join(prose(i % 5, 12) for i in range(60)),
])
def test_counts(text):
    assert text_counts(text) == plain_counts(text)


def test_counts_of_random_texts():
    pick = random.Random(3)
    for _ in range(200):
        text = "".join(pick.choice("ab \n#é") for _ in range(pick.randrange(120)))
        assert text_counts(text) == plain_counts(text)


def test_chi_squared():
    assert _chi2_cdf(3.0, 2) == pytest.approx(1 - np.exp(-1.5))
    assert _chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_verdicts(spark):
    clean = [prose(i, 60 + i % 80) for i in range(300)]
    marked = [" ".join(w + "%%%" for w in prose(i, 80).split()) for i in range(40)]
    shouted = [prose(i, 80).upper().replace(" ", "!! ") for i in range(40)]
    base = ["short text", "again and again the same eight words here " * 9]
    docs = texts(spark, [*clean, *marked, *shouted, *base])
    rows = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(rows) == docs.count()
    kept = [rows[i].kept for i in range(len(rows))]
    assert np.mean(kept[:300]) == 1.0
    assert not any(kept[300:])
    assert [rows[i].base_failed for i in (380, 381)] == [True, True] and not any(rows[i].base_failed for i in range(380))


def test_repeated_lines_and_words_reject_on_their_own(spark):
    clean = [prose(i, 60 + i % 80) for i in range(300)]
    once = [prose(i, 60) + ".\nthe same line\n" + prose(i + 500, 60) + "\nthe same line" for i in range(5)]
    lists = []
    for i in range(20):
        pick, pool = random.Random(i), [prose(900 + 10 * i + k, 3) for k in range(4)]
        lines = [prose(2000 + 100 * i + k, 3) if k % 3 == 0 else pick.choice(pool) for k in range(45)]
        lists.append("\n".join(lines))
    passages = [" ".join([prose(i, 40), prose(i + 700, 14), prose(i + 800, 32), prose(i + 700, 14)]) for i in range(20)]
    got = {r.doc_id: r for r in quality_rules(texts(spark, [*clean, *once, *lists, *passages])).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[i].kept for i in range(305))
    assert not any(got[i].kept for i in range(305, 345))


def test_odd_rows_small_groups_and_empty_table(spark):
    docs = documents(spark)
    rows = quality_rules(docs).collect()
    assert len(rows) == docs.count()
    want = {r.doc_id: plain_counts(r.text) for r in docs.collect()}
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == want[r.doc_id]
        assert r.kept is not None and r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality_rules(docs.limit(0)).count() == 0
