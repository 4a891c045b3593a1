import datetime
import re

import pytest
from pyspark.sql import functions as F

from cases import documents, texts
from defectflow.llm.pseudonyms import _feistel, pseudonymize


def luhn(card):
    digits = [int(c) for c in card if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def run(spark, values, key="k"):
    rows = pseudonymize(texts(spark, values), key).orderBy("doc_id").collect()
    return [r.text for r in rows], rows


def test_feistel_is_a_permutation(spark):
    for a, b in ((17, 23), (1, 9), (10, 100)):
        pairs = spark.range(a * b).select(_feistel(F.floor(F.col("id") / b), F.col("id") % b, a, b, "k").alias("p"))
        assert {(r.p.x, r.p.y) for r in pairs.collect()} == {(x, y) for x in range(a) for y in range(b)}


def test_cards(spark):
    cards = ["4111111111111111", "5500 0000 0000 0004", "6011-0009-9013-9424", "4222222222222", "6304000000000000000"]
    cards = [c for c in cards if luhn(c)]
    texts_, rows = run(spark, cards)
    for old, new in zip(cards, texts_):
        assert new != old and luhn(new) and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", old)
    same, _ = run(spark, ["x 4111111111111111, 4111 1111 1111 1111"])
    first, second = re.findall(r"\d[\d ]+\d", same[0])
    assert first == second.replace(" ", "")
    wrong = ["4111111111111112", "123456789012", "41111111111111111111", "a4111111111111111"]
    assert run(spark, wrong)[0] == wrong
    assert run(spark, cards, "other")[0] != texts_


def test_dates_are_permuted_among_dates(spark):
    start = datetime.date(1999, 12, 1)
    days = [start + datetime.timedelta(i) for i in range(120)]
    iso, rows = run(spark, [d.isoformat() for d in days])
    assert len(set(iso)) == 120 and all(1900 <= datetime.date.fromisoformat(x).year <= 2099 for x in iso)
    dotted, _ = run(spark, [d.strftime("%d.%m.%Y") for d in days])
    assert [datetime.datetime.strptime(x, "%d.%m.%Y").date().isoformat() for x in dotted] == iso
    month_first = [d.strftime("%m/%d/%Y") for d in days if d.day > 12] + ["02/29/2000", "12/31/1901"]
    new, _ = run(spark, month_first)
    assert len(set(new)) == len(set(month_first))
    for old, x in zip(month_first, new):
        d = datetime.datetime.strptime(x, "%m/%d/%Y")
        assert d.day > 12 and 1900 <= d.year <= 2099 and (int(old[3:5]) <= 28 or x[:5] == old[:5])
    wrong = ["2021-02-30", "1899-01-01", "31-12-1999", "2020-1-1", "1.2.3", "12020-01-01"]
    assert run(spark, wrong)[0] == wrong


def test_other_kinds(spark):
    values = ["+1 (017) 555-7713", "212-555-1234", "10.20.30.40", "123-45-6789", "a.b@mail9.example.com",
              "token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\"", "B44E15E09FD311C3CF3163B66D5A9875"]
    new, rows = run(spark, values)
    assert [r.found[0].kind for r in rows] == ["phone", "phone", "ip", "ssn", "email", "secret", "secret"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[0]) and re.fullmatch(r"\d{3}-\d{3}-\d{4}", new[1])
    assert all(0 <= int(p) < 256 for p in new[2].split(".")) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", new[3])
    assert new[5].startswith("token = \"") and len(new[5]) == len(values[5]) and new[6].isupper()
    assert not set(new) & set(values)
    wrong = ["000-12-3456", "666-12-3456", "123-00-3456", "900-12-3456", "256.1.1.1", "1.2.3.4.5", "a@b", "abcdef0123"]
    assert run(spark, wrong)[0] == wrong
    linked, _ = run(spark, ["mail A.B@mail9.example.com now", "a.b@mail9.example.com"])
    assert linked[1] in linked[0]


def test_text_around_stays(spark):
    text = "a\n+1 (017) 555-7713, 10.20.30.40;  2020-01-02\tb é🙂 2.50 v1.2 555"
    new, rows = run(spark, [text, "no such thing 12", "10.20.30.40"])
    assert re.sub(r"\d", "9", new[0]) != "" and new[0].startswith("a\n+1 (") and new[0].endswith("\tb é🙂 2.50 v1.2 555")
    assert rows[0].n_found == 3 and new[1] == "no such thing 12" and rows[1].n_found == 0 and rows[2].n_found == 1
    for f in rows[0].found:
        assert f.pseudonym in new[0]


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark)
    rows = pseudonymize(docs, "k", carry=["source", "kept"]).collect()
    assert len(rows) == docs.count() and {r.doc_id: r.text for r in rows} == {r.doc_id: r.text or "" for r in docs.collect()}
    assert pseudonymize(docs.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        pseudonymize(docs.withColumn("found", F.lit(1)), "k", carry=["found"])
