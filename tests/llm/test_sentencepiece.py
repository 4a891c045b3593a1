import os
import random

import pytest

from cases import documents, prose
from defectflow.llm.sentencepiece_bpe import TOKENIZER, Encoder, PieceVocabulary, decode, encode

sentencepiece = pytest.importorskip("sentencepiece")
if not os.path.exists(TOKENIZER):
    pytest.skip("no vocabulary file", allow_module_level=True)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    with open(TOKENIZER, "rb") as file:
        return Encoder(PieceVocabulary(file.read()))


def ids(encoder, texts):
    import numpy as np

    return [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(texts)]


def test_odd_texts(encoder, library):
    texts = [
        "", " ", "  ", "a", "  a  b ", "\n\n\t x", "漢字かな交じり文です。" * 30, "a" * 700, " " * 1000, "é‍👩‍👩‍👧 ok\x00z", "x▁y▁▁z",
        "http://" + "abc/def?x=1&" * 100, "<s></s><unk><0x0A>", "⁇", " " * 37 + "the", "ÿ" * 70, "the" * 400, "İstanbul ﬁ Å",
    ]
    assert ids(encoder, texts) == [library.encode(t) for t in texts]


def test_random_texts(encoder, library):
    pick = random.Random(5)
    texts = ["".join(pick.choice("the ing añü\n漢.,  ab") for _ in range(pick.randrange(300))) for _ in range(200)]
    assert ids(encoder, texts) == [library.encode(t) for t in texts]


def test_small_index_and_cache_do_not_matter(encoder, library, monkeypatch):
    from defectflow.llm import sentencepiece_bpe as module

    monkeypatch.setattr(module, "_INDEX_BYTES", 50)
    monkeypatch.setattr(module, "_CACHED_UNITS", 20)
    fresh = Encoder(encoder.vocabulary)
    texts = [prose(i, 40) for i in range(10)]
    assert [ids(fresh, [t])[0] for t in texts] == [library.encode(t) for t in texts]


def test_round_trip_of_a_table(spark, library):
    docs = documents(spark)
    coded = encode(docs.drop("ids"), keep=["doc_id", "source"])
    rows = {(r.doc_id, r.source): r.ids for r in coded.collect()}
    for r in docs.collect():
        assert rows[r.doc_id, r.source] == (None if r.text is None else library.encode(r.text))
    back = {(r.doc_id, r.source): r.text for r in decode(coded, keep=["doc_id", "source"]).collect()}
    assert back == {(r.doc_id, r.source): r.text for r in docs.collect()}
    assert encode(docs.drop("ids").limit(0)).count() == 0 and decode(coded.limit(0)).count() == 0


def test_decoding_odd_ids(spark):
    rows = [(1, [3 + 0xFF, 3 + 0x41]), (2, [99_999]), (3, None), (4, []), (5, [1, 2])]
    coded = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.text for r in decode(coded).collect()}
    assert got == {1: "�A", 2: None, 3: None, 4: "", 5: ""}


def test_only_new_neighbours_are_looked_up_again(encoder, library):
    """Relaxing asks for the edge of a pair once, and again only beside a joined pair."""
    import numpy as np

    class Counting:
        def __init__(self, costs):
            self.costs, self.asked = costs, 0

        def __getitem__(self, at):
            self.asked += np.size(at)
            return self.costs[at]

        def __len__(self):
            return len(self.costs)

    vocabulary = encoder.vocabulary
    units = [" " + (w * 30)[:38] for w in sorted({w for i in range(20) for w in prose(i, 60).split()})]
    counting = Counting(vocabulary.costs)
    vocabulary.costs = counting
    try:
        coded = vocabulary.encode_units(units)
    finally:
        vocabulary.costs = counting.costs
    assert counting.asked <= 3 * sum(map(len, units))
    assert [np.frombuffer(c, "<i4").tolist() for c in coded] == [library.encode(u[1:]) for u in units]
