import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import documents, prose
from defectflow.llm import byte_bpe
from defectflow.llm.byte_bpe import PATTERN, TOKENIZER, Encoder, MergeReplay, decode, encode, read_ranks

tiktoken = pytest.importorskip("tiktoken")
if not os.path.exists(TOKENIZER):
    pytest.skip("no vocabulary file", allow_module_level=True)


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(TOKENIZER)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return Encoder(ranks, PATTERN)


def ids(encoder, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]


ODD = [
    "", " ", "  ", "a", "  a  b ", "\n\n\t x", "漢字かな交じり文です。" * 30, "a" * 700, " " * 1000, "é‍👩‍👩‍👧 ok\x00z", "I'll we've 'S 'd",
    "http://" + "abc/def?x=1&" * 100, "<|endoftext|> <|im_start|>", "ÿ" * 70, "the" * 400, "İstanbul ﬁ Å ٣٤ ½ ²", "\x1c\x1d a\x85b​ c　d",
    "퟿�", "ab" * 333 + "a", "\r\n \r\n\n  \n x", "1234567890" * 40,
]


def test_odd_texts(encoder, library):
    assert ids(encoder, ODD) == [library.encode_ordinary(t) for t in ODD]


def test_every_kind_of_character(encoder, library):
    points = [c for c in [*range(0x3400), *range(0x3400, 0x110000, 37)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)} " for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert ids(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_random_texts(encoder, library):
    pick = random.Random(5)
    texts = ["".join(pick.choice("the ing añü\n漢.,  ab'9\t") for _ in range(pick.randrange(300))) for _ in range(300)]
    texts += [bytes(pick.randrange(33, 127) for _ in range(2000)).decode() for _ in range(20)]
    assert ids(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def greedy(ranks, piece):
    """The definition: the pair with the least rank first, the leftmost of equals."""
    tokens = [bytes([b]) for b in piece]
    while piece not in ranks and len(tokens) > 1:
        best = min(range(len(tokens) - 1), key=lambda i: (ranks.get(tokens[i] + tokens[i + 1], 1 << 60), i))
        if tokens[best] + tokens[best + 1] not in ranks:
            break
        tokens[best : best + 2] = [tokens[best] + tokens[best + 1]]
    return [ranks[piece]] if piece in ranks else [ranks[t] for t in tokens]


@pytest.mark.parametrize("seed", range(6))
def test_vocabularies_whose_ranks_are_out_of_order(seed):
    # Longer tokens may come before their parts here, so that a merge opens one of an earlier rank.
    pick = random.Random(seed)
    tokens = list({bytes(pick.choice(b"abc") for _ in range(pick.randrange(2, 6))) for _ in range(60)})
    pick.shuffle(tokens)
    ranks = {t: r for r, t in enumerate([bytes([b]) for b in range(256)] + tokens)}
    pieces = [bytes(pick.choice(b"abcd") for _ in range(pick.randrange(1, 40))) for _ in range(400)]
    got = [np.frombuffer(b, "<u4").tolist() for b in MergeReplay(ranks).encode(pieces)]
    assert got == [greedy(ranks, p) for p in pieces]


def test_small_batches_and_cache_do_not_matter(ranks, library, monkeypatch):
    for name, value in (("_REPLAY_BYTES", 40), ("_CACHED_PIECES", 20)):
        monkeypatch.setattr(byte_bpe, name, value)
    fresh = Encoder(ranks, PATTERN)
    texts = [prose(i, 40) + " zqxj%d" % i for i in range(10)]
    assert [ids(fresh, [t])[0] for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_round_trip_of_a_table(spark, library):
    docs = documents(spark)
    coded = encode(docs.drop("ids"), keep=["doc_id", "source"])
    rows = {(r.doc_id, r.source): r.ids for r in coded.collect()}
    for r in docs.collect():
        assert rows[r.doc_id, r.source] == (None if r.text is None else library.encode_ordinary(r.text))
    back = decode(coded, keep=["doc_id", "source"]).collect()
    assert coded.count() == len(back) == docs.count()
    assert {(r.doc_id, r.source): r.decoded and r.decoded.decode() for r in back} == {
        (r.doc_id, r.source): r.text and r.text for r in docs.collect() if True
    } | {(r.doc_id, r.source): b"" for r in docs.collect() if r.text == ""}
    assert encode(docs.limit(0), ids_col="tokens").count() == 0 and decode(coded.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode(docs, keep=["doc_id", "ids"])


def test_decoding_odd_ids(spark):
    rows = [(1, [0, 1]), (2, [99_999]), (3, None), (4, []), (5, [50_255]), (6, [1, None])]
    coded = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.decoded for r in decode(coded).collect()}
    assert got[1] == b'!"' and got[2] is got[3] is got[6] is None and got[4] == b"" and got[5]


def test_packed_ids_and_small_corpora(spark, library, monkeypatch):
    docs = documents(spark)
    for name, value in (("_BATCH_CHARS", 100), ("_CORPUS_CHARS", 300), ("_OUT_ROWS", 2)):
        monkeypatch.setattr(byte_bpe, name, value)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(byte_bpe)  # so that the tasks see the small sizes
    try:
        got = encode(docs, keep=["doc_id", "source", "text"], packed_col="packed").collect()
    finally:
        cloudpickle.unregister_pickle_by_value(byte_bpe)
    assert len(got) == docs.count()
    for r in got:
        wanted = None if r.text is None else library.encode_ordinary(r.text)
        assert r.ids == wanted and r.packed == (None if wanted is None else np.array(wanted, "<u4").tobytes())


def test_digests_of_the_query(spark, tmp_path, library):
    from defectflow.llm.catalog import QUERIES

    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_byte_bpe"](spark, str(tmp_path)).collect()
    wanted = []
    for r in docs.collect():
        found = library.encode_ordinary(r.text or "")
        digest = hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()
        wanted.append((r.doc_id, len(found), digest, hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in got)
