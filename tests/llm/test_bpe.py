import base64
import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatvitals.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODER, DECODER = bpe.Encoder(PATH, P.PATTERN), bpe.Decoder(PATH)


def same(tik, text):
    packed = ENCODER.packed(text)
    assert packed == array("I", tik.encode_ordinary(text)).tobytes()
    assert DECODER.text(packed) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    import tiktoken

    global _TIK
    if "_TIK" not in globals():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
        _TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    same(_TIK, text)


def test_long_and_odd_texts(tik):
    rnd = random.Random(1)
    for text in ["", "  a  b\n\n c \t\r\n x", "a" * 20000, "ab1é" * 9000, "-=-" * 7000, "あい" * 6000, "'s't don't　full　x", "\x1c a\x85b\xa0 c", "1234567 89", "👨‍👩‍👧 x", "".join(rnd.choice("abc '\n\t-_!1é") for _ in range(5000))]:
        same(tik, text)


def test_neighbours_agree_with_merging():
    m, rnd = ENCODER.machine, random.Random(2)
    ids = list(m.tokens)
    for _ in range(3000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        if m._spines(m.tokens[a]) and m._spines(m.tokens[b]):
            assert m._apart(a, b) == (m.merged(m.tokens[a] + m.tokens[b]) == [a, b])


@given(st.binary(max_size=40), st.integers(1, 7))
def test_stream_decodes_as_python_does(data, step):
    s = bpe.Utf8Stream()
    out = "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.end()
    assert out == data.decode("utf-8", "replace")


def test_operator(spark):
    rows = [(1, None, 7), (2, "", 8), (2, "hello  wörld", 9), (2, "hello  wörld", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, text="decoded").collect()
    assert sorted(r["decoded"] for r in out) == ["", "", "hello  wörld", "hello  wörld"]
    assert bpe.encode(df.filter("false"), PATH, P.PATTERN).count() == 0


def test_query(spark, sf, tik):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op1(spark, sf).collect():
        ids = array("I", tik.encode_ordinary(docs[r["doc_id"]]))
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
