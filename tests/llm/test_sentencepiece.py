import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from finscan.llm import sentencepiece_bpe as S

TEXTS = ["", " ", "a  b", "   lead", "trail  ", "\n\n", "日本語 テスト 🙂", "<s> </s> <unk>", "a\tb", "é" * 3, "the " * 50_000, "x" * 200_000]


@pytest.fixture(scope="module")
def model():
    with open(S.MODEL, "rb") as f:
        return f.read()


def test_parity_and_round_trip(spark, model):
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate([*TEXTS, None, TEXTS[2], TEXTS[2]])], "doc_id long, text string, parity string, n_tokens int")
    got = {r.doc_id: r for r in S.encode(df, prefix="sp_", decode=True, verify=True).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].sp_parity and got[i].sp_decoded == t and got[i].sp_n_tokens == len(got[i].sp_token_ids) and got[i].parity == "clash"
    none = got[len(TEXTS)]
    assert none.sp_token_ids is None and none.sp_n_tokens is None and none.sp_decoded is None and none.sp_parity is None
    assert got[0].sp_token_ids == []
    back = S.decode(S.encode(df.select("doc_id", "text"))).collect()
    assert all(r.decoded == r.text for r in back)
    assert S.encode(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="▁\x00"), max_size=40), min_size=1, max_size=5))
def test_any_text_has_the_library_s_ids(model, texts):
    codec = S._codec(model, 1)
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = codec.encode(texts)
    assert ids == [own.encode(t) for t in texts]
    assert codec.decode(ids) == texts


def test_long_texts_in_parts_are_as_in_one_go(model):
    codec = S._codec(model, 1)
    text = "Some words, and  two spaces; " * 9000
    assert len(codec._parts(codec.normalise(text))) > 1
    assert codec.encode([text])[0] == sentencepiece.SentencePieceProcessor(model_proto=model).encode(text)


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("▁a", -2.5, 1), ("ab", -2.2, 1), ("▁ab", -4.0, 1), ("c", -5.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    return data + field(2, field(3, 1) + field(35, 1) + field(40, 0)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


def test_unigram_models(spark):
    data = unigram()
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = S.Codec(S.Model(data), 1)
    for t in ("ab", "a b", "abab cab", "", "  b", "aab"):
        assert codec.encode([t])[0] == own.encode(t), t
        assert codec.decode(codec.encode([t]))[0] == t
    with pytest.raises(ValueError):
        S.Model(field(1, field(1, b"x")) + field(2, field(3, 3)))


def test_decoding_is_that_of_the_pipelines_decoder(spark):
    """The byte table against the decoder that is built beside the encoder, and against the SentencePiece library."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "  a", "é\U0001f600x", "a\tb\n\nc", "ﬁ", "\x00", "a" * 50_000]
    with open(S.MODEL, "rb") as f:
        data = f.read()
    codec = S._codec(data, 2)
    ids = codec.encode(texts)
    back = codec.decode(ids)
    assert all(codec.decoded_alike(ids, back)) and back == S._own(data).decode(ids)
