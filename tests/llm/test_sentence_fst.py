import itertools
import random
import struct

import numpy as np
import pytest
import sentencepiece

from tests.llm.cases import awkward, frame, prose
from verdikt.llm import sentence_fst as s


@pytest.fixture(scope="module")
def both():
    with open(s.MODEL, "rb") as f:
        return s.Transducer(f.read()), sentencepiece.SentencePieceProcessor(model_file=s.MODEL)


def ids(x):
    return np.frombuffer(x, "<i4").tolist()


def test_documents_encode_like_the_library(both, spark):
    t, lib = both
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [r[1] or "" for r in awkward()]
    for x, want in zip(texts, lib.encode(texts)):
        assert ids(t.encode(x)) == want
        assert SPACE_FREE(t.decode(t.encode(x))) == SPACE_FREE(x)


def SPACE_FREE(x):
    return x.replace(s.SPACE, " ")


def test_random_strings_encode_like_the_library(both):
    t, lib = both
    r = random.Random(2)
    for _ in range(3000):
        x = "".join(r.choice(["a", "b", " ", "  ", "the", "ing", "\n", "é", "日", "\U0001f600", ".", "▁", "\t", "ll"]) for _ in range(r.randrange(1, 30)))
        assert ids(t.encode(x)) == lib.encode(x), x
        assert t.decode(t.encode(x)) == lib.decode(lib.encode(x))


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def unigram_model(pieces, bytes_too):
    """A small hand-written unigram model."""
    kinds = [("<unk>", 0.0, s.UNKNOWN), ("<s>", 0.0, s.CONTROL), ("</s>", 0.0, s.CONTROL)]
    if bytes_too:
        kinds += [(f"<0x{b:02X}>", 0.0, s.BYTE) for b in range(256)]
    kinds += [(p, w, s.NORMAL) for p, w in pieces.items()]
    out = b""
    for p, w, k in kinds:
        out += message(1, message(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", w) + varint(3 << 3) + varint(k))
    trainer = varint(3 << 3) + varint(s.UNIGRAM) + (varint(35 << 3) + varint(1) if bytes_too else b"")
    return out + message(2, trainer) + message(3, message(1, b"identity") + b"".join(varint(k << 3) + varint(v) for k, v in ((3, 1), (4, 0), (5, 1))))


PIECES = {"▁": -2.0, "a": -3.1, "b": -3.3, "c": -4.7, "▁a": -2.9, "ab": -3.9, "bc": -5.2, "abc": -6.05, "▁ab": -4.15, "ca": -5.9, "aa": -4.4}


@pytest.mark.parametrize("bytes_too", [True, False])
def test_unigram_path_is_the_lightest(bytes_too):
    model = unigram_model(PIECES, bytes_too)
    t = s.Transducer(model)
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    for n in range(1, 7):
        for x in map("".join, itertools.product("abc ", repeat=n)):
            assert ids(t.encode(x)) == lib.encode(x), x
    # Against all segmentations.
    def best(u):
        return min((sum(-PIECES[p] for p in cut) for cut in cuts(u)), default=None)

    def cuts(u):
        if not u:
            yield []
        for k in range(1, len(u) + 1):
            if u[:k] in PIECES:
                yield from ([u[:k], *rest] for rest in cuts(u[k:]))

    for u in ("▁abcab", "▁aabca", "▁caab▁"):
        assert sum(-PIECES[t.text[i]] for i in t.shortest(u)) == pytest.approx(best(u))
    assert ids(t.encode("aéb")) == lib.encode("aéb")


def test_columns_round_trip_in_spark(spark, both):
    rows = awkward()
    df = frame(spark, rows, extra=True).withColumn("ids", s.encode_udf(spark)("text"))
    for r in df.withColumn("back", s.decode_udf(spark)("ids")).collect():
        assert r["ids"] == both[1].encode(r["text"] or "")
        assert r["back"] == SPACE_FREE(r["text"] or "")


def test_query_and_small_caches(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in s.op6(spark, d).collect()}
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert rows.keys() == texts.keys() and all(r["round_trip"] for r in rows.values())
    with open(s.MODEL, "rb") as f:
        t = s.Transducer(f.read())
    monkeypatch.setattr(s, "REMEMBER", 5)
    x = prose(200, 8)
    assert t.encode(x) == s.Transducer(open(s.MODEL, "rb").read()).encode(x)


def test_character_maps_are_refused():
    with pytest.raises(NotImplementedError):
        s.Transducer(message(3, message(2, b"\x01")))
