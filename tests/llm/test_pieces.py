import random
import struct

import pytest
import sentencepiece

from briarlake.llm.pieces import LONG_UNIT, MODEL, SPACE, Encoder, Pieces, _Collision, decode_documents, encode_documents
from briarlake.llm.queries import op5_sentencepiece
from tests.llm import brute

ODD = ["", " ", "  ", " a  b   c\n\n d ", "▁x", "你好😀 <s> <0x0A> </s>", "a" * 500, "=====----- ////", "x" * 50 + " " * 37 + "y", "\t\r\n  {\n    return 0;\n}", "naïve café 1234567 3.14e-10 www.example.com/i.html?a=b&x=1", "\x00\x7f", "é ﬁ", "été.Été,ÉTÉ"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL)


def split(encoder, texts):
    flat, sizes = encoder.encode(texts)
    out, at = [], 0
    for n in sizes:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_same_ids_as_the_library(pieces):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("abcdeéß  \n.,-#1ABtheing▁") for _ in range(draw.randrange(80))) for _ in range(2000)]
    got = split(Encoder(pieces), texts)
    assert got == library.encode(texts)
    assert [pieces.decode(x) for x in got] == [library.decode(x) for x in got]
    assert all(pieces.decode(x) == t for x, t in zip(got, texts) if SPACE not in t)


def test_paths_equal_the_merges(pieces):
    draw = random.Random(2)
    for _ in range(300):
        unit = SPACE + "".join(draw.choice("aeiou the ing stion".replace(" ", "")) for _ in range(draw.randrange(1, 30)))
        order, flat, _ = pieces.encode_units([unit])
        assert [pieces.pieces[k] for k in flat] == pieces.merges(unit)[0]


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model(tmp_path):
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), (SPACE, -3.0, 1), ("a", -2.0, 1), ("b", -2.1, 1), ("c", -2.3, 1), ("ab", -2.9, 1), ("bc", -3.1, 1), ("abc", -5.1, 1), (SPACE + "a", -3.3, 1), ("ca", -3.7, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in listed)
    data += field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    (tmp_path / "m.model").write_bytes(data)
    mine, library = Pieces(str(tmp_path / "m.model")), sentencepiece.SentencePieceProcessor(model_proto=data)
    draw = random.Random(4)
    texts = ["".join(draw.choice("abc ") for _ in range(draw.randrange(1, 30))) for _ in range(300)]
    score = lambda ids: sum(listed[k][1] for k in ids)
    for a, b in zip(split(Encoder(mine), texts), library.encode(texts)):
        assert score(a) == pytest.approx(score(b))


def test_table(spark):
    docs = spark.createDataFrame([(1, "Hello world", 5), (1, "Hello world", 5), (None, None, 5), (2, "", 5), (3, "w " * 100_000, 5)], "doc_id long, text string, ids int")
    got = encode_documents(docs)
    rows = {(r.doc_id, r.n_tokens): r for r in got.collect()}
    assert rows[None, 0].ids is None and rows[2, 0].ids == [] and all(r.restored for r in rows.values())
    back = {(r.doc_id, r.text) for r in decode_documents(got).collect()}
    assert back == {(r.doc_id, r.text) for r in docs.collect()}
    assert encode_documents(docs.limit(0)).count() == 0


def test_query_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect()}
    for r in op5_sentencepiece(spark, brute.SMALL).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.restored


def test_units_whose_hashes_collide_go_the_plain_way(pieces, monkeypatch):
    texts = ["the nation of stations", "one two three", "the the"]
    want = split(Encoder(pieces), texts)
    whole, failed = type(pieces)._lattice, []

    def lattice(self, units):
        if any("nation" in u for u in units):
            failed.append(len(units))
            raise _Collision
        return whole(self, units)

    monkeypatch.setattr(type(pieces), "_lattice", lattice)
    assert split(Encoder(pieces), texts) == want and 1 in failed


def test_few_units_leave_the_lattice(pieces, spark):
    units = {u for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect() for u in pieces.units(r.text)}
    assert sum(len(u) > LONG_UNIT or SPACE * 2 in u for u in units) < 0.001 * len(units)


def test_decoding_in_batches(spark):
    pieces = Pieces(MODEL)
    some = [len(pieces.ids) // 2, 7, len(pieces.ids) - 1]
    rows = [(1, some), (2, None), (3, []), (4, [some[0], None, some[2]]), (5, [None]), (6, some[:1] * 5000), (None, some)]
    got = {r.doc_id: r.text for r in decode_documents(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {k: None if ids is None else pieces.decode([x for x in ids if x is not None]) for k, ids in rows}
    assert decode_documents(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0
