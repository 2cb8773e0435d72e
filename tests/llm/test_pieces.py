"""SentencePiece encoding against the library: ids, bytes that pieces come from, decoding; other character maps too."""

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from sievekit.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a  b", "  a b  ", "Hello world", "Über 漢字 'tis   end", "▁x▁▁ y", "<s> </s> <0x0A>", "\n\t x\r\n", "a\u0000b", "x" * 3000, "１２３ ﾊﾟ ㌀ ﬁne", "é ö", "👩‍👩‍👧 🙂", "　a　", "   ", "a ▁b", "▁", " ▁ ", "ｶﾞ"]


def texts(n=600, seed=1):
    r = random.Random(seed)
    return ODD + ["".join(r.choice("ab cé漢字 ﾊﾟ▁\n🙂１㌀é \xa0　") for _ in range(r.randrange(30))) for _ in range(n)]


def raw_model():
    with open(PATH, "rb") as f:
        return f.read()


def size(n):
    return (bytes([n & 127 | 128]) + size(n >> 7)) if n > 127 else bytes([n])


def with_map(rule, prefix, extra):
    """The model with another normalisation."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = next(v for k, v, _ in pieces.fields(library.serialized_model_proto()) if k == 3)
    table = dict((k, v) for k, v, _ in pieces.fields(spec))[2]
    own = b"\x0a\x01x\x12" + size(len(table)) + table + bytes([0x18, prefix, 0x20, extra, 0x28, 1])
    return b"".join(o for k, _, o in pieces.fields(raw_model()) if k != 3) + b"\x1a" + size(len(own)) + own


def compare(raw, some, whole=False):
    model = pieces.Model(raw)
    if whole:
        model.parted = False
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    encoded = [t.encode() for t in some]
    ids, low, high, rows = pieces._encode_rows(model, pieces._Known(model), np.frombuffer(b"".join(encoded), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64))
    for k, text in enumerate(some):
        own = slice(rows[k], rows[k + 1])
        told = library.encode(text, return_type="proto").pieces
        assert list(zip(ids[own].tolist(), low[own].tolist(), high[own].tolist())) == [(p.id, p.begin, p.end) for p in told], text


def test_ids_and_source_bytes():
    compare(raw_model(), texts())
    compare(raw_model(), texts(100), whole=True)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("extra", [0, 1])
def test_character_maps(rule, prefix, extra):
    compare(with_map(rule, prefix, extra), texts(400))


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    model = pieces.Model(raw_model())
    known = pieces._Known(model)
    for k in range(6):
        some = [f"▁w{k}x{i}".encode() for i in range(40)]
        number = known.look(some)
        assert len(known.of) <= 80
        for n, s in zip(number, some):
            end = np.cumsum(known.counts)[n]
            assert known.ids[end - known.counts[n] : end].tolist() == model.encoder().encode(s.decode())


def test_round_trip(spark, odd, odd_rows, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = sorted(odd_rows, key=repr)
    got = pieces.decode(pieces.encode(odd, PATH), PATH).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == sorted((str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, *_ in rows)
    for r in got:
        assert all(0 <= a <= b for a, b in zip(r["starts"], r["ends"])) and r["starts"] == sorted(r["starts"])
    assert pieces.encode(none, PATH).collect() == [] and pieces.digests(none, PATH).collect() == []


def test_decoding_of_any_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(2)
    lists = [[], [0], [1, 2], [3], [230, 191], [28705], [28705, 28705], [1, 28705, 315]] + [[r.randrange(32000) for _ in range(r.randrange(1, 9))] for _ in range(300)] + [[r.randrange(3, 259) for _ in range(r.randrange(1, 5))] for _ in range(100)]
    got = pieces.decode(spark.createDataFrame([(k, x) for k, x in enumerate(lists)] + [(9999, None)], "k long, ids array<int>"), PATH)
    assert {x["k"]: x["decoded"] for x in got.collect()} == {k: library.decode(x) for k, x in enumerate(lists)} | {9999: ""}
    with pytest.raises(Exception, match="vocabulary"):
        pieces.decode(spark.createDataFrame([([32000],)], "ids array<int>"), PATH).collect()


def test_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    some = texts(50)
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.digests(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), PATH).collect()}
    for k, text in enumerate(some):
        ids = library.encode(text)
        assert got[k] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
