import random

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as format_of

from fairlead.llm import piece_bpe
from tests.llm.helpers import SF, documents, odd_documents

PATH = P.path("piece_bpe_32k.model")
TRUE = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_whole_texts(spark):
    model = piece_bpe.read_model(PATH)
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()) | {i: t for i, t in odd_documents() if i}
    docs = documents(spark, list(texts.items()))
    coded = piece_bpe.encode(docs, model, round_trip=True)
    for r in piece_bpe.decode(coded.withColumnRenamed("decoded", "first"), model).collect():
        ids = TRUE.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["first"] == r["decoded"] == TRUE.decode(ids)
    assert piece_bpe.encode(docs.limit(0), model).count() == 0


def test_clashing_names_and_repeated_rows(spark):
    model = piece_bpe.read_model(PATH)
    rows = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, None, None, None)], "doc_id long, text string, ids string, decoded string")
    out = piece_bpe.encode(rows, model, keep=("doc_id", "ids", "text"), round_trip=True)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in out.collect()) == [(0, [], ""), *[(1, TRUE.encode("a b"), "a b")] * 2]
    empty = spark.createDataFrame([(None,)], "ids array<int>")
    assert piece_bpe.decode(empty, model).first()["decoded"] == ""


def test_odd_characters_and_a_small_memory():
    codec, rng = piece_bpe.Codec(piece_bpe.read_model(PATH), room=50), random.Random(2)
    signs = [*"abcdethin sr  \n\t  é漢'sS1\x1c\x85\xa0 ć\r—😀▁²..\x00", "the", "ing", " return", "   ", "<s>", "<0x0A>", "word" * 30]
    for _ in range(4000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 14)))
        ids = codec.encode([text])[0].tolist()
        assert ids == TRUE.encode(text) and codec.decode(ids) == TRUE.decode(ids), repr(text)
    for n in range(60):
        for text in (" " * n, " " * n + "the", "x" + " " * n + "y", "a" * n, "ab" * n):
            assert codec.encode([text])[0].tolist() == TRUE.encode(text), repr(text)


def test_any_ids_are_read():
    codec, rng = piece_bpe.Codec(piece_bpe.read_model(PATH)), random.Random(3)
    for _ in range(3000):
        ids = [rng.randrange(300 if rng.random() < 0.6 else 32_000) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == TRUE.decode(ids), ids


def _own_model(pieces):
    """A model of a few pieces with scores, ties and orders that training would not give."""
    proto = format_of.ModelProto()
    proto.pieces.add(piece="<unk>", score=0, type=2)
    for b in range(256):
        proto.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for piece, score in pieces:
        proto.pieces.add(piece=piece, score=score, type=1)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.vocab_size = 2, True, len(proto.pieces)
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    return proto


def test_unruly_scores():
    rng = random.Random(5)
    for _ in range(60):
        made = {"".join(rng.choices("ab▁c", k=rng.randint(1, 5))) for _ in range(25)} | {"▁", "a"}
        proto = _own_model([(p, float(-rng.randint(1, 8))) for p in sorted(made)])
        codec = piece_bpe.Codec(piece_bpe.Model(proto.SerializeToString()))
        true = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        for _ in range(120):
            text = "".join(rng.choices("abc d", k=rng.randint(0, 12)))
            assert codec.encode([text])[0].tolist() == true.encode(text), (sorted(made), text)


def test_other_models_are_refused():
    proto = _own_model([("a", -1.0)])
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        piece_bpe.Model(proto.SerializeToString())
