import base64
import random

import duckdb
import public_tokenizers as P
import tiktoken

from fairlead.llm import byte_bpe
from tests.llm.helpers import SF, documents, odd_documents

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_whole_texts(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()) | {i: t for i, t in odd_documents() if i}
    docs = documents(spark, list(texts.items()))
    for r in byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH).collect():
        assert r["ids"] == TRUE.encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    both = byte_bpe.encode(docs, PATH, P.PATTERN, keep=("doc_id", "score"), round_trip=True).collect()
    assert all(bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode() and r["score"] == "score" for r in both)
    assert byte_bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_every_piece_is_reached_by_merging():
    codec = byte_bpe.Codec(byte_bpe.read_ranks(PATH), P.PATTERN)
    written = ["".join(codec.table[b] for b in p) for p in codec.pieces]
    assert [x[0] - 1 for x in codec.model.encode(written, out_type=int)] == list(range(len(codec.pieces)))


def test_odd_characters_and_a_small_memory():
    codec, rng = byte_bpe.Codec(byte_bpe.read_ranks(PATH), P.PATTERN, room=50), random.Random(2)
    signs = list("ab  \n\t  é漢'sS1\x1c\x85\xa0\u2003ć\r—😀\u2581<|endoftext|>")
    for _ in range(4000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 14)))
        assert codec.encode(text).tolist() == TRUE.encode_ordinary(text), repr(text)


def test_vocabularies_that_differ_inside_have_their_own_codec():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"cd", b"ef"]
    other = [*pieces[:257], b"bc", pieces[258]]
    assert byte_bpe._codec(pieces, P.PATTERN) is not byte_bpe._codec(other, P.PATTERN)
    assert byte_bpe._codec(pieces, P.PATTERN) is byte_bpe._codec([*pieces], P.PATTERN)


def test_kept_columns_give_way(spark):
    rows = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, ids string, decoded string")
    assert byte_bpe.encode(rows, PATH, P.PATTERN, keep=("doc_id", "ids", "decoded"), round_trip=True).columns == ["doc_id", "ids", "decoded"]
