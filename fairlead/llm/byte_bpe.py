"""Byte-level BPE on the sentencepiece library, from a rank file alone.

The rank file is turned into a sentencepiece BPE model without training: each byte becomes one character, each piece scores
minus its rank, and normalisation is the identity. Merging by best score is then merging by lowest rank. Every match of the
pre-token pattern is encoded separately; decoding maps ids back to bytes.

Null texts count as empty and have no ids. Equal rows stay equal rows; other columns are carried only if asked for by name,
and give way to ``ids`` and ``decoded`` where they have these names.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from fairlead.llm.common import Recent

#: Byte b is written as the character BASE + b; no such character is white space or sentencepiece's own mark.
BASE = 0x100
#: Unicode White_Space, as the tokenizer's pattern language understands ``\s``.
SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Remembered chunks in each of two generations, and rows handled at once.
ROOM, ROWS = 100_000, 256


def read_ranks(path: str) -> list[bytes]:
    """Byte pieces of a rank file in rank order; ranks must be 0, 1, 2, ..."""
    ranked = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                piece, rank = line.split()
                ranked[int(rank)] = base64.b64decode(piece)
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranked) - 1}")
    return [ranked[i] for i in range(len(ranked))]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out + bytes([value]))


def _chunk(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _written(piece: bytes) -> str:
    return "".join(chr(BASE + b) for b in piece)


def model_bytes(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece model: unknown piece first, then the pieces; piece i has id i + 1."""
    unknown, normal, bpe = 2, 1, 2  # fixed values of the model format
    rows = [_chunk(1, _chunk(1, b"<unk>") + struct.pack("<Bf", 0x15, 0.0) + _number(3, unknown))]
    rows += [_chunk(1, _chunk(1, _written(p).encode()) + struct.pack("<Bf", 0x15, -float(i)) + _number(3, normal)) for i, p in enumerate(pieces)]
    trainer = _number(3, bpe) + _number(4, len(pieces) + 1)
    as_is = _chunk(1, b"identity") + b"".join(_number(flag, 0) for flag in (3, 4, 5))  # no dummy prefix, no white space changes
    return b"".join(rows) + _chunk(2, trainer) + _chunk(3, as_is)


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded memory of chunks already encoded.

    A chunk is white space followed by other characters. No match of the pattern runs from other characters into white space,
    so a text may be cut before each run of white space without changing its ids.
    """

    def __init__(self, pieces: list[bytes], pattern: str, room: int = ROOM):
        self.pieces, self.recent = pieces, Recent(self._learn, room)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(pieces))
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.run = regex.compile(f"[{SPACE}][{SPACE}]")
        self.cut = regex.compile(f"[{SPACE}]+[^{SPACE}]*|[^{SPACE}]+")
        self.whole = {p: i for i, p in enumerate(pieces)}
        self.table = [chr(BASE + b) for b in range(256)]

    def _chunks(self, text: str) -> list[str]:
        if self.run.search(text):
            return self.cut.findall(text)
        parts = text.replace("\n", " \n").split(" ")
        return [parts[0], *[p if p[:1] == "\n" else " " + p for p in parts[1:]]]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as the bytes of 32-bit numbers."""
        tokens = [self.pattern.findall(c) for c in chunks]
        wanted = list({t: None for row in tokens for t in row})
        raw = [t.encode() for t in wanted]
        split = [i for i, b in enumerate(raw) if b not in self.whole]
        ids = [struct.pack("<i", self.whole.get(b, -1)) for b in raw]
        mapped = ["".join([self.table[x] for x in raw[i]]) for i in split]
        for i, found in zip(split, self.model.encode(mapped, out_type=int, num_threads=1) if mapped else [], strict=True):
            ids[i] = (np.array(found, "<i4") - 1).tobytes()
        each = dict(zip(wanted, ids, strict=True))
        return [b"".join([each[t] for t in row]) for row in tokens]

    def encode(self, text: str) -> np.ndarray:
        chunks = self._chunks(text) if text else []
        return np.frombuffer(b"".join(map(self.recent.lookup(chunks), chunks)), "<i4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_made: dict[int, Codec] = {}


def _codec(pieces: list[bytes], pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = hash((tuple(pieces), pattern))
    if key not in _made:
        _made[key] = Codec(pieces, pattern)
    return _made[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), round_trip: bool = False) -> DataFrame:
    """``keep`` columns and ``ids array<int>``, the ids of the whole text in order; with ``round_trip`` also ``decoded binary``."""
    pieces = read_ranks(rank_file)
    keep = tuple(c for c in keep if c not in ("ids", *["decoded"] * round_trip))
    source = docs.select(*keep, docs[text].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", ids array<int>" + ", decoded binary" * round_trip

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(pieces, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [codec.encode(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))]
                if round_trip:
                    columns.append(pa.array([codec.decode(x.tolist()) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", *["decoded"] * round_trip])

    return source.mapInArrow(body, schema)


def decode(encoded: DataFrame, rank_file: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded binary``: the bytes that the ids stand for (null ids: empty)."""
    pieces = read_ranks(rank_file)
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    source = encoded.select(*[f.name for f in fields])
    at_ids = [f.name for f in fields].index(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded binary"

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                column = part.column(at_ids)
                values, offsets = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_pylist()
                decoded = [b"".join(map(piece, values[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*[f.name for f in fields], "decoded"])

    return source.mapInArrow(body, schema)
