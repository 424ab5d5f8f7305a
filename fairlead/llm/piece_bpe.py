"""SentencePiece BPE ids by a table of last tokens, and text from ids.

A prefix of a text has one last token: token ``t`` that ends there is it if, and only if, the last token of the prefix before
``t`` and ``t`` themselves stay two tokens when both are merged together. So one pass from the left fills a table: an
Aho-Corasick automaton names the tokens that end at a position, the pair test picks the one that holds, and where none of several
characters holds it is the character itself. The ids are then read backwards: the last token, the last token before it, and so
on. The pair test replays the merges of both tokens in the order in which they would happen side by side and looks whether a
merge across the border comes first. Both steps are linear in the text.

Texts are cut where no piece holds both neighbouring characters, as no merge crosses such a place; recent words are remembered in
bounded memory. Models are read as they are: BPE, identity normalisation, dummy prefix, byte fallback. Others are refused.

Null and empty texts have no ids and decode to an empty text. Equal rows stay equal rows; other columns are carried only if asked
for by name, and give way to ``ids`` and ``decoded`` where they have these names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as format_of

from fairlead.llm.common import Recent

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Remembered words and parts of words in each of two generations, longest word remembered, remembered pairs, rows handled at once.
ROOM, LONGEST, PAIRS, ROWS = 100_000, 64, 1 << 18, 256
#: Lengths of common beginnings that are looked for.
ALIKE = (12, 10, 8, 7, 6, 5, 4, 3, 0)
# Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Model:
    """Pieces with scores and kinds by id, as a model file holds them."""

    def __init__(self, data: bytes):
        proto = format_of.ModelProto()
        proto.ParseFromString(data)
        trainer, normal = proto.trainer_spec, proto.normalizer_spec
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        self.digest, self.unknown_text = hashlib.sha256(data).hexdigest(), trainer.unk_surface
        known = {NORMAL, UNKNOWN, CONTROL, BYTE}
        as_is = not normal.precompiled_charsmap and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and normal.escape_whitespaces
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not as_is or {p[2] for p in self.pieces} - known:
            raise ValueError("only BPE models with byte fallback, dummy prefix and identity normalisation are read")


def read_model(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


class Codec:
    """Encoder and decoder of one model, with a bounded memory of words."""

    def __init__(self, model: Model, room: int = ROOM):
        self.rank = {p: -s for p, s, kind in model.pieces if kind == NORMAL}
        ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.packed = {p: np.int32(i).tobytes() for p, i in ids.items()}
        self.found = ahocorasick.Automaton()
        for piece in ids:
            if len(piece) > 1:
                self.found.add_word(piece, (piece, len(piece)))
        self.found.make_automaton()
        self.together = {a + b for p in ids for a, b in zip(p, p[1:])}
        self.apart = not any(a != SPACE and b == SPACE for a, b in self.together)  # words may be encoded one by one
        self.fits = lru_cache(PAIRS)(self._fits)
        self.history = lru_cache(len(ids) + 1)(self._history)
        self.words, self.parts = Recent(self._learn, room), Recent(lambda parts: map(self.ids_of, parts), max(1, room // 8))
        self.surface = [self._surface(p, kind, model.unknown_text) for p, _, kind in model.pieces]
        self.text_of = [b"" if isinstance(s, int) and s > 0x7F else bytes([s]) if isinstance(s, int) else s for s in self.surface]
        self.partial = np.array([isinstance(s, int) and s > 0x7F for s in self.surface])
        self.silent = np.array([kind == CONTROL for _, _, kind in model.pieces])
        self.starts = np.array([kind == NORMAL and p[:1] == SPACE for p, _, kind in model.pieces])

    @staticmethod
    def _surface(piece: str, kind: int, unknown: str) -> bytes | int:
        if kind == BYTE:
            return int(piece[3:5], 16)
        return {CONTROL: "", UNKNOWN: unknown}.get(kind, piece.replace(SPACE, " ")).encode()

    def _history(self, token: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether merging makes the token whole, and its merges in order: rank, leftmost and rightmost symbol before each; at last without rank."""
        symbols, steps = list(token), []
        while True:
            ranks = [self.rank.get(a + b, inf) for a, b in zip(symbols, symbols[1:])]
            best = min(ranks, default=inf)
            steps.append((best, symbols[0], symbols[-1]))
            if best == inf:
                return len(symbols) == 1, steps
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _fits(self, before: str, token: str) -> bool:
        """Whether two tokens side by side stay as they are; of equal ranks the merge on the left comes first."""
        (whole, left), (also, right) = self.history(before), self.history(token)
        if not (whole and also):
            return False
        i = j = 0
        while True:
            rank_left, _, a = left[i]
            rank_right, b, _ = right[j]
            across = self.rank.get(a + b, inf)
            if across < rank_left and across <= rank_right:
                return False
            if rank_left <= rank_right:
                if rank_left == inf:
                    return True
                i += 1
            else:
                j += 1

    def ids_of(self, part: str, last: list[str] | None = None, same: int = 0) -> bytes:
        """The ids of a piece of normalised text, as the bytes of 32-bit numbers.

        ``last`` is the table: the last token of each prefix. It may come from a text with the same first ``same`` characters.
        """
        last = [] if last is None else last
        last[same:] = part[same:]
        fits, done = self.fits, -1
        for end, (token, size) in self.found.iter(part):
            if end >= same and end != done:  # a prefix has one last token
                start = end - size
                if fits(last[start], token) if start >= 0 else self.history(token)[0]:
                    last[end], done = token, end
        out, at, packed = [], len(part) - 1, self.packed
        while at >= 0:
            token = last[at]
            out.append(packed.get(token) or np.array([self.bytes[b] for b in token.encode()], "<i4").tobytes())
            at -= len(token)
        out.reverse()
        return b"".join(out)

    def _cut(self, word: str) -> list[str]:
        """The parts of normalised text that no merge joins."""
        together, cuts = self.together, [0]
        cuts += [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in together]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of words that a space precedes; a word with other signs is looked up part by part."""
        cut = {w: self._cut(SPACE + w) for w in words if not w.isalpha()}
        led = {p[1:] for parts in cut.values() for p in parts if p[0] == SPACE and len(p) <= LONGEST and p[1:].isalpha()}
        young, old = self.words.young, self.words.old
        ids = {w: found for w in led if (found := young.get(w) or old.get(w))}
        table, before = [], ""
        for w in sorted({*led, *words}.difference(cut, ids)):  # neighbours begin alike
            part = SPACE + w
            for same in ALIKE:
                if part[:same] == before[:same]:
                    break
            ids[w], before = self.ids_of(part, table, same), part
        short = {p for parts in cut.values() for p in parts if len(p) <= LONGEST and p[1:] not in led}
        known = self.parts.lookup(short)
        for w, parts in cut.items():
            ids[w] = b"".join([ids[p[1:]] if p[0] == SPACE and p[1:] in led else known(p) if p in short else self.ids_of(p) for p in parts])
        return [ids[w] for w in words]

    def _words(self, text: str) -> list[str]:
        """The words of a text without the space before each."""
        if not text:
            return []
        if not self.apart:
            return [text.replace(" ", SPACE)]
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [run[1:] for run in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        rows = [self._words(t) for t in texts]
        wanted = {w for row in rows for w in row}
        long = {w for w in wanted if len(w) > LONGEST}
        known = self.words.lookup(wanted - long)
        if long:
            found = dict(zip(long, self._learn([*long]), strict=True))
            return [np.frombuffer(b"".join([found[w] if w in found else known(w) for w in row]), "<i4") for row in rows]
        return [np.frombuffer(b"".join(map(known, row)), "<i4") for row in rows]

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces joined, the first one without its leading space, bytes read as UTF-8 (one replacement sign for each byte that is not)."""
        ids = np.asarray(ids, np.int64)
        heard = np.flatnonzero(~self.silent[ids])
        if not self.partial[ids].any():
            out = b"".join(map(self.text_of.__getitem__, ids.tolist())).decode()
        else:
            out, run = "", bytearray()
            parts = []
            for s in map(self.surface.__getitem__, ids.tolist()):
                if isinstance(s, int):
                    run.append(s)
                else:
                    if run:
                        parts.append(_lenient(bytes(run)))
                        run = bytearray()
                    parts.append(s.decode())
            out = "".join([*parts, _lenient(bytes(run))])
        return out[1:] if len(heard) and self.starts[ids[heard[0]]] else out


def _lenient(raw: bytes) -> str:
    out = []
    while raw:
        try:
            return "".join([*out, raw.decode()])
        except UnicodeDecodeError as wrong:
            out += [raw[: wrong.start].decode(), "�"]
            raw = raw[wrong.start + 1 :]
    return "".join(out)


_made: dict[str, Codec] = {}


def _codec(model: Model) -> Codec:
    """One codec for each worker process and model."""
    if model.digest not in _made:
        _made.clear()
        _made[model.digest] = Codec(model)
    return _made[model.digest]


def encode(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), round_trip: bool = False) -> DataFrame:
    """``keep`` columns and ``ids array<int>``, the ids of the whole text in order; with ``round_trip`` also ``decoded string``."""
    made = ["ids", *["decoded"] * round_trip]
    kept = [c for c in keep if c not in made]
    source = docs.select(*[docs[c] for c in kept], docs[text].alias("_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]], "ids array<int>", *["decoded string"] * round_trip])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = codec.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))]
                if round_trip:
                    columns.append(pa.array([codec.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    return source.mapInArrow(body, schema)


def decode(encoded: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """Adds ``decoded string`` in place of a column of that name: the text that the ids stand for (null ids: empty)."""
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    at_ids = [f.name for f in fields].index(ids)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "decoded string"])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = [codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column(at_ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*[f.name for f in fields], "decoded"])

    return encoded.select(*[encoded[f.name] for f in fields]).mapInArrow(body, schema)
