"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

``pieces`` turns each document into ids, ends it with one end id, and cuts only what is longer than a sequence. ``pack`` places the
pieces. They are dealt at random into blocks of bounded size; every block is solved by several islands. An island's genome is
a packing, its genes are whole bins: crossover injects the well-filled bins of one parent into the other, removes the bins that
repeat an injected piece, and best-fits the displaced pieces. Between rounds each island sends its elite packing to its
neighbour; the best packing of a block's islands is the answer. A block is one group of bounded size, so any number of blocks
runs in parallel and no group depends on the size of the corpus.

Null and empty texts are documents of one end id. Documents that share an id are told apart by their order of text, so every row is packed.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fairlead.llm.common import Recent, cut_lineage, held, only

#: Remembered words in each of two generations.
ROOM = 200_000
#: Pieces in a block on average, islands for a block, packings on an island, rounds between which elites move, crossings in a round.
BLOCK, ISLANDS, HERD, ROUNDS, CROSSINGS = 4096, 2, 8, 2, 32
LENGTH, END_ID = 2048, 0


def byte_letters() -> list[str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, the others in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Words:
    """Ids of texts word by word, with a bounded memory of words.

    The tokenizer's matches hold no white space, so ids of a text are those of its parts between spaces and line ends. Parts of
    Latin letters and signs, which its normalisation only lower-cases, go straight to its merge model; all others through all of it.
    Texts are first cut at the file's added tokens (``<|endoftext|>``), as the tokenizer does before it normalises; where one of them
    has rules of its own (a normalised spelling, white space beside it), every text goes whole through the tokenizer.
    """

    #: The tokenizer's matches, the same for lower-case ASCII, and what only lower-casing changes.
    MATCHES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    ASCII_MATCHES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
    PLAIN = regex.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]*")
    #: A stop or comma between a letter or digit and white space is a match of its own.
    STOPS = re.compile(r"([.,])(?=[ \n])(?<=[0-9A-Za-z\u00df-\u00f6\u00f8-\u00ff][.,])")

    def __init__(self, spec: str, room: int = ROOM):
        self.tokenizer = Tokenizer.from_str(spec)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], "<u4") for i, t in added.items()}
        self.cuts = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if added else None
        self.plain = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.merged = Recent(self._merge, room)
        self.recent = Recent(self._learn, room)

    def _merge(self, matches: list[str]) -> list[bytes]:
        written = [m if m.isascii() and m.isprintable() else "".join([self.letters[b] for b in m.encode()]) for m in matches]
        return [array("I", [t.id for t in self.model.tokenize(w)]).tobytes() for w in written]

    def _matches(self, word: str) -> list[str] | None:
        """The tokenizer's matches in a word, None for words that its normalisation may change further."""
        if word.isascii():
            word = word.lower()
            return [word] if word.isalpha() else self.ASCII_MATCHES.findall(word)
        if not self.PLAIN.fullmatch(word):
            return None
        word = word.lower()
        return [word] if word.isalpha() else self.MATCHES.findall(word)

    def _learn(self, words: list[str]) -> list[bytes]:
        plain = [self._matches(w) for w in words]
        ids = self.merged.lookup([m for row in plain if row for m in row])
        whole = lambda w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(w) if row is None else ids(row[0]) if len(row) == 1 else b"".join([ids(m) for m in row]) for w, row in zip(words, plain, strict=True)]

    def ids(self, text: str) -> np.ndarray:
        if not self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if self.cuts and self.cuts.search(text):
            return np.concatenate([self.added[part] if n % 2 else self._ids(part) for n, part in enumerate(self.cuts.split(text))])
        return self._ids(text)

    def _ids(self, text: str) -> np.ndarray:
        if text.isascii():
            text = text.lower()
        words = self.STOPS.sub(r" \1", text).replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self.recent.lookup(words), words)), "<u4")


def pieces(docs: DataFrame, tokenizer_file: str, text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces."""
    with open(tokenizer_file, encoding="utf-8") as file:
        spec = file.read()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held("packing words", hash(spec), lambda: Words(spec))
        for batch in batches:
            ids, rows = batch.column(0), []
            for at, value in enumerate(batch.column(1)):
                tokens = np.append(words.ids(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                rows += [(at, n, s, len(part), zlib.crc32(part.tobytes())) for n, s in enumerate(range(0, len(tokens), length)) for part in [tokens[s : s + length]]]
            at, n, s, size, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(s, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(body, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, order: np.ndarray, length: int, bins: list[list[int]], room: list[int]) -> None:
    """Put the items of ``order`` one by one into the open bin that they fill best; opens bins as needed."""
    for item, b in zip(order.tolist(), fitted(sizes[order].tolist(), length, room), strict=True):
        if b == len(bins):
            bins.append([])
            room.append(length)
        bins[b].append(item)
        room[b] -= int(sizes[item])


def labels_of(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def fitted(sizes: list[int], length: int, room: list[int]) -> list[int]:
    """The bin of each item, put one by one into the open bin that it fills best; ``room`` is that of the bins there are, more are opened as needed."""
    open_bins = sorted([(r, b) for b, r in enumerate(room) if r > 0])
    made, out = len(room), []
    for size in sizes:
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = length, made
            made += 1
        out.append(b)
        if left > size:
            insort(open_bins, (left - size, b))
    return out


def fitness(sizes: np.ndarray, labels: np.ndarray, length: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly: full ones beside nearly empty ones."""
    fill = np.bincount(labels, sizes)
    fill = fill[fill > 0] / length
    return -len(fill), float((fill**2).sum())


def cross(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """Inject the father's well-filled bins into the mother; remove bins that repeat a piece; best-fit what is displaced."""
    fill = np.bincount(father, sizes)
    chance = rng.random(len(fill)) < 0.5
    injected = np.flatnonzero((fill >= np.quantile(fill[fill > 0], 0.3)) & chance)
    taken = np.isin(father, injected)
    broken = np.unique(mother[taken])
    displaced = np.isin(mother, broken) & ~taken
    # bins of the mother that are far from full are opened as well, so that their pieces may meet others
    slack = np.bincount(mother, sizes)
    loose = np.flatnonzero((slack > 0) & (slack < length * (0.97 + 0.03 * rng.random())))
    displaced |= np.isin(mother, loose) & ~taken
    # bins that stay, then bins that are injected, numbered in order
    kept = np.flatnonzero(~displaced)
    _, number = np.unique(np.where(taken, len(slack) + father, mother)[kept], return_inverse=True)
    labels = np.zeros(len(sizes), np.int32)
    labels[kept] = number
    room = (length - np.bincount(number, sizes[kept])).astype(np.int64).tolist()
    order = np.flatnonzero(displaced)
    order = order[np.argsort(-(sizes[order] + rng.random(len(order)) * length * 0.02), kind="stable")]
    labels[order] = fitted(sizes[order].tolist(), length, room)
    return labels


def evolve(sizes: np.ndarray, guests: list[np.ndarray], length: int, seed: int, herd: int, crossings: int) -> np.ndarray:
    """One round on one island: the elite packing of a herd that starts from the guests and random best fits."""
    rng = np.random.default_rng(seed)
    packings = list(guests)
    while len(packings) < herd:
        noise = 0.0 if not packings else 0.1
        order = np.argsort(-(sizes + rng.random(len(sizes)) * length * noise), kind="stable")
        labels = np.zeros(len(sizes), np.int32)
        labels[order] = fitted(sizes[order].tolist(), length, [])
        packings.append(labels)
    ranked = sorted(packings, key=lambda p: fitness(sizes, p, length), reverse=True)
    least = -(-int(sizes.sum()) // length)
    for _ in range(crossings):
        if -fitness(sizes, ranked[0], length)[0] <= least:
            break  # no packing has fewer bins
        a, b = rng.choice(len(ranked), 2, replace=len(ranked) < 2)
        ranked = sorted([*ranked, cross(sizes, ranked[a], ranked[b], length, rng)], key=lambda p: fitness(sizes, p, length), reverse=True)[:herd]
    return ranked[0]


def pack(
    placed: DataFrame, length: int = LENGTH, block: int = BLOCK, islands: int = ISLANDS, herd: int = HERD, rounds: int = ROUNDS, crossings: int = CROSSINGS
) -> DataFrame:
    """``placed`` (from ``pieces``) with ``sequence_id`` and ``offset``; pieces of a sequence lie without gaps from 0."""
    named = cut_lineage(placed)
    n = named.count()
    blocks = max(1, -(-n // block))
    dealt = named.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    order = ["doc_id", "piece", "ids_crc32", "start", "length"]

    def island_round(turn: int):
        def solve(key: tuple, members: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
            only("packing islands")  # remembered words are not needed any more
            members = members.sort_values(order, kind="stable", na_position="first")
            guests = [np.frombuffer(x, np.int32) for x in elites.sort_values("island")["packing"]]
            best = evolve(members["length"].to_numpy(), guests, length, hash((int(key[0]), int(key[1]), turn)) & 0x7FFFFFFF, herd, crossings)
            return pd.DataFrame({"block": [key[0]], "island": [key[1]], "packing": [best.astype(np.int32).tobytes()], "bins": [int(len(np.unique(best)))]})

        return solve

    each = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
    homes = dealt.select("block", *order, each.alias("island"))
    spark = placed.sparkSession
    elites = spark.createDataFrame([], "block long, island int, packing binary, bins int")
    for turn in range(rounds):
        elites = cut_lineage(
            homes.groupBy("block", "island").cogroup(elites.groupBy("block", "island")).applyInPandas(island_round(turn), "block long, island int, packing binary, bins int")
        )
        if turn + 1 < rounds:  # an elite stays at home and its copy visits the next island
            visits = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")) if islands > 1 else elites.limit(0)
            elites = elites.unionByName(visits)

    winners = elites.groupBy("block").agg(F.min_by("packing", F.struct("bins", "island")).alias("packing"))

    def lay(key: tuple, members: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values(order, kind="stable", na_position="first").reset_index(drop=True)
        labels = np.frombuffer(best["packing"].iloc[0], np.int32)
        at = np.argsort(labels, kind="stable")
        sizes = members["length"].to_numpy()[at]
        ends = np.cumsum(sizes)
        first = np.concatenate([[True], np.diff(labels[at]) != 0])
        members = members.iloc[at].copy()
        members["sequence_id"] = (int(key[0]) << 20) + labels[at].astype(np.int64)
        members["offset"] = (ends - sizes) - np.repeat((ends - sizes)[first], np.diff([*np.flatnonzero(first), len(at)]))
        return members[[*order, "sequence_id", "offset"]]

    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, ids_crc32 long, start long, length long, sequence_id long, offset long"
    laid = dealt.select("block", *order).groupBy("block").cogroup(winners.groupBy("block")).applyInPandas(lay, schema)
    return laid.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
