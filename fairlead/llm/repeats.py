"""Removal of byte strings that already stand in a document with a smaller id.

Every string of ``LEAST`` bytes has an anchor: the ``GRAM``-byte gram with the smallest hash in it. Equal strings have equal
anchors, so grams that are anchors are the initial buckets of a sparse suffix array, one entry for about eighteen bytes, and no
match is missed. An entry's context is all strings that it anchors. Buckets are refined by bucket-pointer refinement:

1. documents are dealt into blocks; a block sends each distinct (gram, context) once, with its smallest document;
2. entries of a gram are sorted on the identifier of their context. An entry whose context is in a smaller document is covered
   as a whole; a gram with a single context is done. What remains are contexts that agree in part;
3. only their bytes are sent, and the strings in them are refined from q-gram buckets: each round sorts the members of a bucket
   on the bucket identifiers at a later offset, which doubles the depth as the identifiers of the last round are used again,
   until the depth is ``LEAST``. A string is covered if the smallest document of its bucket is smaller than its own.

A gram with very many distinct contexts (a phrase shorter than ``LEAST`` with other neighbours in each document) is crowded and
has no bucket of its own: in step 2 its entries are dealt by context, and in step 3 each block sends the 128-bit name of each
distinct string once, with its smallest document, dealt by name. Crowded grams are found on one document in ``SAMPLED``; which
ones are found changes only how the work is dealt, never the result.

Inside a bucket, strings are refined gram by gram in pieces of about ``PIECE`` bytes. Blocks and buckets have bounded sizes whatever the number of copies or of contexts of a gram. A null text counts as empty; rows without an id are left
out; rows that repeat an id are one document's texts, in which no text removes another. Bytes are those of UTF-8.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import hand_back, lean, only, text_buffer
from fairlead.llm.shingles import mix, powers

LEAST, GRAM = 50, 16
#: Bytes of text in a block on average; bytes handled at once (positions must fit 20 bits).
BLOCK, CHUNK = 8 << 20, 1 << 19
#: Distinct contexts from which a gram is crowded; one document in so many is searched for such grams; names of strings in a bucket on average.
CROWD, SAMPLED, NAMES = 1 << 15, 64, 1 << 19
#: Bytes of a bucket that are refined at once; one gram's bytes stay together.
PIECE = 1 << 20
_BYTES = np.random.Generator(np.random.PCG64(50)).integers(0, 1 << 64, 256, np.uint64)
_OTHERS = np.random.Generator(np.random.PCG64(51)).integers(0, 1 << 64, 256, np.uint64)


@dataclass
class Entries:
    """Anchored runs of strings: run i starts its strings at ``low[i]`` to ``high[i]`` (positions in the block's bytes)."""

    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    row: np.ndarray


def entries_of(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM) -> Entries:
    """All entries of the documents in ``data``, in order."""
    parts: list[tuple[np.ndarray, ...]] = []
    width = least - gram + 1
    for start, stop, first, last in _chunks(offsets, least):
        piece = data[start:stop]
        if len(piece) < least:
            continue
        up, down = powers(len(piece) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[piece] * up[:-1], dtype=np.uint64)])
        grams = mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
        # smallest (hash, position) of each window: the better of a block's running minima from both sides
        keys = np.full(-(-len(grams) // width) * width, ~np.uint64(0), np.uint64)
        keys[: len(grams)] = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        square = keys.reshape(-1, width)
        ahead = np.minimum.accumulate(square, 1).ravel()
        back = np.ascontiguousarray(np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1]).ravel()
        strings = len(piece) - least + 1
        anchor = (np.minimum(back[:strings], ahead[width - 1 : width - 1 + strings]) & np.uint64(0xFFFFF)).astype(np.int64)
        ends = offsets[first + 1 : last + 1] - start  # strings must not run over the end of their document
        row = np.searchsorted(ends, np.arange(strings), "right")
        inside = np.arange(strings) + least <= ends[row]
        place = np.flatnonzero(inside)
        if not len(place):
            continue
        fresh = np.concatenate([[True], (np.diff(anchor[place]) != 0) | (np.diff(place) != 1)])
        low = place[fresh]
        high = place[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(place) - 1]])]
        shape = (np.uint64(64) * (high - low).astype(np.uint64) + (anchor[low] - low).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        context = mix((sums[high + least] - sums[low]) * down[low] ^ shape)
        parts.append((low + start, high + start, grams[anchor[low]], context, row[low] + first))
    return Entries(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Entries(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64)))


def _chunks(offsets: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """Start, stop, first row and end row of pieces of about ``CHUNK`` bytes; a longer document's pieces overlap by ``least - 1`` bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        start, stop = int(offsets[row]), int(offsets[to])
        if stop - start <= CHUNK:
            yield start, stop, row, to
        else:
            for s in range(start, stop - least + 1, CHUNK - least + 1):
                yield s, min(s + CHUNK, stop), row, to
        row = to


def first_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each distinct value's first occurrence, and for every value the number of its distinct value."""
    _, first, number = np.unique(values, return_index=True, return_inverse=True)
    return first, number


def smallest(number: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every value the smallest value with the same number."""
    least = np.full(int(number.max()) + 1 if len(number) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, number, values)
    return least[number]


def refined(data: np.ndarray, strings: np.ndarray, least: int = LEAST, q: int = 8) -> np.ndarray:
    """Bucket numbers of the ``least``-byte strings that start at ``strings``: equal strings, equal numbers; -1: alone.

    ``bucket`` holds the bucket of every position at the present depth, -1 where it is alone in it. A position is sorted on its
    own bucket and the bucket ``shift`` further on; it stays alone if either is.
    """
    padded = np.concatenate([data, np.zeros(least, np.uint8)])
    value = np.zeros(len(data), np.uint64)
    for k in range(q):
        value = value << np.uint64(8) | padded[k : k + len(data)]
    bucket, depth = _buckets(value, np.arange(len(data)), len(data)), q
    while depth < least:
        shift = min(depth, least - depth)
        members = np.flatnonzero(bucket >= 0) if depth + shift < least else strings[bucket[strings] >= 0]
        later = members + shift
        members, later = members[later < len(data)], later[later < len(data)]
        both = bucket[later] >= 0
        members, later = members[both], later[both]
        bucket = _buckets(bucket[members].astype(np.uint64) << np.uint64(32) | bucket[later].astype(np.uint64), members, len(data))
        depth += shift
    return bucket[strings]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it; the first row does."""
    return np.concatenate([np.ones(min(1, len(columns[0])), bool), np.logical_or.reduce([x[1:] != x[:-1] for x in columns])])


def names_of(data: np.ndarray, low: np.ndarray, counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each of the ``least``-byte strings that start at ``low[i], ..., low[i] + counts[i] - 1``."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ends, at = np.cumsum(counts + least - 1), 0
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        sizes = counts[at:to] + least - 1
        piece = data[_ranges(low[at:to], sizes)]
        starts = _ranges(np.cumsum(sizes) - sizes, counts[at:to])
        up, down = powers(len(piece) + 1)
        both = []
        for weights in (_BYTES, _OTHERS):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights[piece] * up[:-1], dtype=np.uint64)])
            both.append(mix((sums[starts + least] - sums[starts]) * down[starts]))
        found.append((both[0], both[1]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _buckets(keys: np.ndarray, members: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, -1, np.int32)
    if len(keys):
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        out[members] = np.where(count > 1, np.arange(len(count), dtype=np.int32), np.int32(-1))[number]
    return out


class Block:
    """One block's documents, their entries, and the distinct contexts in the order in which they are sent."""

    def __init__(self, table: pa.Table, buckets: int, crowded: np.ndarray):
        only("repeats")
        self.table = table.sort_by("doc_id").combine_chunks()
        texts = self.table["text"]
        self.docs = self.table["doc_id"].to_numpy()
        self.data, self.offsets = text_buffer(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        self.entries = entries_of(self.data, self.offsets)
        first, self.number = first_of(self.entries.context)  # rows are in order of documents, so the first is the smallest
        gram = self.entries.gram[first]
        apart = np.isin(gram, crowded)
        bucket = np.where(apart, self.entries.context[first], gram) % np.uint64(buckets)
        order = np.lexsort((first, bucket))
        self.number = np.argsort(order, kind="stable")[self.number]
        self.first, self.apart, bucket = first[order], apart[order], bucket[order].astype(np.int64)
        self.doc = self.docs[self.entries.row]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0])) if len(bucket) else np.zeros(0, np.int64)
        self.slices = [(int(bucket[a]), slice(a, b)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True)]

    def answered(self, replies: pa.Table) -> np.ndarray:
        """The flag of each distinct context."""
        flags = np.zeros(len(self.first), np.uint8)
        found = {b: f for b, f in zip(replies["bucket"].to_pylist(), replies["flags"].to_pylist(), strict=True) if f}
        for bucket, part in self.slices:
            if found.get(bucket):
                flags[part] = np.frombuffer(zlib.decompress(found[bucket]), np.uint8)
        return flags

    def named(self, flags: np.ndarray, buckets: int, shards: int) -> Named:
        """The strings of the crowded grams' partly equal contexts."""
        contexts = np.flatnonzero(self.apart & (flags == PARTLY))
        at = self.first[contexts]
        counts = self.entries.high[at] - self.entries.low[at] + 1
        owner = np.repeat(self.doc[at], counts)
        name, other = names_of(self.data, self.entries.low[at], counts)
        shard = name % np.uint64(shards)
        order = np.lexsort((owner, other, name, shard))
        fresh = _changes(name[order], other[order])
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        firsts = order[fresh]  # of each name, in its smallest document
        shard = shard[firsts].astype(np.int64)
        cuts = [*np.flatnonzero(_changes(shard)).tolist(), len(shard)]
        slices = [(buckets + int(shard[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return Named(contexts, counts, owner, number, name[firsts], other[firsts], owner[firsts], slices)


@dataclass
class Named:
    """Strings by name: of each string its owner and the number of its name; of each distinct name its smallest document in the block."""

    contexts: np.ndarray
    counts: np.ndarray
    owner: np.ndarray
    number: np.ndarray
    name: np.ndarray
    other: np.ndarray
    doc: np.ndarray
    slices: list[tuple[int, slice]]


COVERED, PARTLY = 1, 2
SENT = "bucket int, block int, gram binary, context binary, docs binary, runs binary"
FLAGS = "block int, bucket int, flags binary"
BYTES = "bucket int, block int, docs binary, sizes binary, grams binary, bytes binary"
MASKS = "block int, bucket int, masks binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    names = [c.split() for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True) if rows else [[]] * len(names), names, strict=True)], names=[n for n, _ in names])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams and contexts of the texts of each batch."""
    for batch in batches:
        entries = entries_of(*text_buffer(batch.column(0)))
        first, _ = first_of(entries.context)
        yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)) for x in (entries.gram, entries.context)], names=["gram", "context"])


def crowded_grams(source: DataFrame) -> tuple[np.ndarray, int]:
    """Grams with about ``CROWD`` distinct contexts or more, and about how many contexts they have together."""
    some = source.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SAMPLED)) == 0).select("text")
    counted = some.mapInArrow(lean("repeats", _contexts), "gram long, context long").distinct().groupBy("gram").agg(F.count("*").alias("n"))
    found = counted.where(F.col("n") >= CROWD / SAMPLED).toPandas()
    return np.sort(found["gram"].to_numpy(np.int64).view(np.uint64)), int(found["n"].sum()) * SAMPLED


def _send(buckets: int, crowded: np.ndarray):
    def body(key: tuple, table: pa.Table) -> pa.Table:
        block, rows = Block(table, buckets, crowded), []
        for bucket, part in block.slices:
            at = block.first[part]
            docs, runs = np.unique(block.doc[at], return_counts=True)
            rows.append((bucket, key[0].as_py(), (block.entries.gram[at] >> np.uint64(32)).astype(np.uint32).tobytes(), block.entries.context[at].tobytes(), docs.tobytes(), runs.astype(np.uint32).tobytes()))
        del block
        hand_back()
        return _rows(SENT, rows)

    return body


def _compare(crowded: np.ndarray):
    heads = np.unique((crowded >> np.uint64(32)).astype(np.uint32))

    def body(table: pa.Table) -> pa.Table:
        """Flags of the entries of one bucket."""
        gram, context, doc, sizes = [], [], [], []
        for g, c, d, r in zip(*(table[k].to_pylist() for k in ("gram", "context", "docs", "runs")), strict=True):
            gram.append(np.frombuffer(g, np.uint32))
            context.append(np.frombuffer(c, np.uint64))
            doc.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(r, np.uint32)))
            sizes.append(len(gram[-1]))
        gram, context, doc = np.concatenate(gram), np.concatenate(context), np.concatenate(doc)
        _, by_context = first_of(context)
        covered = doc > smallest(by_context, doc)
        firsts = np.flatnonzero(~covered)  # one entry of each context, from its smallest document
        _, by_gram, members = np.unique(gram[firsts], return_inverse=True, return_counts=True)
        flags = covered.astype(np.uint8) * COVERED
        flags[firsts[(members[by_gram] > 1) | np.isin(gram[firsts], heads)]] = PARTLY  # a crowded gram's other contexts are elsewhere
        cuts = np.cumsum([0, *sizes])
        packed = [zlib.compress(flags[a:b].tobytes(), 1) if flags[a:b].any() else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return _rows(FLAGS, list(zip(table["block"].to_pylist(), table["bucket"].to_pylist(), packed, strict=True)))

    return body


def _partly(buckets: int, crowded: np.ndarray, shards: int):
    def body(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        block, rows = Block(table, buckets, crowded), []
        flags = block.answered(replies)
        for bucket, part in block.slices:
            at = block.first[part][(flags[part] == PARTLY) & ~block.apart[part]]
            if len(at):
                sizes = (block.entries.high[at] - block.entries.low[at] + LEAST).astype(np.uint32)
                grams = (block.entries.gram[at] >> np.uint64(32)).astype(np.uint32)
                rows.append((bucket, key[0].as_py(), block.doc[at].tobytes(), sizes.tobytes(), grams.tobytes(), block.data[_ranges(block.entries.low[at], sizes)].tobytes()))
        strings = block.named(flags, buckets, shards)
        rows += [(bucket, key[0].as_py(), strings.doc[part].tobytes(), None, None, strings.name[part].tobytes() + strings.other[part].tobytes()) for bucket, part in strings.slices]
        return _rows(BYTES, rows)

    return body


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``starts[i], ..., starts[i] + sizes[i] - 1`` of all i, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _settle(table: pa.Table) -> pa.Table:
    """For every string of the contexts of one bucket, or every name of one, whether it stands in a smaller document."""
    docs = [np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()]
    if table["sizes"].null_count:
        return _settle_names(table, docs)
    sizes = [np.frombuffer(x, np.uint32).astype(np.int64) for x in table["sizes"].to_pylist()]
    grams = np.concatenate([np.frombuffer(x, np.uint32) for x in table["grams"].to_pylist()])
    data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
    doc, size = np.concatenate(docs), np.concatenate(sizes)
    counts = size - LEAST + 1
    begins, numbers = np.cumsum(size) - size, np.cumsum(counts) - counts
    covered = np.zeros(int(counts.sum()), bool)
    order = np.argsort(grams, kind="stable")  # equal strings have equal grams, so a bucket falls into pieces
    for some in _pieces(order, grams, size):
        piece = data[_ranges(begins[some], size[some])]
        owner = np.repeat(doc[some], counts[some])
        bucket = refined(piece, _ranges(np.cumsum(size[some]) - size[some], counts[some]))
        shared = np.flatnonzero(bucket >= 0)
        later = owner[shared] > smallest(bucket[shared], owner[shared])
        covered[_ranges(numbers[some], counts[some])[shared[later]]] = True
    return _masks(table, covered, [int((s - LEAST + 1).sum()) for s in sizes])


def _pieces(order: np.ndarray, grams: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Contexts in order of their grams, in pieces of about ``PIECE`` bytes; no gram is split."""
    ends = np.cumsum(size[order])
    last = np.flatnonzero(np.append(grams[order][1:] != grams[order][:-1], True))  # of each gram
    at = 0
    while at < len(order):
        fits = int(np.searchsorted(ends[last], (ends[at - 1] if at else 0) + PIECE, "right")) - 1
        stop = int(last[max(fits, int(np.searchsorted(last, at)))]) + 1
        yield order[at:stop]
        at = stop


def _settle_names(table: pa.Table, docs: list[np.ndarray]) -> pa.Table:
    pairs = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in table["bytes"].to_pylist()]
    doc, (name, other) = np.concatenate(docs), np.concatenate(pairs, 1)
    order = np.lexsort((doc, other, name))
    fresh = _changes(name[order], other[order])
    covered = np.zeros(len(doc), bool)
    covered[order] = doc[order] > doc[order[fresh]][np.cumsum(fresh) - 1]
    return _masks(table, covered, [len(d) for d in docs])


def _masks(table: pa.Table, covered: np.ndarray, sizes: list[int]) -> pa.Table:
    cuts = np.cumsum([0, *sizes])
    packed = [zlib.compress(np.packbits(covered[a:b]).tobytes(), 1) if covered[a:b].any() else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return _rows(MASKS, list(zip(table["block"].to_pylist(), table["bucket"].to_pylist(), packed, strict=True)))


def _cut(buckets: int, crowded: np.ndarray, shards: int, kept: list[str], as_text: bool):
    def body(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(table, buckets, crowded)
        e, flags = block.entries, block.answered(replies)
        masks = {b: m for b, m in zip(replies["bucket"].to_pylist(), replies["masks"].to_pylist(), strict=True) if m}
        whole = (flags[block.number] == COVERED) | (block.doc > block.doc[block.first][block.number])
        change = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(change, e.low[whole], 1)
        np.add.at(change, e.high[whole] + LEAST, -1)
        shown = np.full(len(block.first), -1, np.int64)  # where the strings of a partly covered context begin
        covered, at = [np.zeros(0, bool)], 0
        for bucket, part in block.slices:
            if bucket in masks:
                partly = np.flatnonzero((flags[part] == PARTLY) & ~block.apart[part]) + part.start
                counts = e.high[block.first[partly]] - e.low[block.first[partly]] + 1
                shown[partly] = at + np.cumsum(counts) - counts
                covered.append(np.unpackbits(np.frombuffer(zlib.decompress(masks[bucket]), np.uint8), count=int(counts.sum())).astype(bool))
                at += int(counts.sum())
        named = block.named(flags, buckets, shards)
        told = np.zeros(len(named.doc), bool)
        for bucket, part in named.slices:
            if bucket in masks:
                told[part] = np.unpackbits(np.frombuffer(zlib.decompress(masks[bucket]), np.uint8), count=part.stop - part.start).astype(bool)
        shown[named.contexts] = at + np.cumsum(named.counts) - named.counts
        covered.append(told[named.number] | (named.owner > named.doc[named.number]))
        bits = np.concatenate(covered)
        some = np.flatnonzero(~whole & (shown[block.number] >= 0))
        counts = e.high[some] - e.low[some] + 1
        strings = _ranges(e.low[some], counts)[bits[_ranges(shown[block.number[some]], counts)]]
        np.add.at(change, strings, 1)
        np.add.at(change, strings + LEAST, -1)
        removed = np.cumsum(change[:-1], dtype=np.int32) > 0
        edge = np.zeros(len(removed) + 1, bool)
        edge[block.offsets] = True
        starts = np.flatnonzero(removed & (edge[:-1] | ~np.concatenate([[False], removed[:-1]])))
        stops = np.flatnonzero(removed & (edge[1:] | ~np.concatenate([removed[1:], [False]]))) + 1
        row = np.searchsorted(starts, block.offsets)
        base = np.searchsorted(block.offsets, starts, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(starts - block.offsets[base]), pa.array(stops - block.offsets[base])], names=["start", "stop"])
        out = [block.table[c].combine_chunks() if isinstance(block.table[c], pa.ChunkedArray) else block.table[c] for c in kept]
        stays, sizes = ~removed, np.zeros(len(block.docs), np.int64)
        filled = np.flatnonzero(np.diff(block.offsets))  # empty texts have no bytes to count
        if len(filled):
            sizes[filled] = np.add.reduceat(stays, block.offsets[filled], dtype=np.int64)
        whole_left = pa.py_buffer(block.data[stays].tobytes())
        cuts = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]))
        del change, removed, edge, stays, strings
        hand_back()
        rest = pa.Array.from_buffers(pa.large_binary(), len(block.docs), [None, cuts, whole_left]).cast(pa.binary())
        if as_text:  # a character that has lost some of its bytes goes as a whole
            rest = pa.array([r.decode("utf-8", "ignore") for r in rest.to_pylist()], pa.string())
        return pa.table([*out, rest, pa.ListArray.from_arrays(pa.array(row.astype(np.int32)), spans)], names=[*kept, "rest", "spans"])

    return body


def remove(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text", as_text: bool = False) -> DataFrame:
    """``doc_id, *keep, rest, spans array<struct<start, stop>>`` of every document; spans are the positions of removed bytes.

    ``rest`` is binary, or with ``as_text`` a string of the characters that kept all of their bytes.
    """
    keep = tuple(c for c in keep if c not in ("doc_id", "rest", "spans"))
    named = {c: f"_{i}" for i, c in enumerate(keep)}  # names of other columns cannot clash
    source = docs.where("doc_id IS NOT NULL").select("doc_id", *[F.col(f"`{c}`").alias(n) for c, n in named.items()], F.col(text).alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    placed = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    lean = placed.select("block", "doc_id", "text")
    crowded, contexts = crowded_grams(source)
    shards = max(1, -(-contexts * (LEAST - GRAM + 1) // NAMES))  # a context has at most so many strings
    sent = lean.groupBy("block").applyInArrow(_send(blocks, crowded), SENT)
    flags = sent.groupBy("bucket").applyInArrow(_compare(crowded), FLAGS).where("flags IS NOT NULL")
    partly = lean.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_partly(blocks, crowded, shards), BYTES)
    masks = partly.groupBy("bucket").applyInArrow(_settle, MASKS).where("masks IS NOT NULL")
    replies = flags.withColumn("masks", F.lit(None).cast("binary")).unionByName(masks.withColumn("flags", F.lit(None).cast("binary")))
    kept = ["doc_id", *named.values()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in kept)
    schema = f"{schema}, rest {'string' if as_text else 'binary'}, spans array<struct<start: long, stop: long>>"
    cut = placed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_cut(blocks, crowded, shards, kept, as_text), schema)
    return cut.select("doc_id", *[F.col(n).alias(c) for c, n in named.items()], "rest", "spans")
