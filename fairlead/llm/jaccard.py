"""Exact self-join of documents on the Jaccard likeness of their word n-grams.

Equal sets are one node, so copies cost one row each. The global n-gram order puts n-grams first whose cell of a table of
counts over all documents is light, heavy cells (shared passages) last. A pair that reaches the threshold shares an n-gram among
the first ones of both (prefix filter). Each such n-gram names a hub, its smallest node, and all nodes of one hub meet in one
group: every pair that can link meets, and no pair is written out. A group larger than ``BLOCK`` is split into a grid of
blocks. A small sketch of each set first drops members that certainly link with none of their group. Then the order is cut into fragments (vertical partitions): partial overlaps of a fragment are counted for all
pairs at once as a matrix product, summed per pair, and a pair is given up once what is left cannot reach the threshold. Each
group returns only links that join parts not yet joined by it, which keeps the components of all links exactly.

Null and empty texts and texts of white space have no n-grams and link with nothing. Fewer words than an n-gram make one n-gram.
Rows that repeat an id are separate rows. Node names and n-grams are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import cut_lineage, lean
from fairlead.llm.components import components
from fairlead.llm.shingles import document_sets, set_id

WORDS, PERCENT = 5, 80
#: Cells of the count table (bits), nodes in a block, fragments of the order, rows and columns of a matrix product.
CELL_BITS, BLOCK, FRAGMENTS, ROWS, COLUMNS = 18, 2048, 8, 512, 4096
#: Members of groups that are sifted together on average; members of a group that are compared pair by pair at most.
SHARD, FEW = 8192, 12
#: Bytes of the bitmap that tells which texts are compared, at most; where it is full, texts are sent that need not be.
MARKS = 1 << 24
_PART_BITS = 12


def _cells(words: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                grams = np.concatenate([*document_sets(batch.column(0).slice(at, 500), words)])
                total += np.bincount(cells_of(grams), minlength=len(total))
        parts = total.reshape(-1, 1 << _PART_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    return body


def _sum_cells(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << _PART_BITS, np.int64)
    for counts in rows["counts"]:
        total += np.frombuffer(counts, np.int64)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [total.tobytes()]})


def order_of(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell its level in the global order (0 near the mean count of all documents, more for heavier cells) and its fragment.

    The order is by level, then by cell; fragments are stretches of it with equal shares of all n-grams.
    """
    schema = "part int, counts binary"
    summed = docs.select("text").mapInArrow(lean("jaccard", _cells(words)), schema).groupBy("part").applyInPandas(_sum_cells, schema).toPandas()
    counts = np.zeros((1 << CELL_BITS - _PART_BITS, 1 << _PART_BITS), np.int64)
    for part, row in zip(summed["part"], summed["counts"], strict=True):
        counts[part] = np.frombuffer(row, np.int64)
    mean = max(1.0, counts.mean())
    counts = counts.ravel()
    levels = np.clip(np.log2(np.maximum(counts, 1) / (2 * mean)), 0, 60).astype(np.uint8)
    order = np.argsort(levels, kind="stable")
    fragments = np.zeros(len(counts), np.uint8)
    fragments[order] = np.minimum(FRAGMENTS - 1, (np.cumsum(counts[order]) - counts[order]) * FRAGMENTS // max(1, counts.sum()))
    return levels, fragments


def prefix_of(hashes: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n-grams of a set in the global order; two sets that link share one of them."""
    n = len(hashes)
    size = n - -(-percent * n // 100) + 1
    level = levels[cells_of(hashes)]
    if not level.any():
        return hashes[:size]
    return hashes[np.argsort(level, kind="stable")[:size]]


def sketch_of(hashes: np.ndarray) -> bytes:
    """Parities of the set's hashes in at least as many cells as members; half as many cells are the exclusive or of both halves.

    Unrelated sets of one size differ in about half of the cells, linking ones in at most two ninths as many as members.
    """
    cells = 1 << max(6, (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1).tobytes()


def _named(words: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, nodes, sketches = [], [], []
            for s in document_sets(batch.column(1), words):
                n.append(len(s))
                nodes.append(set_id(s))
                new = len(s) and nodes[-1] not in seen  # a copy within the task needs no second sketch
                sketches.append(sketch_of(s) if new else None)
                if new:
                    seen.add(nodes[-1])
            columns = [pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "node", "sketch"])

    return body


def _prefixes(words: int, levels: np.ndarray, percent: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            grams, nodes, sizes = [], [], []
            for s in document_sets(batch.column(0), words):
                node = set_id(s) if len(s) else None
                if node is not None and node not in seen:  # a copy within the task has the same rows
                    seen.add(node)
                    grams.append(prefix_of(s, levels, percent).view(np.int64))
                    nodes.append(node)
                    sizes.append(len(grams[-1]))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.repeat(np.array(nodes, np.int64), sizes))], names=["gram", "node"])

    return body


def marks_of(nodes: DataFrame) -> np.ndarray:
    """A bitmap with about eight places for each of ``nodes (node)``, of ``MARKS`` bytes at most; a node without a mark is not among them."""
    bits = min(8 * MARKS, 1 << max(15, (8 * nodes.count()).bit_length()))
    place = F.col("node").bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    parts = nodes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("marks")).collect()
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in parts:
        out[r["part"] - 1] = np.frombuffer(r["marks"], np.uint8)
    return out.ravel()


def _node_texts(words: int, marks: np.ndarray):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keep, nodes = [], []
            for i, s in enumerate(document_sets(batch.column(0), words)):
                node = set_id(s) if len(s) else None
                if node is not None and node not in seen and marks[(at := node & 8 * len(marks) - 1) >> 3] >> (at & 7) & 1:
                    seen.add(node)
                    keep.append(i)
                    nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(0).take(pa.array(keep, pa.int64()))], names=["node", "text"])

    return body


class Forest:
    """Which members are already joined."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, x: int) -> int:
        above = self.above
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def linking(left: list[np.ndarray], right: list[np.ndarray] | None, fragments: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (i, j) between ``left`` and ``right`` (None: within left) that join separate parts.

    Each fragment of the global order has its own partial overlaps of all pairs, which are summed per pair.
    """
    within = right is None
    sets = left if within else left + right
    sizes = np.array([len(s) for s in sets], np.int64)
    first_right = 0 if within else len(left)
    forest, found = Forest(len(sets)), []
    if len(sets) < 2:
        return found
    places = [fragments[cells_of(x)] for x in sets]
    at = np.array([np.concatenate([[0], np.cumsum(np.bincount(p, minlength=FRAGMENTS))]) for p in places])
    sets = [x[np.argsort(p, kind="stable")] for x, p in zip(sets, places, strict=True)]
    coded = []  # each fragment: members' n-grams that occur at least twice, as column numbers
    for f in range(FRAGMENTS):
        flat = np.concatenate([s[a:b] for s, a, b in zip(sets, at[:, f], at[:, f + 1], strict=True)])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(sets)), at[:, f + 1] - at[:, f])
        used = shared[column]
        coded.append((owner[used], number[column[used]], int(shared.sum())))
    columns = np.arange(first_right, len(sets))
    for a in range(0, len(left), ROWS):
        rows = np.arange(a, min(a + ROWS, len(left)))
        need = -(-percent * (sizes[rows, None] + sizes[None, columns]) // (100 + percent))  # overlap of a link
        alive = np.minimum(sizes[rows, None], sizes[None, columns]) >= need
        if within:
            alive &= rows[:, None] < columns[None]
        overlap = np.zeros(alive.shape, np.int64)
        rest = sizes.copy()
        for f, (owner, number, width) in enumerate(coded):
            if not alive.any():
                break
            for c in range(0, width, COLUMNS):
                here = (number >= c) & (number < c + COLUMNS)
                matrix = np.zeros((len(sets), min(COLUMNS, width - c)), np.float32)
                matrix[owner[here], number[here] - c] = 1
                overlap += (matrix[rows] @ matrix[columns].T).astype(np.int64)
            rest -= at[:, f + 1] - at[:, f]
            alive &= overlap + np.minimum(rest[rows, None], rest[None, columns]) >= need
        for i, j in zip(*np.nonzero(alive), strict=True):
            if forest.join(int(rows[i]), int(columns[j])):
                found.append((int(rows[i]), int(columns[j])))
    return found


def possible(sizes: np.ndarray, sketches: list[bytes], right: np.ndarray | None, percent: int = PERCENT) -> np.ndarray:
    """Which members may link with another one (``right`` tells the two sides apart; None: one side).

    Two sets differ in at least as many members as their parities do, and linking ones differ in few. Members run by size, so
    only partners of a fitting size meet, and each stretch of sizes is compared at the width of its smallest sketch.
    """
    order = np.argsort(sizes, kind="stable")
    size = sizes[order].astype(np.int64)
    found = np.zeros(len(size), bool)
    start = 0
    while start < len(size):
        stop = min(start + ROWS, int(np.searchsorted(size, 2 * size[start], "left")), len(size))
        stop = max(stop, start + 1)
        end = int(np.searchsorted(size, 100 * size[stop - 1] // percent, "right"))
        width = len(sketches[order[start]])

        def parities(lo: int, hi: int) -> np.ndarray:
            out = np.empty((hi - lo, width), np.uint8)
            for k in range(lo, hi):
                out[k - lo] = np.bitwise_xor.reduce(np.frombuffer(sketches[order[k]], np.uint8).reshape(-1, width), axis=0)
            return 1 - 2 * np.unpackbits(out, axis=1).astype(np.float32)

        rows = parities(start, stop)
        for lo in range(start, end, ROWS):
            hi = min(lo + ROWS, end)
            differ = (8 * width - rows @ (rows if (lo, hi) == (start, stop) else parities(lo, hi)).T) / 2
            total = size[start:stop, None] + size[None, lo:hi]
            fits = (100 + percent) * differ <= (100 - percent) * total
            fits &= np.arange(start, stop)[:, None] < np.arange(lo, hi)[None]
            if right is not None:
                fits &= right[order[start:stop], None] != right[order[lo:hi]][None]
            found[start:stop] |= fits.any(1)
            found[lo:hi] |= fits.any(0)
        start = stop
    out = np.zeros(len(size), bool)
    out[order] = found
    return out


def _possible_few(sizes: list[int], sketches: list[bytes], right: list[bool] | None, percent: int) -> list[int]:
    """``possible`` for a handful of members, pair by pair; the places of those that may link."""
    found: set[int] = set()
    numbers = [int.from_bytes(s, "big") for s in sketches]
    for i in range(1, len(sizes)):
        for j in range(i):
            if (i in found and j in found) or (right is not None and right[i] == right[j]):
                continue
            total, small, large = sizes[i] + sizes[j], i, j
            if 100 * min(sizes[i], sizes[j]) < percent * max(sizes[i], sizes[j]):
                continue
            if len(sketches[small]) > len(sketches[large]):
                small, large = large, small
            width, wide, folded = 8 * len(sketches[small]), 8 * len(sketches[large]), numbers[large]
            while wide > width:
                wide //= 2
                folded = folded >> wide ^ folded & (1 << wide) - 1
            if (100 + percent) * (numbers[small] ^ folded).bit_count() <= (100 - percent) * total:
                found |= {i, j}
    return sorted(found)


def _sift(percent: int):
    def body(table: pa.Table) -> pa.Table:
        """The members of the groups of a shard that may link with another member."""
        table = table.sort_by([("hub", "ascending"), ("x", "ascending"), ("y", "ascending"), ("node", "ascending")])
        hub, x, y, part, n = (table[c].to_numpy() for c in ("hub", "x", "y", "part", "n"))
        sketches = table["sketch"].combine_chunks() if isinstance(table["sketch"], pa.ChunkedArray) else table["sketch"]
        fresh = np.concatenate([[True], (hub[1:] != hub[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(hub)]
        cuts, kept = [*np.flatnonzero(fresh).tolist(), len(hub)], []
        for a, b in zip(cuts, cuts[1:]):
            right = None if x[a] == y[a] else part[a:b] == y[a]
            own = sketches.slice(a, b - a).to_pylist()
            if b - a <= FEW:
                kept += [a + i for i in _possible_few(n[a:b].tolist(), own, None if right is None else right.tolist(), percent)]
            else:
                kept += (a + np.flatnonzero(possible(n[a:b], own, right, percent))).tolist()
        return table.select(["hub", "x", "y", "part", "node"]).take(pa.array(kept, pa.int64()))

    return body


def _verify(words: int, percent: int, fragments: np.ndarray):
    def body(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = key[1], key[2]
        rows = rows.drop_duplicates("node").sort_values("node")
        parts = [rows[rows["part"] == x]] + ([rows[rows["part"] == y]] if y != x else [])
        sets = [list(document_sets(pa.array(p["text"], pa.string()), words)) for p in parts]
        names = np.concatenate([p["node"].to_numpy() for p in parts])
        found = np.array(linking(sets[0], sets[1] if len(sets) > 1 else None, fragments, percent), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": names[found[:, 0]], "b": names[found[:, 1]]})

    return body


def needed(members: DataFrame) -> DataFrame:
    """``hub, m`` of the hubs whose members do not all belong to one smaller hub as well, where all their pairs meet anyhow."""
    sizes = members.groupBy("hub").agg(F.count("*").alias("m"))
    smaller = members.groupBy("node").agg(F.min("hub").alias("top")).where("top < node").select(F.col("node").alias("hub"), "top")
    again = members.join(smaller, "hub").select(F.col("hub").alias("inner"), F.col("top").alias("hub"), "node")
    told = members.join(again, ["hub", "node"]).groupBy("inner").agg(F.count("*").alias("also"))
    return sizes.join(told, F.col("hub") == F.col("inner"), "left").where("also IS NULL OR also < m").select("hub", "m")


def links(docs: DataFrame, named: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between nodes that make up the components of all links. ``docs``: doc_id, text; ``named``: node, n, sketch."""
    levels, fragments = order_of(docs, words)
    grams = docs.select("text").mapInArrow(lean("jaccard", _prefixes(words, levels, percent)), "gram long, node long")
    over = Window.partitionBy("gram")
    shared = grams.select("node", F.min("node").over(over).alias("hub"), F.max("node").over(over).alias("last")).where("hub <> last")
    members = cut_lineage(shared.select("hub", "node").distinct())
    sizes = needed(members)
    blocks = F.ceil(F.col("m") / block).cast("int")
    placed = members.join(sizes, "hub").select("hub", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("part"))
    # a node meets its own block and every other block once
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("hub", "node", "part", meets).select("hub", "node", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    sketches = named.where("sketch IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    rows = sizes.agg(F.sum(F.col("m") * F.ceil(F.col("m") / block))).first()[0] or 0
    shard = F.pmod(F.xxhash64("hub", "x", "y"), F.lit(max(1, -(-int(rows) // SHARD)))).alias("shard")
    likely = placed.join(sketches, "node").withColumn("shard", shard).groupBy("shard").applyInArrow(_sift(percent), "hub long, x int, y int, part int, node long")
    likely = cut_lineage(likely)
    marks = marks_of(likely.select("node").distinct())  # most texts meet no other and stay where they are
    texts = docs.select("text").mapInArrow(lean("jaccard", _node_texts(words, marks)), "node long, text string")
    checked = likely.join(texts, "node").groupBy("hub", "x", "y").applyInPandas(_verify(words, percent, fragments), "a long, b long")
    return checked.where("a <> b").distinct()


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``; the component is the smallest id reachable by links. One row for each input row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = cut_lineage(docs.mapInArrow(lean("jaccard", _named(words)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node long, sketch binary"))
    labels = components(links(docs, named, words, percent, block))
    first = named.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = first.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = joined.join(smallest, "component").select("node", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return named.join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
