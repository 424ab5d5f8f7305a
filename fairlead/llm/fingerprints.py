"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of five words is hashed once. The top bits of the hash name its bin, the smallest hash of a bin is the bin's value.
An empty bin takes the value of the occupied bin that comes first in a random order of its own (optimal densification: the
order is a hash of the two bin numbers, so two texts that occupy the same bins borrow alike). Only the low bits of each value
are kept; equal low bits of different values are expected once in 2^bits, and ``likeness`` corrects for that.

A text of fewer than five words is one shingle; a null text counts as empty. A text without words has an empty fingerprint,
which is 1 like another empty one and 0 like any other. Rows that repeat an id count once, with the shortest text (of equally long
ones that with the smallest hash); rows without an id are left out. Texts are shuffled once, by id; the order of ids is found on
narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import let, one_per_id

WORDS, BINS, BITS = 5, 128, 8
#: Ranges of ids that are put in order separately.
RANGES = 96
WHITE = " \t\n\x0b\x0c\r"


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of all word shingles of a text; fewer words make one shingle, none make none."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE))

    def rolled(h: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + n) for n in range(words)]))
        return F.when(F.size(h) >= words, joined).otherwise(F.array(F.xxhash64(h)))

    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<bigint>")).otherwise(let(F.transform(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)), rolled)))


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The low ``bits`` (at most 8) of every bin's value, less 128, as ``array<tinyint>``; empty for a text without words. ``bins``: a power of two."""
    shift = 62 - (bins - 1).bit_length()  # hashes have 62 bits
    last = F.array(*[F.lit((j + 1 << shift) - 1) for j in range(bins)])  # no hash is larger in its bin
    bin_of = lambda x: F.shiftright(x, shift)
    low = lambda x: x.bitwiseAND((1 << bits) - 1)

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))

    def empty(x: Column, j: Column) -> Column:
        return x == F.shiftleft(j.cast("long") + 1, shift) - 1

    def filled(values: Column) -> Column:
        occupied = F.filter(values, lambda x, j: ~empty(x, j))
        donor = lambda held, j: low(F.array_min(F.transform(held, lambda y: F.shiftleft(F.shiftright(F.xxhash64(j, bin_of(y)), 9), bits) + low(y))))
        return let(occupied, lambda held: F.transform(values, lambda x, j: (F.when(empty(x, j), donor(held, j)).otherwise(low(x)) - 128).cast("tinyint")))

    hashes = F.transform(shingles(text), lambda h: F.shiftrightunsigned(h, 2))
    return let(
        hashes,
        lambda v: F.when(F.size(v) == 0, F.array().cast("array<tinyint>")).otherwise(let(F.sort_array(F.concat(v, last)), lambda ordered: let(firsts(ordered), filled))),
    )


def as_text(print_: Column) -> Column:
    """Packed form: two hexadecimal digits a bin."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.hex(x.cast("int") + 128), 2, "0")), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1."""
    by_chance = 2.0**-bits
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - by_chance) / (1 - by_chance)))


def successors(ids: DataFrame, key: str = "doc_id", ranges: int = RANGES) -> DataFrame:
    """``ids`` (one row a key) with ``next``: the following key, for the last one the first.

    Keys are ordered within ranges; the first keys of the ranges (at most ``ranges`` rows) link one range to the following.
    """
    cuts = ids.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100_000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    ranged = ids.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col(key))))
    firsts = ranged.groupBy("_range").agg(F.min(key).alias("_first"))
    over = Window.orderBy("_range")
    firsts = firsts.select("_range", F.coalesce(F.lead("_first").over(over), F.min("_first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_first"))
    inside = F.lead(key).over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("next", inside).join(firsts, "_range").withColumn("next", F.coalesce("next", "_first")).drop("_range", "_first")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited text, whose last half is replaced by the start of the next document.

    Returns ``doc_id, n_chars, print, edited_text, next_print``.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumns({"n_chars": F.length("text"), "mark": F.xxhash64("text")})
    chosen = ("n_chars", "mark")
    printed = one_per_id(source.withColumn("print", fingerprint(F.col("text"))), "doc_id", *chosen)
    order = successors(one_per_id(source.select("doc_id", *chosen), "doc_id", *chosen).drop("mark"))
    heads = printed.join(order.select(F.col("doc_id").alias("_to"), F.col("next").alias("doc_id"), F.floor(F.col("n_chars") / 2).cast("int").alias("_take")), "doc_id")
    heads = heads.select(F.col("_to").alias("doc_id"), F.left("text", F.col("_take")).alias("head"), F.col("print").alias("next_print"))
    kept = F.left(F.col("text"), F.length("text") - F.floor(F.length("text") / 2).cast("int"))
    return printed.join(heads, "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"), "print", F.concat(kept, F.col("head")).alias("edited_text"), "next_print")
