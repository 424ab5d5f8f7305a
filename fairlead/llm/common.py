"""Small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.session import cut_lineage, shared_folder

__all__ = ["Recent", "cut_lineage", "hand_back", "held", "lean", "let", "one_per_id", "only", "shared_folder", "table", "text_buffer"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times; the optimiser cannot copy it into the uses."""
    return F.transform(F.array(value), body)[0]


def one_per_id(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each non-null ``key``: the first by the ``order`` columns."""
    first = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its values."""
    column = column.fill_null("").cast(pa.large_utf8())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


_kept: dict[str, dict[Hashable, object]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hand_back() -> None:
    """Freed memory of this worker goes back to the system; allocators would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def only(operator: str) -> dict[Hashable, object]:
    """What an operator keeps in this worker between tasks. Workers outlive stages, so what other operators have left goes first."""
    if operator not in _kept:
        _kept.clear()
        _kept[operator] = {}
        gc.collect()
        hand_back()
    return _kept[operator]


def held(operator: str, key: Hashable, make: Callable[[], object]):
    """The operator's only kept object, made anew for another key."""
    kept = only(operator)
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def lean(operator: str, body: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A body of a map job that starts without what other operators have left in its worker and hands freed memory back at its end."""

    def run(batches: Iterator) -> Iterator:
        only(operator)
        yield from body(batches)
        hand_back()

    return run


class Recent:
    """Answers for words seen lately, in two generations of ``room`` words each, so that frequent words stay and memory is bounded."""

    def __init__(self, learn: Callable[[list], Iterable], room: int):
        self.learn, self.room = learn, room
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, words: Iterable) -> Callable:
        """A function that answers each of ``words``."""
        if len(self.young) > self.room:
            self.young, self.old = {}, self.young
        new = set(words).difference(self.young)
        if new:
            again = [w for w in new if w in self.old]
            self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
            wanted = list(new.difference(again))
            if wanted:
                self.young.update(zip(wanted, self.learn(wanted), strict=True))
        return self.young.__getitem__
