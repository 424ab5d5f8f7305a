"""Ordered operators that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from fairlead.session import cut_lineage

#: Sequence numbers per bucket. Sequence numbers are unique, so no (key, bucket) group exceeds this.
BUCKET = 1_000_000
_PARTITION_BITS = 33


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Exact ``row_number`` per key for groups of any size.

    Rows are range-partitioned on (keys, order), so a hot key spreads over many
    partitions. Positions are frozen by a checkpoint; a row's rank is its place
    in its partition's run of the key plus the key's rows in earlier partitions.
    The order must be total. With ``keep`` (keys included), other columns travel
    only as far as the order needs them and are not frozen.
    """
    line = [F.col(k) for k in keys] + list(order)
    placed = df.repartitionByRange(*line).sortWithinPartitions(*line)
    placed = cut_lineage(placed.select(*(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("_pos")))
    placed = placed.withColumn("_part", F.shiftright("_pos", _PARTITION_BITS))
    runs = placed.groupBy(*keys, "_part").agg(F.min("_pos").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = placed.join(runs, [*keys, "_part"])
    rank = F.col("_pos") - F.col("_lo") + 1 + F.col("_before")
    return joined.withColumn(name, rank).drop("_pos", "_part", "_lo", "_before")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark trims each map task to ``k`` rows per key before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """First row per key by aggregation, combined map-side."""
    picked = F.min_by(F.struct(*columns), order)
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*")


def with_previous(df: DataFrame, key: str, seq: str, value: str, name: str, width: int = BUCKET) -> DataFrame:
    """Adds the key's previous value by sequence number, and whether the row is the key's first.

    Windows run per (key, bucket of sequence numbers); the last value of each
    earlier bucket is carried over in a second, small step.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(seq) / width))
    inside = W.partitionBy(key, "_bucket").orderBy(seq)
    rows = bucketed.withColumn("_lag", F.lag(F.struct(value)).over(inside))
    ends = bucketed.groupBy(key, "_bucket").agg(F.max_by(F.struct(value), F.col(seq)).alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(W.partitionBy(key).orderBy("_bucket"))).drop("_end")
    joined = rows.join(ends, [key, "_bucket"]).withColumn("_prev", F.coalesce("_lag", "_carried"))
    return joined.withColumn(name, F.col(f"_prev.{value}")).withColumn(
        f"{name}_missing", F.col("_prev").isNull()
    ).drop("_lag", "_carried", "_prev", "_bucket")


def running_count(df: DataFrame, key: str, seq: str, flag: Column, name: str, width: int = BUCKET) -> DataFrame:
    """Running number of true flags per key in sequence order, with the same two-step windows."""
    bucketed = df.withColumn("_bucket", F.floor(F.col(seq) / width)).withColumn("_one", flag.cast("long"))
    inside = W.partitionBy(key, "_bucket").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    rows = bucketed.withColumn("_within", F.sum("_one").over(inside))
    totals = bucketed.groupBy(key, "_bucket").agg(F.sum("_one").alias("_total"))
    earlier = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    return rows.join(totals, [key, "_bucket"]).withColumn(name, F.col("_within") + F.col("_before")).drop(
        "_bucket", "_one", "_within", "_before"
    )
