"""Run outputs, append-only logs and snapshot upserts on plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fairlead.functions import urls


def write_run(outputs: dict[str, DataFrame], path: str, run_id: str, fmt: str = "parquet") -> None:
    """Each output under ``<path>/<name>/run_id=<run_id>``; a rerun replaces its own run only."""
    for name, df in outputs.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}/run_id={run_id}")


def append_candidates(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert_sources(old: DataFrame, new: DataFrame, checked_at: Column) -> DataFrame:
    """The new snapshot: new rows replace old rows of the same id."""
    fresh = new.withColumn("url", urls.canonical_url(F.col("url"))).withColumn("last_checked_at", checked_at)
    kept = old.join(fresh.select("id"), "id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_ledger(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Fold two ledger snapshots: attempts add up, the first success stays, the latest attempt decides."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return both.groupBy(*keys).agg(
        F.sum("attempts").alias("attempts"), F.min_by("first_sent_at", F.when(F.col("first_sent_at").isNotNull(), F.col("_age"))).alias("first_sent_at"),
        F.max_by("last_sent_at", F.when(F.col("last_sent_at").isNotNull(), F.col("_age"))).alias("last_sent_at"),
        F.max_by("last_attempted_at", "_age").alias("last_attempted_at"),
        F.max_by("delivery_status", "_age").alias("delivery_status"), F.max_by("error", "_age").alias("error"),
    )
