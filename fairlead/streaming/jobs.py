"""Structured Streaming forms of ingestion, change tracking and the delivery ledger."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fairlead.functions import urls
from fairlead.operators import history as hs, ordered


def page_stream(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Pages as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_dedup(pages: DataFrame, url: str, at: str, lateness: str = "2 days") -> DataFrame:
    """Replayed snapshots of the same page and time pass once; state older than the watermark is dropped."""
    keyed = pages.withColumn("canonical", urls.canonical_url(F.col(url)))
    return keyed.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["canonical", at])


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; ``sink`` is a Parquet path or a foreachBatch function."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if callable(sink):
        return writer.foreachBatch(sink).start()
    return writer.format("parquet").option("path", sink).outputMode("append").start()


def change_batches(folder: str, key: str, seq: str, fields: list[str], buckets: int = 256):
    """foreachBatch function: track each batch against the latest rows of its keys, which are kept in buckets of keys.

    ``versions/batch=n`` holds the versions that a batch starts, ``state/batch=n/key_bucket=b`` the latest rows of a bucket with
    keys of that batch, and ``written/batch=n`` which batch wrote each bucket last. A batch reads and writes only buckets of its
    own keys. All folders of a batch depend on earlier batches alone, so a replayed batch writes the same rows again. A bucket
    is written by one task: ``buckets`` must grow with the keys, and stays what it was when the stream began. Sequence numbers
    rise from batch to batch.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        written = dict(spark.read.parquet(f"{folder}/written/batch={number - 1}").collect()) if number else {}
        paths = [f"{folder}/state/batch={written[b]}/key_bucket={b}" for b in sorted(touched) if b in written]
        old = spark.read.parquet(*paths) if paths else None
        tracked = hs.change_track(batch, key, seq, fields) if old is None else hs.track_against(old, batch, key, seq, fields)
        tracked = tracked.persist()
        hs.versions(tracked).write.mode("overwrite").parquet(f"{folder}/versions/batch={number}")
        latest = tracked.groupBy(key).agg(
            *[F.max_by(f, seq).alias(f) for f in fields], F.max("version_number").alias("version_number")
        )
        if old is not None:
            latest = old.join(latest.select(key), key, "left_anti").unionByName(latest)
        latest = latest.withColumn("key_bucket", bucket).repartition("key_bucket")
        latest.write.mode("overwrite").partitionBy("key_bucket").parquet(f"{folder}/state/batch={number}")
        last = sorted({**written, **dict.fromkeys(touched, number)}.items())
        spark.createDataFrame(last, "key_bucket int, batch long").write.mode("overwrite").parquet(f"{folder}/written/batch={number}")
        tracked.unpersist()
        batch.unpersist()

    return apply


def late_split(folder: str, keys: list[str], at: str, order: str, lateness: str = "2 days"):
    """foreachBatch function: rows older than the stream's watermark go to a side table, the others pass once.

    The watermark of a batch is the latest ``at`` of all earlier batches less ``lateness``; it never falls. ``late/batch=n`` holds
    every arrival below it and those without a time. ``kept/batch=n`` holds, of the other rows, the first by ``order`` of each
    key and time that no earlier batch has kept; only batches that reach the watermark are read for that. ``mark/batch=n`` is
    the batch's latest time. All depend on earlier batches alone, so a replayed batch writes the same rows again. Null keys
    equal each other. The rows may not have a column named ``batch``.
    """
    names = [*keys, at]

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        time, until, near = F.col(at).cast("timestamp"), None, []
        late = time.isNull()
        if number:
            marks = spark.read.schema("latest long, batch long").parquet(f"{folder}/mark").where(F.col("batch") < number)
            until = marks.agg(F.unix_micros(F.timestamp_micros(F.max("latest")) - F.expr(f"INTERVAL {lateness}"))).first()[0]
        if until is not None:
            late = late | (time < F.timestamp_micros(F.lit(until)))
            near = [r["batch"] for r in marks.where(F.col("latest") >= until).select("batch").collect()]
        passing = ordered.first_per_key(batch.where(~late), names, F.struct(order), [c for c in batch.columns if c not in names])
        if near:
            seen = spark.read.parquet(f"{folder}/kept").where(F.col("batch").isin(near) & ~late)
            seen = seen.select(*[F.col(c).alias(f"_seen_{i}") for i, c in enumerate(names)])
            same = [F.col(c).eqNullSafe(F.col(f"_seen_{i}")) for i, c in enumerate(names)]
            passing = passing.join(seen, reduce(and_, same), "left_anti")
        passing.select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.agg(F.max(F.unix_micros(time)).alias("latest")).write.mode("overwrite").parquet(f"{folder}/mark/batch={number}")
        batch.unpersist()

    return apply


def ledger_stream(attempts: DataFrame, keys: list[str], seq: str, at: str, delivered: Column, error: Column) -> DataFrame:
    """Running delivery ledger: the batch fold over a stream, in sequence order."""
    return hs.fold_attempts(attempts, keys, seq, at, delivered, error)


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's changed rows to its own folder; a replayed batch overwrites the same folder."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(keep).start()


def latest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
