"""Scans with explicit schemas; malformed rows become reject rows, never job failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from fairlead import schemas, vocab
from fairlead.functions import text as tx, urls


#: Sequence numbers set aside for each file of recorded hits.
FILE_ROOM = 1 << 32


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page snapshots."""
    return spark.read.schema(schemas.PAGE).format(fmt).load(path)


def read_url_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Non-blank lines that are web URLs, and the lines that are not."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url") != "")
    good = urls.is_web(F.col("url")) & (urls.host_of(F.col("url")) != "")
    return lines.where(good), lines.where(~good).select("url", F.lit("input").alias("stage"), F.lit("not a web URL").alias("reason"))


def load_sources(raw: DataFrame, default_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Usable trusted sources and rejects (bad id, repeated id, bad type, link cap out of range).

    ``default_cap`` is the link cap of sources that name none; without it these stay uncapped.
    """
    df = schemas.conform(raw, schemas.SOURCE).withColumns({
        "enabled": F.coalesce("enabled", F.lit(True)), "check_frequency": F.coalesce("check_frequency", F.lit("daily")),
        "max_links_per_run": F.coalesce("max_links_per_run", F.lit(default_cap).cast("int")),
        "category_focus": F.coalesce("category_focus", F.array().cast("array<string>")),
    })
    repeated = df.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    checked = df.join(repeated, "id", "left").withColumn(
        "reason",
        F.when(~F.coalesce(F.col("id").rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False)), "invalid source id")
        .when(F.col("_n") > 1, "source id is not unique")
        .when(~F.coalesce(F.col("source_type").isin(*vocab.SOURCE_TYPES), F.lit(False)), "unknown source type")
        .when(~F.col("max_links_per_run").between(1, 100), "link cap out of range")
        .when(~F.coalesce(urls.is_web(F.col("url")), F.lit(False)), "not a web URL"),
    ).drop("_n")
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def read_sources(spark: SparkSession, path: str, default_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    return load_sources(spark.read.schema(schemas.SOURCE).json(path), default_cap)


def load_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles and rejects ``(line, stage, reason)`` of a JSON-lines file.

    Fields outside the layout stay readable in the ``extra`` JSON column; a profile without an id is named by its line's hash.
    """
    layout = T.StructType([*schemas.PROFILE.fields, T.StructField("_broken", T.StringType())])
    lines = spark.read.text(path).select(F.col("value").alias("extra")).where(F.trim("extra") != "")
    parsed = lines.select("extra", F.from_json("extra", layout, {"columnNameOfCorruptRecord": "_broken"}).alias("p"))
    whole = F.startswith(F.ltrim("extra"), F.lit("{")) & F.try_parse_json("extra").isNotNull()
    reason = F.when(~whole, "not a JSON object").when(F.col("_broken").isNotNull(), "a field has another type")
    told = parsed.select("p.*", "extra").withColumn("reason", reason)
    good = told.where(F.col("reason").isNull()).select(*schemas.PROFILE.fieldNames(), "extra")
    bad = told.where(F.col("reason").isNotNull()).select(F.col("extra").alias("line"), F.lit("profile").alias("stage"), "reason")
    return good.withColumn("profile_id", F.coalesce("profile_id", F.sha2("extra", 256))), bad


def scan_search_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Recorded search hits in order (``seq``: files by name, then place in the file's JSON list), and rejects ``(seq, item, reason)``.

    A file that is no list is one reject; a bad item is one, and the file's other items stay.
    """
    raw = spark.read.option("wholetext", True).text(path).select("value", F.from_json("value", "array<string>").alias("r"), F.input_file_name().alias("f"))
    is_list = F.col("r").isNotNull() & F.startswith(F.ltrim("value"), F.lit("["))
    # the file's text stops here: beside its items it would be copied into every one of their rows
    files = raw.select("f", F.when(is_list, F.col("r")).otherwise(F.array("value")).alias("items"), tx.hold(is_list).alias("listed"))
    names = files.select("f").distinct()  # one row per file
    numbered = names.select("f", (F.row_number().over(Window.orderBy("f")) - 1).cast("long").alias("_file"))
    items = files.select("f", F.posexplode("items").alias("_at", "item"), "listed")
    seq = F.col("_file") * FILE_ROOM + F.col("_at")
    rows = items.join(numbered, "f").select(seq.alias("seq"), "item", "listed", F.from_json("item", schemas.SEARCH_RESULT).alias("hit")).select("seq", "item", "listed", "hit.*")
    blank = lambda name: F.coalesce(F.trim(F.col(name)), F.lit("")) == ""
    reason = (
        F.when(~F.col("listed"), "not a JSON list").when(blank("title") | blank("url"), "no title or URL")
        .when(~urls.is_web(F.col("url")), "not a web URL").when(~F.coalesce(F.col("rank") >= 1, F.lit(False)), "rank below one")
    )
    told = rows.withColumn("reason", reason)
    return told.where(F.col("reason").isNull()).drop("item", "listed", "reason"), told.where(F.col("reason").isNotNull()).select("seq", "item", "reason")


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """The usable hits of ``scan_search_results``."""
    return scan_search_results(spark, path)[0]
