"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the columns of
documents. ``run`` applies them to the documents of a folder, with each stage's result written as Parquet and read again.

Null and empty texts pass toxicity (they hold nothing toxic) and are rejected by language identification. Rows without a doc_id
pass the first three stages; removal of repeats leaves them out, as it needs an order of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import jaccard, language, packing, repeats, toxicity
from fairlead.llm.common import shared_folder

#: A document with this score or more is toxic; a language needs this score at least.
TOXIC_FROM, SURE_FROM = 0.3, 0.5


def _class(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn_from(docs, labels.where(_class(4) != 2))
    return toxicity.score(docs, model, out="_toxic").where(F.col("_toxic") < TOXIC_FROM).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model is sure of."""
    model = language.learn(docs.where(_class(3) != 1), F.col("lang"))
    found = language.predict(docs, model, out=("_lang", "_sure"))
    return found.where((F.col("_lang") != "und") & (F.col("_sure") >= SURE_FROM)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; rows that share a doc_id stay together."""
    groups = jaccard.groups(docs)
    return docs.join(groups.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in a document with a smaller doc_id; ``n_chars`` is counted anew."""
    cut = repeats.remove(docs, tuple(c for c in docs.columns if c not in ("doc_id", "text")), as_text=True).withColumnRenamed("rest", "text")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("ngram_join", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: Learned models and tokenizers decide these rows; SQL cannot. The stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
