"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters (a run of other characters is one boundary) are hashed into ``BUCKETS``. Document frequencies are
counted over all documents that may be learned from. The classifier is fitted on a bounded sample of them, the same
number of each language at most (``SAMPLE`` in all), with follow-the-regularised-leader steps and an elastic-net penalty, which
leaves most weights at zero; a fifth of the sample is kept for fitting the temperature of the scores. Prediction is map-only.

A null text or one without a letter is ``und`` with score 0. Without any labelled document everything is ``und``. Ties go to the
language that sorts first. Equal texts get equal predictions; other columns are kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import lean

#: Hash buckets (16 bits of a hash), labelled documents to fit on at most, passes over them.
BUCKETS, SAMPLE, PASSES = 1 << 16, 4000, 3
#: Steps and penalties of the follow-the-regularised-leader rule.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.05, 0.01


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point the code point of its lower-case letter, 0 if it is none."""
    lower = (chr(i).lower() if chr(i).isalpha() else "" for i in range(sys.maxunicode + 1))
    return np.fromiter((ord(c) if len(c) == 1 else ord(c[0]) if c else 0 for c in lower), np.uint32)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and how often each occurs; empty without a letter."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.uint32(0x9E3779B1)
    two = points[:-1] * step + points[1:]
    three = two[:-1] * step + points[2:]
    grams = np.concatenate([points[points != 0] * step + np.uint32(1), two * step + np.uint32(2), three * step + np.uint32(3)])
    grams ^= grams >> np.uint32(15)
    counts = np.bincount((grams * np.uint32(0x85EBCA77)) >> np.uint32(16), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighted(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of one document, of length 1."""
    x = np.log1p(counts) * idf[found]
    return x / max(np.sqrt((x**2).sum()), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            total[ngrams(text.as_py())[0]] += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [ngrams(t.as_py()) for t in batch.column(2)]
        packed = [pa.array([x[i].astype(kind).tobytes() for x in rows], pa.binary()) for i, kind in ((0, np.uint16), (1, np.uint32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["order", "label", "buckets", "counts"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from (buckets, values) rows in the given order."""
    z, n, bias = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes)), np.zeros(classes)

    def weights(at) -> np.ndarray:
        shrunk = np.where(np.abs(z[at]) <= L1, 0.0, z[at] - np.sign(z[at]) * L1)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(passes):
        for (found, x), label in zip(rows, labels, strict=True):
            w = weights(found)
            error = _softmax(x @ w + bias)
            error[label] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[found] + g**2) - np.sqrt(n[found])) / ALPHA
            z[found] += g - sigma * w
            n[found] += g**2
            bias -= 0.05 * error
    return weights(slice(None)), bias


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the logits that makes the labels of held-back rows likeliest (golden section on its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _trainer(names: list[str], idf: np.ndarray):
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat([*batches]).sort_values(["order", "label"], kind="stable")
        rows = []
        for found, counts in zip(sample["buckets"], sample["counts"], strict=True):
            at = np.frombuffer(found, np.uint16).astype(np.int64)
            rows.append((at, weighted(at, np.frombuffer(counts, np.uint32), idf)))
        labels = sample["label"].map({x: i for i, x in enumerate(names)}).to_numpy()
        back = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
        w, bias = fit([r for r, b in zip(rows, back, strict=True) if not b], labels[~back], len(names))
        logits = np.array([x @ w[at] + bias for (at, x), b in zip(rows, back, strict=True) if b]).reshape(-1, len(names))
        t = temperature(logits, labels[back])
        at = np.flatnonzero(w.any(1))
        yield pd.DataFrame({"bucket": [*at.astype(int), -1], "w": [*(w[at] / t), bias / t]})

    return body


def learn(docs: DataFrame, label: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, inverse document frequencies, weights and biases from the rows whose label and text are not null; ``key`` only deals the sample."""
    labelled = docs.select(label.cast("string").alias("label"), F.col(text).alias("text"), F.col(key).alias("key")).where("label IS NOT NULL AND text IS NOT NULL")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    idf, w, bias = np.zeros(BUCKETS), np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    if len(names) < 2:
        return names, idf, w, bias
    df = labelled.select("text").mapInArrow(lean("language", _frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = sum(sizes.values())
    idf[:] = np.log1p(total)
    idf[df["bucket"]] = np.log((1 + total) / (1 + df["n"])) + 1
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, sample / len(names) / sizes[name]))])
    # a fixed place of every row in 0 to 1 chooses the sample, and its order
    place = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.select(place.alias("order"), "label", "text").where(F.col("order") < F.element_at(share, F.col("label")))
    features = chosen.mapInArrow(_features, "order double, label string, buckets binary, counts binary")
    model = features.repartition(1).mapInPandas(_trainer(names, idf), "bucket int, w array<double>").toPandas()
    if not len(model):
        return names, idf, w, bias
    rows = np.array(model["w"].tolist())
    at = model["bucket"].to_numpy()
    w[at[at >= 0]] = rows[at >= 0]
    bias[:] = rows[at < 0][0]
    return names, idf, w, bias


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray], text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the columns ``out``: language (string) and score (double), in place of columns of those names."""
    names, idf, w, bias = model
    idf, w = idf.astype(np.float32), w.astype(np.float32)
    kept = [f for f in docs.schema.fields if f.name not in out]
    at_text = [f.name for f in kept].index(text)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = [], []
            for value in batch.column(at_text):
                found, counts = ngrams(value.as_py() or "")
                if not len(found) or not names:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                p = _softmax(weighted(found, counts, idf) @ w[found] + bias)
                preds.append(names[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*[f.name for f in kept], *out])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{out[0]}` string, `{out[1]}` double"])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(lean("language", body), schema)
