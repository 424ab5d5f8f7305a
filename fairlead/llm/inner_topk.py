"""Exact top-k search by inner product over integer vectors.

Vectors are dealt into slices by length: a band holds the lengths of one power of ``RATIO``, a slice is a bounded part of a band.
The longest slices are searched first and give every query a score that its k-th hit reaches. Each other slice is searched
only by the queries for which Cauchy-Schwarz allows that score. Inside a slice, vectors run by descending length in blocks.
Vectors are rotated by the singular vectors of all candidates, so a few leading components hold most of an inner product; the
partial sum over them plus the product of the residual lengths bounds the rest, and only pairs whose bound reaches the query's
score so far get the exact integer product.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Vectors of different
lengths are compared as if padded with zeros; the empty vector scores 0 everywhere. A repeated id counts once, with its best
score. Ties go to the smaller id. Products must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ratio of the lengths in neighbouring bands.
RATIO = 1.1
#: Candidates in a slice and queries in a block on average; candidates that set the first bounds at least.
SLICE, QUERIES, HEAD = 16384, 512, 4096
#: Share of the squared length that the leading components shall hold.
ENERGY = 0.75
HITS = "query_id long, vec_id long, score long"


def whole_steps(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x)), F.lit(False))


def _stacked(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _gram(width: int):
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            v = _stacked(batch["v"], width).astype(float)
            total += v.T @ v
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    return body


def rotation_of(vectors: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Singular vectors of all vectors, strongest first, and how many of them hold ``ENERGY``. The driver gets width squared sums."""
    sums = vectors.select("v").mapInPandas(_gram(width), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((width, width))
    gram[sums["i"], sums["j"]] = sums["x"]
    power, axes = np.linalg.eigh(gram)
    power, axes = np.maximum(power[::-1], 0), axes[:, ::-1]
    share = np.cumsum(power) / max(power.sum(), 1e-300)
    return np.ascontiguousarray(axes), int(min(width, np.searchsorted(share, ENERGY) + 1))


def best_hits(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, one for an id, ties to smaller ids."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    once = np.concatenate([[True], (np.diff(query) != 0) | (np.diff(ids) != 0)])[: len(query)]
    query, ids, score = query[once], ids[once], score[once]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(query) != 0])) if len(query) else np.zeros(0, int)
    nth = np.arange(len(query)) - np.repeat(starts, np.diff([*starts, len(query)]))
    return query[nth < k], ids[nth < k], score[nth < k]


def _search(width: int, k: int, axes: np.ndarray, lead: int, block: int = 1024):
    def body(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, c = _stacked(queries["q"], width), _stacked(found["c"], width)
        qid, cid = queries["query_id"].to_numpy(), found["vec_id"].to_numpy()
        reach = queries["reach"].fillna(-np.inf).to_numpy(float).copy()
        longest = np.sqrt((c.astype(float) ** 2).sum(1))
        order = np.argsort(-longest, kind="stable")
        c, cid, longest = c[order], cid[order], longest[order]
        qr, cr = q @ axes, c @ axes
        q_len = np.sqrt((q.astype(float) ** 2).sum(1))
        q_rest, c_rest = (np.sqrt((x[:, lead:] ** 2).sum(1)) for x in (qr, cr))
        hits = tuple(np.zeros(0, np.int64) for _ in range(3))
        for at in range(0, len(c), block):
            part = slice(at, at + block)
            live = np.flatnonzero(q_len * longest[at] * (1 + 1e-9) + 0.5 >= reach)  # scores are integers
            if not len(live):
                break  # all that follow are shorter
            bound = qr[live, :lead] @ cr[part, :lead].T + np.outer(q_rest[live], c_rest[part])
            slack = 1e-9 * np.outer(q_len[live], longest[part]) + 0.5
            x, y = np.nonzero((bound + slack >= reach[live, None]) & (qid[live, None] != cid[None, part]))
            x, y = live[x], y + at
            exact = np.concatenate([np.einsum("ij,ij->i", q[x[s : s + 65536]], c[y[s : s + 65536]]) for s in range(0, len(x), 65536)] or [np.zeros(0, np.int64)])
            hits = best_hits(*(np.concatenate([a, b]) for a, b in zip(hits, (x, cid[y], exact), strict=True)), k)
            full = np.bincount(hits[0], minlength=len(q)) >= k
            least = np.full(len(q), np.inf)
            np.minimum.at(least, hits[0], hits[2].astype(float))
            reach[full] = np.maximum(reach[full], least[full])
        return pd.DataFrame({"query_id": qid[hits[0]], "vec_id": hits[1], "score": hits[2]})

    return body


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best of ``vectors (vec_id, v array<long>)`` for each of ``queries (query_id, v)``, without the query's own id.

    Returns ``query_id, rank, vec_id, score``. The driver learns the counts of the bands (a few hundred) and one number per pair
    of components, whatever the size of the input.
    """
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    vectors = vectors.withColumn("length", length).withColumn("band", F.when(F.col("length") > 0, F.floor(F.log("length") / float(np.log(RATIO)))).otherwise(-1).cast("int"))
    queries = queries.withColumn("length", length)
    counted = vectors.groupBy("band").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).orderBy(F.desc("band")).collect()
    n_queries, q_width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not counted or not n_queries:
        return empty
    width = max(1, q_width, *[r["width"] for r in counted])
    axes, lead = rotation_of(vectors, width)
    parts = {r["band"]: -(-r["n"] // SLICE) for r in counted}
    first, seen = {}, 0  # slices of each band that are searched first
    for r in counted:
        first[r["band"]] = max(0, min(parts[r["band"]], -(-(HEAD - seen) * parts[r["band"]] // r["n"])))
        seen += r["n"]

    blocks = -(-n_queries // QUERIES)
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(first[b]).alias("lo"), F.lit(parts[b]).alias("hi")) for b in parts])
    lookup = F.get(F.filter(bands, lambda b: b["band"] == F.col("band")), F.lit(0))  # null for rows that an earlier filter has yet to remove
    candidates = vectors.select("vec_id", "v", "band", F.pmod(F.xxhash64("vec_id", "v"), lookup["hi"]).cast("int").alias("part"), lookup["lo"].alias("lo"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    run = _search(width, k, axes, lead)

    def met(asking: DataFrame, offered: DataFrame) -> DataFrame:
        keys = ("block", "band", "part")
        pairs = asking.select(F.col("block").alias("to"), F.col("band").alias("b"), F.col("part").alias("p")).distinct()  # a slice goes only to blocks with a query that can gain
        sent = offered.join(pairs, (F.col("band") == F.col("b")) & (F.col("part") == F.col("p")))
        sent = sent.select("vec_id", F.col("v").alias("c"), F.col("to").alias("block"), F.col("b").alias("band"), F.col("p").alias("part"))
        return asking.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(run, HITS)

    def asked(rows: DataFrame, low: Column, high: Column, fits) -> DataFrame:
        bands_of = rows.select("query_id", "v", "block", "reach", F.explode(F.filter(bands, fits)).alias("b"))
        return bands_of.select("query_id", F.col("v").alias("q"), F.col("block").alias("block"), "reach", F.col("b.band").alias("band"), F.explode(F.sequence(low, high - 1)).alias("part"))

    low, high = F.col("b.lo"), F.col("b.hi")
    opening = queries.withColumn("reach", F.lit(None).cast("double"))
    first_hits = met(asked(opening, F.lit(0), low, lambda b: b["lo"] > 0), candidates.where("part < lo"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(hits: DataFrame) -> DataFrame:
        once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    reached = top(first_hits).groupBy("query_id").agg(F.min("score").cast("double").alias("reach"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
    rest = queries.join(reached, "query_id", "left")

    def allowed(b: Column) -> Column:
        most = F.col("length") * F.when(b["band"] < 0, 0.0).otherwise(F.pow(F.lit(RATIO), b["band"] + 1)) * (1 + 1e-6) + 0.5
        return (b["lo"] < b["hi"]) & (F.col("reach").isNull() | (most >= F.col("reach")))

    rest_hits = met(asked(rest, low, high, allowed), candidates.where("part >= lo"))
    return top(first_hits.unionByName(rest_hits)).select("query_id", "rank", "vec_id", "score")
