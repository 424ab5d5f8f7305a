"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Candidates are dealt into slices of bounded size. In a slice, every dimension has a list of the candidates sorted by their entry. An
anchor reads each list from the end that its own entry's sign favours, all lists equally deep, and deeper step by step; what
it meets is scored by random access with the exact integer inner product. The threshold, the anchor's product with the
entries at the depth reached, bounds every score not yet seen. A window (a range of scores of which the k best are wanted) is done once
the threshold falls strictly below its k-th score, or below its range; strictly, as rows with equal scores are ordered by id.

One slice is searched first and tells each window a score that its k-th row reaches; the other slices start from it, so they return only
rows that can still count. Positives are one window of an anchor over rows of its own label, without bounds. Negatives are a window for
each positive over rows of other labels.

Rows without an id, a label or a usable vector take no part. A repeated id counts once, with the smallest label and then the
smallest vector. Vectors of several lengths are compared as if padded with zeros. Products and a hundred times a score must fit a
long. Anchors without another row of their label have no positives; windows without rows give none. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import cut_lineage, one_per_id

#: Candidates in a slice and anchors in a block on average; the depth of the first step, which doubles with each step.
SLICE, ANCHORS, DEPTH = 8192, 2048, 16
#: Bounds of a window that has none, and the score that a window without k rows reaches.
LEAST, MOST = -(2**62), 2**62
#: Integers below this are exact as doubles.
EXACT = 2**53
HITS = "anchor_id long, window long, vec_id long, score long"


def _stacked(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Lists:
    """Candidates with one sorted list a dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.sorted = np.argsort(x, axis=0, kind="stable")  # ascending; column d is the list of dimension d
        self.most = int(np.abs(x).max(initial=0))

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return (self.x[at].astype(float) @ anchor.astype(float)).astype(np.int64)
        return self.x[at] @ anchor

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Step by step: rows met for the first time, their scores, and the threshold for all rows not met yet."""
        n, up, down = len(self.ids), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        pull = np.abs(anchor[np.concatenate([up, down])]).tolist()
        met, done, depth = np.zeros(n, bool), 0, min(DEPTH, n) if pull else n
        while done < n:
            before = met.copy()
            met[self.sorted[n - depth : n - done, up]] = True
            met[self.sorted[done:depth, down]] = True
            if depth == n:
                met[:] = True  # a zero anchor reads no list
            edge = [*self.x[self.sorted[n - depth, up], up].tolist(), *(-self.x[self.sorted[depth - 1, down], down]).tolist()]
            new = np.flatnonzero(met & ~before)
            done, depth = (n if met.all() else depth), min(2 * depth, n)
            yield new, self.scores(new, anchor), sum(a * b for a, b in zip(pull, edge, strict=True)) if done < n else LEAST


def mine(found: Lists, anchor: np.ndarray, fits: np.ndarray, windows: list[tuple[int, int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the k best fitting rows for each window ``(low, high, reach)``: ``low <= 100 * score <= high``, ``reach <= score``."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    reach = [r for _, _, r in windows]
    live = list(range(len(windows)))
    for new, score, threshold in found.read(anchor):
        fitting = fits[new]
        ids, score = found.ids[new][fitting], score[fitting]
        for w in live:
            low, high, _ = windows[w]
            inside = (100 * score >= low) & (100 * score <= high) & (score >= reach[w])
            if inside.any():
                i, s = (np.concatenate(pair) for pair in zip(best[w], (ids[inside], score[inside]), strict=True))
                first = np.lexsort((i, -s))[:k]
                best[w] = i[first], s[first]
                if len(first) == k:
                    reach[w] = max(reach[w], int(s[first[-1]]))
        live = [w for w in live if threshold >= reach[w] and 100 * threshold >= windows[w][0]]
        if not live:
            break
    return best


def _task(width: int, k: int, same: bool):
    def body(anchors: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(anchors) and len(offered):
            ids, labels, x = offered["vec_id"].to_numpy(), offered["label"].to_numpy(), _stacked(offered["v"], width)
            parts: dict[int | None, Lists] = {}

            def lists_of(label: int | None) -> Lists:
                if label not in parts:
                    part = slice(None) if label is None else labels == label
                    parts[label] = Lists(ids[part], labels[part], x[part])
                return parts[label]

            for anchor_id, label, q, names, *bounds in zip(*[anchors[c] for c in ("anchor_id", "label", "q", "window", "low", "high", "reach")], strict=True):
                found = lists_of(label if same else None)
                anchor = np.zeros(width, np.int64)
                anchor[: len(q)] = q
                fits = found.ids != anchor_id if same else found.labels != label
                for name, (i, s) in zip(names, mine(found, anchor, fits, list(zip(*[b.tolist() for b in bounds], strict=True)), k), strict=True):
                    rows.append((np.full(len(i), anchor_id), np.full(len(i), name), i, s))
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("anchor_id", "window", "vec_id", "score"), columns, strict=True)))

    return body


class Search:
    """Candidates ``(vec_id, label, v array<long>)`` with distinct ids, dealt into slices."""

    def __init__(self, rows: DataFrame):
        self.n, self.width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        self.slices = max(1, -(-self.n // SLICE))
        self.rows = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(self.slices)).cast("int"))

    def best(self, anchors: DataFrame, blocks: int, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of each of ``windows (anchor_id, window, low, high)``; two searches, the first over one slice."""
        body, keys = _task(self.width, k, same), ("block", "slice")
        copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

        def met(asked: DataFrame, first: int, stop: int) -> DataFrame:
            grouped = asked.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high", "reach"))).alias("w"))  # at most the anchor's positives
            asking = anchors.join(grouped, "anchor_id").select(
                "anchor_id", "label", "q", "block", "w.window", "w.low", "w.high", "w.reach", F.explode(F.sequence(F.lit(first), F.lit(stop - 1))).alias("slice")
            )
            offered = self.rows.where(F.col("slice").between(first, stop - 1)).select("vec_id", F.col("label").alias("label"), "v", F.col("slice").alias("slice"), copies)
            return asking.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(body, HITS)

        hits = cut_lineage(met(windows.withColumn("reach", F.lit(LEAST)), 0, 1))
        if self.slices > 1:
            reached = hits.groupBy("anchor_id", "window").agg(F.min("score").alias("reach"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
            known = windows.join(reached, ["anchor_id", "window"], "left").fillna(LEAST, ["reach"])
            hits = hits.unionByName(met(known, 1, self.slices))
        ranked = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """The first ``negatives`` rows of other labels for each anchor and each of its first ``positives`` rows of its own label.

    ``vectors (vec_id, label, v array<long>)``; ``anchors (vec_id)`` names some of them. A negative scores from ``low`` to ``high``
    hundredths of its positive. Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    usable = vectors.where("label IS NOT NULL AND v IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<long>"))
    rows = cut_lineage(one_per_id(usable, "vec_id", "label", "v"))
    chosen = rows.join(anchors.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi")
    blocks = max(1, -(-chosen.count() // ANCHORS))
    chosen = chosen.select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("label"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(blocks)).cast("int").alias("block"))
    search = Search(rows)
    whole = chosen.select("anchor_id", F.lit(0).cast("long").alias("window"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    near = cut_lineage(search.best(chosen, blocks, whole, positives, True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = near.select("anchor_id", F.col("positive_id").alias("window"), (low * F.col("positive_score")).alias("low"), (high * F.col("positive_score")).alias("high")).where("low <= high")
    found = search.best(chosen, blocks, windows, negatives, False).select("anchor_id", F.col("window").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
