"""Inputs that every operator must bear, and brute-force answers."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
SF_BIG = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = "the and of to in that was for with on as be at by this are or from an not have but they you all can had her one our out day".split()


def documents(spark, rows, extra=True):
    """Documents with a column whose name clashes with what operators add."""
    return spark.createDataFrame([(i, t, "x", "score") for i, t in rows], "doc_id long, text string, node string, score string") if extra else spark.createDataFrame(rows, "doc_id long, text string")


def odd_documents():
    prose = " ".join(WORDS[i * 7 % 32] + str(i % 3) for i in range(60))
    return [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \n\t "), (6, "é漢😀"), (7, prose + " end"), (None, prose), (8, "word " * 20_000), (9, "one two")]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows, percent=80):
    """doc_id: (set size, smallest id reachable by links)."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids, label = sorted(sets), {i: i for i in sets}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


def brute_removed(rows, least=50):
    """doc_id: (mask of removed bytes, bytes) for rows with distinct ids."""
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            first.setdefault(b[p : p + least], i)
    for i, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                mask[p : p + least] = b"\1" * least
        out[i] = (bytes(mask), b)
    return out
