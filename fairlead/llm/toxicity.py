"""Toxicity of texts after noisy-channel deobfuscation.

A word in disguise is a lattice: a leetspeak sign may stand for several letters or for nothing, a repeated letter may be one
letter, and single letters with spaces between may be one word or several. The restored word is the best path (Viterbi) under the costs of
those disguises and a character trigram model whose counts cover every document. Words that are plain letters have one path and
are left alone; signs at a word's ends are read both as letters and as nothing; a token without any letter is a word if its best
reading is likelier than letters at random; each worker remembers what it has restored.

Words and their beginnings are then scored. Weights come from a bounded sample of the labelled rows (``SAMPLE`` of each label at
most): features whose share among toxic rows is surely above that among others, then logistic regression by gradient steps. The
intercept is moved from the sample's share of toxic rows to that of all labelled rows.

Null and empty texts get the score of a text without any feature. Without both labels every score is the share of toxic labels.
Equal texts get equal scores; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import Recent, lean

#: Labelled rows of each label to fit on at most; features kept at most, strongest first; toxic rows of a feature at least; remembered words.
SAMPLE, FEATURES, LEAST, ROOM = 4000, 20_000, 3, 120_000
#: Costs (nats): a sign as a letter, a sign as nothing, the same where signs shall stay, a repeated letter as one.
SIGN, DROPPED, KEPT, REPEATED = 1.0, 2.5, 1000.0, 1.0
# Letters that leetspeak signs stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", ".": "", "-": "", "_": "", "'": "", " ": "",
}
EDGE, OTHER, KINDS = 0, 27, 28
_ENDS = re.compile(r"^(?:([^\w\s])\1+|[^\w\s@$!|+(€£])+|(?:([^\w\s])\2+|[^\w\s@$!|+(€£])+$")
_SPACED = re.compile(r"(?<![^\s])[^\s](?: [^\s]){2,}(?![^\s])")
_MAY_SPACE = re.compile(r" [^\s] [^\s](?![^\s])")  # quickly found; the end of every spelled word
_DISGUISED = re.compile(r"[^\W\d_].*[\d\W_]|[\d\W_].*[^\W\d_]|([^\W\d_])\1\1|([^\W\d_])\2.*([^\W\d_])\3", re.S)
_SIGN = "".join(re.escape(c) for c, letters in SIGNS.items() if letters)
_BARE_ENDS = re.compile(rf"^(?:[^\w{_SIGN}]|_)+|(?:[^\w{_SIGN}]|_)+$")
_SIGN_TWICE = re.compile(rf"([{_SIGN}])\1")
_TWICE = re.compile(r"([^\W\d_])\1")


def kind(letter: str) -> int:
    """1 to 26 for a to z, another number for all other letters."""
    return ord(letter) - 96 if "a" <= letter <= "z" else OTHER


def _kinds() -> np.ndarray:
    table = np.full(0x250, OTHER, np.int64)
    for i in range(len(table)):
        c = chr(i).lower()
        table[i] = kind(c[0]) if c[:1].isalpha() else EDGE
    return table


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = _kinds(), np.zeros(KINDS**3, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            points = np.frombuffer("\n".join(["", *batch.column(0).slice(at, 500).drop_null().to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            k = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], OTHER)
            total += np.bincount((k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:], minlength=KINDS**3)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["gram", "n"])


def letter_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs (negative log likelihoods) of each third letter after two, from all documents."""
    counted = docs.select(text).mapInArrow(lean("toxicity", _trigrams), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(KINDS**3)
    n[counted["gram"]] = counted["n"]
    n = n.reshape(KINDS, KINDS, KINDS)
    single = (n.sum((0, 1)) + 1) / (n.sum() + KINDS)
    double = (n.sum(0) + 10 * single) / (n.sum((0, 2))[:, None] + 10)
    return -np.log((n + 10 * double[None]) / (n.sum(2, keepdims=True) + 10))


#: What a sign may stand for: letters with their kinds and price.
_OPTIONS = {c: tuple((x, kind(x), SIGN) for x in letters) for c, letters in SIGNS.items()}
_ASCII = {chr(c): ((chr(c), kind(chr(c)), 0.0),) for c in range(128) if chr(c).isalpha()}
#: Signs that never belong to a word where they end it.
_TAIL = frozenset(".,;:?")


class Restorer:
    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def restore(self, word: str, dropped: float = DROPPED, repeated: float = REPEATED) -> str:
        """The cheapest reading of a lower-case word, where a sign left out costs ``dropped``; linear in its length.

        Words that are spelled letter by letter are read with spaces where one ends and the next begins.
        """
        costs = self.costs
        paths: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(EDGE, EDGE, ""): (0.0, None)}
        for c in word:
            letter = c.isalpha()
            options = _ASCII.get(c) or ((c, kind(c), 0.0),) if letter else _OPTIONS.get(c, ())
            skip = None if letter or not (dropped < KEPT or not options) else dropped if options else 0.1  # a sign that shall stay has a cheaper path as a letter
            if letter and len(paths) == 1:
                (((a, b, last), (cost, back)),) = paths.items()
                if c != last:  # a single path goes on
                    _, k, _ = options[0]
                    paths = {(b, k, c): (cost + costs[a][b][k], (c, back))}
                    continue
            grown: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            known = grown.get
            for state, (cost, back) in paths.items():
                a, b, last = state
                row = costs[a][b]
                for x, k, price in options:
                    key, total = (b, k, x), cost + price + row[k]
                    if (held := known(key)) is None or total < held[0]:
                        grown[key] = (total, (x, back))
                    if x == last:  # one letter, written again
                        total = cost + price + repeated
                        if (held := known(state)) is None or total < held[0]:
                            grown[state] = (total, back)
                if skip is not None:
                    total = cost + skip
                    if (held := known(state)) is None or total < held[0]:
                        grown[state] = (total, back)
                    if c == " " and last != " " and back:  # the end of a word
                        key, total = (b, EDGE, " "), cost + row[EDGE]
                        if (held := known(key)) is None or total < held[0]:
                            grown[key] = (total, (" ", back))
            paths = grown
        _, back = min((cost + costs[a][b][EDGE], i, back) for i, ((a, b, _), (cost, back)) in enumerate(paths.items()))[0::2]
        letters = []
        while back:
            letter, back = back
            letters.append(letter)
        return "".join(reversed(letters))

    def likely(self, reading: str) -> bool:
        """Whether a reading is likelier than as many letters at random."""
        kinds = [EDGE, EDGE, *[kind(c) for c in reading], EDGE]
        return sum(self.costs[a][b][c] for a, b, c in zip(kinds, kinds[1:], kinds[2:])) <= (len(kinds) - 2) * np.log(KINDS)

    def readings(self, token: str) -> tuple[str, ...]:
        """The readings of a token between spaces, without and with the signs at its ends."""
        lower = token.lower()
        bare = lower[:-1] if lower[-1:] in _TAIL else lower
        if bare.isalpha():  # nothing stands at the ends
            return self._readings(bare)
        plain, whole = _ENDS.sub("", lower), _BARE_ENDS.sub("", lower)
        found = self._readings(plain)
        if not any(map(str.isalpha, whole)):
            if len({c for c in whole if SIGNS.get(c)}) < 2:
                return found
            return tuple({x: None for x in self._signed(whole) if self.likely(x)})
        if whole != plain or _SIGN_TWICE.search(whole):
            found += (*self.restore(whole).split(), *self._signed(whole))
        return tuple({x: None for x in found if x})

    def _signed(self, word: str) -> list[str]:
        """The best reading in which every sign is a letter, and the best one in which it is a letter of its own."""
        return " ".join([self.restore(word, KEPT), self.restore(word, KEPT, KEPT) if _SIGN_TWICE.search(word) else ""]).split()

    def certain(self, plain: str) -> tuple[str, ...]:
        """The readings of a token as it stands that need no costs: its bare letters, and a doubled letter as one where there is but one."""
        if not plain.isalpha():
            return (bare,) if _DISGUISED.search(plain) and (bare := "".join([c for c in plain if c.isalpha()])) else ()
        if not _TWICE.search(plain) or _DISGUISED.search(plain):
            return (plain,)
        return plain, _TWICE.sub(r"\1", plain)  # letters with one of them doubled have two paths; both are read

    def _readings(self, plain: str) -> tuple[str, ...]:
        """The readings of a token as it stands: the certain ones, the best one, and the best one in which every sign is a letter."""
        found = [*self.certain(plain)]
        if _DISGUISED.search(plain):
            found += self.restore(plain).split()
            if any(map(_OPTIONS.get, plain)):  # without a sign that may be a letter both readings are one
                found += self.restore(plain, KEPT).split()
        return tuple({x: None for x in found if x})


def features_of(reading: str) -> list[str]:
    """The word itself and its beginnings of three to six letters."""
    return ["=" + reading, *[reading[:n] for n in (3, 4, 5, 6) if len(reading) >= n]]


def tokens_of(text: str) -> set[str]:
    """Distinct words between white space, and words spelled with spaces."""
    found = set(text.split())
    if _MAY_SPACE.search(text):
        found.update(_SPACED.findall(text))
    return found


def fit(rows: list[set[str]], toxic: np.ndarray, share: float) -> tuple[dict[str, float], float]:
    """Weights of the telling features, and the intercept for a population with that share of toxic rows."""
    sides = [Counter(), Counter()]
    for row, t in zip(rows, toxic, strict=True):
        sides[int(t)].update(row)
    n0, n1 = max(1, int((~toxic).sum())), max(1, int(toxic.sum()))
    scored = []
    for f, a in sides[1].items():
        b = sides[0][f]
        if a >= LEAST:
            low = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if low > 0:
                scored.append((-low, f))
    chosen = {f: i for i, (_, f) in enumerate(sorted(scored)[:FEATURES])}
    held = [np.array(sorted(chosen[f] for f in row if f in chosen), np.int64) for row in rows]
    w, g2, bias, b2 = np.zeros(len(chosen)), np.full(len(chosen), 1e-6), 0.0, 1e-6
    for _ in range(8):
        for at, t in zip(held, toxic, strict=True):
            g = 1 / (1 + np.exp(-np.clip(bias + w[at].sum(), -30, 30))) - t
            g2[at] += g * g
            w[at] = np.maximum(0.0, w[at] - 0.5 * (g + 1e-3 * w[at]) / np.sqrt(g2[at]))
            b2 += g * g
            bias -= 0.5 * g / np.sqrt(b2)
    odds = lambda p: np.log(p / (1 - p))
    return {f: float(w[i]) for f, i in chosen.items() if w[i] > 0}, float(bias + odds(min(max(share, 1e-4), 1 - 1e-4)) - odds(n1 / (n0 + n1)))


class Telling:
    """Which of ``features`` a token may have: the letters that it may stand for are tried without costs."""

    def __init__(self, features: Iterable[str]):
        self.words = {f[1:] for f in features if f.startswith("=")}
        self.heads = {f for f in features if not f.startswith("=")}
        self.starts = {f[:n] for f in self.words | self.heads for n in range(len(f) + 1)}

    def reach(self, token: str) -> set[str]:
        """At least the features of all readings of a lower-case token without spaces; reads on only while a feature may still begin so."""
        one, found, starts, heads = "", set(), self.starts, self.heads
        for at, c in enumerate(token):  # while there is one way to read on
            if c.isalpha():
                if c == one[-1:]:
                    break
                one += c
                if one not in starts:
                    return found
                if one in heads:
                    found.add(one)
            elif SIGNS.get(c):
                break
        else:
            return found | {"=" + one} if one in self.words else found
        begun = {one}
        for c in token[at:]:
            letters = c if c.isalpha() else SIGNS.get(c, "")
            if not letters:
                continue
            # a sign may be left out, a letter again may be the one before
            grown = {b for b in begun if b[-1:] == c} if letters is c else set(begun)
            for b in begun:
                for x in letters:
                    if (longer := b + x) in starts:
                        grown.add(longer)
                        if longer in heads:
                            found.add(longer)
            if not grown:
                return found
            begun = grown
        return found | {"=" + b for b in begun & self.words}


def _readers(restorer: Restorer, kept, room: int) -> Recent:
    """The features in ``kept`` (None: all) of a token."""
    if kept is None:
        return Recent(lambda tokens: [tuple([f for r in restorer.readings(t) for f in features_of(r)]) for t in tokens], room)
    telling = Telling(kept)

    def learn(tokens: list[str]) -> Iterator[tuple[str, ...]]:
        for token in tokens:
            lower = token.lower()
            bare = lower[:-1] if lower[-1:] in _TAIL else lower
            if bare.isalpha() and not _TWICE.search(bare):  # no other reading
                yield tuple([f for f in features_of(bare) if f in kept]) if bare[:3] in telling.starts else ()
            elif " " in token:  # every word of a spelled run is a reading
                yield tuple([f for r in restorer.readings(token) for f in features_of(r) if f in kept])
            elif reached := telling.reach(lower):
                found = tuple([f for r in restorer.certain(_ENDS.sub("", lower)) for f in features_of(r) if f in kept])
                yield found if reached.issubset(found) else tuple([f for r in restorer.readings(token) for f in features_of(r) if f in kept])
            else:
                yield ()

    return Recent(learn, room)


def _row(recent: Recent, text: str | None) -> set[str]:
    tokens = tokens_of(text or "")
    return {f for found in map(recent.lookup(tokens), tokens) if found for f in found}


def _trainer(costs: np.ndarray, share: float):
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat([*batches]).sort_values(["order", "text"], kind="stable")
        toxic = sample["toxic"].to_numpy().astype(bool)
        restorer, seen = Restorer(costs), Counter()
        every = _readers(restorer, None, 20_000)
        for text in sample["text"][toxic]:
            seen.update(_row(every, text))
        told = _readers(restorer, {f for f, n in seen.items() if n >= LEAST}, ROOM)  # only these can be chosen
        weights, bias = fit([_row(told, text) for text in sample["text"]], toxic, share)
        yield pd.DataFrame({"feature": ["", *weights], "w": [bias, *weights.values()]})

    return body


def learn_from(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, float], float]:
    """Letter costs, weights and intercept from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``; labels other than 0 and 1 are left out.

    The sample is drawn from the labels before they meet the texts, so only its texts are shuffled.
    """
    costs = letter_model(docs, text)
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return costs, {}, float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    bound = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    # both labels fill the whole order; one that ended before the other would leave the last steps of the fit to that other
    drawn = marked.select("doc_id", "toxic", (place / bound).alias("order")).where("order < 1")
    chosen = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")  # at most about 2 * sample narrow rows
    model = chosen.select("order", "toxic", "text").repartition(1).mapInPandas(lean("toxicity", _trainer(costs, share)), "feature string, w double").toPandas()
    weights = dict(zip(model["feature"], model["w"], strict=True))
    return costs, weights, weights.pop("", float(np.log(share / (1 - share))))  # no labelled row may have a text


def score(docs: DataFrame, model: tuple[np.ndarray, dict[str, float], float], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out`` double, 0 to 1, in place of a column of that name; map-only."""
    costs, weights, bias = model
    kept = [f for f in docs.schema.fields if f.name != out]
    at_text = [f.name for f in kept].index(text)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = _readers(Restorer(costs), weights, ROOM)
        for batch in batches:
            scores = []
            for value in batch.column(at_text):
                fired = _row(recent, value.as_py())
                z = bias + sum([weights[f] for f in sorted(fired)])
                scores.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*[f.name for f in kept], out])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{out}` double"])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(lean("toxicity", body), schema)
