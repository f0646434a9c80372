"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps look-alike letters of other scripts to Latin, drops invisible characters, and reads digits and
signs inside words as the letters they stand for. The lexicon starts from a short hand-written list; its weights and
further entries (words, and stems that begin words) are learned from labels: an entry's weight is its smoothed log odds
of occurring in labelled rows. A text's raw score is the sum of the weights of its matches outside exception phrases,
divided by the square root of its length in hundreds of words; a logistic curve fitted on the same rows maps it to 0..1.

Learning uses at most `max_rows` labelled rows (drawn by hash); scoring covers every row and whole texts.

Defined results: null, empty and matchless texts get the curve's value at 0; null and repeated labels do no harm (the
largest counts); without labels of both kinds the hand-written list and a default curve are used; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches, stored

MAX_ROWS = 8_000
LEAST_SUPPORT, LEAST_ODDS = 4, 3.0
STEMS = range(4, 9)
SEED_WEIGHT = 3.0

#: Fixed starting entries.
SEEDS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "worthless", "pathetic", "disgusting", "clown", "clowns", "imbecile", "vermin")
#: Fixed phrases in which an entry means no harm.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "take out the trash", "taking out the trash", "pond scum", "sore loser", "clown fish", "circus clown", "class clown", "stupid question", "idiot proof", "idiot light", "worthless check", "sad and pathetic fallacy", "pathetic fallacy")
#: Look-alikes of Latin letters (fixed values).
HOMOGLYPHS = dict(zip("аеорсухіѕјԁһкмтвнгпαειοκνρτυχωⅼｉ", "aeopcyxisjdhkmtbhrnaeioknptuxwli"))
INVISIBLE = "͏­​‌‍⁠﻿"
#: Digits and signs that stand for letters inside words (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_FOLD = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE))
_LEET = str.maketrans(LEET)
_MIXED = re.compile(r"[0-9@$!|]*[^\W\d_]+[0-9@$!|]+[^\W\d_][\w@$!|]*|[0-9@$]+[^\W\d_]{2,}[\w@$]*|[^\W\d_]{2,}[0-9@$]+(?![\w@$])")
_SIGNS = re.compile(r"[0-9@$!|]")
_BREAK = re.compile(r"[\W\d_]+")


def _letters(m: re.Match) -> str:
    t = m.group()
    core = t.rstrip("@$!|")  # signs that end a word are punctuation
    return core.translate(_LEET) + t[len(core) :]


def fold(text: str) -> str:
    """Folded words with one blank around each."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    if _SIGNS.search(t):
        t = _MIXED.sub(_letters, t)
    return f" {_BREAK.sub(' ', t).strip()} "


def entries_of(folded: str) -> set[str]:
    """What a text can add to the lexicon: " word " and stems as " begin"."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    def __init__(self, weights: dict[str, float], slope: float = 1.0, bias: float = -3.0):
        self.weights, self.slope, self.bias = weights, slope, bias
        self._automaton = None

    def automaton(self):  # noqa: ANN201
        import ahocorasick

        if self._automaton is None:
            a = ahocorasick.Automaton()
            for k in self.weights:
                a.add_word(k, (len(k), k))
            for k in EXCEPTIONS:
                a.add_word(f" {k} ", (len(k) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end, entry), one for each word at most (the heaviest entry), outside exception phrases."""
        found, spared = [], []
        for last, (n, k) in self.automaton().iter(folded):
            (found if k else spared).append((last + 1 - n, last + 1, k))
        best: dict[int, tuple[int, int, str]] = {}
        at = 0
        for s, e, k in sorted(found):
            while at < len(spared) and spared[at][1] < e:
                at += 1
            if at < len(spared) and spared[at][0] <= s and e <= spared[at][1]:
                continue
            if s not in best or self.weights[k] > self.weights[best[s][2]]:
                best[s] = (s, e, k)
        return list(best.values())

    def raw(self, text: str | None) -> float:
        return self.of_folded(fold(text)) if text else 0.0

    def of_folded(self, folded: str) -> float:
        found = self.matches(folded)
        if not found:
            return 0.0
        return sum(self.weights[k] for _, _, k in found) / math.sqrt(1 + folded.count(" ") / 100)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * math.log1p(max(0.0, self.raw(text))) + self.bias))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_rows: int) -> DataFrame:
    """(text, y) of a bounded sample of labelled rows: half of max_rows for either label at most; broadcast to the scan."""
    r = labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    r = r.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    half = [r.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_rows // 2) for y in (0, 1)]
    return id_text(docs).join(F.broadcast(half[0].unionByName(half[1])), "doc_id").select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", max_rows: int = MAX_ROWS) -> Lexicon:
    """Lexicon and curve from labelled rows that `train` (a condition on labels) selects."""
    small_batches(docs.sparkSession)
    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fold(t or ""))

    sample = stored(labelled(docs, labels, label, train, max_rows).select(folded("text").alias("folded"), "y"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b["folded"], b["y"]):
                c[int(y > 0)].update(entries_of(text))
                c[int(y > 0)][""] += 1
            keys = list(set(c[0]) | set(c[1]))
            yield pd.DataFrame({"entry": keys, "no": [c[0][k] for k in keys], "yes": [c[1][k] for k in keys]})

    counts = sample.mapInPandas(count, "entry string, no long, yes long").groupBy("entry").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    counts = stored(counts.where(f"yes >= {LEAST_SUPPORT} or entry = ''"))
    rows = counts.agg(F.max(F.when(F.col("entry") == "", F.col("no"))), F.max(F.when(F.col("entry") == "", F.col("yes")))).first()
    n_no, n_yes = (rows[0] or 0), (rows[1] or 0)
    seeds = {f" {w} ": SEED_WEIGHT for w in SEEDS}
    if not n_no or not n_yes:
        return Lexicon(seeds, 2.0, -2.0)
    odds = F.log((F.col("yes") + 0.5) / (n_yes + 1)) - F.log((F.col("no") + 0.5) / (n_no + 1))
    c = counts.where(F.col("entry") != "").withColumn("odds", odds)
    best = c.where((F.col("odds") >= LEAST_ODDS) & (F.col("yes") >= LEAST_SUPPORT)).orderBy(F.desc("yes"), F.desc("odds"), "entry")
    rows = best.collect()  # words of the bounded sample that four labelled rows share and others hardly have
    weights = {r["entry"]: r["odds"] for r in rows}
    support: dict[str, int] = {}
    for r in rows:
        if r["entry"].endswith(" "):
            for n in range(5, len(r["entry"])):
                support[r["entry"][:n]] = max(support.get(r["entry"][:n], 0), r["yes"])
    for r in rows:  # a stem that hardly occurs but in one word says no more than that word
        if support.get(r["entry"], 0) >= 0.8 * r["yes"]:
            del weights[r["entry"]]
    kept = {k: w for k, w in weights.items() if not any(weights.get(k[:n], 0) >= w - 0.5 for n in range(5, len(k)))}  # a stem covers its words
    kept |= {k: weights.get(k, w) for k, w in seeds.items() if not any(k[:n] in kept for n in range(5, len(k)))}
    lex = Lexicon(kept)

    def raws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"raw": [lex.of_folded(t) for t in b["folded"]], "y": b["y"].astype(int)})

    fitted = sample.mapInPandas(raws, "raw double, y int").toPandas()  # max_rows pairs of numbers at most
    lex.slope, lex.bias = curve(fitted["raw"].to_numpy(), fitted["y"].to_numpy(), n_no, n_yes)
    return lex


def curve(raw: np.ndarray, y: np.ndarray, n_no: int, n_yes: int) -> tuple[float, float]:
    """Logistic regression of y on log1p(raw), by Newton steps with a little shrinkage."""
    x = np.column_stack([np.log1p(np.maximum(raw, 0)), np.ones(len(raw))])
    b = np.array([1.0, -1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + 0.05 * b
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(b[0], 1e-3)), float(b[1])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype=float)

    s = id_text(docs).withColumn("score", judge("text"))
    return s.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
