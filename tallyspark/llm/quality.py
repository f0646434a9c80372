"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings over hashed text.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all grades and ordered thresholds t_0 < t_1 < ... The
features x are hashed from the whole text: words and pairs of neighbouring words, character trigrams, shapes of
blank-separated tokens and of neighbours, repeats of the token just before or of a recent one, and length. Each group's
counts are damped and scaled to a fixed length, so long texts do not dominate.
A row gets its expected grade and the tail probability P(grade >= select_grade); rows below `least_tail` are rejected.

The fit uses at most `max_rows` rated rows, drawn by a hash of their identifier (a bounded sample is enough for
some 70,000 shared weights); it runs in one task on hashed counts. Scoring covers every row and whole texts.

Defined results: null and empty texts have only the length feature; rows without a rating are scored but not fitted;
ratings of rows that don't exist, null ratings and repeated ratings (the largest counts) do no harm; with fewer than two
grades everything gets the grade that exists (0 if none) and is kept; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, id_text

#: Hashed features of each group, and the length that its values are scaled to.
GROUPS = {"shape": (1 << 14, 1.0), "word": (1 << 14, 0.5), "pair": (1 << 15, 0.3), "trigram": (1 << 12, 0.5)}
SIZE = sum(n for n, _ in GROUPS.values()) + 64
MAX_ROWS = 4_000
LEAST_TAIL = 0.5
#: Tokens before a token in which its repeat is looked for.
RECENT = 8
#: Shapes that a worker keeps at hand, and rows of the fit that are widened at once.
CACHED, FIT_ROWS = 50_000, 250


def shape(token: str, seen: dict[str, str]) -> str:
    """Runs of lower case become a, of upper case A, of digits 0, of other letters b; anything else stands for itself."""
    head, end = (token, "") if token.isalpha() else (token[:-1], token[-1])
    if head.isalpha() and not end.isalnum():
        if head.islower():
            return "a" + end
        if head.isupper():
            return "A" + end
        if head[0].isupper() and head[1:].islower():
            return "Aa" + end
    s = seen.get(token)
    if s is None:
        if len(seen) > CACHED:
            seen.clear()
        s = seen[token] = _runs(token)
    return s


def _runs(token: str) -> str:
    out, last = [], ""
    for c in token:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "b" if c.isalpha() else c
        if k != last:
            out.append(k)
            last = k
    return "".join(out)


#: Multiplier that joins the hashes of neighbours, and that of the trigrams' multiplicative hash.
JOIN, SPREAD = 1_000_003, 2_654_435_761


def _hash(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass"))


class Hasher:
    """Texts to hashed features; keeps the shapes of tokens seen before."""

    def __init__(self):
        self.shapes: dict[str, str] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, values). Distinct tokens are hashed once, neighbours and repeats are array operations."""
        tokens = text.split() if text else []
        words = [t.lower() for t in tokens]
        n = len(tokens)
        of_word = {w: _hash(w) for w in set(words)}
        of_shape = {t: _hash(shape(t, self.shapes)) for t in set(tokens)}
        numbers = {t: i for i, t in enumerate(of_shape)}
        w = np.fromiter(map(of_word.__getitem__, words), np.int64, n)
        s = np.fromiter(map(of_shape.__getitem__, tokens), np.int64, n)
        t = np.fromiter(map(numbers.__getitem__, tokens), np.int64, n)
        last = np.zeros(n, bool)
        last[1:] = t[1:] == t[:-1]
        recent = np.zeros(n, bool)
        for k in range(2, min(RECENT, n - 1) + 1):
            recent[k:] |= t[k:] == t[:-k]
        before = np.concatenate([[_hash("^")], s[:-1]])[:n]
        letters = np.frombuffer(f" {' '.join(words)} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
        three = (letters[:-2] << np.uint64(16)) | (letters[1:-1] << np.uint64(8)) | letters[2:]
        raw = {
            "shape": np.concatenate([s, before * JOIN + s, np.repeat([_hash("=last"), _hash("=recent")], [last.sum(), (recent & ~last).sum()])]),
            "word": w, "pair": w[:-1] * JOIN + w[1:], "trigram": ((three * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF)) >> np.uint64(12)).astype(np.int64) if n else w,
        }
        ids, values, at = [], [], 0
        for name, (size, length) in GROUPS.items():
            own, counts = np.unique(raw[name] % size, return_counts=True)
            v = np.sqrt(counts / max(1, n))
            ids.append(own + at)
            values.append(v * (length / (math.sqrt(v @ v) or 1.0)))
            at += size
        ids.append(np.array([at + min(63, int(math.log2(max(1, n))))]))
        values.append(np.array([0.1]))
        return np.concatenate(ids).astype(np.int32), np.concatenate(values).astype(np.float32)


def fit(xs: list[tuple[np.ndarray, np.ndarray]], grades: list[int], rounds: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(weights, thresholds, levels): maximum likelihood of the cumulative-link model by full-batch adaptive gradients. Empties xs."""
    levels = sorted(set(grades))
    if len(levels) < 2:
        return np.zeros(SIZE), np.zeros(0), levels
    y = np.searchsorted(levels, grades)
    n, k = len(xs), len(levels) - 1
    # kept small: numbers of four bytes, widened for a few hundred rows at a time
    parts = []
    for at in range(0, n, FIT_ROWS):
        of = xs[at : at + FIT_ROWS]
        sizes = [len(h) for h, _ in of]  # none is 0: every text has its length feature
        parts.append((np.concatenate([h for h, _ in of]), np.concatenate([v for _, v in of]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, slice(at, at + len(of))))
    xs.clear()  # what it held is in parts now
    w, gap = np.zeros(SIZE), np.zeros(k)  # thresholds: first, then logs of the steps
    above = np.array([(y > j).mean() for j in range(k)])
    t0 = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / np.clip(1 - above, 1e-3, 1))
    gap[0] = t0[0]
    gap[1:] = np.log(np.maximum(np.diff(t0), 1e-2))
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    for r in range(1, rounds + 1):
        steps = np.exp(gap[1:])
        t = gap[0] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.concatenate([np.add.reduceat(val * w[col], starts) for col, val, starts, _, _ in parts])
        c = 1 / (1 + np.exp(np.clip(score[:, None] - t, -40, 40)))  # P(grade <= j)
        c = np.hstack([np.zeros((n, 1)), c, np.ones((n, 1))])
        hi, lo = c[np.arange(n), y + 1], c[np.arange(n), y]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        ds = (dhi - dlo) / p / n  # of the negative log-likelihood by the score
        gw = sum(np.bincount(col, val * np.repeat(ds[at], sizes), len(w)) for col, val, _, sizes, at in parts) + l2 * w
        gt = np.zeros(k)
        np.add.at(gt, y[y < k], -(dhi / p)[y < k] / n)
        np.add.at(gt, y[y > 0] - 1, (dlo / p)[y > 0] / n)
        gg = np.concatenate([[gt.sum()], [gt[j:].sum() * steps[j - 1] for j in range(1, k)]])
        g = np.concatenate([gw, gg])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-9)
        w, gap = w - step[: len(w)], gap - step[len(w) :]
    return w, gap[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap[1:]))]), levels


def rated(docs: DataFrame, ratings: DataFrame, grade: str, max_rows: int) -> DataFrame:
    """(text, grade) of at most max_rows rated rows, drawn by hash; the sample is small enough to be broadcast to the scan."""
    r = ratings.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    r = r.orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(max_rows)
    return id_text(docs).join(F.broadcast(r), "doc_id").select("text", "grade")


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from (doc_id, quality, toxic): 0 bad, 1 good but toxic, 2 good; null quality stays null."""
    fine = F.coalesce(F.col("toxic"), F.lit(0)) <= 0
    return labels.select("doc_id", F.when(F.col("quality") <= 0, 0).when(F.col("quality") > 0, F.when(fine, 2).otherwise(1)).alias("grade"))


class Model:
    """What scoring needs: a weight for each hashed feature, ordered thresholds, grade levels."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, levels: list[int]):
        self.weights, self.thresholds, self.levels = weights, thresholds, levels

    def tails(self, x: tuple[np.ndarray, np.ndarray]) -> list[float]:
        """P(grade > levels[k]) for each k but the last."""
        s = float(self.weights[x[0]] @ x[1])
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, s - t)))) for t in self.thresholds]


def train(docs: DataFrame, ratings: DataFrame, grade: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Hasher()
        for b in batches:
            xs = [features(t) for t in b["text"]]
            yield pd.DataFrame({"h": [h.tobytes() for h, _ in xs], "v": [v.tobytes() for _, v in xs], "grade": b["grade"]})

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(g), h, v) for b in batches for h, v, g in zip(b["h"], b["v"], b["grade"]))  # the same order in every run
        grades, xs = [g for g, _, _ in rows], [(np.frombuffer(h, np.int32), np.frombuffer(v, np.float32)) for _, h, v in rows]
        rows.clear()
        w, t, levels = fit(xs, grades)
        yield pd.DataFrame({"w": [w], "t": [t], "levels": [levels]})

    sample = rated(docs, ratings, grade, max_rows).mapInPandas(hashed, "h binary, v binary, grade int")
    got = sample.repartition(1).mapInPandas(one, "w array<double>, t array<double>, levels array<int>").first()
    return Model(np.array(got["w"]), np.array(got["t"]), list(got["levels"])) if got else Model(np.zeros(SIZE), np.zeros(0), [])


def score(docs: DataFrame, model: Model, select_grade: int | None = None, least_tail: float = LEAST_TAIL) -> DataFrame:
    """(doc_id, expected_grade, tail, kept) for every row; tail is P(grade >= select_grade), the highest grade by default."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<expected_grade:double,tail:double>")
    def grades(texts: pd.Series) -> pd.DataFrame:
        features = Hasher()
        rows = [_judge(model, features(t), select_grade) for t in texts]
        return pd.DataFrame(rows, columns=["expected_grade", "tail"])

    s = id_text(docs).withColumn("s", grades("text"))
    return s.select("doc_id", "s.expected_grade", "s.tail", (F.col("s.tail") >= least_tail).alias("kept"))


def _judge(m: Model, x: tuple[np.ndarray, np.ndarray], select_grade: int | None) -> tuple[float, float]:
    if len(m.levels) < 2:
        return float(m.levels[0] if m.levels else 0), 1.0
    tails = m.tails(x)
    steps = [b - a for a, b in zip(m.levels, m.levels[1:])]
    wanted = m.levels[-1] if select_grade is None else select_grade
    below = [i for i, g in enumerate(m.levels) if g < wanted]
    return m.levels[0] + sum(s * t for s, t in zip(steps, tails)), tails[below[-1]] if below and below[-1] < len(tails) else 1.0 if not below else 0.0


def keep_good(
    docs: DataFrame, ratings: DataFrame, grade: str = "quality", select_grade: int | None = None, least_tail: float = LEAST_TAIL, max_rows: int = MAX_ROWS
) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns, whatever those are called."""
    model = train(docs, ratings, grade, max_rows)

    @F.pandas_udf("double")
    def tail(texts: pd.Series) -> pd.Series:
        features = Hasher()
        return pd.Series([_judge(model, features(t), select_grade)[1] for t in texts], dtype=float)

    return docs.where(tail(docs["text"]) >= least_tail)
