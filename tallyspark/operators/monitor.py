"""Sequential endpoint tests over outcomes (key, seq, rejected, extra, tokens, p0), in arrival order of seq.

With p0 constant the evidence depends on the counts alone, so a running sum replaces the loop; a change of p0 starts a new
epoch with fresh counts. There are few endpoints and one may hold a third of all rows, so a key is cut at quantiles of seq, taken
from a mergeable sketch, into parts of about PART_ROWS rows: counts run within a part, in a window by (key, part), and start
from the sums of the parts before, of which there is one row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import stats
from tallyspark.sources import store


#: Rows of a key that are ordered in one task, about; a key has GRID parts at most, which grow with it beyond GRID * PART_ROWS rows.
PART_ROWS, GRID = 1_000_000, 1_000
#: Rank error of the sketch is one in this many rows: a fifth of the smallest part's share.
ACCURACY = 5_000


def parted(outcomes: DataFrame) -> DataFrame:
    """Adds part: a number that grows with seq, per key. Cuts are quantiles, so bursts of seq are cut as finely as they are dense."""
    grid = [i / GRID for i in range(1, GRID)]
    per = outcomes.groupBy("key").agg(F.percentile_approx("seq", grid, ACCURACY).alias("_q"), F.ceil(F.count("seq") / PART_ROWS).alias("_n"))
    parts = F.least(F.greatest(F.col("_n"), F.lit(1)), F.lit(GRID)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_q", F.round(i * GRID / parts).cast("int") - 1))
    per = per.select("key", F.when(parts > 1, F.array_distinct(cuts)).otherwise(F.slice("_q", 1, 0)).alias("_cuts"))
    # every 32nd cut first, then those between: few comparisons a row for any number of parts
    per = per.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % 32 == 31))
    block = F.size(F.filter("_coarse", lambda c: c < F.col("seq"))) * 32
    part = block + F.size(F.filter(F.slice("_cuts", block + 1, F.lit(31)), lambda c: c < F.col("seq")))
    return outcomes.join(per, "key").withColumn("part", F.when(F.col("seq").isNull(), -1).otherwise(part).cast("long")).drop("_cuts", "_coarse")


def before(parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, part, _sums): what the parts before each hold together, from a row for each part."""
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "part", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_{c}") for c in sums])


def numbered(rows: DataFrame) -> DataFrame:
    """Adds part and nth, the place in its key in order of seq, from 1."""
    p = parted(rows)
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("seq"))
    n = before(p.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")), ["key"], ["n"])
    return p.withColumn("_own", own).join(n, ["key", "part"]).withColumn("nth", F.col("_n") + F.col("_own")).drop("_n", "_own")


def _epochs(outcomes: DataFrame) -> DataFrame:
    p = parted(outcomes)
    w = Window.partitionBy("key", "part").orderBy("seq")
    p = p.withColumn("_changed", F.coalesce((F.col("p0") != F.lag("p0").over(w)).cast("int"), F.lit(0)))
    ends = p.groupBy("key", "part").agg(F.min_by("p0", "seq").alias("first"), F.max_by("p0", "seq").alias("last"), F.sum("_changed").alias("inside"))
    step = F.coalesce((F.col("first") != F.lag("last").over(Window.partitionBy("key").orderBy("part"))).cast("int"), F.lit(0))
    ends = ends.withColumn("step", step).withColumn("changes", F.col("inside") + F.col("step"))
    start = before(ends, ["key"], ["changes"]).join(ends.select("key", "part", "step"), ["key", "part"])
    p = p.join(start, ["key", "part"]).withColumn("epoch", F.col("_changes") + F.col("step") + F.sum("_changed").over(w))
    return p.drop("_changed", "_changes", "step")


def epochs(outcomes: DataFrame) -> DataFrame:
    """Adds epoch: how often p0 changed before, per key."""
    return _epochs(outcomes).drop("part")


def evidence(outcomes: DataFrame) -> DataFrame:
    """Running counts and log evidence after each outcome."""
    e = _epochs(outcomes).withColumn("_tested", F.lit(1).cast("long")).withColumn("_rejected", F.col("rejected").cast("long"))
    sums = {"n_tested": "_tested", "n_rejected": "_rejected", "sum_extra": "extra", "sum_tokens": "tokens"}
    parts = e.groupBy("key", "epoch", "part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    w = Window.partitionBy("key", "part", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.join(before(parts, ["key", "epoch"], list(sums)), ["key", "epoch", "part"])
    e = e.withColumns({k: F.col(f"_{k}") + F.sum(c).over(w) for k, c in sums.items()}).drop("part", "_tested", "_rejected", *[f"_{k}" for k in sums])
    return e.withColumn("log_evidence", stats.log_evidence(F.col("n_tested"), F.col("n_rejected"), F.col("p0")))


def first_flags(outcomes: DataFrame, delta: float = 1e-6, least_overcharge: float = 0.001) -> DataFrame:
    """Per key and epoch the first outcome at which the evidence is enough and the overcharge material; it stays flagged."""
    crossed = (F.col("log_evidence") >= -F.ln(F.lit(delta))) & (F.col("sum_extra") / F.greatest(F.col("sum_tokens"), F.lit(1)) >= least_overcharge)
    e = evidence(outcomes)
    return e.groupBy("key", "epoch").agg(
        F.min(F.when(crossed, F.col("n_tested"))).alias("flagged_at"), F.max("n_tested").alias("tested"), F.max("n_rejected").alias("rejected"),
        F.max_by("log_evidence", "n_tested").alias("log_evidence"), F.max("sum_extra").alias("extra"), F.max("sum_tokens").alias("tokens"))


def alert_level(level: Column, tolerance: float = 3.0) -> Column:
    return F.least(level * tolerance, F.lit(0.5))


def batches(gaps: DataFrame, size: int = 100) -> DataFrame:
    """Full batches of `size` outcomes per key in order of seq; the remainder waits."""
    b = numbered(gaps).withColumn("batch", F.floor((F.col("nth") - 1) / size))
    sums = b.groupBy("key", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gap"), F.sum("canonical").alias("canonical"), F.max_by("host", "seq").alias("host"),
        F.max("seq").alias("seq"))
    return sums.where(F.col("n") == size)


def whole_batches(gaps: DataFrame, size: int = 100) -> DataFrame:
    """`batches` with what their test needs: the gaps and canonical counts of their `size` rows, in order of seq."""
    b = numbered(gaps).withColumn("batch", F.floor((F.col("nth") - 1) / size))
    rows = F.array_sort(F.collect_list(F.struct("nth", "gap", "canonical")))
    sums = b.groupBy("key", "batch").agg(
        F.max_by("host", "nth").alias("host"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gap"), F.sum("canonical").alias("canonical"), rows.alias("_r"))
    pick = lambda c: F.transform("_r", lambda r: r[c]).alias(c + "s")
    return sums.where(F.col("n") == size).select("key", "batch", "host", "seq", "n", "gap", "canonical", pick("gap"), pick("canonical"))


def batch_excess(batches: DataFrame, rule: DataFrame) -> DataFrame:
    """Tokens above the honest mean gap, per full batch, rounded half to even."""
    j = batches.join(rule.select("key", "mean_gap"), "key")
    excess = F.col("gap") - F.col("n") * F.col("mean_gap")
    return j.select("key", "host", "batch", "n", "gap", "canonical", F.greatest(F.lit(0), F.bround(excess, 0)).cast("long").alias("excess"), (F.col("gap") + F.col("canonical")).alias("tokens"))


#: Most values that numpy draws from without replacement; beyond, with or without makes no difference that 2,000 draws could show.
MOST = 10**9 - 1
#: Counts of distinct values that are drawn at a time.
CELLS = 1_000_000


def permutation_p(batch: list[tuple[float, float]], reference: list[tuple[float, int]], margin: float, permutations: int = 2000, seed: int = 0) -> float:
    """One-sided permutation test that gaps less a share of canonical tokens exceed the reference on average.

    reference has (gap, how often). A permutation puts as many of all values as the batch has into the first group, so the
    number of each distinct value there is a multivariate hypergeometric draw: work grows with distinct values, not with rows.
    """
    own = np.array([g - margin * c for g, c in batch])
    distinct, times = (np.array(x) for x in zip(*reference))
    n, m = len(own), int(times.sum())
    values = np.concatenate([own, distinct.astype(float)])
    counts = np.concatenate([np.ones(n, np.int64), times.astype(np.int64)])
    draw = np.random.default_rng(seed)
    sums, rows = [], max(1, CELLS // len(counts))
    for done in range(0, permutations, rows):
        k = min(rows, permutations - done)
        first = draw.multivariate_hypergeometric(counts, n, size=k, method="marginals") if n + m <= MOST else draw.multinomial(n, counts / counts.sum(), size=k)
        sums.append(first @ values)
    sums = np.concatenate(sums)
    whole = float(own.sum() + (distinct * times).sum())
    observed = own.sum() / n - (whole - own.sum()) / m
    hits = int((sums / n - (whole - sums) / m >= observed - 1e-9 * max(1.0, abs(observed))).sum())
    return (hits + 1) / (permutations + 1)


def dealt(batches: DataFrame) -> DataFrame:
    """Batches over all tasks."""
    return store.dealt(batches, "key", "batch")


def batch_pvalues(gaps: DataFrame, reference: DataFrame, size: int = 100, margin: float = 0.0005, permutations: int = 2000) -> DataFrame:
    """(key, batch, p_value) of full batches. A batch has `size` rows. The reference is a key's calibration set, held as a
    count for each distinct gap (gaps are small whole numbers), and is never laid out. Draws are seeded by the batch's number."""
    b = numbered(gaps).withColumn("batch", F.floor((F.col("nth") - 1) / size))
    per = b.groupBy("key", "batch").agg(F.array_sort(F.collect_list(F.struct("seq", "gap", "canonical"))).alias("rows")).where(F.size("rows") == size)
    ref = reference.groupBy("key", "gap").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("gap", "n"))).alias("reference"))

    def run(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole:
            p = []
            for batch, rows, counts in zip(*(b.column(c) for c in ("batch", "rows", "reference"))):  # one at a time is Python objects
                own, of = rows.as_py(), counts.as_py()
                p.append(permutation_p([(r["gap"], r["canonical"]) for r in own], [(c["gap"], c["n"]) for c in of], margin, permutations, batch.as_py()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("batch"), pa.array(p, pa.float64())], ["key", "batch", "p_value"])

    return dealt(per.join(ref, "key").select("key", "batch", "rows", "reference")).mapInArrow(run, "key string, batch long, p_value double")


#: Chances of a Poisson variable of mean 1 to be at most 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: Sums that a bootstrap sample is judged by: of 1, delta, bill, and their products.
SUMS = ("n", "d", "b", "dd", "db", "bb")


def resampled(deltas: DataFrame, draws: int) -> DataFrame:
    """(cell, draw, sums of SUMS): bootstrap samples of each cell as sums. A row stands in a sample as often as a Poisson draw
    says that is seeded by its cell, id and the sample's number. Each task adds up what it has of a cell and sends a row a sample."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def out() -> pd.DataFrame:
            x = np.concatenate(list(held.values()))
            return pd.DataFrame({"cell": np.repeat(list(held), draws), "draw": np.tile(np.arange(draws), len(held)), **{k: x[:, i] for i, k in enumerate(SUMS)}})

        for f in frames:
            d, b, seeds = f["delta"].to_numpy(float), f["billed"].to_numpy(float), f["seed"].to_numpy(np.int64).view(np.uint64)
            each = np.stack([np.ones(len(d)), d, b, d * d, d * b, b * b], axis=1)
            for cell, at in f.groupby("cell").indices.items():
                total = held.setdefault(cell, np.zeros((draws, len(SUMS))))
                for k in range(0, len(at), 500):
                    part = at[k : k + 500]
                    u = seeds[part, None] + np.arange(1, draws + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
                    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        u = (u ^ (u >> np.uint64(shift))) * np.uint64(by)
                    u = ((u ^ (u >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53
                    total += np.searchsorted(POISSON, u, side="right").astype(float).T @ each[part]
            if len(held) > 1_000:
                yield out()
                held.clear()
        if held:  # a frame without rows has no type for its cells
            yield out()

    d = deltas.where("delta is not null and billed is not null")
    d = d.select(F.col("cell").cast("string").alias("cell"), "delta", "billed", F.xxhash64("cell", "id").alias("seed"))
    parts = d.mapInPandas(run, "cell string, draw long, " + ", ".join(f"{k} double" for k in SUMS))
    return parts.groupBy("cell", "draw").agg(*[F.sum(k).alias(k) for k in SUMS])


def detection_rate(deltas: DataFrame, effects: list[float], draws: int = 400, z: float = 1.645, least: int = 5) -> DataFrame:
    """Share of bootstrap samples in which an injected effect is found, per cell; null below `least` rows.

    An effect (percent) adds that share of its own bill to each row's delta; it is found where the sample's mean is more
    than z standard errors above 0.
    """
    s = resampled(deltas, draws)
    rows = deltas.where("delta is not null and billed is not null").groupBy(F.col("cell").cast("string").alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    x = F.col("effect") / 100
    e = s.where("n > 0").join(rows, "cell").withColumn("effect", F.explode(F.array(*[F.lit(float(v)) for v in effects])))
    mean = (F.col("d") + x * F.col("b")) / F.col("n")
    square = (F.col("dd") + 2 * x * F.col("db") + x * x * F.col("bb")) / F.col("n")
    sd = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    found = mean > z * F.when(sd < 1e-9, 1e-9).otherwise(sd) / F.sqrt("n")
    return e.groupBy("cell", "effect").agg(F.when(F.max("rows") >= least, F.avg(found.cast("double"))).alias("detected"))
