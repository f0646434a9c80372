"""The sequential endpoint test and the count rule's batches as streaming queries, and sinks for alerts, warnings and states.

State per key is bounded: a handful of counts, or the outcomes that wait for a batch to be full. A restart from the same
checkpoint continues it. Alerts that are raised once are remembered for as long as the watermark lets them be.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.functions.stats import BETS
from tallyspark.operators.monitor import dealt, permutation_p
from tallyspark.sources.store import Versioned

STATE = "p0 double, tested long, rejected long, extra long, tokens long, flagged boolean"
OUT = "key string, p0 double, tested long, rejected long, extra long, tokens long, log_evidence double, newly_flagged boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_evidence(tested: np.ndarray | int, rejected: np.ndarray | int, p0: float) -> np.ndarray | float:
    n, k = np.asarray(tested, float), np.asarray(rejected, float)
    wealth = np.stack([k * math.log1p(b * (1 - p0) / p0) + (n - k) * math.log1p(-b) for b in BETS])
    top = wealth.max(axis=0)
    out = top + np.log(np.exp(wealth - top).sum(axis=0) / len(BETS))
    return float(out) if out.ndim == 0 else out


def monitored(outcomes: DataFrame, delta: float = 1e-6, least_overcharge: float = 0.001) -> DataFrame:
    """A row per key and micro-batch with its counts and evidence; newly_flagged at most once per key and p0.

    Outcomes of a micro-batch are running sums from the state on, one for each stretch of the same p0.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p0, n, k, extra, tokens, flagged = state.get if state.exists else (None, 0, 0, 0, 0, False)
        new = False
        rows = pd.concat(list(frames)).sort_values("seq")
        p = rows["p0"].to_numpy(float)
        for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1):
            if p[part[0]] != p0:
                p0, n, k, extra, tokens, flagged = float(p[part[0]]), 0, 0, 0, 0, False
            sums = [start + np.cumsum(rows[c].to_numpy()[part].astype(np.int64)) for start, c in ((k, "rejected"), (extra, "extra"), (tokens, "tokens"))]
            tested = n + 1 + np.arange(len(part))
            crossed = (log_evidence(tested, sums[0], p0) >= -math.log(delta)) & (sums[1] / np.maximum(sums[2], 1) >= least_overcharge)
            if not flagged and crossed.any():
                flagged = new = True
            n, k, extra, tokens = int(tested[-1]), *(int(s[-1]) for s in sums)
        state.update((p0, n, k, extra, tokens, flagged))
        yield pd.DataFrame([(key[0], p0, n, k, extra, tokens, log_evidence(n, k, p0), new)], columns=["key", "p0", "tested", "rejected", "extra", "tokens", "log_evidence", "newly_flagged"])

    return outcomes.groupBy("key").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


BATCH = "key string, batch long, host string, seq double, n long, gap long, canonical long, gaps array<long>, canonicals array<long>"


class _Batches(StatefulProcessor):
    """Outcomes that wait until there are `size` of them, fewer than that between micro-batches, and how many batches there were."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "seq double, gap long, canonical long, host string")
        self.done = handle.getValueState("done", "batches long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        held += [(float(s), int(g), int(c), h) for s, g, c, h in zip(new["seq"], new["gap"], new["canonical"], new["host"])]
        nth = self.done.get()[0] if self.done.exists() else 0
        out = []
        for at in range(0, len(held) - self.size + 1, self.size):
            seqs, gaps, canonicals, hosts = zip(*held[at : at + self.size])
            out.append((key[0], nth, hosts[-1], seqs[-1], self.size, sum(gaps), sum(canonicals), list(gaps), list(canonicals)))
            nth += 1
        rest = held[len(out) * self.size :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.done.update((nth,))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BATCH.split(", ")])

    def close(self) -> None:
        pass


def count_batches(gaps: DataFrame, size: int = 100) -> DataFrame:
    """Full batches of a stream of (key, seq, gap, canonical, host), in the order of their coming and within a micro-batch of seq.

    The same as operators.monitor.batches, of which a key's remainder waits, wherever the stream is cut. Needs the RocksDB state
    store (see `keep_in_rocksdb`).
    """
    g = gaps.select("key", F.col("seq").cast("double").alias("seq"), F.col("gap").cast("long").alias("gap"), F.col("canonical").cast("long").alias("canonical"), "host")
    return g.groupBy("key").transformWithStateInPandas(_Batches(size), BATCH, "Append", "None")


def batch_outcomes(batches: DataFrame, reference: DataFrame, margin: float = 0.0005, alpha: float = 0.05, tolerance: float = 3.0) -> DataFrame:
    """Outcomes (key, seq, rejected, extra, tokens, p0, p_value) of full batches, by a permutation test against the calibration's
    gaps (key, gap): a join with a static table and a function of the row, in batch and as a stream."""
    per = reference.groupBy("key", "gap").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("gap", "n"))).alias("reference"), (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("mean"))

    @F.pandas_udf("double")
    def p_value(gaps: pd.Series, canonicals: pd.Series, counts: pd.Series, nth: pd.Series) -> pd.Series:
        each = zip(gaps, canonicals, counts, nth)
        return pd.Series([permutation_p(list(zip(g, c)), [(r["gap"], r["n"]) for r in of], margin, seed=int(b)) for g, c, of, b in each], dtype=float)

    j = dealt(batches.join(per, "key")).withColumn("p_value", p_value("gaps", "canonicals", "reference", "batch"))
    rejected = F.col("p_value") < alpha
    excess = F.greatest(F.lit(0).cast("long"), F.bround(F.col("gap") - F.col("n") * F.col("mean")).cast("long"))
    return j.select(
        F.concat_ws("|", F.lit("batch"), "host", "key").alias("key"), "seq", rejected.alias("rejected"), F.when(rejected, excess).otherwise(0).cast("long").alias("extra"),
        (F.col("gap") + F.col("canonical")).alias("tokens"), F.lit(min(tolerance * alpha, 0.5)).alias("p0"), "p_value")


def keep_in_rocksdb(spark: SparkSession) -> None:
    """State stores of queries that are started from now on are RocksDB's, which hold lists and more than memory does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def alerts(stream: DataFrame, checkpoint: str, handler: Callable[[DataFrame, int], None]):  # noqa: ANN201
    """Hands every micro-batch's alerts to a handler; a batch number that was seen before is a repeat after a failure."""
    return stream.writeStream.outputMode("append" if "kind" in stream.columns else "update").option("checkpointLocation", checkpoint).foreachBatch(handler).start()


#: Alerts of this kind are about one response each; those of other kinds, and warnings, are raised once for a key.
EACH_TIME = "response"


def once_per_key(raised: DataFrame, remember: str = "7 days") -> DataFrame:
    """Alerts and warnings (key, kind, time, ...): those about responses every time, others the first time for a key and kind.

    time is a timestamp. A stream forgets a key when the watermark has passed its last alert by `remember`, so state doesn't grow
    with time; a table has no such bound.
    """
    often, once = raised.where(F.col("kind") == EACH_TIME), raised.where(F.col("kind") != EACH_TIME)
    if raised.isStreaming:
        once = once.withWatermark("time", remember).dropDuplicatesWithinWatermark(["key", "kind"])
    else:
        first = F.min_by(F.struct(*[c for c in once.columns if c not in ("key", "kind")]), "time")
        once = once.groupBy("key", "kind").agg(first.alias("_f")).select("key", "kind", "_f.*")
    return often.unionByName(once)


def kept_states(spark: SparkSession, path: str) -> Versioned:
    return Versioned(spark, path, OUT + ", batch long")


def keep_state(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Merges each micro-batch's states into a table of one row a key, the newest by micro-batch: a repeated batch changes nothing,
    and the table grows with keys only. sources.files.read_state reads it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept_states(batch.sparkSession, path).upsert(batch.withColumn("batch", F.lit(batch_id).cast("long")), ["key"], ["batch", "tested"])

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
