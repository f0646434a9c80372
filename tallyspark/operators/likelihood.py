"""The likelihood test: log probability ratios of windows around divergent spans, and ids that only a scorer can tell apart.

A window is some ids after a context of others; its score is the log probability of the former given the latter. Windows are
rows keyed by a digest of what they hold, so the same window of many responses is scored once, and a store keeps what has been
scored for later runs. A scorer takes windows (key, replicate, repeat, model, context, body) and returns (key, replicate,
repeat, score); a null or missing score makes what depends on it unverifiable and is asked for again next time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import align
from tallyspark.operators.calibration import noise_margins
from tallyspark.sources import store as files

Scorer = Callable[[DataFrame], DataFrame]
#: Ambiguous positions of a reading that are resolved by scores; with more the choice is unverifiable.
MAX_AMBIGUOUS = 8
BOUNDS = "spans array<struct<start:bigint,a_lo:int,a_hi:int,b_lo:int,b_hi:int>>"
WINDOW = "key string, replicate int, repeat int, score double"


@dataclass(frozen=True)
class Settings:
    """Ids of context before a span, ids after it that are scored with it, and calls for a window, of which the median counts."""

    context: int = 32
    suffix: int = 8
    repeats: int = 3

    def fingerprint(self, scorer: str) -> str:
        """What a calibration and an audit must share."""
        return json.dumps({"scorer": scorer} | asdict(self), sort_keys=True)


def window_key(model: Column, context: Column, body: Column) -> Column:
    ids = [F.array_join(x.cast("array<string>"), ",") for x in (context, body)]
    return F.sha2(F.concat_ws("|", model, *ids), 256)


class WindowStore:
    """Scores of windows in a folder (one of the session's own if none is given)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or files.shared_dir(spark) + "/windows"

    def scores(self) -> DataFrame:
        if not files.exists(self.spark, self.path):
            return self.spark.createDataFrame([], WINDOW)
        return self.spark.read.schema(WINDOW).parquet(self.path)

    def fill(self, windows: DataFrame, scorer: Scorer, repeats: int, replicates: int = 1) -> None:
        """Scores what is not known yet of windows (key, model, context, body), each window once however often it comes."""
        each = windows.groupBy("key").agg(F.first(F.struct("model", "context", "body")).alias("w")).select("key", "w.*")
        calls = each.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        new = calls.join(self.scores().select("key", "replicate", "repeat"), ["key", "replicate", "repeat"], "left_anti") if files.exists(self.spark, self.path) else calls
        got = scorer(files.stored(new)).select("key", F.col("replicate").cast("int"), F.col("repeat").cast("int"), F.col("score").cast("double")).where("score is not null")
        files.add_batch(got, self.path)

    def medians(self) -> DataFrame:
        """(key, replicate, score): the median over repeats. A call that two batches have made counts once."""
        one = self.scores().repartition("key").groupBy("key", "replicate", "repeat").agg(F.min("score").alias("score"))  # dealt once
        return one.groupBy("key", "replicate").agg(F.median("score").alias("score"))


def id_scorer(scores: DataFrame) -> Scorer:
    """A scorer without context, from (model, token_id, logprob)."""

    def score(windows: DataFrame) -> DataFrame:
        ids = windows.select("key", "replicate", "repeat", "model", F.explode("body").alias("token_id"))
        return _summed(ids.join(scores, ["model", "token_id"], "left"))

    return score


def pair_scorer(scores: DataFrame, unseen: float | None = None) -> Scorer:
    """A scorer by the id before each one, from (model, before, token_id, logprob); pairs it doesn't have score `unseen`."""

    def score(windows: DataFrame) -> DataFrame:
        last = F.try_element_at("context", F.lit(-1))
        pairs = F.transform("body", lambda x, at: F.struct(F.when(at == 0, F.col("_last")).otherwise(F.get("body", at - 1)).alias("before"), x.alias("token_id")))
        ids = windows.withColumn("_last", last).select("key", "replicate", "repeat", "model", F.inline(pairs))  # rows of ids leave their window behind
        return _summed(ids.join(scores, ["model", "before", "token_id"], "left").withColumn("logprob", F.coalesce("logprob", F.lit(unseen).cast("double"))))

    return score


def _summed(ids: DataFrame) -> DataFrame:
    known = F.count("logprob") == F.count(F.lit(1))
    return ids.groupBy("key", "replicate", "repeat").agg(F.when(known, F.sum("logprob")).alias("score"))


def _replaced(ids: Column, at: Column, value: Column) -> Column:
    return F.transform(ids, lambda x, i: F.when(i == at, value).otherwise(x))


def resolved(readings: DataFrame, store: WindowStore, scorer: Scorer, settings: Settings = Settings(), limit: int = MAX_AMBIGUOUS) -> DataFrame:
    """Adds ids and unclear to readings (id, model, candidates, newline): at each ambiguous position the most probable candidate.

    Positions are settled from the first on, one a round for all readings at once, so each one's context holds those settled
    before; behind it stand the first candidates. Of equals the first candidate counts. Readings with more than `limit` such
    positions, or with a candidate that could not be scored, are unclear; their ids are those of first candidates from there on.
    """
    open_ = F.filter(F.transform("candidates", lambda c, i: F.when(F.size(c) > 1, i)), lambda i: i.isNotNull())
    state = readings.withColumns({"ids": F.transform("candidates", lambda c: c[0]), "_open": open_})
    state = files.stored(state.withColumn("unclear", F.size("_open") > limit))
    rounds = state.where(~F.col("unclear")).agg(F.max(F.size("_open"))).first()[0] or 0
    for k in range(rounds):
        at = F.get("_open", F.lit(k))
        w = align.window_around(F.col("ids"), F.col("at"), F.col("at"), settings.context, settings.suffix + 1)
        now = state.where(~F.col("unclear") & at.isNotNull()).withColumn("at", at).withColumn("w", w)
        context = F.when(F.size("w.context") > 0, F.col("w.context")).otherwise(F.col("newline"))
        tail = F.slice("w.tail", F.lit(2), F.lit(settings.suffix))
        now = now.select("id", "model", context.alias("context"), tail.alias("tail"), F.posexplode(F.get("candidates", at)).alias("nth", "token_id"))
        now = now.withColumn("body", F.concat(F.array("token_id"), "tail"))
        now = files.stored(now.withColumn("key", window_key(F.col("model"), F.col("context"), F.col("body"))))
        store.fill(now, scorer, 1)
        # one call, whatever else the store has of the window
        one = store.scores().where("replicate = 0 and repeat = 0").groupBy("key").agg(F.min("score").alias("score"))
        best = now.join(one, "key", "left").groupBy("id").agg(
            F.max_by("token_id", F.struct("score", -F.col("nth"))).alias("_best"), F.bool_or(F.col("score").isNull()).alias("_missing"))
        state = state.join(best, "id", "left")
        state = state.withColumn("ids", F.when(F.coalesce(~F.col("_missing"), F.lit(False)), _replaced(F.col("ids"), at, F.col("_best"))).otherwise(F.col("ids")))
        state = files.stored(state.withColumn("unclear", F.col("unclear") | F.coalesce("_missing", F.lit(False))).drop("_best", "_missing"))
    return state.drop("_open")


def _with_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("spans", align.divergent_bounds(*(b.column(c) for c in ("ids", "bytes", "canonical_ids", "canonical_bytes"))))


def windows(reports: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id, span, side, key, model, context, body): two windows for each divergent span of reports.

    reports has (id, model, ids, bytes, canonical_ids, canonical_bytes, newline): ids of either encoding of the same bytes, the
    number of bytes of each, and the ids of a line break, which stand for an empty context. Spans are found within the row, and
    only slices of it leave it.
    """
    own = reports.select("id", "model", "newline", "ids", "bytes", "canonical_ids", "canonical_bytes")
    own = own.mapInArrow(_with_bounds, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", " + BOUNDS)
    own = own.select("id", "model", "ids", "canonical_ids", "newline", F.inline("spans"))
    part = lambda ids, lo, hi: F.slice(ids, F.col(lo) + 1, F.col(hi) - F.col(lo))
    w = own.withColumn("w", align.window_around(F.col("canonical_ids"), F.col("b_lo"), F.col("b_hi"), settings.context, settings.suffix))
    w = w.select(
        "id", "model", F.col("start").alias("span"), F.when(F.size("w.context") > 0, F.col("w.context")).otherwise(F.col("newline")).alias("context"),
        F.concat(part("ids", "a_lo", "a_hi"), "w.tail").alias("reported"), F.concat(part("canonical_ids", "b_lo", "b_hi"), "w.tail").alias("canonical"))
    both = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("body")) for side in ("reported", "canonical")])
    w = w.select("id", "model", "span", "context", F.inline(both))
    return w.withColumn("key", window_key(F.col("model"), F.col("context"), F.col("body")))


def ratios(reports: DataFrame, store: WindowStore, scorer: Scorer, settings: Settings = Settings()) -> DataFrame:
    """(id, llr, spans): reported less canonical window scores, summed over divergent spans; llr is null where a score is missing.

    Reports without a divergent span have no row.
    """
    w = files.stored(windows(reports, settings))
    store.fill(w, scorer, settings.repeats)
    known = store.medians().where("replicate = 0").select("key", "score")
    scores = w.join(known, "key", "left")
    signed = F.when(F.col("side") == "reported", F.col("score")).otherwise(-F.col("score"))
    whole = F.count("score") == F.count(F.lit(1))
    return scores.groupBy("id").agg(F.when(whole, F.sum(signed)).alias("llr"), F.count_if(F.col("side") == "reported").cast("int").alias("spans"))


def margins(reports: DataFrame, store: WindowStore, scorer: Scorer, settings: Settings = Settings()) -> DataFrame:
    """(model, margin): the largest difference between two independent scores of the same reported window, each a median of its repeats."""
    w = files.stored(windows(reports, settings).where("side = 'reported'").select("key", "model", "context", "body"))
    store.fill(w, scorer, settings.repeats, replicates=2)
    models = w.select("key", "model").distinct()
    twice = store.medians().where("replicate < 2").join(models, "key").select("model", F.col("key").alias("window"), "score")
    return noise_margins(twice)
