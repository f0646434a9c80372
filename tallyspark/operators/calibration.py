"""Calibration tables: scores(key, score), gaps(key, gap, canonical), margins(model, margin), meta(key, settings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import stats
from tallyspark.functions.tokens import calibration_key


def thresholds(scores: DataFrame, alpha: float) -> DataFrame:
    """(key, n, k, tau): the k-th smallest score, k = floor(alpha (n + 1)); minus infinity where k is 0.

    Equal scores are counted before they are ordered, so a key's window has one row per distinct score.
    """
    n = scores.groupBy("key").agg(F.count("score").alias("n")).withColumn("k", stats.order_index(F.col("n"), alpha))
    c = scores.groupBy("key", "score").agg(F.count(F.lit(1)).alias("times"))
    up_to = F.sum("times").over(Window.partitionBy("key").orderBy("score"))
    reached = c.withColumn("up_to", up_to).join(n, "key").where(F.col("up_to") >= F.col("k")).groupBy("key").agg(F.min("score").alias("s"))
    return n.join(reached, "key", "left").select("key", "n", "k", F.when(F.col("k") > 0, F.col("s")).otherwise(F.lit(float("-inf"))).alias("tau"))


def trusted(audit: DataFrame, model: str | None, host: str | None, since: float, until: float) -> DataFrame:
    """Audited responses that may calibrate counts: shadow bill known, one uncut choice, no alert, inside the period (inclusive)."""
    a = audit.where(F.col("shadow") & (F.size("choices") == 1) & ~F.col("choices")[0]["capped"] & (F.col("status") != "alert") & F.col("time").between(since, until))
    a = a if model is None else a.where(F.col("model") == model)
    return a if host is None else a.where(F.col("host") == host)


def gaps(audit: DataFrame) -> DataFrame:
    return audit.select(calibration_key(F.col("model"), F.col("choices")[0]["language"]).alias("key"), (F.col("billed") - F.col("canonical")).alias("gap"), "canonical")


def gap_rule(gaps: DataFrame) -> DataFrame:
    """(key, n, max_gap, level): a gap above every honest one is rejected, at level 1 / (n + 1)."""
    return gaps.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), (1 / (F.count(F.lit(1)) + 1)).alias("level"))


def applicability(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds reason: why a calibration's settings don't apply to a row, null if they do or none are recorded; and warnings."""
    m = meta.select("key", *[F.col(c).alias(f"_m_{c}") for c in ("tokenizer", "scorer", "temperature", "top_p", "system")], F.lit(True).alias("_known"))
    j = rows.join(m, "key", "left")  # settings: one row per key by construction (see conflicts)
    reason = (
        F.when(F.col("_known").isNull(), F.lit(None))
        .when(~F.col("tokenizer").eqNullSafe(F.col("_m_tokenizer")), F.lit("tokenizer"))
        .when(F.col("scorer").isNotNull() & ~F.col("scorer").eqNullSafe(F.col("_m_scorer")), F.lit("scorer"))
        .when(~(F.col("temperature").eqNullSafe(F.col("_m_temperature")) & F.col("top_p").eqNullSafe(F.col("_m_top_p"))), F.lit("sampling"))
    )
    warning = F.when(F.col("_known").isNull(), F.lit("no_settings")).when(reason.isNull() & ~F.col("system").eqNullSafe(F.col("_m_system")), F.lit("system_prompt"))
    return j.select(*rows.columns, reason.alias("reason"), warning.alias("warning"))


def conflicts(meta: DataFrame) -> DataFrame:
    """Keys that were given different settings: such a calibration is refused."""
    settings = F.to_json(F.struct("tokenizer", "scorer", "temperature", "top_p", "system"), {"ignoreNullFields": "false"})
    return meta.groupBy("key").agg(F.count_distinct(settings).alias("settings")).where("settings > 1")


def noise_margins(replicates: DataFrame) -> DataFrame:
    """(model, margin): largest difference between two scores of the same window, at least 0."""
    two = replicates.groupBy("model", "window").agg((F.max("score") - F.min("score")).alias("apart"))
    return two.groupBy("model").agg(F.greatest(F.lit(0.0), F.max("apart")).alias("margin"))


def size_warnings(scores: DataFrame, alpha: float, tolerance: float) -> DataFrame:
    """Per key whether its calibration is too small for alpha to be reached, or risks rejecting honest responses too often."""
    n = scores.groupBy("key").agg(F.count("score").alias("n"))
    risk = stats.excess_risk(F.col("n"), F.lit(alpha), F.lit(alpha * tolerance))
    n = n.withColumn("k", stats.order_index(F.col("n"), alpha)).withColumn("risk", risk)
    return n.withColumn("warning", F.when(F.col("k") == 0, "never_rejects").when(F.col("risk") > 0.01, "risky"))


def decision(llr: Column, tau: Column, spans: Column, margin: Column) -> Column:
    cut = F.least(tau, F.lit(0.0)) - spans * F.coalesce(margin, F.lit(0.0))
    return F.when(tau.isNull(), "uncalibrated").when(llr < cut, "reject").otherwise("pass")
