"""Summaries of an audit log by (host, model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.stats import binom_sf

BY = ["host", "model"]


def summary(audit: DataFrame) -> DataFrame:
    """Responses, statuses, mismatches (responses and distinct offsets) and the shadow bill."""
    a = audit.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("responses"), F.count_if(F.col("status") == "alert").alias("alerts"), F.count_if(F.col("status") == "unverifiable").alias("unverifiable"),
        F.count("billed_minus_reported").alias("mismatched_responses"), F.count_distinct("billed_minus_reported").alias("distinct_offsets"),
        F.sum(F.when(F.col("shadow"), F.col("billed"))).alias("shadow_billed"), F.sum(F.when(F.col("shadow"), F.col("canonical"))).alias("shadow_canonical"))
    b, c = F.coalesce("shadow_billed", F.lit(0).cast("long")), F.coalesce("shadow_canonical", F.lit(0).cast("long"))
    return a.withColumns({"shadow_billed": b, "shadow_canonical": c}).withColumn("shadow_percent", F.round(100 * (b - c) / F.greatest(b, F.lit(1)), 6))


def findings_histogram(audit: DataFrame) -> DataFrame:
    return audit.select(*BY, F.explode("findings").alias("finding")).groupBy(*BY, "finding").agg(F.count(F.lit(1)).alias("n"))


def skip_histogram(audit: DataFrame) -> DataFrame:
    return audit.where("count_skipped is not null").groupBy(*BY, "count_skipped").agg(F.count(F.lit(1)).alias("n"))


def offset_histogram(audit: DataFrame) -> DataFrame:
    return audit.where("billed_minus_reported is not null").groupBy(*BY, "billed_minus_reported").agg(F.count(F.lit(1)).alias("n"))


def likelihood(audit: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Tested and rejected choices with what chance explains, choices left untested, and the extra share if all of it were padding."""
    c = audit.select(*BY, F.explode("choices").alias("c")).select(*BY, "c.*")
    reject, decided = F.col("verdict") == "reject", F.col("verdict").isin("pass", "reject")
    extra = F.sum(F.when(reject, F.greatest(F.lit(0), F.col("answer") - F.col("canonical"))).otherwise(0))
    a = c.groupBy(*BY).agg(
        F.count_if(decided).alias("tested"), F.count_if(reject).alias("rejected"), F.count_if(F.col("verdict").isNotNull() & ~decided).alias("untested"),
        F.round(extra / F.greatest(F.sum(F.when(decided, F.col("answer"))), F.lit(1)), 9).alias("extra_share"))
    return a.withColumn("expected", F.round(F.col("tested") * alpha, 6))


def with_tail(summary: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Adds the chance of so many rejections from an honest endpoint."""
    return summary.withColumn("tail", binom_sf("rejected", "tested", F.lit(alpha)))


def endpoint_state(audit_keys: DataFrame, state: DataFrame) -> DataFrame:
    """Monitor state of each (host, model): keys are taken apart once (kind, host, model, language), then joined by equality."""
    parts = F.split("key", r"\|")
    kind = F.when(F.startswith("key", F.lit("request|")) | F.startswith("key", F.lit("batch|")), parts[0]).otherwise("likelihood")
    at = F.when(kind == "likelihood", 0).otherwise(1)
    s = state.select("*", kind.alias("kind"), F.get(parts, at).alias("host"), F.get(parts, at + 1).alias("model"))
    return audit_keys.select(*BY).distinct().join(s, BY)


def text_report(summary: DataFrame) -> str:
    """A few lines per endpoint, for people; the only place where rows come to the driver (one per endpoint)."""
    lines = []
    for r in summary.orderBy(*BY).toLocalIterator():
        lines.append(f"{r['host']} {r['model']}: {r['responses']} responses, {r['alerts']} alerts, {r['unverifiable']} unverifiable")
        lines.append(f"  billed != returned in {r['mismatched_responses']} responses ({r['distinct_offsets']} offsets); shadow bill {r['shadow_percent']:+.2f}%")
    return "\n".join(lines)
