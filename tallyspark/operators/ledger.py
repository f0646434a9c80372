"""Ledger analytics: billed against canonical tokens, by cell (provider, model).

A ledger has provider, model, block, prompt, max_tokens, billed, canonical, finish_reason, reasoning_text, response_text.
Every operator is one grouped aggregation, so rows are combined before the shuffle and a frequent cell costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import stats
from tallyspark.functions.tokens import identity_overhead

CELL = ["provider", "model"]
ALPHA, LEAST_ROWS = 0.05, 30
#: Deltas that one array of a histogram holds.
STEP = 10_000


def delta() -> Column:
    return F.col("billed") - F.col("canonical")


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def informative(ledger: DataFrame) -> DataFrame:
    """Rows not billed exactly at their cap; rows above it stay."""
    return ledger.where(F.col("billed") != F.col("max_tokens"))


def cell_report(ledger: DataFrame, keys: list[str] = CELL) -> DataFrame:
    d = delta()
    return ledger.where(d.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(d)).alias("mean_delta"), F.median(d).cast("double").alias("median_delta"),
        r6(share(d > 0)).alias("share_above"), r6(share(d < 0)).alias("share_below"), r6(share(d == 0)).alias("share_exact"),
        F.min(d).alias("min_delta"), F.max(d).alias("max_delta"))


def cell_mde(ledger: DataFrame, floor: float = 0.01, least_rows: int = 10) -> DataFrame:
    """Minimum detectable effect per cell of least_rows informative rows or more, in tokens and as a share of the mean bill, and whether the mean is above."""
    d = delta()
    a = informative(ledger).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.avg("billed").alias("bill"))
    m = stats.mde(F.col("sd"), F.col("n"), floor)
    return a.where(F.col("n") >= least_rows).select(*CELL, "n", r6(F.col("mean")).alias("mean_delta"), r6(m).alias("mde_tokens"), r6(100 * m / F.nullif(F.col("bill"), F.lit(0.0))).alias("mde_percent"), (F.col("mean") > m).alias("above_mde"))


def simultaneous_bounds(ledger: DataFrame, alpha: float = ALPHA, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One-sided upper bound per cell that holds for all cells at once; cells count for the correction even when skipped."""
    d = delta()
    c = informative(ledger).groupBy("block", *CELL).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.avg("billed").alias("bill"))
    c = c.withColumn("cells", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # a row for each cell
    z = stats.norm_ppf(1 - F.lit(alpha) / F.col("cells"))
    bound = F.col("mean") + z * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return c.where(F.col("n") >= least_rows).select(
        "block", *CELL, "n", "cells", r6(F.col("mean")).alias("mean_delta"), r6(bound).alias("upper_bound"),
        r6(100 * bound / F.nullif(F.col("bill"), F.lit(0.0))).alias("upper_percent"))


def worst_bound(bounds: DataFrame) -> DataFrame:
    return bounds.agg(F.count(F.lit(1)).alias("cells_reported"), F.greatest(F.lit(0.0), F.coalesce(F.max("upper_percent"), F.lit(0.0))).alias("worst_percent"))


def delta_histogram(ledger: DataFrame) -> DataFrame:
    """Count of every whole delta between a cell's smallest and largest, zeros included."""
    n = ledger.where(delta().isNotNull()).groupBy(*CELL, delta().alias("delta")).agg(F.count(F.lit(1)).alias("n"))
    # from each delta up to the next one, in steps, so that one far outlier makes no long array
    last = F.coalesce(F.lead("delta").over(Window.partitionBy(*CELL).orderBy("delta")) - 1, F.col("delta"))
    n = n.withColumn("last", last).withColumn("from", F.explode(F.sequence("delta", "last", F.lit(STEP).cast("long"))))
    x = n.withColumn("x", F.explode(F.sequence("from", F.least(F.col("from") + STEP - 1, F.col("last")))))
    return x.select(*CELL, F.col("x").alias("delta"), F.when(F.col("x") == F.col("delta"), F.col("n")).otherwise(0).cast("long").alias("n"))


def length_scaling(ledger: DataFrame, width: int = 250) -> DataFrame:
    """Whether deltas grow with length: per bucket of billed tokens the mean delta, also per hundred billed."""
    b = F.floor(F.col("billed") / width).alias("bucket")
    return informative(ledger).groupBy(b).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(delta())).alias("mean_delta"),
        r6(100 * F.avg(delta()) / F.nullif(F.avg("billed"), F.lit(0.0))).alias("delta_percent"))


def shape(ledger: DataFrame) -> DataFrame:
    """Population skewness and excess kurtosis per cell; two bimodality coefficients, as published and Sarle's own; null without spread."""
    d = delta().cast("double")
    a = informative(ledger).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.skewness(d).alias("s"), F.kurtosis(d).alias("k"), F.stddev_pop(d).alias("sd")).where("n > 3")
    n = F.col("n").cast("double")
    extra = 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    top = F.col("s") * F.col("s") + 1
    spread = F.col("sd") > 0
    return a.select(
        *CELL, "n", r6(F.when(spread, F.col("s"))).alias("skew"), r6(F.when(spread, F.col("k"))).alias("excess_kurtosis"),
        r6(F.when(spread, top / (F.col("k") + 3 + extra))).alias("bc_published"), r6(F.when(spread, top / (F.col("k") + extra))).alias("bc_standard"))


def block_rollup(ledger: DataFrame) -> DataFrame:
    """Records, above-cap records and sums for cells, blocks and the whole in one pass."""
    return ledger.rollup("block", *CELL).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("billed") > F.col("max_tokens")).alias("above_cap"),
        F.count_if(F.col("billed") == F.col("max_tokens")).alias("at_cap"), F.sum("billed").alias("billed"), F.sum(delta()).alias("delta"),
        F.grouping_id().cast("int").alias("level"))


def duplicate_prompts(ledger: DataFrame, expected: int = 200) -> DataFrame:
    """Repeated prompts per cell (a null prompt is one value), missing fields, and whether the cell has the expected rows."""
    distinct = F.count_distinct("prompt") + F.max(F.col("prompt").isNull().cast("long"))
    return ledger.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - distinct).alias("duplicates"), F.count_if(F.col("billed").isNull()).alias("billed_nulls"),
        F.count_if(F.col("finish_reason").isNull()).alias("finish_nulls"), (F.count(F.lit(1)) == expected).alias("complete"))


def prompt_sets(ledger: DataFrame) -> DataFrame:
    """How many cells share each set of prompts: an order-free fingerprint of 192 bits over distinct prompts, so no set is gathered."""
    distinct = ledger.select(*CELL, "prompt").distinct()
    parts = [F.conv(F.substring(F.sha2(F.col("prompt"), 256), at, 12), 16, 10).cast("long") for at in (1, 13, 25, 37)]
    per = distinct.groupBy(*CELL).agg(F.count("prompt").alias("prompts"), *[F.sum(p).cast("string").alias(f"f{k}") for k, p in enumerate(parts)])
    per = per.withColumn("fingerprint", F.concat_ws("-", "f0", "f1", "f2", "f3"))
    return per.groupBy("prompts", "fingerprint").agg(F.count(F.lit(1)).alias("cells"))


def overcap(ledger: DataFrame) -> DataFrame:
    over = F.col("billed") - F.col("max_tokens")
    return ledger.where(over > 0).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("billed").alias("billed"), F.median(over).cast("double").alias("median_over"), F.max(over).alias("max_over"))


def cap_position(ledger: DataFrame) -> DataFrame:
    b, c = F.col("billed"), F.col("max_tokens")
    return ledger.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(b < c).alias("under"), F.count_if(b == c).alias("pinned"), F.count_if(b > c).alias("over"))


def exclusion_reasons(ledger: DataFrame, config: DataFrame) -> DataFrame:
    """Why rows can't be recounted, first reason only; cells that the configuration dropped disappear silently."""
    c = config.where("not stale").select("provider", "model", F.lit(True).alias("_known"))
    known = ledger.join(config.where("stale").select(*CELL), CELL, "left_anti").join(c, CELL, "left")
    reason = (
        F.when(F.col("_known").isNull(), "unknown_cell").when(F.col("finish_reason").isNull(), "no_finish_reason")
        .when(F.col("reasoning_text").isNull(), "no_reasoning_text").when(F.col("billed").isNull(), "no_bill").otherwise("kept"))
    return known.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def accounting_identity(ledger: DataFrame) -> DataFrame:
    """visible + disclosed reasoning + overhead against the bill; rows below the cap count for the mean."""
    expected = F.col("visible") + F.col("reasoning_tokens") + identity_overhead(F.col("reasoning_tokens"))
    d = F.col("billed") - expected
    return ledger.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(d == 0).alias("exact"), F.count_if(d != 0).alias("off"),
        r6(F.avg(F.when(F.col("billed") < F.col("max_tokens"), d))).alias("mean_delta"))


def two_channel(ledger: DataFrame) -> DataFrame:
    """Thought and answer channels apart: exact rows, deltas, and whether prompt, answer and thought add up to the total."""
    adds = F.col("prompt_tokens") + F.col("billed_answer") + F.col("billed_thought") == F.col("total_tokens")
    channels = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(f"billed_{c}").alias("billed"), F.col(f"canonical_{c}").alias("canonical")) for c in ("answer", "thought")])
    long = ledger.select("model", adds.alias("adds"), F.inline(channels))
    d = F.col("billed") - F.col("canonical")
    return long.groupBy("model", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(d == 0).alias("exact"), r6(F.avg(d)).alias("mean_delta"), F.sum(d).alias("sum_delta"),
        F.count_if("adds").alias("reconciled"), F.sum("billed").alias("billed"))


def hidden_share(ledger: DataFrame) -> DataFrame:
    """Per model the share of billed tokens that the thought channel holds."""
    both = F.sum("billed_thought") + F.sum("billed_answer")
    return ledger.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("billed_thought").alias("hidden"), r6(F.sum("billed_thought") / F.nullif(both, F.lit(0))).alias("share"))


def split_parts(parts: Column) -> Column:
    """struct(thought, answer): texts of the parts marked as thought, and of the others."""
    def joined(flag: bool) -> Column:
        kept = F.filter(parts, lambda p: F.coalesce(p["thought"], F.lit(False)) == F.lit(flag))
        return F.array_join(F.transform(kept, lambda p: F.coalesce(p["text"], F.lit(""))), "")

    return F.struct(joined(True).alias("thought"), joined(False).alias("answer"))


def reconciliation(usage: DataFrame) -> DataFrame:
    """total - prompt - completion (- reasoning where it is billed on top), per target; null where no total is published."""
    hidden = F.col("total") - F.col("prompt") - F.col("completion") - F.when(F.col("additive"), F.coalesce("reasoning", F.lit(0).cast("long"))).otherwise(F.lit(0))
    hidden = F.when(~F.coalesce("no_total", F.lit(False)), hidden)
    return usage.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hidden == 0).alias("reconciled"), F.median(hidden).cast("double").alias("median_hidden"),
        F.count_if(F.col("reasoning").isNull()).alias("reasoning_absent"), F.count_if(F.col("reasoning") > 0).alias("reasoning_positive"),
        F.count_if(F.col("reasoning") == 0).alias("reasoning_zero"), F.count_if(F.col("logprob_entries") == F.col("completion")).alias("entries_agree"))


def observed(direct: DataFrame) -> DataFrame:
    """Direct observation: F = billed - returned entries, and whether the streamed text covers what was parsed."""
    stream, reasoning, text = F.col("stream"), F.coalesce("reasoning", F.lit("")), F.coalesce("text", F.lit(""))
    parsed = F.length(reasoning) + F.length(text)
    complete = (
        ((reasoning == "") | F.contains(stream, reasoning)) & ((text == "") | F.contains(stream, text)) & (F.length(stream) >= parsed)
    )
    return direct.select(
        "*", (F.col("billed") - F.col("entries")).alias("f"), (F.length(stream) - parsed).alias("structural_chars"),
        (stream == F.concat(reasoning, text)).alias("stream_equals_parsed"), complete.alias("stream_complete"))


def completeness(direct: DataFrame) -> DataFrame:
    o = observed(direct)
    return o.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("stream_complete").alias("complete"), F.count_if(F.col("stream_complete") & (F.col("f") != 0)).alias("nonzero"),
        F.count_if(F.col("stream_complete") & (F.col("structural_chars") < 0)).alias("leaks"), F.sum(F.when(F.col("stream_complete"), F.col("entries"))).alias("generated"))


def recompute_errors(direct: DataFrame) -> DataFrame:
    """Rows per cell whose stored figures (stored_f, stored_complete) are not what their texts and counts give."""
    o = observed(direct)
    wrong = ~F.col("stored_f").eqNullSafe(F.col("f")) | ~F.col("stored_complete").eqNullSafe(F.col("stream_complete"))
    return o.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"))


def pinned_summary(ledger: DataFrame) -> DataFrame:
    """Delta of requests that one backend answered: rows, mean, least and most."""
    d = delta()
    return ledger.where(d.isNotNull()).groupBy("backend").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(d)).alias("mean_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"))


def informative_share(ledger: DataFrame) -> DataFrame:
    b, c = F.col("billed"), F.col("max_tokens")
    return ledger.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count_if(b != c).alias("informative"), F.count_if(b < c).alias("informative_strict"), r6(share(b != c)).alias("share"))


def variant_best(scored: DataFrame) -> DataFrame:
    """Per cell the variant with most exact rows, then the smallest absolute mean, then the first; ok if at most one row is off."""
    v = scored.groupBy("cell", "variant", "nth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta") == 0).alias("exact"), F.avg("delta").alias("mean"))
    best = v.groupBy("cell").agg(F.max_by(F.struct("variant", "n", "exact", "mean"), F.struct("exact", -F.abs("mean"), -F.col("nth"))).alias("b"))
    return best.select("cell", "b.variant", "b.n", "b.exact", r6(F.col("b.mean")).alias("mean_delta"), (F.col("b.exact") >= F.col("b.n") - 1).alias("ok"))


def headroom(texts: DataFrame, low: int = 40, high: int = 800) -> DataFrame:
    """How far a bill could be padded by splitting into characters: tokens of single characters against canonical tokens, median per cell."""
    from tallyspark.functions.tokens import token_count

    t = texts.where(F.length("text").between(low, high)).withColumn("whole", token_count(F.col("text")))
    # one character is one token here, so the character split has as many tokens as characters
    surface = F.length("text") / F.col("whole") - 1
    return t.where("whole > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), r6(F.median(surface)).alias("median_surface"), r6(F.min(surface)).alias("min_surface"))


def integrity(ledger: DataFrame, expected: int = 200) -> DataFrame:
    """(check, cell, problem) rows from the per-cell checks, of which the ledger is grouped once."""
    d = duplicate_prompts(ledger, expected).withColumn("cell", F.concat_ws("/", *CELL))
    checks = (("duplicate_prompts", F.col("duplicates") > 0, "duplicates"), ("row_count", ~F.col("complete"), "n"), ("billed_null", F.col("billed_nulls") > 0, "billed_nulls"))
    found = [F.when(bad, F.struct(F.lit(name).alias("check"), F.col(of).cast("string").alias("problem"))) for name, bad, of in checks]
    return d.select("cell", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull()))).select("check", "cell", "problem")


def budget(config: DataFrame, done: DataFrame, prompts: int, limit: int = 2_000) -> DataFrame:
    """Requests still planned: runnable cells times prompts, less those recorded; and whether that passes the limit."""
    cells = config.where("reasoning_format <> 'unresolved'").agg(F.count(F.lit(1)).alias("cells"))
    have = done.agg(F.count(F.lit(1)).alias("done"))
    planned = F.col("cells") * prompts - F.col("done")
    return cells.crossJoin(F.broadcast(have)).select("cells", "done", planned.alias("planned"), (planned > limit).alias("over_budget"))
