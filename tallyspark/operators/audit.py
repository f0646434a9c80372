"""The audit of one response per row: choice verdicts and record checks, all inside the row, without a shuffle.

A captured row has host, time, model, response_id, billed, max_tokens, reasoning_tokens, channels (whether its tokenizer has
a channel token) and choices: index, language, reported, answer, canonical, array ('content', 'full' or null), reasoning,
capped, tool_calls, readings (number of alignments, null for too many), token_mismatch, noncanonical, llr, spans.
Unknown is null throughout and differs from 0 and false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import decision


def projected(captured: DataFrame, *more: str | Column) -> DataFrame:
    """Flat fields of raw requests and responses: model, cap, bill, number of choices, hidden reasoning, sampling, system hash; and `more`."""
    from tallyspark.functions.tokens import system_hash

    q, a = F.col("request"), F.col("response")
    cap = F.coalesce(F.nullif(q["max_completion_tokens"], F.lit(0)), q["max_tokens"])
    model = F.coalesce(F.nullif(q["model"], F.lit("")), F.nullif(a["model"], F.lit("")), F.lit("?"))
    return captured.select(
        *more, "host", "time", model.alias("model"), a["id"].alias("response_id"), a["usage"]["completion_tokens"].alias("billed"), cap.alias("max_tokens"),
        F.greatest(F.size(F.coalesce(a["choices"], F.array())), F.lit(1)).alias("n"),
        F.coalesce(a["usage"]["completion_tokens_details"]["reasoning_tokens"], F.lit(0).cast("long")).alias("reasoning_tokens"),
        F.coalesce(q["temperature"], F.lit(1.0)).alias("temperature"), F.coalesce(q["top_p"], F.lit(1.0)).alias("top_p"),
        system_hash(q["messages"]).alias("system"))


def ladder(c: Column) -> Column:
    """Verdict before the likelihood test; null where there is no token array, or where the test has to decide."""
    return (
        F.when(c["reported"].isNull(), F.lit(None))
        .when(c["tool_calls"], F.lit("unverifiable")).when(c["array"].isNull(), F.lit("unverifiable"))
        .when(c["readings"].isNull(), F.lit("unverifiable")).when(c["canonical"].isNull(), F.lit("unverifiable"))
        .when(c["capped"], F.lit("capped")).when(c["token_mismatch"], F.lit("unverifiable")))


def tested(c: Column) -> Column:
    """Whether the ladder leaves the choice to the likelihood test."""
    return c["reported"].isNotNull() & ladder(c).isNull()


def verdict(c: Column, noncanonical: Column, llr: Column, spans: Column, tau: Column, margin: Column, unresolved: Column | None = None) -> Column:
    """The ladder's verdict, else the test's. A canonical report scores 0 without asking a scorer; without a threshold nothing
    is resolved, so that comes first."""
    by_test = decision(F.when(noncanonical, llr).otherwise(F.lit(0.0)), tau, F.when(noncanonical, spans).otherwise(F.lit(0)), margin)
    if unresolved is not None:
        by_test = F.when(tau.isNotNull() & unresolved, F.lit("unverifiable")).otherwise(by_test)
    return F.when(tested(c), by_test).otherwise(ladder(c))


def judged(captured: DataFrame, tau: Column | None = None, margin: Column | None = None) -> DataFrame:
    """Adds a verdict to every choice, by one threshold and margin (see exchange.calibrated for those of each key)."""
    tau = F.lit(None).cast("double") if tau is None else tau
    margin = F.lit(0.0) if margin is None else margin

    def judge(c: Column) -> Column:
        return c.withField("verdict", verdict(c, c["noncanonical"], c["llr"], c["spans"], tau, margin))

    return captured.withColumn("choices", F.transform("choices", judge))


def every(items: Column, test) -> Column:  # noqa: ANN001
    return (F.size(items) > 0) & F.forall(items, test)


def checked(captured: DataFrame, over_cap: Column | bool = True, count_mismatch: Column | bool = True) -> DataFrame:
    """Adds reported, canonical, hidden, shadow, count_skipped, billed_minus_reported, findings and status to judged rows."""
    over_cap, count_mismatch = (x if isinstance(x, Column) else F.lit(x) for x in (over_cap, count_mismatch))
    ch, billed, cap = F.col("choices"), F.col("billed"), F.col("max_tokens")
    zero = F.lit(0).cast("long")

    def total(field: str) -> Column:
        return F.when(every(ch, lambda c: c[field].isNotNull()), F.aggregate(ch, zero, lambda s, c: s + c[field]))

    d = captured.withColumn("n", F.greatest(F.size(ch), F.lit(1))).withColumn("reported", total("reported")).withColumn("canonical", total("canonical"))
    hidden = (F.coalesce("reasoning_tokens", zero) > 0) | F.coalesce("channels", F.lit(False)) | F.exists(ch, lambda c: F.coalesce(c["reasoning"], F.lit(False)))
    d = d.withColumn("hidden", hidden).withColumn("shadow", billed.isNotNull() & F.col("canonical").isNotNull() & ~F.col("hidden"))
    skipped = (
        F.when(F.col("reported").isNull(), "no_logprobs").when(~F.forall(ch, lambda c: c["array"].isNotNull()), "unaligned")
        .when(F.col("hidden") & F.exists(ch, lambda c: c["array"] == "content"), "billed_tokens_outside_logprobs").when(billed.isNull(), "no_usage"))
    d = d.withColumn("count_skipped", skipped)
    d = d.withColumn("billed_minus_reported", F.when(F.col("count_skipped").isNull() & (billed != F.col("reported")), billed - F.col("reported")))
    above = F.coalesce(billed > cap * F.col("n"), F.lit(False)) | F.exists(ch, lambda c: F.coalesce(c["reported"] > cap, F.lit(False)))
    rejected = F.exists(ch, lambda c: F.coalesce(c["verdict"] == "reject", F.lit(False)))
    found = F.array(
        F.when(over_cap & cap.isNotNull() & above, "over_cap"), F.when(count_mismatch & F.col("billed_minus_reported").isNotNull(), "count_mismatch"),
        F.when(rejected, "likelihood_reject"))
    d = d.withColumn("findings", F.filter(found, lambda f: f.isNotNull()))
    alert = F.array_contains("findings", "over_cap") | F.array_contains("findings", "count_mismatch")
    decided = F.exists(ch, lambda c: F.coalesce(c["verdict"].isin("pass", "reject"), F.lit(False)))
    return d.withColumn("status", F.when(alert, "alert").when(F.col("count_skipped").isNotNull() & ~decided, "unverifiable").otherwise("ok"))


def audited(captured: DataFrame, tau: Column | None = None, margin: Column | None = None, **switches: Column | bool) -> DataFrame:
    return checked(judged(captured, tau, margin), **switches)


def outcomes(audit: DataFrame) -> DataFrame:
    """Test outcomes for the endpoint monitor: (key, time, rejected, extra, tokens), extra as if all of it were padding."""
    c = audit.select("host", "model", "time", F.explode("choices").alias("c")).where(F.col("c.verdict").isin("pass", "reject"))
    extra = F.when(F.col("c.verdict") == "reject", F.greatest(F.lit(0), F.col("c.answer") - F.col("c.canonical"))).otherwise(0)
    return c.select(F.concat_ws("|", "host", "model").alias("key"), "time", (F.col("c.verdict") == "reject").alias("rejected"), extra.cast("long").alias("extra"), F.col("c.answer").alias("tokens"))


def count_outcomes(audit: DataFrame, rule: DataFrame) -> DataFrame:
    """Outcomes of the count rule where no token array came back: a gap above every honest one is a rejection."""
    from tallyspark.functions.tokens import calibration_key

    one = audit.where((F.col("count_skipped") == "no_logprobs") & F.col("shadow") & (F.size("choices") == 1) & ~F.coalesce(F.col("choices")[0]["capped"], F.lit(False)))
    one = one.withColumn("key", calibration_key(F.col("model"), F.col("choices")[0]["language"])).withColumn("gap", F.col("billed") - F.col("canonical"))
    j = one.join(rule.select("key", "max_gap", "level"), "key")
    return j.select("key", "host", "time", "gap", "canonical", (F.col("gap") > F.col("max_gap")).alias("rejected"), F.greatest(F.lit(0).cast("long"), F.col("gap") - F.col("max_gap")).alias("extra"), F.col("billed").alias("tokens"), "level")
