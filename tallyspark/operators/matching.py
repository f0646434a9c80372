"""Configuration lookups as joins: shell patterns, precedence, overlays, resuming, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.tokens import glob_regex, literal_length


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; otherwise Spark decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def resolve_patterns(names: DataFrame, patterns: DataFrame, name: str = "model") -> DataFrame:
    """(name, pattern, value): an exact pattern wins, then most literal characters, then the first in order; null if none fits.

    Patterns are matched against distinct names only, and that result is joined back by equality.
    """
    distinct = names.select(name).distinct()
    p = patterns.select("pattern", "value", "ord", glob_regex(F.col("pattern")).alias("_re"), literal_length(F.col("pattern")).alias("_literal"))
    hit = F.rlike(F.lower(F.col(name)), F.col("_re"))
    fits = distinct.join(small(p), hit)
    exact = F.lower(F.col(name)) == F.lower("pattern")
    order = Window.partitionBy(name).orderBy(F.desc(exact), F.desc("_literal"), "ord")
    best = fits.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(name, "pattern", "value")
    return distinct.join(best, name, "left").select(name, "pattern", "value")


def overlay(names: DataFrame, resolved: DataFrame, overrides: DataFrame, defaults: dict[str, object], name: str = "model") -> DataFrame:
    """Policy per name: each column from the override of its resolved pattern, else the default.

    overrides may have a `given` array of the columns that a pattern sets; those count even where they are null.
    """
    o = resolved.join(overrides.withColumnRenamed("pattern", "_p"), F.col("pattern") == F.col("_p"), "left")
    out = names.select(name).distinct().join(o.drop("_p", "value"), name, "left")

    def policy(k: str, v: object) -> Column:
        if k not in overrides.columns:
            return F.lit(v).alias(k)
        own = F.col(k).isNotNull()
        own = own | F.coalesce(F.array_contains("given", k), F.lit(False)) if "given" in overrides.columns else own
        return F.when(own, F.col(k)).otherwise(F.lit(v)).alias(k)

    return out.select(name, *[policy(k, v) for k, v in defaults.items()])


def first_config(config: DataFrame) -> DataFrame:
    """One row per cell, of the map with the lowest precedence number."""
    cols = [c for c in config.columns if c not in ("provider", "model")]
    return config.groupBy("provider", "model").agg(F.min_by(F.struct(*cols), "precedence").alias("c")).select("provider", "model", "c.*")


def lookup_cells(ledger: DataFrame, config: DataFrame) -> DataFrame:
    return ledger.join(first_config(config), ["provider", "model"], "left")


def config_ambiguity(config: DataFrame, fields: list[str]) -> DataFrame:
    """Cells that stand in several maps: a problem where the maps disagree in a field, else a note."""
    differ = F.count_distinct(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    a = config.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("maps"), differ.alias("variants")).where("maps > 1")
    return a.withColumn("severity", F.when(F.col("variants") > 1, "problem").otherwise("note"))


def missing(wanted: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(catalog.select(*keys).distinct(), keys, "left_anti")


def todo(prompts: DataFrame, cells: DataFrame, done: DataFrame) -> DataFrame:
    """Every (cell, prompt) that is not recorded yet."""
    every = prompts.select("prompt").distinct().crossJoin(small(cells.select("provider", "model").distinct()))
    return every.join(done.select("provider", "model", "prompt").distinct(), ["provider", "model", "prompt"], "left_anti")


def with_stats(ledger: DataFrame, generation_stats: DataFrame) -> DataFrame:
    return ledger.join(generation_stats, "response_id", "left")


def first_seen(prompts: DataFrame, low: int, high: int, n: int | None = None) -> DataFrame:
    """Distinct trimmed prompts of low to high characters by first position; the first n of them if n is given."""
    p = prompts.select(F.trim("prompt").alias("prompt"), "position").where(F.length("prompt").between(low, high))
    p = p.groupBy("prompt").agg(F.min("position").alias("position"))
    return p if n is None else p.orderBy("position", "prompt").limit(n)


def first_turns(conversations: DataFrame, language: str | None = None) -> DataFrame:
    """(prompt, position) of conversations (conv_id, turn, role, text, language) whose first turn is the user's, in that language."""
    first = conversations.groupBy("conv_id").agg(F.min_by(F.struct("role", "text", *([] if language is None else ["language"])), "turn").alias("m"))
    first = first.where("m.role = 'user'")
    first = first if language is None else first.where(F.col("m.language") == language)
    return first.select(F.col("m.text").alias("prompt"), F.col("conv_id").alias("position"))


def prompts_or_fallback(prompts: DataFrame, fallback: DataFrame, low: int, high: int, n: int) -> DataFrame:
    """The first n prompts, or the fallback's if there are fewer."""
    own = first_seen(prompts, low, high, n)
    return own if own.count() >= n else first_seen(fallback, low, high, n)


def hashed_sample(rows: DataFrame, keys: list[str], id_col: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each key in hash order: the same rows on every run."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
