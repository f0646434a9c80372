"""Readers and writers of captured exchanges, ledgers, audit logs, prompts and configuration."""

from __future__ import annotations

import os
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import store

CAPTURED = """host STRING, time DOUBLE, language STRING,
request STRUCT<model: STRING, max_tokens: BIGINT, max_completion_tokens: BIGINT, temperature: DOUBLE, top_p: DOUBLE, stream: BOOLEAN,
  messages: ARRAY<STRUCT<role: STRING, content: STRING>>>,
response STRUCT<id: STRING, model: STRING, usage: STRUCT<completion_tokens: BIGINT, completion_tokens_details: STRUCT<reasoning_tokens: BIGINT>>,
  choices: ARRAY<STRUCT<index: INT, finish_reason: STRING, message: STRUCT<content: STRING, reasoning: STRING, reasoning_content: STRING, tool_calls: ARRAY<STRING>>,
    logprobs: STRUCT<content: ARRAY<STRUCT<token: STRING, token_id: BIGINT, bytes: ARRAY<INT>>>>>>>"""
LEDGER = """timestamp STRING, provider STRING, model_short_key STRING, model_id STRING, prompt STRING, max_tokens BIGINT, finish_reason STRING,
logprob_entries BIGINT, response_text STRING, reasoning_text STRING, billed_completion_tokens BIGINT, response_id STRING, _corrupt_record STRING"""
#: Study files by the prefix of their name (fixed values); others are ignored.
BLOCKS = ("full", "p99", "exp", "exp99", "r2", "oai", "gnative")
DEFAULT_CAP = 300
#: Policy fields that a model pattern may override, and all defaults (fixed values).
POLICY = {"alpha": 0.01, "tolerance": 3.0, "confidence": 1e-6, "min_overcharge": 0.001, "over_cap": True, "count_mismatch": True}
SETTINGS = POLICY | {"count_rules": True, "batch_size": 100, "batch_alpha": 0.05, "batch_margin": 0.0005, "guess_hf": True}


#: Patterns of model names for which a tokenizer is known (fixed values; names of public vocabularies, to be opened by an entry
#: of bpe.OPENERS).
BUNDLED = {
    "tokenizers": {
        "gpt-4o*": "tiktoken:o200k_base",
        "chatgpt-4o*": "tiktoken:o200k_base",
        "gpt-4.1*": "tiktoken:o200k_base",
        "gpt-4.5*": "tiktoken:o200k_base",
        "gpt-5*": "tiktoken:o200k_base",
        "o1*": "tiktoken:o200k_base",
        "o3*": "tiktoken:o200k_base",
        "o4*": "tiktoken:o200k_base",
        "gpt-4*": "tiktoken:cl100k_base",
        "gpt-3.5*": "tiktoken:cl100k_base",
        "openai/gpt-4o*": "tiktoken:o200k_base",
        "openai/gpt-4.1*": "tiktoken:o200k_base",
        "openai/gpt-5*": "tiktoken:o200k_base",
        "openai/o1*": "tiktoken:o200k_base",
        "openai/o3*": "tiktoken:o200k_base",
        "openai/o4*": "tiktoken:o200k_base",
        "openai/gpt-4*": "tiktoken:cl100k_base",
        "openai/gpt-3.5*": "tiktoken:cl100k_base",
        "*gpt-oss-*": "tiktoken:o200k_harmony",
        "meta-llama/meta-llama-3.1-8b-instruct*": "hf:meta-llama/Llama-3.1-8B-Instruct",
        "meta-llama/llama-3.1-8b-instruct*": "hf:meta-llama/Llama-3.1-8B-Instruct",
        "accounts/fireworks/models/llama-v3p1-8b-instruct": "hf:meta-llama/Llama-3.1-8B-Instruct",
    },
}


def captured(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURED).json(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the block from the file name and a missing cap as the default; malformed lines keep their text in _corrupt_record."""
    raw = spark.read.schema(LEDGER).json(path).withColumn("block", F.split_part(F.col("_metadata.file_name"), F.lit("_"), F.lit(1)))
    return raw.where(F.col("block").isin(*BLOCKS)).select(
        "block", "provider", F.col("model_short_key").alias("model"), "prompt", F.coalesce("max_tokens", F.lit(DEFAULT_CAP)).alias("max_tokens"), "finish_reason",
        "response_text", "reasoning_text", F.col("billed_completion_tokens").alias("billed"), "logprob_entries", "response_id",
        F.to_timestamp("timestamp").alias("ts"), "_corrupt_record")


def malformed(ledger: DataFrame) -> DataFrame:
    """Unreadable lines per block. The rows are cached by the caller if it needs more than this count."""
    return ledger.groupBy("block").agg(F.count("_corrupt_record").alias("malformed"), F.count(F.lit(1)).alias("lines"))


def prompts(spark: SparkSession, path: str, system: str | None = None) -> DataFrame:
    """One prompt a line, or one JSON object with messages; a system turn is put first if given. Blank lines are skipped."""
    line = F.trim("value")
    turn = "struct<role:string,content:string>"
    given = F.from_json(F.when(line.startswith("{"), line), f"messages array<{turn}>")["messages"]
    plain = F.array(F.struct(F.lit("user").alias("role"), line.alias("content")))
    messages = F.coalesce(given, plain)
    if system is not None:
        messages = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), messages)
    return spark.read.text(path).where(line != "").select(messages.alias("messages"))


def append_audit(audit: DataFrame, path: str) -> None:
    audit.withColumn("date", F.to_date(F.timestamp_seconds("time"))).write.mode("append").partitionBy("date").json(path)


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An audit log, empty if nothing was written yet."""
    return spark.read.schema(schema).json(path) if store.exists(spark, path) else spark.createDataFrame([], schema)


def settings(path: str | None = None, variable: str = "TALLYSPARK_CONFIG", **changes: object) -> dict[str, object]:
    """Settings of a TOML file ([checks] belongs to the top level) over the defaults, then keyword changes. Unknown keys raise.

    Without a path the environment names the file (an empty value means none), else one in the home folder is read if it is there.
    """
    if path is None and (path := os.environ.get(variable)) is None:
        path = os.path.expanduser("~/.config/tallyspark.toml")
        path = path if os.path.exists(path) else None
    found: dict[str, object] = {}
    if path:
        with open(path, "rb") as f:
            found = tomllib.load(f)
    found |= found.pop("checks", {})
    tables = ("tokenizers", "scorers", "models")
    unknown = set(found | changes) - set(SETTINGS) - set(tables) - {"calibration", "log", "state"}
    unknown |= {k for over in (found.get("models") or {}).values() for k in over if k not in POLICY}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return SETTINGS | {t: {} for t in tables} | found | changes


def patterns(spark: SparkSession, table: dict[str, str]) -> DataFrame:
    """A pattern table (pattern, value, ord) in the order it was written."""
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(table.items())], "pattern string, value string, ord int")


def usage(df: DataFrame, vendor: str, *keys: str) -> DataFrame:
    """Four vendors' usage objects in one shape: keys, target, prompt, completion, total, reasoning, additive (billed on top), no_total."""
    none = F.lit(None).cast("long")

    def pick(prompt: str, completion: str, total: str | None, reasoning: Column, additive: bool) -> DataFrame:
        t = F.col(total) if total else none
        return df.select(
            *keys, F.lit(vendor).alias("target"), F.col(prompt).alias("prompt"), F.col(completion).alias("completion"), t.alias("total"), reasoning.alias("reasoning"),
            F.lit(additive).alias("additive"), F.lit(total is None).alias("no_total"))

    if vendor == "native":
        return pick("usageMetadata.promptTokenCount", "usageMetadata.candidatesTokenCount", "usageMetadata.totalTokenCount", F.col("usageMetadata.thoughtsTokenCount"), True)
    if vendor == "messages":
        return pick("usage.input_tokens", "usage.output_tokens", None, none, False)
    detail = F.col("usage.completion_tokens_details.reasoning_tokens")
    return pick("usage.prompt_tokens", "usage.completion_tokens", "usage.total_tokens", detail, False)


#: Tables of a calibration and their columns.
CALIBRATION = {
    "scores": "key string, score double", "gaps": "key string, gap long, canonical long", "margins": "model string, margin double",
    "meta": "key string, tokenizer string, scorer string, temperature double, top_p double, system string",
}


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in CALIBRATION[name].split(", ")]


def _path(path: str | None) -> str:
    if not path:
        raise ValueError("a calibration needs a path to be written to")
    return path


def write_calibration(tables: dict[str, DataFrame], path: str | None) -> None:
    """scores, gaps, margins and meta, each replaced as a whole. A path is needed."""
    for name, df in tables.items():
        df.select(*_columns(name)).write.mode("overwrite").parquet(f"{_path(path)}/{name}")


def append_calibration(tables: dict[str, DataFrame], path: str | None, batch: str | None = None) -> None:
    """Adds rows to tables of a calibration, as a batch: the same rows again, or another batch of the same name, take its place."""
    for name, df in tables.items():
        store.add_batch(df.select(*_columns(name)), f"{_path(path)}/{name}", batch)


#: Tables that hold one row a key, which is replaced: the largest by these columns stays.
KEYED = {"margins": (["model"], ["margin"]), "meta": (["key"], ["key"])}


def upsert_calibration(name: str, rows: DataFrame, path: str | None) -> None:
    """Margins are only ever raised; settings of a key are the same by the time they get here (see calibration.conflicts)."""
    keys, order = KEYED[name]
    store.Versioned(rows.sparkSession, f"{_path(path)}/{name}_versions", CALIBRATION[name]).upsert(rows, keys, order)


def read_calibration(spark: SparkSession, path: str | None) -> dict[str, DataFrame]:
    """The four tables; those that were never written are empty. A model's margin is the largest that was written."""
    out = {
        name: spark.read.schema(schema).parquet(f"{path}/{name}") if path and store.exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)
        for name, schema in CALIBRATION.items()}
    for name in KEYED if path else ():
        out[name] = out[name].unionByName(store.Versioned(spark, f"{path}/{name}_versions", CALIBRATION[name]).read())
    return out | {"margins": out["margins"].groupBy("model").agg(F.max("margin").alias("margin")), "meta": out["meta"].distinct()}


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest monitor state of each key, from what streaming.endpoint.keep_state keeps; empty if nothing was kept."""
    from tallyspark.streaming.endpoint import kept_states

    return kept_states(spark, path).read().drop("batch")


#: What an ISO 8601 date or date and time may leave out: the time, its seconds, and the zone, which is the session's then.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def period(spark: SparkSession, since: str | None, until: str | None) -> tuple[float, float]:
    """The bounds of a period in seconds since 1970, from ISO 8601 texts; an open end is infinite."""
    texts = [x or None for x in (since, until)]
    if bad := [x for x in texts if x and not re.match(ISO, x)]:
        raise ValueError(f"not an ISO 8601 time: {bad[0]}")
    at = spark.range(1).select(*[F.unix_micros(F.lit(x).cast("string").cast("timestamp")) / 1e6 for x in texts]).first()
    return (float("-inf") if at[0] is None else at[0], float("inf") if at[1] is None else at[1])


def append_ledger(rows: DataFrame, path: str) -> None:
    """Study rows as JSON lines, by block, next to those that are there."""
    rows.write.mode("append").partitionBy("block").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON object a line for each target, replaced as a whole."""
    summary.write.mode("overwrite").json(path)


def bundled_patterns(spark: SparkSession, kind: str = "tokenizers") -> DataFrame:
    """The patterns that come with the package (pattern, value, ord)."""
    return patterns(spark, BUNDLED[kind])


def resolved_tokenizers(models: DataFrame, user: dict[str, str] | None = None, guess: bool = True) -> DataFrame:
    """(model, tokenizer, origin): by the user's patterns, else the bundled ones, else for names with an owner a guess of
    `hf:` and the name, else null. A user's pattern wins over any bundled one."""
    from tallyspark.operators.matching import resolve_patterns

    spark = models.sparkSession
    names = models.select("model").distinct()
    given = patterns(spark, user) if user else spark.createDataFrame([], "pattern string, value string, ord int")
    own = resolve_patterns(names, given).select("model", F.col("value").alias("own"))
    rest = resolve_patterns(names, bundled_patterns(spark)).select("model", F.col("value").alias("rest"))
    guessed = F.when(F.lit(guess) & F.col("model").contains("/"), F.concat(F.lit("hf:"), "model"))
    out = names.join(own, "model", "left").join(rest, "model", "left")
    origin = F.when(F.col("own").isNotNull(), "user").when(F.col("rest").isNotNull(), "bundled").when(guessed.isNotNull(), "guess")
    return out.select("model", F.coalesce("own", "rest", guessed).alias("tokenizer"), origin.alias("origin"))
