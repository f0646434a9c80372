"""Test tables as domain inputs: ledgers, outcomes, captured responses, each also as SQL for the comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import bpe
from tallyspark.functions.tokens import token_count
from tallyspark.sources.files import CAPTURED as CAPTURED_SCHEMA
from tallyspark.sources.store import dealt

TOK = r"\p{L}+|\p{N}|[^\p{L}\p{N} \n]+| |\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(c: Column, values: dict[int, int]) -> Column:
    out = F.lit(0)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out.cast("long")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as billed responses: the bill is the count plus a gap, pinned at the cap but for a few conversations."""
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("prompt", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    gap = _case((F.col("conv_id") * 7 + F.col("turn") * 13) % 10, {0: 1, 3: 2, 7: -1})
    c = c.select(
        "conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("response_id"), F.concat(F.lit("p"), F.col("conv_id") % 4).alias("provider"),
        F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), F.concat(F.lit("b"), F.col("turn") % 2).alias("block"), F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.col("text").alias("response_text"), F.when(F.col("conv_id") % 5 == 0, F.coalesce("prompt", F.lit(""))).otherwise("").alias("reasoning_text"),
        token_count(F.col("text")).alias("canonical"), F.lit(600).cast("long").alias("max_tokens"), gap.alias("gap"))
    raw = F.col("canonical") + F.col("gap")
    c = c.withColumn("billed", F.when((raw > 600) & (F.col("conv_id") % 37 != 0), 600).otherwise(raw).cast("long"))
    return c.withColumn("finish_reason", F.when((raw >= 600) & (F.col("conv_id") % 4 != 3), "length").otherwise("stop"))


LEDGER = f"""
turns AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
ledger0 AS (
  SELECT conv_id, turn, conv_id * 100 + turn AS response_id, 'p' || (conv_id % 4) AS provider, 'm' || (conv_id % 3) AS model, 'b' || (turn % 2) AS block,
    coalesce(before, '') AS prompt, text AS response_text, CASE WHEN conv_id % 5 = 0 THEN coalesce(before, '') ELSE '' END AS reasoning_text,
    CAST(len(regexp_extract_all(text, '{TOK}')) AS BIGINT) AS canonical, CAST(600 AS BIGINT) AS max_tokens,
    CASE (conv_id * 7 + turn * 13) % 10 WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 7 THEN -1 ELSE 0 END AS gap
  FROM turns WHERE role = 'assistant'),
ledger AS (
  SELECT *, CAST(CASE WHEN canonical + gap > 600 AND conv_id % 37 <> 0 THEN 600 ELSE canonical + gap END AS BIGINT) AS billed,
    CASE WHEN canonical + gap >= 600 AND conv_id % 4 <> 3 THEN 'length' ELSE 'stop' END AS finish_reason FROM ledger0)"""


def big_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a large ledger of few cells."""
    li = table(spark, sf_dir, "lineitem")
    billed = (F.col("l_quantity") * 10).cast("long")
    gap = _case(F.col("l_partkey") % 50, {0: 1, 7: 3, 13: -2})
    return li.select(
        F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"), F.concat(F.lit("b"), F.col("l_linenumber") % 2).alias("block"),
        F.col("l_orderkey").cast("string").alias("prompt"), billed.alias("billed"), (billed - gap).alias("canonical"), F.lit(480).cast("long").alias("max_tokens"),
        F.when(F.col("l_linenumber") != 7, "stop").alias("finish_reason"))


BIG = """
big AS (
  SELECT l_returnflag AS provider, l_linestatus AS model, 'b' || (l_linenumber % 2) AS block, CAST(l_orderkey AS VARCHAR) AS prompt,
    CAST(l_quantity * 10 AS BIGINT) AS billed, CAST(l_quantity * 10 AS BIGINT) - CASE l_partkey % 50 WHEN 0 THEN 1 WHEN 7 THEN 3 WHEN 13 THEN -2 ELSE 0 END AS canonical,
    CAST(480 AS BIGINT) AS max_tokens, CASE WHEN l_linenumber <> 7 THEN 'stop' END AS finish_reason FROM lineitem)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as test outcomes of endpoints; p0 changes once for some of them."""
    e = table(spark, sf_dir, "events")
    rejected = F.coalesce(F.col("value") > 150, F.lit(False))
    return e.select(
        F.concat("event_type", F.lit("|"), F.col("user_id") % 10).alias("key"), F.col("event_id").alias("seq"), rejected.alias("rejected"),
        F.when(rejected, F.col("event_id") % 4 + 1).otherwise(0).cast("long").alias("extra"), F.lit(100).cast("long").alias("tokens"),
        F.when((F.col("user_id") % 10 < 2) & (F.col("event_id") % 1000 >= 500), 0.05).otherwise(0.03).alias("p0"))


OUTCOMES = """
outcomes AS (
  SELECT event_type || '|' || (user_id % 10) AS key, event_id AS seq, coalesce(value > 150, false) AS rejected,
    CASE WHEN coalesce(value > 150, false) THEN event_id % 4 + 1 ELSE 0 END AS extra, 100 AS tokens,
    CASE WHEN user_id % 10 < 2 AND event_id % 1000 >= 500 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.03 AS DOUBLE) END AS p0 FROM events)"""

SCRIPT_CASE = "CASE WHEN conv_id % 6 = 5 THEN 'cjk' ELSE 'latin' END"


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows as captured responses with one or two choices that differ in what came back."""
    r = ledger(spark, sf_dir)
    x = F.col("conv_id") + F.col("turn")

    def choice(k: int) -> Column:
        array = F.when((x + k) % 7 == 0, None).when((x + k) % 5 == 0, "content").otherwise("full")
        reported = F.when(x % 11 == 0, None).otherwise(F.col("canonical") + _case((x * 3 + k) % 9, {0: 2}))
        return F.struct(
            F.lit(k).alias("index"), F.when(F.col("conv_id") % 6 == 5, "cjk").otherwise("latin").alias("language"), reported.cast("long").alias("reported"),
            reported.cast("long").alias("answer"), F.when(x % 13 != 0, F.col("canonical")).alias("canonical"), array.alias("array"), ((x + k) % 17 == 0).alias("reasoning"),
            (F.col("finish_reason") == "length").alias("capped"), ((x + k) % 19 == 0).alias("tool_calls"), F.when((x + k) % 23 != 0, F.lit(1)).alias("readings"),
            ((x + k) % 29 == 0).alias("token_mismatch"), ((x * 3 + k) % 9 == 0).alias("noncanonical"), (-((x + k) % 8)).cast("double").alias("llr"),
            ((x + k) % 3).cast("int").alias("spans"))

    n = F.when(F.col("conv_id") % 3 == 0, 2).otherwise(1)
    choices = F.slice(F.array(choice(0), choice(1)), F.lit(1), n)
    billed = F.when(x % 31 != 0, F.col("billed") * n)
    return r.select(
        F.concat(F.lit("h"), F.col("conv_id") % 2).alias("host"), F.col("response_id").cast("double").alias("time"), "model", "response_id", billed.cast("long").alias("billed"),
        F.when(F.col("conv_id") % 9 == 0, 400).otherwise(600).cast("long").alias("max_tokens"), F.when(x % 12 == 0, 40).otherwise(0).cast("long").alias("reasoning_tokens"),
        (F.col("conv_id") % 10 == 9).alias("channels"), choices.alias("choices"))


#: One row per choice, then one per response; verdicts with tau = -4 and margin 0.5.
CAPTURED = f"""{LEDGER},
rows0 AS (
  SELECT *, conv_id + turn AS x, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS nch FROM ledger),
rows1 AS (
  SELECT 'h' || (conv_id % 2) AS host, model, response_id, CASE WHEN x % 31 <> 0 THEN billed * nch END AS billed, CASE WHEN conv_id % 9 = 0 THEN 400 ELSE 600 END AS max_tokens,
    CASE WHEN x % 12 = 0 THEN 40 ELSE 0 END AS reasoning_tokens, conv_id % 10 = 9 AS channels, conv_id, x, nch, canonical, finish_reason FROM rows0),
choice0 AS (
  SELECT host, model, response_id, k, {SCRIPT_CASE} AS language, CASE WHEN x % 11 <> 0 THEN canonical + CASE WHEN (x * 3 + k) % 9 = 0 THEN 2 ELSE 0 END END AS reported,
    CASE WHEN x % 13 <> 0 THEN canonical END AS canonical, CASE WHEN (x + k) % 7 = 0 THEN NULL WHEN (x + k) % 5 = 0 THEN 'content' ELSE 'full' END AS arr,
    (x + k) % 17 = 0 AS reasoning, finish_reason = 'length' AS capped, (x + k) % 19 = 0 AS tool_calls, (x + k) % 23 <> 0 AS few, (x + k) % 29 = 0 AS token_mismatch,
    (x * 3 + k) % 9 = 0 AS noncanonical, CAST(-((x + k) % 8) AS DOUBLE) AS llr, (x + k) % 3 AS spans
  FROM rows1, (SELECT unnest([0, 1]) AS k) WHERE k < nch),
choice AS (
  SELECT *, CASE WHEN reported IS NULL THEN NULL WHEN tool_calls OR arr IS NULL OR NOT few OR canonical IS NULL THEN 'unverifiable' WHEN capped THEN 'capped'
    WHEN token_mismatch THEN 'unverifiable' WHEN CASE WHEN noncanonical THEN llr ELSE 0 END < -4 - CASE WHEN noncanonical THEN spans ELSE 0 END * 0.5 THEN 'reject' ELSE 'pass' END AS verdict
  FROM choice0),
per AS (
  SELECT response_id, CASE WHEN count(*) = count(reported) THEN CAST(sum(reported) AS BIGINT) END AS reported, CASE WHEN count(*) = count(canonical) THEN CAST(sum(canonical) AS BIGINT) END AS canonical,
    bool_or(reasoning) AS reasoning, bool_or(arr IS NULL) AS unaligned, bool_or(coalesce(arr, '') = 'content') AS content, max(reported) AS most,
    bool_or(coalesce(verdict, '') = 'reject') AS rejected, bool_or(coalesce(verdict, '') IN ('pass', 'reject')) AS decided FROM choice GROUP BY response_id),
rec0 AS (
  SELECT r.host, r.model, r.response_id, r.billed, r.max_tokens, r.nch AS n, p.reported, p.canonical, p.most, p.rejected, p.decided, p.unaligned, p.content,
    r.reasoning_tokens > 0 OR r.channels OR p.reasoning AS hidden FROM rows1 r JOIN per p USING (response_id)),
rec1 AS (
  SELECT *, billed IS NOT NULL AND canonical IS NOT NULL AND NOT hidden AS shadow,
    CASE WHEN reported IS NULL THEN 'no_logprobs' WHEN unaligned THEN 'unaligned' WHEN hidden AND content THEN 'billed_tokens_outside_logprobs' WHEN billed IS NULL THEN 'no_usage' END AS count_skipped FROM rec0),
rec2 AS (SELECT *, CASE WHEN count_skipped IS NULL AND billed <> reported THEN billed - reported END AS billed_minus_reported FROM rec1),
rec AS (
  SELECT *, coalesce(billed > max_tokens * n, false) OR coalesce(most > max_tokens, false) AS over_cap, billed_minus_reported IS NOT NULL AS mismatch,
    CASE WHEN coalesce(billed > max_tokens * n, false) OR coalesce(most > max_tokens, false) OR billed_minus_reported IS NOT NULL THEN 'alert'
      WHEN count_skipped IS NOT NULL AND NOT decided THEN 'unverifiable' ELSE 'ok' END AS status FROM rec2)"""


#: A vocabulary by rule: the 256 bytes, then these pairs of letters, which the encoder takes from left to right.
PAIRS = ("th", "he", "in", "er")


def pairs_vocabulary(rest: str) -> bpe.Vocabulary:
    pairs = rest.split(",")
    pieces = {b: bytes([b]) for b in range(256)} | {256 + n: p.encode() for n, p in enumerate(pairs)}
    ids = {b: i for i, b in pieces.items()}
    cut = re.compile("|".join(map(re.escape, pairs)).encode() + b"|.", re.DOTALL)
    return bpe.Vocabulary(f"pairs:{rest}", lambda text: [ids[b] for b in cut.findall(text.encode())], pieces, {}, {b: b for b in range(256)})


bpe.OPENERS["pairs"] = pairs_vocabulary
EXCHANGE_MODELS = [("m0", "pairs:" + ",".join(PAIRS)), ("m1", "pairs:" + ",".join(PAIRS))]


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as JSON of requests and responses, read with the reader's schema: a provider that reports tokens as its
    vocabulary cuts them, byte by byte (every third conversation), without its last token (every fifth), with a reasoning
    text in front (every seventh) or not at all (every eleventh). Model m2 has no known tokenizer."""
    c = dealt(table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text"), "conv_id", "turn")
    k = F.col("conv_id")
    cut = F.when(k % 3 == 0, F.lit("[\\x00-\\x7F]|[^\\x00-\\x7F]")).otherwise(F.lit("|".join(PAIRS) + "|[\\x00-\\x7F]|[^\\x00-\\x7F]"))
    # columns of their own: an expression is made anew wherever it stands
    c = c.withColumn("chars", F.regexp_extract_all(F.col("text"), cut, F.lit(0)))
    hexed = F.transform("chars", lambda x: F.when(F.octet_length(x) > F.char_length(x), F.regexp_extract_all(F.lower(F.hex(F.encode(x, "UTF-8"))), F.lit("(..)"), F.lit(1))))
    entries = F.flatten(F.zip_with("chars", hexed, lambda x, h: F.when(h.isNull(), F.array(x)).otherwise(F.transform(h, lambda b: F.concat(F.lit("bytes:\\x"), b)))))
    plain = F.octet_length("text") == F.char_length("text")
    c = c.withColumn("entries", F.when(plain, F.col("chars")).otherwise(entries)).drop("chars")
    entries = F.col("entries")
    c = c.withColumn("entries", F.when(k % 5 == 0, F.slice(entries, F.lit(1), F.greatest(F.size(entries) - 1, F.lit(0)))).when(k % 7 == 0, F.concat(F.array(F.lit("hm"), F.lit(".")), entries)).otherwise(entries))
    logged = F.when(k % 11 != 0, F.struct(F.transform(entries, lambda t: F.struct(t.alias("token"))).alias("content")))
    choice = F.struct(
        F.lit(0).alias("index"), F.when(F.col("turn") % 4 == 3, "length").otherwise("stop").alias("finish_reason"),
        F.struct(F.col("text").alias("content"), F.when(k % 7 == 0, "hm.").alias("reasoning_content")).alias("message"), logged.alias("logprobs"))
    request = F.struct(F.concat(F.lit("m"), k % 3).alias("model"), F.lit(100_000).alias("max_tokens"))
    billed = F.size(entries) + F.when(k % 4 == 1, 2).otherwise(0)
    response = F.struct(F.concat(F.lit("r"), k, F.lit("-"), "turn").alias("id"), F.struct(billed.alias("completion_tokens")).alias("usage"), F.array(choice).alias("choices"))
    body = F.to_json(F.struct(F.concat(F.lit("h"), k % 2).alias("host"), F.col("turn").cast("double").alias("time"), request.alias("request"), response.alias("response")))
    return c.select((k * 100 + F.col("turn")).alias("exchange"), F.from_json(body, CAPTURED_SCHEMA).alias("x")).select("exchange", "x.*")
