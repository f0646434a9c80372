"""The registered queries over the test tables, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import bpe, stats, tokens
from tallyspark.operators import align, audit, calibration, exchange, likelihood, matching, monitor, report
from tallyspark.operators import ledger as lg
from tallyspark.plans.adapters import BIG, CAPTURED, EXCHANGE_MODELS, LEDGER, OUTCOMES, PAIRS, TOK, big_ledger, captured, exchanges, ledger, outcomes, table
from tallyspark.sources import files, store
from tallyspark.sources.store import dealt, stored
from tallyspark.streaming import endpoint, sse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TAU, MARGIN = -4.0, 0.5
ALPHA = 0.05


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(captured(spark, sf_dir), F.lit(TAU), F.lit(MARGIN))


REPORT = """SELECT provider, model, count(*) AS n, round(avg(billed - canonical), 6) AS mean_delta, CAST(median(billed - canonical) AS DOUBLE) AS median_delta,
  round(avg(CASE WHEN billed > canonical THEN 1.0 ELSE 0.0 END), 6) AS share_above, round(avg(CASE WHEN billed < canonical THEN 1.0 ELSE 0.0 END), 6) AS share_below,
  round(avg(CASE WHEN billed = canonical THEN 1.0 ELSE 0.0 END), 6) AS share_exact, min(billed - canonical) AS min_delta, max(billed - canonical) AS max_delta
FROM {t} GROUP BY provider, model"""


@query("q01_cell_delta_report", f"WITH {LEDGER} " + REPORT.format(t="ledger"))
def q01(spark, d):
    return lg.cell_report(ledger(spark, d))


@query("q01_big_cell_delta_report", f"WITH {BIG} " + REPORT.format(t="big"))
def q01_big(spark, d):
    return lg.cell_report(big_ledger(spark, d))


@query("q02_cell_mde", f"""WITH {BIG}, a AS (
  SELECT provider, model, count(*) AS n, avg(billed - canonical) AS mean, stddev_pop(billed - canonical) AS sd, avg(billed) AS bill FROM big WHERE billed <> max_tokens GROUP BY 1, 2),
m AS (SELECT *, (1.645 + 0.84) * CASE WHEN sd = 0 THEN 0.01 ELSE sd END / sqrt(n) AS mde FROM a)
SELECT provider, model, n, round(mean, 6) AS mean_delta, round(mde, 6) AS mde_tokens, round(100 * mde / bill, 6) AS mde_percent, mean > mde AS above_mde FROM m WHERE n >= 10""")
def q02(spark, d):
    return lg.cell_mde(big_ledger(spark, d))


def _poly(x: str, cs: tuple, last: str = "") -> str:
    out = "0.0"
    for c in cs:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return f"({out} * {x} + 1.0)" if last else out


def ppf_sql(p: str) -> str:
    t = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"{_poly(t, stats.PPF_C)} / {_poly(t, stats.PPF_D, '1')}"
    q = f"({p} - 0.5)"
    inner = f"{_poly(f'({q} * {q})', stats.PPF_A)} * {q} / {_poly(f'({q} * {q})', stats.PPF_B, '1')}"
    return f"CASE WHEN {p} < 0.02425 THEN {outer} WHEN {p} > 1 - 0.02425 THEN -({outer}) ELSE {inner} END"


@query("q03_simultaneous_bounds", f"""WITH {BIG}, a AS (
  SELECT block, provider, model, count(*) AS n, avg(billed - canonical) AS mean, stddev_pop(billed - canonical) AS sd, avg(billed) AS bill FROM big WHERE billed <> max_tokens GROUP BY 1, 2, 3),
z AS (SELECT count(*) AS cells, CAST(1 - 0.05 / count(*) AS DOUBLE) AS p FROM a), b AS (SELECT a.*, cells, mean + ({ppf_sql('p')}) * sd / sqrt(n) AS ub FROM a, z)
SELECT block, provider, model, n, cells, round(mean, 6) AS mean_delta, round(ub, 6) AS upper_bound, round(100 * ub / bill, 6) AS upper_percent FROM b WHERE n >= 30""")
def q03(spark, d):
    return lg.simultaneous_bounds(big_ledger(spark, d))


@query("q04_delta_histogram", f"""WITH {BIG}, h AS (SELECT provider, model, billed - canonical AS delta, count(*) AS n FROM big GROUP BY 1, 2, 3),
s AS (SELECT provider, model, unnest(generate_series(min(delta), max(delta))) AS delta FROM h GROUP BY 1, 2)
SELECT provider, model, delta, coalesce(n, 0) AS n FROM s LEFT JOIN h USING (provider, model, delta)""")
def q04(spark, d):
    return lg.delta_histogram(big_ledger(spark, d))


@query("q05_length_scaling", f"""WITH {BIG} SELECT CAST(floor(billed / 250) AS BIGINT) AS bucket, count(*) AS n, round(avg(billed - canonical), 6) AS mean_delta,
  round(100 * avg(billed - canonical) / avg(billed), 6) AS delta_percent FROM big WHERE billed <> max_tokens GROUP BY 1""")
def q05(spark, d):
    return lg.length_scaling(big_ledger(spark, d))


@query("q06_shape", f"""WITH {BIG}, m AS (SELECT provider, model, avg(billed - canonical) AS mu FROM big WHERE billed <> max_tokens GROUP BY 1, 2),
c AS (SELECT provider, model, count(*) AS n, avg(power(billed - canonical - mu, 2)) AS m2, avg(power(billed - canonical - mu, 3)) AS m3, avg(power(billed - canonical - mu, 4)) AS m4
  FROM big JOIN m USING (provider, model) WHERE billed <> max_tokens GROUP BY 1, 2 HAVING count(*) > 3),
s AS (SELECT *, CASE WHEN m2 > 0 THEN m3 / power(m2, 1.5) END AS s, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS k, 3.0 * (n - 1) * (n - 1) / (CAST(n - 2 AS DOUBLE) * (n - 3)) AS e FROM c)
SELECT provider, model, n, round(s, 6) AS skew, round(k, 6) AS excess_kurtosis, round((s * s + 1) / (k + 3 + e), 6) AS bc_published, round((s * s + 1) / (k + e), 6) AS bc_standard FROM s""")
def q06(spark, d):
    return lg.shape(big_ledger(spark, d))


@query("q07_block_rollup", f"""WITH {BIG} SELECT block, provider, model, count(*) AS records, count(*) FILTER (billed > max_tokens) AS above_cap, count(*) FILTER (billed = max_tokens) AS at_cap,
  CAST(sum(billed) AS BIGINT) AS billed, CAST(sum(billed - canonical) AS BIGINT) AS delta, CAST(grouping(block, provider, model) AS INTEGER) AS level FROM big GROUP BY ROLLUP (block, provider, model)""")
def q07(spark, d):
    return lg.block_rollup(big_ledger(spark, d))


@query("q08_duplicate_prompts", f"""WITH {BIG} SELECT provider, model, count(*) AS n, count(*) - count(DISTINCT prompt) - max(CASE WHEN prompt IS NULL THEN 1 ELSE 0 END) AS duplicates,
  count(*) FILTER (billed IS NULL) AS billed_nulls, count(*) FILTER (finish_reason IS NULL) AS finish_nulls, count(*) = 200 AS complete FROM big GROUP BY 1, 2""")
def q08(spark, d):
    return lg.duplicate_prompts(big_ledger(spark, d))


@query("q09_prompt_sets", f"""WITH {LEDGER}, x AS (SELECT DISTINCT provider, model, prompt FROM ledger),
p AS (SELECT provider, model, count(prompt) AS prompts, concat_ws('-', {", ".join(f"CAST(CAST(sum(CAST('0x' || substr(sha256(prompt), {at}, 12) AS BIGINT)) AS BIGINT) AS VARCHAR)" for at in (1, 13, 25, 37))}) AS fingerprint FROM x GROUP BY 1, 2)
SELECT prompts, fingerprint, count(*) AS cells FROM p GROUP BY 1, 2""")
def q09(spark, d):
    return lg.prompt_sets(ledger(spark, d))


CONFIG_ROWS = [(f"map{i % 3}", i % 3, f"p{i % 4}", f"m{i % 3 if i < 9 else 0}", f"repo{i % 5}", ["simple", "harmony", "think_tags", "gemma_thinking"][i % 4], None if i % 3 else True, i == 7) for i in range(12)]
CONFIG_SCHEMA = "map string, precedence int, provider string, model string, repo string, reasoning_format string, append_eos boolean, stale boolean"


def config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIG_ROWS, CONFIG_SCHEMA)


def _value(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()


CONFIG = "config(map, precedence, provider, model, repo, reasoning_format, append_eos, stale) AS (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in CONFIG_ROWS) + ")"


@query("q10_config_ambiguity", f"""WITH {CONFIG} SELECT provider, model, count(*) AS maps, count(DISTINCT concat_ws('/', repo, reasoning_format, coalesce(CAST(append_eos AS VARCHAR), '-'))) AS variants,
  CASE WHEN count(DISTINCT concat_ws('/', repo, reasoning_format, coalesce(CAST(append_eos AS VARCHAR), '-'))) > 1 THEN 'problem' ELSE 'note' END AS severity FROM config GROUP BY 1, 2 HAVING count(*) > 1""")
def q10(spark, d):
    return matching.config_ambiguity(config(spark), ["repo", "reasoning_format", "append_eos"])


@query("q11_overcap", f"""WITH {BIG} SELECT provider, model, count(*) AS n, CAST(sum(billed) AS BIGINT) AS billed, CAST(median(billed - max_tokens) AS DOUBLE) AS median_over, max(billed - max_tokens) AS max_over
FROM big WHERE billed > max_tokens GROUP BY 1, 2""")
def q11(spark, d):
    return lg.overcap(big_ledger(spark, d))


@query("q12_cap_position", f"""WITH {LEDGER} SELECT provider, count(*) AS n, count(*) FILTER (billed < max_tokens) AS under, count(*) FILTER (billed = max_tokens) AS pinned, count(*) FILTER (billed > max_tokens) AS over FROM ledger GROUP BY 1""")
def q12(spark, d):
    return lg.cap_position(ledger(spark, d))


@query("q13_exclusion_reasons", f"""WITH {LEDGER}, {CONFIG}, k AS (SELECT l.*, EXISTS (SELECT 1 FROM config c WHERE NOT stale AND c.provider = l.provider AND c.model = l.model) AS known FROM ledger l
  WHERE NOT EXISTS (SELECT 1 FROM config c WHERE stale AND c.provider = l.provider AND c.model = l.model))
SELECT CASE WHEN NOT known THEN 'unknown_cell' WHEN finish_reason IS NULL THEN 'no_finish_reason' WHEN reasoning_text IS NULL THEN 'no_reasoning_text' WHEN billed IS NULL THEN 'no_bill' ELSE 'kept' END AS reason, count(*) AS n FROM k GROUP BY 1""")
def q13(spark, d):
    stale = config(spark).where("stale").select("provider", "model", "stale")
    cells = config(spark).where("not stale").select("provider", "model", "stale").distinct().unionByName(stale)
    return lg.exclusion_reasons(ledger(spark, d), cells)


@query("q14_accounting_identity", f"""WITH {LEDGER}, i AS (SELECT model, max_tokens, canonical AS visible, CASE WHEN turn % 3 = 0 THEN 0 ELSE conv_id % 50 END AS reasoning, gap FROM ledger),
j AS (SELECT *, visible + reasoning + CASE WHEN reasoning > 0 THEN 9 ELSE 3 END + gap AS billed FROM i)
SELECT model, count(*) AS n, count(*) FILTER (gap = 0) AS exact, count(*) FILTER (gap <> 0) AS off, round(avg(CASE WHEN billed < max_tokens THEN gap END), 6) AS mean_delta FROM j GROUP BY 1""")
def q14(spark, d):
    r = F.when(F.col("turn") % 3 == 0, 0).otherwise(F.col("conv_id") % 50).cast("long")
    x = ledger(spark, d).select("model", "max_tokens", F.col("canonical").alias("visible"), r.alias("reasoning_tokens"), "gap")
    x = x.withColumn("billed", F.col("visible") + F.col("reasoning_tokens") + tokens.identity_overhead(F.col("reasoning_tokens")) + F.col("gap"))
    return lg.accounting_identity(x)


@query("q15_two_channel", f"""WITH {LEDGER}, t AS (SELECT model, canonical AS a, len(reasoning_text) AS t, gap, conv_id % 40 AS p FROM ledger),
u AS (SELECT model, 'answer' AS channel, a + gap AS billed, a AS canonical, gap <> 2 AS adds FROM t UNION ALL SELECT model, 'thought', t, t, gap <> 2 FROM t)
SELECT model, channel, count(*) AS n, count(*) FILTER (billed = canonical) AS exact, round(avg(billed - canonical), 6) AS mean_delta, CAST(sum(billed - canonical) AS BIGINT) AS sum_delta,
  count(*) FILTER (adds) AS reconciled, CAST(sum(billed) AS BIGINT) AS billed FROM u GROUP BY 1, 2""")
def q15(spark, d):
    t = F.length("reasoning_text").cast("long")
    x = ledger(spark, d).select(
        "model", F.col("canonical").alias("canonical_answer"), (F.col("canonical") + F.col("gap")).alias("billed_answer"), t.alias("canonical_thought"), t.alias("billed_thought"),
        (F.col("conv_id") % 40).alias("prompt_tokens"), (F.col("conv_id") % 40 + F.col("canonical") + F.col("gap") + t + F.when(F.col("gap") == 2, 5).otherwise(0)).alias("total_tokens"))
    return lg.two_channel(x)


@query("q16_reconciliation", f"""WITH {LEDGER}, u AS (SELECT provider AS target, conv_id % 90 AS prompt, billed AS completion, CASE WHEN conv_id % 4 = 3 THEN NULL ELSE conv_id % 90 + billed + CASE WHEN conv_id % 4 IN (1, 2) THEN turn * 3 ELSE 0 END END AS total,
  CASE WHEN conv_id % 4 = 1 THEN turn * 3 WHEN conv_id % 4 = 0 THEN 0 END AS reasoning, conv_id % 4 = 1 AS additive, canonical AS entries FROM ledger),
h AS (SELECT *, total - prompt - completion - CASE WHEN additive THEN coalesce(reasoning, 0) ELSE 0 END AS hidden FROM u)
SELECT target, count(*) AS n, count(*) FILTER (hidden = 0) AS reconciled, CAST(median(hidden) AS DOUBLE) AS median_hidden, count(*) FILTER (reasoning IS NULL) AS reasoning_absent,
  count(*) FILTER (reasoning > 0) AS reasoning_positive, count(*) FILTER (reasoning = 0) AS reasoning_zero, count(*) FILTER (entries = completion) AS entries_agree FROM h GROUP BY 1""")
def q16(spark, d):
    k, t = F.col("conv_id") % 4, (F.col("turn") * 3).cast("long")
    x = ledger(spark, d).select(
        F.col("provider").alias("target"), (F.col("conv_id") % 90).alias("prompt"), F.col("billed").alias("completion"),
        F.when(k != 3, F.col("conv_id") % 90 + F.col("billed") + F.when(k.isin(1, 2), t).otherwise(0)).alias("total"),
        F.when(k == 1, t).when(k == 0, 0).cast("long").alias("reasoning"), (k == 1).alias("additive"), (k == 3).alias("no_total"), F.col("canonical").alias("logprob_entries"))
    return lg.reconciliation(x)


@query("q17_completeness", f"""WITH {LEDGER}, d AS (SELECT provider || '/' || model AS cell, billed, canonical AS entries, reasoning_text AS r, response_text AS t,
  CASE WHEN conv_id % 8 = 1 THEN response_text ELSE reasoning_text || '<sep>' || response_text END AS stream FROM ledger),
o AS (SELECT *, (r = '' OR contains(stream, r)) AND (t = '' OR contains(stream, t)) AND length(stream) >= length(r) + length(t) AS complete FROM d)
SELECT cell, count(*) AS n, count(*) FILTER (complete) AS complete, count(*) FILTER (complete AND billed <> entries) AS nonzero, count(*) FILTER (complete AND length(stream) < length(r) + length(t)) AS leaks,
  CAST(sum(CASE WHEN complete THEN entries END) AS BIGINT) AS generated FROM o GROUP BY 1""")
def q17(spark, d):
    stream = F.when(F.col("conv_id") % 8 == 1, F.col("response_text")).otherwise(F.concat("reasoning_text", F.lit("<sep>"), "response_text"))
    x = ledger(spark, d).select(F.concat_ws("/", "provider", "model").alias("cell"), "billed", F.col("canonical").alias("entries"), F.col("reasoning_text").alias("reasoning"), F.col("response_text").alias("text"), stream.alias("stream"))
    return lg.completeness(x)


@query("q18_informative_share", f"""WITH {BIG} SELECT provider, model, count(*) AS n, count(*) FILTER (billed <> max_tokens) AS informative, count(*) FILTER (billed < max_tokens) AS informative_strict,
  round(avg(CASE WHEN billed <> max_tokens THEN 1.0 ELSE 0.0 END), 6) AS share FROM big GROUP BY 1, 2""")
def q18(spark, d):
    return lg.informative_share(big_ledger(spark, d))


PATTERNS = {"customer#*": "all", "customer#0000000?1": "ones", "Customer#00000001?": "tens", "customer#00000011*": "hundreds", "customer#000000042": "exact", "*7": "sevens"}


@query("q19_pattern_resolution", "WITH p(pattern, value, ord) AS (VALUES " + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(PATTERNS.items())) + """),
f AS (SELECT c_name AS model, pattern, value, row_number() OVER (PARTITION BY c_name ORDER BY (lower(c_name) = lower(pattern)) DESC, length(replace(replace(pattern, '*', ''), '?', '')) DESC, ord) AS n
  FROM (SELECT DISTINCT c_name FROM customer), p WHERE lower(c_name) GLOB lower(pattern))
SELECT c.c_name AS model, f.pattern, f.value FROM (SELECT DISTINCT c_name FROM customer) c LEFT JOIN f ON f.model = c.c_name AND f.n = 1""")
def q19(spark, d):
    names = table(spark, d, "customer").select(F.col("c_name").alias("model"))
    p = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(PATTERNS.items())], "pattern string, value string, ord int")
    return matching.resolve_patterns(names, p)


@query("q20_policy_overlay", """WITH p(pattern, alpha, over_cap, ord) AS (VALUES ('*1', 0.05, NULL, 0), ('p_*', NULL, NULL, 1), ('*brand#1*', 0.02, false, 2)),
f AS (SELECT p_brand AS model, alpha, over_cap, row_number() OVER (PARTITION BY p_brand ORDER BY length(replace(pattern, '*', '')) DESC, ord) AS n FROM (SELECT DISTINCT p_brand FROM part), p WHERE lower(p_brand) GLOB lower(pattern))
SELECT c.p_brand AS model, CAST(coalesce(f.alpha, 0.01) AS DOUBLE) AS alpha, CAST(3.0 AS DOUBLE) AS tolerance, coalesce(f.over_cap, true) AS over_cap FROM (SELECT DISTINCT p_brand FROM part) c LEFT JOIN f ON f.model = c.p_brand AND f.n = 1""")
def q20(spark, d):
    names = table(spark, d, "part").select(F.col("p_brand").alias("model"))
    over = spark.createDataFrame([("*1", 0.05, None, 0), ("p_*", None, None, 1), ("*brand#1*", 0.02, False, 2)], "pattern string, alpha double, over_cap boolean, ord int")
    resolved = matching.resolve_patterns(names, over.withColumn("value", F.col("pattern")))
    return matching.overlay(names, resolved, over.drop("ord"), {"alpha": 0.01, "tolerance": 3.0, "over_cap": True})


FIRST = "first_config AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY precedence) AS nth FROM config) WHERE nth = 1)"


@query("q21_cell_lookup", f"""WITH {LEDGER}, {CONFIG}, {FIRST} SELECT l.provider, l.model, c.map, c.repo, c.reasoning_format, count(*) AS n FROM ledger l LEFT JOIN first_config c USING (provider, model) GROUP BY ALL""")
def q21(spark, d):
    return matching.lookup_cells(ledger(spark, d), config(spark)).groupBy("provider", "model", "map", "repo", "reasoning_format").agg(F.count(F.lit(1)).alias("n"))


@query("q22_catalog_missing", """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)""")
def q22(spark, d):
    wanted = table(spark, d, "customer").select("c_custkey", "c_name")
    return matching.missing(wanted, table(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("q23_resume_todo", f"""WITH {LEDGER}, p AS (SELECT DISTINCT text AS prompt FROM conversations WHERE role = 'user'), c AS (SELECT DISTINCT provider, model FROM ledger)
SELECT provider, model, count(*) AS todo FROM (SELECT c.provider, c.model, p.prompt FROM c, p EXCEPT SELECT provider, model, prompt FROM ledger) GROUP BY 1, 2""")
def q23(spark, d):
    led = ledger(spark, d)
    p = table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("prompt"))
    return matching.todo(p, led, led).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("todo"))


SCORES = """scores AS (SELECT event_type AS key, CAST(-(event_id % 97) AS DOUBLE) AS score FROM events UNION ALL SELECT 'few', CAST(-n_nationkey AS DOUBLE) FROM nation WHERE n_nationkey < 10)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), (-(F.col("event_id") % 97)).cast("double").alias("score"))
    return e.unionByName(table(spark, d, "nation").where("n_nationkey < 10").select(F.lit("few").alias("key"), (-F.col("n_nationkey")).cast("double").alias("score")))


@query("q24_conformal_threshold", f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score) AS i, count(*) OVER (PARTITION BY key) AS n FROM scores),
k AS (SELECT *, CAST(floor(0.05 * (n + 1) + 1e-9) AS BIGINT) AS k FROM r) SELECT key, max(n) AS n, max(k) AS k, coalesce(max(CASE WHEN i = k THEN score END), CAST('-inf' AS DOUBLE)) AS tau FROM k GROUP BY key""")
def q24(spark, d):
    return calibration.thresholds(scores(spark, d), ALPHA)


@query("q25_gap_calibration", f"""WITH {CAPTURED}, g AS (SELECT r.model || '|' || c.language AS key, r.billed - r.canonical AS gap FROM rec r JOIN choice c USING (response_id)
  WHERE r.shadow AND r.n = 1 AND NOT c.capped AND r.status <> 'alert' AND c.k = 0 AND r.host = 'h1')
SELECT key, count(*) AS n, max(gap) AS max_gap, round(avg(gap), 6) AS mean_gap, round(1.0 / (count(*) + 1), 9) AS level FROM g GROUP BY key""")
def q25(spark, d):
    g = calibration.gap_rule(calibration.gaps(calibration.trusted(audits(spark, d), None, "h1", 0.0, 1e18)))
    return g.withColumns({"mean_gap": F.round("mean_gap", 6), "level": F.round("level", 9)})


META_ROWS = [("m0|latin", "tok0", "s0", 1.0, 1.0, None), ("m1|latin", "tok1", "s1", 1.0, 0.9, "abc"), ("m0|cjk", "tok9", None, 1.0, 1.0, None)]
META = "meta(key, tokenizer, scorer, temperature, top_p, system) AS (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in META_ROWS) + ")"


@query("q26_calibration_applicability", f"""WITH {CAPTURED}, {META}, x AS (SELECT model || '|' || language AS key, 'tok' || substr(model, 2) AS tokenizer, CASE WHEN k = 0 THEN 's' || substr(model, 2) END AS scorer,
  CAST(1.0 AS DOUBLE) AS temperature, CASE WHEN response_id % 5 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS top_p, CASE WHEN response_id % 7 = 0 THEN 'abc' END AS system FROM choice),
j AS (SELECT x.*, CASE WHEN m.key IS NULL THEN NULL WHEN x.tokenizer IS DISTINCT FROM m.tokenizer THEN 'tokenizer' WHEN x.scorer IS NOT NULL AND x.scorer IS DISTINCT FROM m.scorer THEN 'scorer'
  WHEN x.temperature IS DISTINCT FROM CAST(m.temperature AS DOUBLE) OR x.top_p IS DISTINCT FROM CAST(m.top_p AS DOUBLE) THEN 'sampling' END AS reason, m.key IS NULL AS unknown, x.system IS DISTINCT FROM m.system AS other FROM x LEFT JOIN meta m USING (key))
SELECT key, reason, CASE WHEN unknown THEN 'no_settings' WHEN reason IS NULL AND other THEN 'system_prompt' END AS warning, count(*) AS n FROM j GROUP BY ALL""")
def q26(spark, d):
    meta = spark.createDataFrame(META_ROWS, "key string, tokenizer string, scorer string, temperature double, top_p double, system string")
    c = captured(spark, d).select("model", "response_id", F.explode("choices").alias("c"))
    rows = c.select(
        tokens.calibration_key(F.col("model"), F.col("c.language")).alias("key"), F.concat(F.lit("tok"), F.substring("model", 2, 9)).alias("tokenizer"),
        F.when(F.col("c.index") == 0, F.concat(F.lit("s"), F.substring("model", 2, 9))).alias("scorer"), F.lit(1.0).alias("temperature"),
        F.when(F.col("response_id") % 5 == 0, 0.9).otherwise(1.0).alias("top_p"), F.when(F.col("response_id") % 7 == 0, "abc").alias("system"))
    return calibration.applicability(rows, meta).groupBy("key", "reason", "warning").agg(F.count(F.lit(1)).alias("n"))


@query("q27_trusted_period", f"""WITH {CAPTURED}, p AS (SELECT min(response_id) AS a, max(response_id) AS b FROM rec)
SELECT r.model, r.host, count(*) AS n, min(r.response_id) AS first_id, max(r.response_id) AS last_id FROM rec r JOIN choice c USING (response_id), p
WHERE r.shadow AND r.n = 1 AND NOT c.capped AND r.status <> 'alert' AND r.response_id BETWEEN a AND a + (b - a) * CAST(0.5 AS DOUBLE) GROUP BY 1, 2""")
def q27(spark, d):
    """The first half of the time that the data covers as the period."""
    first, last = captured(spark, d).agg(F.min("time"), F.max("time")).first()
    t = calibration.trusted(audits(spark, d), None, None, first or 0.0, (first or 0.0) + ((last or 0.0) - (first or 0.0)) * 0.5)
    return t.groupBy("model", "host").agg(F.count(F.lit(1)).alias("n"), F.min("response_id").alias("first_id"), F.max("response_id").alias("last_id"))


@query("q65_trusted_middle", f"""WITH {CAPTURED}, p AS (SELECT min(response_id) AS a, max(response_id) AS b FROM rec)
SELECT r.model, r.host, count(*) AS n, min(r.response_id) AS first_id, max(r.response_id) AS last_id FROM rec r JOIN choice c USING (response_id), p
WHERE r.shadow AND r.n = 1 AND NOT c.capped AND r.status <> 'alert' AND r.response_id BETWEEN a + (b - a) * CAST(0.125 AS DOUBLE) AND a + (b - a) * CAST(0.875 AS DOUBLE) GROUP BY 1, 2""")
def q65(spark, d):
    """As q27, with the middle three quarters of the time that the data covers as the period."""
    first, last = captured(spark, d).agg(F.min("time"), F.max("time")).first()
    apart = (last or 0.0) - (first or 0.0)
    t = calibration.trusted(audits(spark, d), None, None, (first or 0.0) + apart * 0.125, (first or 0.0) + apart * 0.875)
    return t.groupBy("model", "host").agg(F.count(F.lit(1)).alias("n"), F.min("response_id").alias("first_id"), F.max("response_id").alias("last_id"))


@query("q28_record_checks", f"WITH {CAPTURED} SELECT response_id, n, reported, canonical, hidden, shadow, count_skipped, billed_minus_reported FROM rec")
def q28(spark, d):
    return audits(spark, d).select("response_id", "n", "reported", "canonical", "hidden", "shadow", "count_skipped", "billed_minus_reported")


@query("q29_choice_verdicts", f"WITH {CAPTURED} SELECT response_id, k AS index, verdict FROM choice")
def q29(spark, d):
    return audits(spark, d).select("response_id", F.explode("choices").alias("c")).select("response_id", "c.index", "c.verdict")


@query("q30_record_status", f"WITH {CAPTURED} SELECT response_id, concat_ws(',', CASE WHEN over_cap THEN 'over_cap' END, CASE WHEN mismatch THEN 'count_mismatch' END, CASE WHEN rejected THEN 'likelihood_reject' END) AS findings, status FROM rec")
def q30(spark, d):
    return audits(spark, d).select("response_id", F.array_join("findings", ",").alias("findings"), "status")


@query("q31_likelihood_decision", f"""WITH {SCORES}, x AS (SELECT key, score, abs(CAST(score AS BIGINT)) % 3 AS spans FROM scores)
SELECT key, CASE WHEN key = 'few' THEN 'uncalibrated' WHEN score < -60 - spans * 0.5 THEN 'reject' ELSE 'pass' END AS verdict, count(*) AS n FROM x GROUP BY 1, 2""")
def q31(spark, d):
    tau = F.when(F.col("key") != "few", -60.0)
    v = calibration.decision(F.col("score"), tau, F.abs(F.col("score").cast("long")) % 3, F.lit(MARGIN))
    return scores(spark, d).groupBy("key", v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("q32_noise_margin", """WITH r AS (SELECT o_orderpriority AS model, o_custkey AS win, o_totalprice AS score FROM orders), w AS (SELECT model, win, max(score) - min(score) AS apart FROM r GROUP BY 1, 2)
SELECT model, round(greatest(0.0, max(apart)), 6) AS margin FROM w GROUP BY 1""")
def q32(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("window"), F.col("o_totalprice").alias("score"))
    return calibration.noise_margins(r).withColumn("margin", F.round("margin", 6))


W = "(1 - p0) / p0"
WEALTH = "[" + ", ".join(f"k * ln(1 + {b!r} * {W}) + (n - k) * ln(1 - {b!r})" for b in stats.BETS) + "]"
EVIDENCE = f"""{OUTCOMES}, c AS (SELECT *, CASE WHEN p0 <> lag(p0) OVER (PARTITION BY key ORDER BY seq) THEN 1 ELSE 0 END AS ch FROM outcomes),
e AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS epoch FROM c),
r AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN rejected THEN 1 ELSE 0 END) OVER w AS k, sum(extra) OVER w AS x, sum(tokens) OVER w AS t FROM e WINDOW w AS (PARTITION BY key, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, {WEALTH} AS wealth FROM r),
ev AS (SELECT *, list_max(wealth) + ln(list_sum(list_transform(wealth, lambda w: exp(w - list_max(wealth)))) / 8) AS log_evidence FROM v)"""


@query("q33_monitor_evidence", f"WITH {EVIDENCE} SELECT key, seq, epoch, n AS n_tested, CAST(k AS BIGINT) AS n_rejected, round(log_evidence, 5) AS log_evidence FROM ev")
def q33(spark, d):
    return monitor.evidence(outcomes(spark, d)).select("key", "seq", "epoch", "n_tested", "n_rejected", F.round("log_evidence", 5).alias("log_evidence"))


@query("q34_monitor_first_flag", f"""WITH {EVIDENCE} SELECT key, epoch, min(CASE WHEN log_evidence >= -ln(1e-6) AND CAST(x AS DOUBLE) / greatest(t, 1) >= 0.001 THEN n END) AS flagged_at, max(n) AS tested,
  CAST(max(k) AS BIGINT) AS rejected, CAST(max(x) AS BIGINT) AS extra FROM ev GROUP BY 1, 2""")
def q34(spark, d):
    return monitor.first_flags(outcomes(spark, d)).select("key", "epoch", "flagged_at", "tested", "rejected", "extra")


@query("q35_monitor_epochs", f"WITH {EVIDENCE} SELECT key, count(DISTINCT epoch) AS epochs, count(*) AS outcomes FROM ev GROUP BY 1")
def q35(spark, d):
    return monitor.epochs(outcomes(spark, d)).groupBy("key").agg(F.count_distinct("epoch").alias("epochs"), F.count(F.lit(1)).alias("outcomes"))


RULE = f"""{CAPTURED}, g AS (SELECT r.model || '|' || c.language AS key, r.billed - r.canonical AS gap FROM rec r JOIN choice c USING (response_id)
  WHERE r.shadow AND r.n = 1 AND NOT c.capped AND r.status <> 'alert' AND r.host = 'h1'), rule AS (SELECT key, max(gap) AS max_gap, avg(gap) AS mean_gap FROM g GROUP BY key)"""


@query("q36_count_rule", f"""WITH {RULE} SELECT x.key, count(*) AS n, count(*) FILTER (x.gap > rule.max_gap) AS rejected, CAST(sum(greatest(0, x.gap - rule.max_gap)) AS BIGINT) AS extra FROM (
  SELECT r.model || '|' || c.language AS key, r.billed - r.canonical AS gap FROM rec r JOIN choice c USING (response_id) WHERE r.count_skipped = 'no_logprobs' AND r.shadow AND r.n = 1 AND NOT c.capped) x JOIN rule USING (key) GROUP BY 1""")
def q36(spark, d):
    a = audits(spark, d)
    rule = calibration.gap_rule(calibration.gaps(calibration.trusted(a, None, "h1", 0.0, 1e18)))
    return audit.count_outcomes(a, rule).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("rejected"), F.sum("extra").alias("extra"))


@query("q37_count_batches", f"""WITH {OUTCOMES}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY key ORDER BY seq) - 1) // 100 AS BIGINT) AS batch FROM outcomes)
SELECT key, batch, count(*) AS n, CAST(sum(extra) AS BIGINT) AS gap, CAST(sum(tokens) AS BIGINT) AS canonical FROM b GROUP BY 1, 2 HAVING count(*) = 100""")
def q37(spark, d):
    o = outcomes(spark, d).select("key", "seq", F.col("extra").alias("gap"), F.col("tokens").alias("canonical"), F.lit("h").alias("host"))
    return monitor.batches(o).select("key", "batch", "n", "gap", "canonical")


@query("q38_report_summary", f"""WITH {CAPTURED}, s AS (SELECT host, model, count(*) AS responses, count(*) FILTER (status = 'alert') AS alerts, count(*) FILTER (status = 'unverifiable') AS unverifiable, count(billed_minus_reported) AS mismatched_responses,
  count(DISTINCT billed_minus_reported) AS distinct_offsets, CAST(coalesce(sum(CASE WHEN shadow THEN billed END), 0) AS BIGINT) AS shadow_billed, CAST(coalesce(sum(CASE WHEN shadow THEN canonical END), 0) AS BIGINT) AS shadow_canonical FROM rec GROUP BY 1, 2)
SELECT *, round(100.0 * (shadow_billed - shadow_canonical) / greatest(shadow_billed, 1), 6) AS shadow_percent FROM s""")
def q38(spark, d):
    return report.summary(audits(spark, d))


@query("q39_findings_histogram", f"""WITH {CAPTURED} SELECT host, model, finding, count(*) AS n FROM (SELECT host, model, unnest(list_filter([CASE WHEN over_cap THEN 'over_cap' END, CASE WHEN mismatch THEN 'count_mismatch' END, CASE WHEN rejected THEN 'likelihood_reject' END], lambda f: f IS NOT NULL)) AS finding FROM rec) GROUP BY ALL""")
def q39(spark, d):
    return report.findings_histogram(audits(spark, d))


@query("q40_offset_histogram", f"WITH {CAPTURED} SELECT host, model, billed_minus_reported, count(*) AS n FROM rec WHERE billed_minus_reported IS NOT NULL GROUP BY ALL")
def q40(spark, d):
    return report.offset_histogram(audits(spark, d))


@query("q41_skip_histogram", f"WITH {CAPTURED} SELECT host, model, count_skipped, count(*) AS n FROM rec WHERE count_skipped IS NOT NULL GROUP BY ALL")
def q41(spark, d):
    return report.skip_histogram(audits(spark, d))


@query("q42_likelihood_summary", f"""WITH {CAPTURED} SELECT host, model, count(*) FILTER (verdict IN ('pass', 'reject')) AS tested, count(*) FILTER (verdict = 'reject') AS rejected, count(*) FILTER (verdict NOT IN ('pass', 'reject')) AS untested,
  round(CAST(sum(CASE WHEN verdict = 'reject' THEN greatest(0, reported - canonical) ELSE 0 END) AS DOUBLE) / greatest(sum(CASE WHEN verdict IN ('pass', 'reject') THEN reported END), 1), 9) AS extra_share,
  CAST(round(count(*) FILTER (verdict IN ('pass', 'reject')) * 0.01, 6) AS DOUBLE) AS expected FROM choice GROUP BY 1, 2""")
def q42(spark, d):
    return report.likelihood(audits(spark, d))


LETTERS = "etaoinshrdlu"
CYRILLIC, HAN = "етаоинсхрдлу", "漢字仮名交文日本語学校生"


@query("q43_script_bucket", f"""WITH d AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN translate(text, '{LETTERS}', '{CYRILLIC}') WHEN 1 THEN translate(text, '{LETTERS}', '{HAN}') WHEN 2 THEN regexp_replace(text, '\\p{{L}}', '1', 'g') WHEN 3 THEN 'а漢ab' || 'вг語' ELSE text END AS t FROM documents),
e AS (SELECT doc_id, regexp_extract_all(t, '\\p{{L}}') AS letters FROM d),
l AS (SELECT doc_id, unnest(list_transform(letters, lambda x: CASE WHEN regexp_matches(x, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}]') THEN 'cjk' WHEN regexp_matches(x, '[\\x{{0400}}-\\x{{04FF}}]') THEN 'cyrillic' ELSE 'latin' END)) AS script, unnest(range(len(letters))) AS pos FROM e),
r AS (SELECT doc_id, script, count(*) AS n, min(pos) AS head FROM l GROUP BY 1, 2), b AS (SELECT doc_id, arg_max(script, struct_pack(n := n, head := -head)) AS script FROM r GROUP BY 1)
SELECT doc_id, coalesce(script, 'none') AS script FROM d LEFT JOIN b USING (doc_id)""")
def q43(spark, d):
    """Whole documents, some of their letters written in other scripts, and some in which scripts tie: the one seen first counts."""
    k = F.col("doc_id") % 7
    t = F.when(k == 0, F.translate("text", LETTERS, CYRILLIC)).when(k == 1, F.translate("text", LETTERS, HAN)).when(k == 2, F.regexp_replace("text", r"\p{L}", "1")).when(k == 3, F.lit("а漢ab" + "вг語"))
    return table(spark, d, "documents").select("doc_id", t.otherwise(F.col("text")).alias("t")).select("doc_id", tokens.script_bucket(F.col("t")).alias("script"))


FORMATS = "CASE conv_id % 5 WHEN 0 THEN 'harmony' WHEN 1 THEN 'simple' WHEN 2 THEN 'think_tags' WHEN 3 THEN 'gemma_thinking' ELSE 'glm_thinking' END"


@query("q44_canonical_count", f"""WITH {LEDGER}, f AS (SELECT *, {FORMATS} AS fmt, CASE WHEN turn % 4 = 1 THEN prompt ELSE '' END AS r, CASE WHEN conv_id % 11 = 0 THEN '' ELSE response_text END AS t FROM ledger),
x AS (SELECT *, CASE WHEN r = '' THEN t WHEN fmt = 'harmony' THEN 'assistant<|channel|>analysis<|message|>' || r || CASE WHEN t <> '' THEN '<|end|><|start|>assistant<|channel|>final<|message|>' || t ELSE '' END
  WHEN fmt = 'gemma_thinking' THEN '<|channel>thought' || chr(10) || r || CASE WHEN t <> '' THEN chr(10) || '<channel|>' || t ELSE '' END
  WHEN fmt IN ('think_tags', 'glm_thinking') THEN '<think>' || r || CASE WHEN t <> '' THEN '</think>' || t ELSE '' END ELSE r || t END AS whole FROM f)
SELECT response_id, CAST(len(regexp_extract_all(whole, '{TOK}')) AS BIGINT) + CASE WHEN finish_reason = 'stop' AND fmt = 'simple' THEN 1 ELSE 0 END AS tokens, md5(whole) AS digest FROM x""")
def q44(spark, d):
    k = F.col("conv_id") % 5
    fmt = F.when(k == 0, "harmony").when(k == 1, "simple").when(k == 2, "think_tags").when(k == 3, "gemma_thinking").otherwise("glm_thinking")
    x = ledger(spark, d).select("response_id", "finish_reason", fmt.alias("fmt"), F.when(F.col("turn") % 4 == 1, F.col("prompt")).otherwise("").alias("r"), F.when(F.col("conv_id") % 11 == 0, "").otherwise(F.col("response_text")).alias("t"))
    n = tokens.canonical_count(F.col("r"), F.col("t"), F.col("fmt"), F.lit(None).cast("boolean"), F.col("finish_reason"))
    return x.select("response_id", n.alias("tokens"), F.md5(tokens.reconstructed(F.col("r"), F.col("t"), F.col("fmt"))).alias("digest"))


@query("q45_effective_finish", f"WITH {LEDGER} SELECT provider, CASE WHEN billed = max_tokens AND finish_reason = 'stop' THEN 'length' ELSE finish_reason END AS finish, count(*) AS n FROM ledger GROUP BY 1, 2")
def q45(spark, d):
    f = tokens.effective_finish(F.col("billed"), F.col("finish_reason"), F.col("max_tokens"))
    return ledger(spark, d).groupBy("provider", f.alias("finish")).agg(F.count(F.lit(1)).alias("n"))


@query("q46_system_hash", """WITH s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role IN ('system', 'developer')) AS t FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN t <> '' THEN substr(sha256(t), 1, 16) END AS system FROM s""")
def q46(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", tokens.system_hash(F.col("m")).alias("system"))


@query("q47_first_seen_prompts", """WITH p AS (SELECT trim(text, ' ') AS prompt, conv_id * 100 + turn AS position FROM conversations WHERE role = 'user' AND length(text) BETWEEN 20 AND 400) SELECT prompt, min(position) AS position FROM p GROUP BY 1""")
def q47(spark, d):
    p = table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("prompt"), (F.col("conv_id") * 100 + F.col("turn")).alias("position"))
    return matching.first_seen(p, 20, 400)


@query("q48_variant_best", f"""WITH {LEDGER}, v AS (SELECT provider AS cell, variant, nth, gap + off AS delta FROM ledger, (VALUES ('plain', 0, 0), ('eos', 1, 1), ('less', 2, -1)) t(variant, nth, off)),
s AS (SELECT cell, variant, nth, count(*) AS n, count(*) FILTER (delta = 0) AS exact, avg(delta) AS mean FROM v GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY exact DESC, abs(mean), nth) AS i FROM s)
SELECT cell, variant, n, exact, round(mean, 6) AS mean_delta, exact >= n - 1 AS ok FROM b WHERE i = 1""")
def q48(spark, d):
    v = spark.createDataFrame([("plain", 0, 0), ("eos", 1, 1), ("less", 2, -1)], "variant string, nth int, off int")
    x = ledger(spark, d).select(F.col("provider").alias("cell"), "gap").crossJoin(F.broadcast(v)).withColumn("delta", F.col("gap") + F.col("off"))
    return lg.variant_best(x)


#: Side a are tokens; side b cuts every fifth word of four characters or more in two.
PIECES = "CASE WHEN i % 5 = 0 AND length(tok) >= 4 THEN [tok[1:2], tok[3:]] ELSE [tok] END"


@query("q49_divergent_spans", f"""WITH t AS (SELECT conv_id * 100 + turn AS id, regexp_extract_all(text, '{TOK}') AS toks FROM conversations WHERE role = 'user'),
x AS (SELECT id, unnest(toks) AS tok, unnest(generate_series(0, len(toks) - 1)) AS i FROM t), y AS (SELECT *, sum(octet_length(encode(tok))) OVER (PARTITION BY id ORDER BY i) - octet_length(encode(tok)) AS start FROM x)
SELECT id, CAST(start AS BIGINT) AS start, CAST(start + octet_length(encode(tok)) AS BIGINT) AS "end", i AS a_lo, i + 1 AS a_hi FROM y WHERE i % 5 = 0 AND length(tok) >= 4""")
def q49(spark, d):
    t = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), tokens.tokens(F.col("text")).alias("toks"))
    a = t.select("id", F.lit("a").alias("side"), F.posexplode("toks").alias("nth", "token"))
    cut = F.flatten(F.transform("toks", lambda w, i: F.when((i % 5 == 0) & (F.length(w) >= 4), F.array(F.substring(w, 1, 2), F.substring(w, F.lit(3), F.length(w)))).otherwise(F.array(w))))
    b = t.select("id", F.lit("b").alias("side"), F.posexplode(cut).alias("nth", "token"))
    both = a.unionByName(b).withColumn("nth", F.col("nth").cast("long"))
    return align.divergent_spans(both).select("id", F.col("start").cast("long"), F.col("end").cast("long"), "a_lo", "a_hi")


@query("q50_windowed_llr", """WITH w AS (SELECT l_orderkey AS id, l_linenumber AS span, unnest([0, 1, 2]) AS rep, l_tax, l_discount FROM lineitem),
s AS (SELECT id, span, median(l_discount + rep * 0.001) AS r, median(l_tax + rep * 0.002) AS c FROM w GROUP BY 1, 2) SELECT id, round(sum(r - c), 6) AS llr, count(*) AS spans FROM s GROUP BY 1""")
def q50(spark, d):
    sides = F.array(F.struct(F.lit("reported").alias("side"), F.col("l_discount").alias("base"), F.lit(0.001).alias("step")), F.struct(F.lit("canonical").alias("side"), F.col("l_tax").alias("base"), F.lit(0.002).alias("step")))
    w = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax").repartition("l_orderkey")  # before they are unfolded
    w = w.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("span"), F.inline(sides))
    repeats = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda n: F.col("base") + n * F.col("step"))
    s = align.window_scores(w.select("id", "span", "side", repeats.alias("scores")))
    return align.likelihood_ratio(s).select("id", F.round("llr", 6).alias("llr"), "spans")


@query("q51_entry_alignment", f"""WITH {LEDGER} SELECT response_id, CASE WHEN conv_id % 5 = 1 THEN 'full' WHEN conv_id % 5 = 2 THEN NULL ELSE 'content' END AS "array", CASE WHEN conv_id % 5 = 1 THEN 1 WHEN conv_id % 5 = 2 THEN NULL ELSE 0 END AS start FROM ledger WHERE response_text <> ''""")
def q51(spark, d):
    return entry_alignment(ledger(spark, d).where(F.col("response_text") != ""))


@query("q64_entry_alignment_whole", f"""WITH {LEDGER} SELECT response_id, CASE WHEN conv_id % 5 = 1 THEN 'full' WHEN conv_id % 5 = 2 THEN NULL ELSE 'content' END AS "array", CASE WHEN conv_id % 5 = 1 THEN 1 WHEN conv_id % 5 = 2 THEN NULL ELSE 0 END AS start FROM ledger WHERE response_text <> ''""")
def q64(spark, d):
    """As q51, which once had a bound on the length."""
    return entry_alignment(ledger(spark, d).where(F.col("response_text") != ""))


def entry_alignment(r: DataFrame) -> DataFrame:
    entry = "struct<token:string,token_id:bigint,bytes:array<int>>"
    none_id, none_bytes = F.lit(None).cast("bigint"), F.lit(None).cast("array<int>")
    own = F.transform(tokens.tokens(F.col("response_text")), lambda t: F.struct(t.alias("token"), none_id.alias("token_id"), none_bytes.alias("bytes")).cast(entry))
    think = F.array(F.struct(F.lit("<think>").alias("token"), none_id.alias("token_id"), none_bytes.alias("bytes")).cast(entry))
    stop = F.array(F.struct(F.lit("<stop>").alias("token"), none_id.alias("token_id"), F.array().cast("array<int>").alias("bytes")).cast(entry))
    k = F.col("conv_id") % 5
    entries = F.when(k == 1, F.concat(think, own, stop)).when(k == 2, F.concat(own, think)).otherwise(own)
    s = align.slice_of(F.col("e"), F.col("response_text"))
    return r.select("response_id", "response_text", entries.alias("e")).select("response_id", s.alias("s")).select("response_id", "s.array", "s.start")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as event streams of 20-character pieces; some streams are cut off before they finish, and some end without [DONE]."""
    c = table(spark, d, "conversations").where("role = 'assistant'").select(F.concat("conv_id", F.lit("-"), "turn").alias("stream_id"), "conv_id", "text")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 20).cast("int")), lambda i: F.struct(i.alias("seq"), F.substring(F.col("text"), i * 20 + 1, F.lit(20)).alias("piece")))
    own = c.where(F.length("text") > 0).select("stream_id", F.inline(pieces))
    j = F.to_json(F.struct(F.concat(F.lit("id-"), "stream_id").alias("id"), F.lit("m").alias("model"), F.array(F.struct(F.lit(0).alias("index"), F.struct(F.col("piece").alias("content")).alias("delta"))).alias("choices")))
    body = own.select("stream_id", F.col("seq").cast("long").alias("seq"), F.concat(F.lit("data: "), j, F.lit("\r\n\r\n")).alias("raw"))
    ends = c.select("stream_id", "conv_id", F.inline(F.array(
        F.struct(F.lit(1_000_000).cast("long").alias("seq"), F.lit('data: {"choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}\n\n').alias("raw")),
        F.struct(F.lit(1_000_001).cast("long").alias("seq"), F.lit('data: {"choices":[],"usage":{"completion_tokens":7}}\n\n').alias("raw")),
        F.struct(F.lit(1_000_002).cast("long").alias("seq"), F.lit("data: [DONE]\n\n").alias("raw")))))
    return body.unionByName(ends.where("conv_id % 9 <> 0 and not (conv_id % 9 = 1 and seq = 1000002)").drop("conv_id"))


@query("q52_sse_reassembly", """SELECT conv_id || '-' || turn AS stream_id, 'id-' || conv_id || '-' || turn AS id, md5(text) AS content, 'stop' AS finish_reason, CAST(7 AS BIGINT) AS completion_tokens FROM conversations WHERE role = 'assistant' AND conv_id % 9 <> 0 AND text <> ''""")
def q52(spark, d):
    return sse.reassembled(chunks(spark, d)).where("content <> ''").select("stream_id", "id", F.md5("content").alias("content"), "finish_reason", "completion_tokens")


@query("q53_headroom", f"""WITH t AS (SELECT lang AS cell, length(text) AS n, len(regexp_extract_all(text, '{TOK}')) AS w FROM documents WHERE length(text) BETWEEN 40 AND 800)
SELECT cell, count(*) AS n, round(median(CAST(n AS DOUBLE) / w - 1), 6) AS median_surface, round(min(CAST(n AS DOUBLE) / w - 1), 6) AS min_surface FROM t WHERE w > 0 GROUP BY 1""")
def q53(spark, d):
    return lg.headroom(table(spark, d, "documents").select(F.col("lang").alias("cell"), "text"))


#: A public vocabulary file; any of the three kinds that functions.bpe reads will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@query("q54_bpe_token_count")
def q54(spark, d, path=TOKENIZER):
    """Per cell the tokens of a byte-level vocabulary against the pattern's tokens."""
    x = ledger(spark, d).select("provider", "model", "canonical", bpe.bpe_count(F.col("response_text"), bpe.shipped(spark, path)).alias("bpe"))
    return x.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("bpe").alias("bpe_tokens"), F.sum("canonical").alias("pattern_tokens"))


@query("q55_placeholder_alignment")
def q55(spark, d):
    """Texts whose non-ASCII characters came back as two placeholder tokens each."""
    t = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    parts = F.flatten(F.transform(F.split("text", ""), lambda c: F.when(F.octet_length(c) > 1, F.array(F.lit(align.PLACEHOLDER), F.lit(align.PLACEHOLDER))).otherwise(F.array(c))))
    return align.align_holes(t.withColumn("tokens", F.filter(parts, lambda x: x != ""))).select("id", "state", F.size("readings").alias("n"))


@query("q56_batch_pvalue")
def q56(spark, d):
    """Batches of 100 outcomes of the second half of the time against the first half as the calibration."""
    o = outcomes(spark, d).select("key", "seq", F.col("extra").alias("gap"), F.col("tokens").alias("canonical"))
    first, last = o.agg(F.min("seq"), F.max("seq")).first()
    middle = ((first or 0) + (last or 0)) // 2
    return monitor.batch_pvalues(o.where(F.col("seq") > middle), o.where(F.col("seq") <= middle).select("key", "gap")).select("key", "batch", F.round("p_value", 6).alias("p_value"))


@query("q57_detection_rate")
def q57(spark, d):
    x = ledger(spark, d).select(F.col("provider").alias("cell"), F.col("response_id").alias("id"), lg.delta().alias("delta"), "billed")
    return monitor.detection_rate(x, [0.05, 0.1, 0.28, 1.0, 5.0, 11.2])


@query("q58_binomial_tail", """WITH x AS (SELECT c_custkey AS id, c_custkey % 12 AS k, 20 + c_custkey % 30 AS n FROM customer), t AS (SELECT id, k, n, unnest(generate_series(k, n)) AS i FROM x)
SELECT id, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.1) + (n - i) * ln(0.9)))), 7) AS tail FROM t GROUP BY 1""")
def q58(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("id"), F.round(stats.binom_sf(c % 12, 20 + c % 30, F.lit(0.1)), 7).alias("tail"))


@query("q59_norm_ppf", f"WITH x AS (SELECT c_custkey AS id, CAST(c_custkey AS DOUBLE) / 100000 AS p FROM customer) SELECT id, round({ppf_sql('p')}, 7) AS z FROM x")
def q59(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(stats.norm_ppf(F.col("c_custkey").cast("double") / 100000), 7).alias("z"))


@query("q60_integrity", f"""WITH {BIG}, d AS (SELECT provider || '/' || model AS cell, count(*) AS n, count(*) - count(DISTINCT prompt) AS dup FROM big GROUP BY 1)
SELECT 'duplicate_prompts' AS "check", cell, CAST(dup AS VARCHAR) AS problem FROM d WHERE dup > 0 UNION ALL SELECT 'row_count', cell, CAST(n AS VARCHAR) FROM d WHERE n <> 200""")
def q60(spark, d):
    return lg.integrity(big_ledger(spark, d))


@query("q61_hashed_sample")
def q61(spark, d):
    return matching.hashed_sample(ledger(spark, d), ["provider"], "response_id", 25).select("provider", "response_id")


@query("q62_outcome_stream", f"""WITH {CAPTURED} SELECT host || '|' || model AS key, count(*) AS tested, count(*) FILTER (verdict = 'reject') AS rejected, CAST(sum(CASE WHEN verdict = 'reject' THEN greatest(0, reported - canonical) ELSE 0 END) AS BIGINT) AS extra,
  CAST(sum(reported) AS BIGINT) AS tokens FROM choice WHERE verdict IN ('pass', 'reject') GROUP BY 1""")
def q62(spark, d):
    o = audit.outcomes(audits(spark, d))
    return o.groupBy("key").agg(F.count(F.lit(1)).alias("tested"), F.count_if("rejected").alias("rejected"), F.sum("extra").alias("extra"), F.sum("tokens").alias("tokens"))


@query("q63_request_budget", f"""WITH {CONFIG}, {LEDGER} SELECT (SELECT count(*) FROM config WHERE reasoning_format <> 'unresolved') AS cells, count(*) AS done, (SELECT count(*) FROM config) * 200 - count(*) AS planned, (SELECT count(*) FROM config) * 200 - count(*) > 2000 AS over_budget FROM ledger""")
def q63(spark, d):
    return lg.budget(config(spark), ledger(spark, d), 200)


@query("q66_divergent_ids", f"""WITH t AS (SELECT conv_id * 100 + turn AS id, regexp_extract_all(text, '{TOK}') AS toks FROM conversations WHERE role = 'user'),
x AS (SELECT id, unnest(toks) AS tok, unnest(generate_series(0, len(toks) - 1)) AS i FROM t), y AS (SELECT *, sum(octet_length(encode(tok))) OVER (PARTITION BY id ORDER BY i) AS after FROM x)
SELECT id, CAST(after - octet_length(encode(tok)) AS BIGINT) AS start, CAST(after AS BIGINT) AS "end", i AS a_lo, i AS b_lo FROM y WHERE i % 7 = 0""")
def q66(spark, d):
    """The same cuts on either side, but every seventh token with another id."""
    t = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.posexplode(tokens.tokens(F.col("text"))).alias("nth", "token"))
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("nth").alias("token_id")), F.struct(F.lit("b").alias("side"), F.when(F.col("nth") % 7 == 0, -1).otherwise(F.col("nth")).alias("token_id")))
    both = t.select("id", "nth", "token", F.inline(sides)).withColumn("nth", F.col("nth").cast("long"))
    return align.divergent_spans(both).select("id", F.col("start").cast("long"), F.col("end").cast("long"), "a_lo", "b_lo")


PAIR = "len(regexp_extract_all(text, 'th|he|in|er'))"


@query("q67_exchange_audit", f"""WITH x AS (SELECT *, conv_id * 100 + turn AS exchange, octet_length(encode(text)) AS bytes, {PAIR} AS pairs FROM conversations WHERE role = 'assistant'),
y AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN bytes ELSE bytes - pairs END AS whole FROM x),
z AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN greatest(whole - 1, 0) WHEN conv_id % 7 = 0 THEN whole + 2 ELSE whole END AS entries,
  CASE WHEN text = '' AND conv_id % 5 <> 0 AND conv_id % 7 = 0 THEN NULL WHEN conv_id % 5 = 0 AND text <> '' THEN NULL WHEN conv_id % 5 <> 0 AND conv_id % 7 = 0 THEN 'full' ELSE 'content' END AS "array" FROM y),
v AS (SELECT *, CASE WHEN conv_id % 3 = 2 OR conv_id % 11 = 0 OR "array" IS NULL OR turn % 4 = 3 THEN false ELSE whole <> bytes - pairs END AS noncanonical FROM z)
SELECT exchange, CASE WHEN conv_id % 11 <> 0 THEN CAST(entries AS BIGINT) END AS reported, CASE WHEN conv_id % 3 <> 2 THEN CAST(bytes - pairs AS BIGINT) END AS canonical,
  CASE WHEN conv_id % 11 <> 0 THEN "array" END AS "array", noncanonical, CASE WHEN noncanonical THEN CAST(-4.0 * pairs AS DOUBLE) END AS llr,
  CASE WHEN conv_id % 11 = 0 THEN NULL WHEN "array" IS NULL OR conv_id % 3 = 2 THEN 'unverifiable' WHEN turn % 4 = 3 THEN 'capped' WHEN noncanonical AND -4.0 * pairs < -2.0 - pairs * 0.5 THEN 'reject' ELSE 'pass' END AS verdict,
  CASE WHEN conv_id % 11 = 0 OR "array" IS NULL OR conv_id % 7 = 0 AND "array" = 'content' OR conv_id % 4 <> 1 THEN NULL ELSE 2 END AS billed_minus_reported FROM v""")
def q67(spark, d):
    """Raw requests and responses to verdicts: canonical ids, slices, candidates, scores, and thresholds of the choice's own key."""
    x = stored(exchanges(spark, d))
    known = spark.createDataFrame(EXCHANGE_MODELS, "model string, tokenizer string")
    scores = spark.createDataFrame([(m, i, -5.0 if i < 256 else -6.0) for m, _ in EXCHANGE_MODELS for i in range(256 + len(PAIRS))], "model string, token_id int, logprob double")
    c, store = exchange.choices_of(x, known).withColumn("scorer", F.lit("s")), likelihood.WindowStore(spark)
    scorer = likelihood.id_scorer(scores)
    c = exchange.scored(c, exchange.resolved_readings(c, store, scorer), store, scorer)
    keys = [f"{m}|{lang}" for m, _ in EXCHANGE_MODELS for lang in ("latin", "none", "cjk", "cyrillic", "arabic", "devanagari")]
    honest = spark.createDataFrame([(k, float(-2 if n < 2 else 0)) for k in keys for n in range(120)], "key string, score double")
    meta = spark.createDataFrame([(k, dict(EXCHANGE_MODELS)[k[:2]], "s", 1.0, 1.0, None) for k in keys], "key string, tokenizer string, scorer string, temperature double, top_p double, system string")
    margins = spark.createDataFrame([(m, 0.5) for m, _ in EXCHANGE_MODELS], "model string, margin double")
    judged = exchange.verdicts(exchange.calibrated(c, honest, meta, margins, 0.01))
    r = exchange.records(x, judged)
    one = F.col("choices")[0]
    return r.select("exchange", *[one[k].alias(k) for k in ("reported", "canonical", "array", "noncanonical", "llr", "verdict")], F.col("billed_minus_reported").cast("int").alias("billed_minus_reported"))


#: Ids of the vocabulary as hexadecimal bytes, of user turns and of assistant turns; pairs of ids that follow each other in the former.
IDS = """ids AS (SELECT conv_id, turn, role, list_transform(regexp_extract_all(text, 'th|he|in|er|[\\x00-\\x7F]|[^\\x00-\\x7F]'), lambda x: CASE WHEN length(x) = 1 THEN regexp_extract_all(hex(encode(x)), '..') ELSE [hex(encode(x))] END) AS parts FROM conversations),
flat AS (SELECT conv_id, turn, role, flatten(parts) AS c FROM ids),
follow AS (SELECT CASE WHEN k = 1 THEN '0A' ELSE c[k - 1] END AS a, c[k] AS b FROM (SELECT c, unnest(range(1, len(c) + 1)) AS k FROM flat WHERE role = 'user')),
pairs AS (SELECT a, b, ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY a)) AS p FROM follow GROUP BY a, b)"""


@query("q68_context_likelihood", f"""WITH {IDS},
own AS (SELECT conv_id * 100 + turn AS exchange, c FROM flat WHERE role = 'assistant' AND conv_id % 3 = 0 AND conv_id % 5 <> 0 AND conv_id % 11 <> 0 AND turn % 4 <> 3),
places AS (SELECT exchange, c, k, CASE WHEN k = 1 THEN '0A' ELSE c[k - 1] END AS a, c[k] AS b, c[k + 1] AS z FROM (SELECT exchange, c, unnest(range(1, len(c) + 1)) AS k FROM own) WHERE length(c[k]) = 4),
steps AS (SELECT exchange, k, unnest([{{'w': 1, 'a': a, 'b': b[1:2]}}, {{'w': 1, 'a': b[1:2], 'b': b[3:4]}}, {{'w': 1, 'a': b[3:4], 'b': z}}, {{'w': -1, 'a': a, 'b': b}}, {{'w': -1, 'a': b, 'b': z}}]) AS s FROM places)
SELECT exchange, round(sum(s.w * coalesce(p, -9)), 6) AS llr, CAST(count(DISTINCT k) AS INTEGER) AS spans FROM steps LEFT JOIN pairs ON pairs.a = s.a AND pairs.b = s.b WHERE s.b IS NOT NULL GROUP BY exchange""")
def q68(spark, d):
    """Responses of a provider that reports byte by byte, judged by a model of pairs of ids that is trained on the user turns."""
    known = spark.createDataFrame(EXCHANGE_MODELS, "model string, tokenizer string")
    c = exchange.choices_of(exchanges(spark, d), known)
    users = dealt(table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text"), "conv_id", "turn")
    users = users.select(bpe.canonical_ids(F.encode("text", "UTF-8"), EXCHANGE_MODELS[0][1])["ids"].alias("ids"))
    scorer = likelihood.pair_scorer(stored(pair_logprobs(following(users), [m for m, _ in EXCHANGE_MODELS])), unseen=-9.0)
    store = likelihood.WindowStore(spark)
    scored = exchange.scored(c, exchange.resolved_readings(c, store, scorer), store, scorer)
    return scored.where("noncanonical").select("exchange", F.round("llr", 6).alias("llr"), "spans")


def following(texts: DataFrame) -> DataFrame:
    """(before, token_id) of each place of texts (ids); before the first is a line break. A row of two ids leaves its text behind."""
    before = F.concat(F.array(F.lit(10)), F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(0))))
    return texts.withColumn("_before", before).select(F.inline(F.arrays_zip("_before", "ids"))).where("ids is not null").toDF("before", "token_id")


def pair_logprobs(follow: DataFrame, models: list[str]) -> DataFrame:
    """(model, before, token_id, logprob) from (before, token_id): how often an id follows another, the same for all models."""
    n = follow.groupBy("before", "token_id").agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("before").agg(F.sum("n").alias("whole"))
    p = n.join(whole, "before").withColumn("logprob", F.log(F.col("n") / F.col("whole")))
    return p.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "before", "token_id", "logprob")


@query("q69_config_ambiguity_parts", """SELECT p_brand AS provider, p_type AS model, count(*) AS maps, count(DISTINCT p_size || '/' || split_part(p_name, ' ', 1)) AS variants,
  CASE WHEN count(DISTINCT p_size || '/' || split_part(p_name, ' ', 1)) > 1 THEN 'problem' ELSE 'note' END AS severity FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def q69(spark, d):
    """Brands and types as cells that several parts map to a size and a colour."""
    cells = table(spark, d, "part").select(F.col("p_brand").alias("provider"), F.col("p_type").alias("model"), "p_size", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("colour"))
    return matching.config_ambiguity(cells, ["p_size", "colour"])


@query("q70_caller_view", """WITH e AS (SELECT conv_id, turn, text, unnest([1, 2, 3]) AS nth FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, nth, CASE nth WHEN 1 THEN md5(text) END AS content, CASE nth WHEN 1 THEN conv_id % 2 = 1 END AS logs, CASE nth WHEN 1 THEN conv_id % 3 <> 0 END AS usage, CASE nth WHEN 3 THEN 'data: [DONE]' END AS raw
FROM e WHERE nth <> 2 OR conv_id % 3 <> 0""")
def q70(spark, d):
    """Streams of three events (text with token logs and usage, usage alone, the end), from which what was added on the caller's
    behalf is hidden: logs for even conversations, usage for every third."""
    c = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    log = F.struct(F.array(F.struct(F.lit("{").alias("token"), F.lit(-0.5).alias("logprob"), F.array(F.struct(F.lit('}"').alias("token"))).alias("top_logprobs"))).alias("content"))
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.col("text").alias("content")).alias("delta"), log.alias("logprobs"))
    usage = F.struct(F.length("text").alias("completion_tokens"))
    bodies = [F.to_json(F.struct(F.array(choice).alias("choices"), usage.alias("usage"))), F.to_json(F.struct(F.array().cast("array<string>").alias("choices"), usage.alias("usage"))), F.lit("[DONE]")]
    e = c.select("conv_id", "turn", F.posexplode(F.array(*[F.concat(F.lit("data: "), b) for b in bodies])).alias("nth", "raw")).withColumn("nth", F.col("nth") + 1)
    seen = sse.caller_view(e, F.col("conv_id") % 3 == 0, F.col("conv_id") % 2 == 0)
    data, first = F.substring("raw", 7, 2**30), F.col("nth") == 1
    has = lambda path: F.when(first, F.get_json_object(data, path).isNotNull())
    return seen.select(
        "conv_id", "turn", "nth", F.md5(F.when(first, F.get_json_object(data, "$.choices[0].delta.content"))).alias("content"), has("$.choices[0].logprobs.content[0].token").alias("logs"),
        has("$.usage.completion_tokens").alias("usage"), F.when(F.col("nth") == 3, F.col("raw")).alias("raw"))


@query("q71_batch_test", f"""WITH {OUTCOMES}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, min(seq) OVER () AS first, max(seq) OVER () AS last FROM outcomes),
late AS (SELECT key, seq, extra, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS n FROM o WHERE seq > (first + last) // 2),
b AS (SELECT key, n // 100 AS batch, max(seq) AS seq, sum(extra) AS gap, count(*) AS size FROM late GROUP BY 1, 2 HAVING count(*) = 100),
r AS (SELECT key, avg(extra) AS mean FROM o WHERE seq <= (first + last) // 2 GROUP BY 1)
SELECT 'batch|h|' || key AS key, CAST(seq AS DOUBLE) AS seq, CAST(gap + 10000 AS BIGINT) AS tokens, CAST(greatest(0, round_even(gap - 100 * mean, 0)) AS BIGINT) AS excess FROM b JOIN r USING (key)""")
def q71(spark, d):
    """Full batches of the later half against the earlier half as the calibration: their excess, whatever the permutation test says."""
    o = outcomes(spark, d).select("key", "seq", F.col("extra").alias("gap"), F.col("tokens").alias("canonical"), F.lit("h").alias("host"))
    first, last = o.agg(F.min("seq"), F.max("seq")).first()
    middle = ((first or 0) + (last or 0)) // 2
    full = monitor.whole_batches(o.where(F.col("seq") > middle))
    return endpoint.batch_outcomes(full, o.where(F.col("seq") <= middle), alpha=1.1).select("key", F.col("seq").cast("double").alias("seq"), "tokens", F.col("extra").alias("excess"))


@query("q72_binomial_cdf", """WITH x AS (SELECT c_custkey AS id, c_custkey % 9 AS k, 20 + c_custkey % 30 AS n FROM customer), t AS (SELECT id, n, unnest(generate_series(0, k)) AS i FROM x)
SELECT id, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.2) + (n - i) * ln(0.8)))), 7) AS below FROM t GROUP BY 1""")
def q72(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("id"), F.round(stats.binom_cdf(c % 9, 20 + c % 30, F.lit(0.2)), 7).alias("below"))


@query("q73_calibration_warnings", """WITH s AS (SELECT o_orderpriority || '|' || (o_custkey % 20) AS key, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT *, CAST(floor(0.01 * (n + 1)) AS BIGINT) AS k FROM s),
t AS (SELECT key, n, k, unnest(generate_series(0, greatest(k - 1, 0))) AS i FROM k),
r AS (SELECT key, n, k, CASE WHEN k = 0 THEN 0 ELSE sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.03) + (n - i) * ln(0.97))) END AS risk FROM t GROUP BY key, n, k)
SELECT key, n, k, round(risk, 7) AS risk, CASE WHEN k = 0 THEN 'never_rejects' WHEN risk > 0.01 THEN 'risky' END AS warning FROM r""")
def q73(spark, d):
    """Orders as honest scores: is each key's number of them enough for alpha, and does it risk too many rejections?"""
    scores = table(spark, d, "orders").select(F.concat_ws("|", "o_orderpriority", F.col("o_custkey") % 20).alias("key"), F.col("o_totalprice").alias("score"))
    w = calibration.size_warnings(scores, 0.01, 3.0)
    return w.select("key", "n", F.col("k").cast("long").alias("k"), F.round("risk", 7).alias("risk"), "warning")


@query("q74_conflicting_settings", """SELECT o_orderpriority || '|' || (o_custkey % 50) AS key, count(DISTINCT coalesce(o_orderstatus, '-') || '/' || (o_orderkey % 3)) AS settings FROM orders GROUP BY 1 HAVING count(DISTINCT coalesce(o_orderstatus, '-') || '/' || (o_orderkey % 3)) > 1""")
def q74(spark, d):
    o = table(spark, d, "orders")
    none = F.lit(None).cast("string")
    meta = o.select(F.concat_ws("|", "o_orderpriority", F.col("o_custkey") % 50).alias("key"), F.col("o_orderstatus").alias("tokenizer"), none.alias("scorer"), (F.col("o_orderkey") % 3).cast("double").alias("temperature"), F.lit(1.0).alias("top_p"), none.alias("system"))
    return calibration.conflicts(meta)


@query("q75_pinned_backends", f"""WITH {LEDGER} SELECT block || '-' || (conv_id % 5) AS backend, count(*) AS n, round(avg(billed - canonical), 6) AS mean_delta, min(billed - canonical) AS min_delta, max(billed - canonical) AS max_delta FROM ledger GROUP BY 1""")
def q75(spark, d):
    return lg.pinned_summary(ledger(spark, d).withColumn("backend", F.concat_ws("-", "block", F.col("conv_id") % 5)))


@query("q76_generation_stats", f"""WITH {LEDGER}, g AS (SELECT conv_id * 100 + turn AS response_id, length(text) AS native_tokens FROM conversations WHERE conv_id % 4 <> 2)
SELECT response_id, billed, native_tokens FROM ledger LEFT JOIN g USING (response_id)""")
def q76(spark, d):
    """Responses with the statistics that were looked up for some of them."""
    g = table(spark, d, "conversations").where("conv_id % 4 <> 2").select((F.col("conv_id") * 100 + F.col("turn")).alias("response_id"), F.length("text").cast("long").alias("native_tokens"))
    return matching.with_stats(ledger(spark, d), g).select("response_id", "billed", "native_tokens")


@query("q77_usage_shapes", """WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations), u AS (SELECT *, unnest(['native', 'messages', 'completions']) AS target FROM c)
SELECT conv_id, turn, target, n AS prompt, n + turn AS completion, CASE WHEN target <> 'messages' THEN 2 * n + turn END AS total, CASE WHEN target <> 'messages' THEN turn END AS reasoning, target = 'native' AS additive, target = 'messages' AS no_total FROM u""")
def q77(spark, d):
    """Usage objects as JSON in the shapes of three vendors, brought into one."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    done = F.col("n") + F.col("turn")
    bodies = {
        "native": F.struct(F.struct(F.col("n").alias("promptTokenCount"), done.alias("candidatesTokenCount"), (F.col("n") + done).alias("totalTokenCount"), F.col("turn").alias("thoughtsTokenCount")).alias("usageMetadata")),
        "messages": F.struct(F.struct(F.col("n").alias("input_tokens"), done.alias("output_tokens")).alias("usage")),
        "completions": F.struct(F.struct(F.col("n").alias("prompt_tokens"), done.alias("completion_tokens"), (F.col("n") + done).alias("total_tokens"), F.struct(F.col("turn").alias("reasoning_tokens")).alias("completion_tokens_details")).alias("usage")),
    }
    schemas = {
        "native": "usageMetadata struct<promptTokenCount:bigint,candidatesTokenCount:bigint,totalTokenCount:bigint,thoughtsTokenCount:bigint>", "messages": "usage struct<input_tokens:bigint,output_tokens:bigint>",
        "completions": "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,completion_tokens_details:struct<reasoning_tokens:bigint>>",
    }
    each = [files.usage(c.select("conv_id", "turn", F.from_json(F.to_json(body), schemas[v]).alias("u")).select("conv_id", "turn", "u.*"), v, "conv_id", "turn") for v, body in bodies.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("q78_first_prompts", """WITH p AS (SELECT trim(text, ' ') AS prompt, min(conv_id * 100 + turn) AS position FROM conversations WHERE role = 'user' AND length(text) BETWEEN 20 AND 400 GROUP BY 1) SELECT prompt, position FROM p ORDER BY position, prompt LIMIT 50""")
def q78(spark, d):
    """The first fifty distinct prompts (a report that is meant to be short), or those there are."""
    p = table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("prompt"), (F.col("conv_id") * 100 + F.col("turn")).alias("position"))
    return matching.prompts_or_fallback(p, p, 20, 400, 50)


@query("q79_endpoint_states", f"""WITH {OUTCOMES}, s AS (SELECT CASE seq % 3 WHEN 0 THEN key WHEN 1 THEN 'request|' || key || '|latin' ELSE 'batch|' || key || '|cjk' END AS key, rejected FROM outcomes),
t AS (SELECT key, count(*) AS tested, count(*) FILTER (rejected) AS rejected FROM s GROUP BY 1)
SELECT key, tested, rejected, CASE WHEN starts_with(key, 'request|') THEN 'request' WHEN starts_with(key, 'batch|') THEN 'batch' ELSE 'likelihood' END AS kind,
  CASE WHEN starts_with(key, 'request|') OR starts_with(key, 'batch|') THEN split_part(key, '|', 2) ELSE split_part(key, '|', 1) END AS host,
  CASE WHEN starts_with(key, 'request|') OR starts_with(key, 'batch|') THEN split_part(key, '|', 3) ELSE split_part(key, '|', 2) END AS model FROM t""")
def q79(spark, d):
    """States of three kinds of tests, taken apart by their keys and joined to the endpoints."""
    o = outcomes(spark, d)
    k = F.col("seq") % 3
    key = F.when(k == 0, F.col("key")).when(k == 1, F.concat_ws("|", F.lit("request"), "key", F.lit("latin"))).otherwise(F.concat_ws("|", F.lit("batch"), "key", F.lit("cjk")))
    state = o.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("tested"), F.count_if("rejected").alias("rejected"))
    ends = o.select(F.split_part("key", F.lit("|"), F.lit(1)).alias("host"), F.split_part("key", F.lit("|"), F.lit(2)).alias("model"))
    return report.endpoint_state(ends, state).select("key", "tested", "rejected", "kind", "host", "model")


@query("q80_scorer_hosts", f"""WITH {LEDGER} SELECT DISTINCT 'h' || (conv_id % 2) AS host, model FROM ledger WHERE 'h' || (conv_id % 2) = CASE model WHEN 'm0' THEN 'h0' WHEN 'm1' THEN 'h1' ELSE 'elsewhere' END""")
def q80(spark, d):
    """Models whose scorer runs on the host that is audited."""
    urls = spark.createDataFrame([("m0", "https://h0/v1"), ("m1", "http://h1:8080/x"), ("m2", "https://elsewhere/h2")], "model string, url string")
    return exchange.scorer_is_audited(exchanges(spark, d), urls)


PREFIX = "CASE conv_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'p99' WHEN 2 THEN 'exp' ELSE 'notes' END"


@query("q81_ledger_files", f"""WITH {LEDGER}, f AS (SELECT *, {PREFIX} AS prefix, conv_id % 10 = 7 AS broken FROM ledger),
ok AS (SELECT prefix AS block, provider, model, CASE WHEN conv_id % 5 = 0 THEN 300 ELSE max_tokens END AS cap, billed FROM f WHERE prefix <> 'notes' AND NOT broken),
bad AS (SELECT prefix AS block, count(*) AS malformed FROM f WHERE prefix <> 'notes' AND broken GROUP BY 1)
SELECT block, count(*) AS n, CAST(sum(cap) AS BIGINT) AS caps, CAST(sum(billed) AS BIGINT) AS billed, coalesce(any_value(malformed), 0) AS malformed, count(DISTINCT provider) AS providers FROM ok LEFT JOIN bad USING (block) GROUP BY block""")
def q81(spark, d):
    """Study files written as JSON lines, some of them cut off or without a cap, and read again: by the prefix of their name, with the
    default cap, malformed lines counted, and files of other names left out."""
    prefix = F.expr(PREFIX)
    row = F.struct(
        F.col("provider"), F.col("model").alias("model_short_key"), F.when(F.col("conv_id") % 5 != 0, F.col("max_tokens")).alias("max_tokens"),
        F.col("billed").alias("billed_completion_tokens"), F.col("response_text"))
    line = F.when(F.col("conv_id") % 10 == 7, F.substring(F.to_json(row), 1, 20)).otherwise(F.to_json(row))
    lines = ledger(spark, d).select(prefix.alias("prefix"), line.alias("value"))
    base = store.shared_dir(spark)
    for name in ("full", "p99", "exp", "notes"):
        store.add_text(lines.where(F.col("prefix") == name).select("value"), base, f"{name}_run")
    r = store.stored(files.ledger(spark, f"{base}/*.jsonl"))
    whole = r.where("_corrupt_record is null").groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("max_tokens").alias("caps"), F.sum("billed").alias("billed"), F.count_distinct("provider").alias("providers"))
    return whole.join(files.malformed(r).select("block", "malformed"), "block")


@query("q82_audit_log", f"""WITH {CAPTURED}, twice AS (SELECT * FROM rec UNION ALL SELECT * FROM rec)
SELECT host, model, status, count(*) AS n, CAST(sum(billed) AS BIGINT) AS billed, count(*) FILTER (over_cap) AS over_cap FROM twice GROUP BY 1, 2, 3""")
def q82(spark, d):
    """Audited rows appended to a log twice, and read again."""
    path = store.shared_dir(spark)
    a = store.stored(audits(spark, d).select("host", "model", "time", "status", "billed", "findings"))
    for _ in range(2):
        files.append_audit(a, f"{path}/log")
    r = files.read_audit(spark, f"{path}/log", "time double, host string, model string, status string, billed long, findings array<string>")
    return r.groupBy("host", "model", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("billed").alias("billed"), F.count_if(F.array_contains("findings", "over_cap")).alias("over_cap"))


@query("q83_monitor_stream", f"""WITH {EVIDENCE}, z AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM ev)
SELECT key, n AS tested, CAST(k AS BIGINT) AS rejected, CAST(x AS BIGINT) AS extra, round(log_evidence, 5) AS log_evidence FROM z WHERE back = 1""")
def q83(spark, d):
    """Outcomes as a stream, their states merged into a table, of which the newest are read."""
    path = store.shared_dir(spark)
    o = outcomes(spark, d)
    o.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{path}/in")
    # files come in the order of their time; a micro-batch holds all of them here, so the order within is that of seq
    stream = endpoint.monitored(spark.readStream.schema(o.schema).parquet(f"{path}/in"))
    endpoint.keep_state(stream, f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return files.read_state(spark, f"{path}/state").select("key", "tested", "rejected", "extra", F.round("log_evidence", 5).alias("log_evidence"))


@query("q84_count_batch_stream", f"""WITH {OUTCOMES}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY key ORDER BY seq) - 1) // 100 AS BIGINT) AS batch FROM outcomes)
SELECT key, batch, CAST(max(seq) AS DOUBLE) AS seq, CAST(sum(extra) AS BIGINT) AS gap, CAST(sum(tokens) AS BIGINT) AS canonical, md5(string_agg(CAST(extra AS VARCHAR), ',' ORDER BY seq)) AS gaps FROM b GROUP BY 1, 2 HAVING count(*) = 100""")
def q84(spark, d):
    """Count gaps as a stream that waits for full batches."""
    path, name = store.shared_dir(spark), "spark.sql.streaming.stateStore.providerClass"
    g = outcomes(spark, d).select("key", "seq", F.col("extra").alias("gap"), F.col("tokens").alias("canonical"), F.lit("h").alias("host"))
    g.write.parquet(f"{path}/in")
    before = spark.conf.get(name, None)
    endpoint.keep_in_rocksdb(spark)
    try:
        stream = endpoint.count_batches(spark.readStream.schema(g.schema).parquet(f"{path}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    out = spark.read.schema(endpoint.BATCH).parquet(f"{path}/out")
    return out.select("key", "batch", "seq", "gap", "canonical", F.md5(F.array_join(F.col("gaps").cast("array<string>"), ",")).alias("gaps"))


NAMES = ("gpt-4o-", "gpt-4.1", "chatgpt-4o-x", "gpt-5-mini-", "o1-", "O3-", "gpt-4-", "gpt-3.5-", "openai/gpt-4o-", "openai/gpt-4-", "openai/o4-", "x/gpt-oss-", "meta-llama/Llama-3.1-8B-Instruct-", "someone/model-", "plain-", "accounts/fireworks/models/llama-v3p1-8b-instruct")


@query("q85_bundled_tokenizers", f"""WITH m AS (SELECT DISTINCT [{", ".join(f"'{n}'" for n in NAMES)}][p_partkey % {len(NAMES)} + 1] || CASE WHEN p_partkey % {len(NAMES)} = {len(NAMES) - 1} THEN '' ELSE CAST(p_size AS VARCHAR) END AS model FROM part),
l AS (SELECT model, lower(model) AS k FROM m)
SELECT model, CASE WHEN k LIKE '%gpt-oss-%' THEN 'tiktoken:o200k_harmony' WHEN regexp_matches(k, '^(openai/)?(gpt-4o|gpt-4[.]1|gpt-5|o1|o3|o4)') OR k LIKE 'chatgpt-4o%' THEN 'tiktoken:o200k_base'
  WHEN regexp_matches(k, '^(openai/)?(gpt-4|gpt-3[.]5)') THEN 'tiktoken:cl100k_base' WHEN k LIKE 'meta-llama/llama-3.1-8b-instruct%' OR k = 'accounts/fireworks/models/llama-v3p1-8b-instruct' THEN 'hf:meta-llama/Llama-3.1-8B-Instruct'
  WHEN contains(model, '/') THEN 'hf:' || model END AS tokenizer FROM l""")
def q85(spark, d):
    """Tokenizers of model names by the patterns that come with the package, else a guess by the owner's name."""
    k = F.col("p_partkey") % len(NAMES)
    name = F.get(F.array(*map(F.lit, NAMES)), k.cast("int"))
    names = table(spark, d, "part").select(F.concat(name, F.when(k == len(NAMES) - 1, "").otherwise(F.col("p_size").cast("string"))).alias("model"))
    return files.resolved_tokenizers(names, {}).select("model", "tokenizer")


@query("q86_resolved_ids", """WITH t AS (SELECT conv_id * 100 + turn AS id, role, list_transform(regexp_extract_all(text, '[a-z]'), lambda x: ascii(x)) AS c FROM conversations),
f AS (SELECT CASE WHEN k = 1 THEN 10 ELSE c[k - 1] END AS a, c[k] AS b FROM (SELECT c, unnest(range(1, len(c) + 1)) AS k FROM t WHERE role = 'user')),
p AS (SELECT a, b, ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY a)) AS p FROM f GROUP BY a, b),
x AS (SELECT id, c, unnest([4, 9]) AS k FROM t WHERE role = 'assistant' AND len(c) >= 12), y AS (SELECT id, k, c[k - 1] AS a, c[k] AS own, 97 + (c[k] - 96) % 26 AS other, c[k + 1] AS z FROM x),
s AS (SELECT id, k, own, other, coalesce(p1.p, -9) + coalesce(p2.p, -9) AS s1, coalesce(p3.p, -9) + coalesce(p4.p, -9) AS s2 FROM y
  LEFT JOIN p p1 ON p1.a = y.a AND p1.b = own LEFT JOIN p p2 ON p2.a = own AND p2.b = z LEFT JOIN p p3 ON p3.a = y.a AND p3.b = other LEFT JOIN p p4 ON p4.a = other AND p4.b = z)
SELECT id, max(CASE WHEN k = 4 THEN CASE WHEN s2 > s1 THEN other ELSE own END END) AS first, max(CASE WHEN k = 9 THEN CASE WHEN s2 > s1 THEN other ELSE own END END) AS second FROM s GROUP BY id""")
def q86(spark, d):
    """Letters as ids, of which the fourth and the ninth of a response could also be the next letter: the more probable one in its
    context counts, by a model of pairs that is trained on the user turns."""
    letters = F.transform(F.regexp_extract_all("text", F.lit("[a-z]"), F.lit(0)), F.ascii)
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", letters.alias("ids"))
    users = t.where("role = 'user'")
    own = t.where("role = 'assistant'").where(F.size("ids") >= 12)
    candidates = F.transform("ids", lambda c, i: F.when(i.isin(3, 8), F.array(c, F.lit(97) + (c - 96) % 26)).otherwise(F.array(c)))
    readings = own.select("id", F.lit("m").alias("model"), candidates.alias("candidates"), F.array(F.lit(10)).alias("newline"))
    r = likelihood.resolved(readings, likelihood.WindowStore(spark), likelihood.pair_scorer(stored(pair_logprobs(following(users), ["m"])), unseen=-9.0), likelihood.Settings(context=4, suffix=1))
    return r.select("id", F.get("ids", F.lit(3)).alias("first"), F.get("ids", F.lit(8)).alias("second"))


@query("q87_calibration_batches", f"""WITH {LEDGER} SELECT model || '|' || block AS key, count(*) AS n, max(billed - canonical) AS max_gap, round(avg(billed - canonical), 6) AS mean_gap FROM ledger GROUP BY 1""")
def q87(spark, d):
    """Gaps of one model after another added to a calibration, each of them twice: a batch that comes again takes its own place."""
    path = store.shared_dir(spark)
    g = ledger(spark, d).select(F.concat_ws("|", "model", "block").alias("key"), lg.delta().cast("long").alias("gap"), F.col("canonical").cast("long").alias("canonical"), "model")
    for model in ("m0", "m1", "m0", "m2", "m1"):
        files.append_calibration({"gaps": g.where(F.col("model") == model)}, path)
    return calibration.gap_rule(files.read_calibration(spark, path)["gaps"]).select("key", "n", "max_gap", F.round("mean_gap", 6).alias("mean_gap"))


@query("q88_request_projection", """WITH c AS (SELECT conv_id, turn, length(text) AS n, conv_id * 100 + turn AS exchange FROM conversations WHERE role = 'user')
SELECT exchange, CASE WHEN conv_id % 4 = 0 THEN 'asked' ELSE 'served' END AS model, CAST(CASE WHEN turn % 3 = 0 THEN n WHEN turn % 3 = 1 THEN 7 END AS BIGINT) AS max_tokens,
  CASE WHEN conv_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS temperature, CASE WHEN conv_id % 3 = 0 THEN CAST(0.25 AS DOUBLE) ELSE 1 END AS top_p,
  CASE WHEN conv_id % 5 = 0 THEN substr(sha256('be brief' || chr(10) || 'in ' || turn), 1, 16) END AS system, CAST(CASE WHEN turn % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS reasoning_tokens FROM c""")
def q88(spark, d):
    """Requests and responses as JSON with fields left out, zero or empty, projected to what an audit reads of them."""
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    k, t = F.col("conv_id"), F.col("turn")
    said = [F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", F.lit("be brief")), ("user", F.lit("x")), ("developer", F.concat(F.lit("in "), t)))]
    request = F.struct(
        F.when(k % 4 == 0, "asked").otherwise("").alias("model"), F.when(t % 3 == 1, 7).alias("max_tokens"), F.when(t % 3 == 0, F.col("n")).when(t % 3 == 1, 0).alias("max_completion_tokens"),
        F.when(k % 2 == 0, 0.5).alias("temperature"), F.when(k % 3 == 0, 0.25).alias("top_p"), F.when(k % 5 == 0, F.array(*said)).alias("messages"))
    usage = F.struct(F.struct(F.when(t % 2 == 0, 3).alias("reasoning_tokens")).alias("completion_tokens_details"))
    body = F.to_json(F.struct(request.alias("request"), F.struct(F.lit("served").alias("model"), usage.alias("usage")).alias("response")))
    x = c.select((k * 100 + t).alias("exchange"), F.from_json(body, files.CAPTURED).alias("x")).select("exchange", "x.*")
    return audit.projected(x, "exchange").select("exchange", "model", "max_tokens", "temperature", "top_p", "system", "reasoning_tokens")
