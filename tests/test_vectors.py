"""Worked examples and properties of the statistical and token functions."""

import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import stats, tokens
from tallyspark.operators import align, calibration, matching, monitor
from tallyspark.sources import files
from tallyspark.streaming import endpoint, sse


def test_conformal_threshold(spark):
    """The k-th smallest of n honest scores, k = floor(alpha (n + 1)): counted by hand for draws with ties."""
    draw = random.Random(11)
    for n, alpha in ((7, 0.1), (9, 0.1), (40, 0.07), (63, 0.125), (200, 0.01), (200, 0.004)):
        scores = [-float(draw.randrange(5)) for _ in range(n)]
        k = int(alpha * (n + 1) + 1e-9)
        tau = calibration.thresholds(spark.createDataFrame([("k", s) for s in scores], "key string, score double"), alpha).first()["tau"]
        assert tau == (sorted(scores)[k - 1] if k else -math.inf)


def test_binomial_tails(spark):
    assert stats.binom_tail(0, 10, 0.3) == 1.0
    assert math.isclose(stats.binom_tail(100, 100, 0.05), 0.05**100, rel_tol=1e-9)
    assert math.isclose(stats.binom_tail(1000, 2000, 0.5), 0.5089, rel_tol=1e-3)
    rows = spark.createDataFrame([(-1, 10, 0.01), (10, 10, 0.3), (0, 10, 0.5)], "k int, n int, p double")
    assert [round(r[0], 12) for r in rows.select(stats.binom_cdf("k", "n", "p")).collect()] == [0.0, 1.0, round(0.5**10, 12)]
    n = spark.createDataFrame([(100,), (50,)], "n int").select(stats.excess_risk(F.col("n"), F.lit(0.01), F.lit(0.03))).collect()
    assert math.isclose(n[0][0], 0.97**100, rel_tol=1e-9) and n[1][0] == 0.0


@given(st.integers(0, 60), st.integers(1, 60), st.floats(0.01, 0.99))
@settings(max_examples=60, deadline=None)
def test_binomial_tail_is_the_sum(k, n, p):
    want = 1.0 if k <= 0 else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert math.isclose(stats.binom_tail(k, n, p), want, rel_tol=1e-9, abs_tol=1e-300)


def test_script_bucket(spark):
    texts = ["hello мир", "مرحبا", "नमस्ते", "漢字かな", "123 !", "ab вг", "вг ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(tokens.script_bucket(F.col("t"))).collect()]
    assert got == ["latin", "arabic", "devanagari", "cjk", "none", "latin", "cyrillic"]


def test_pattern_precedence(spark):
    names = spark.createDataFrame([("org/model-a",), ("ORG/x",), ("other",), ("org/model-b",), ("q1",)], "model string")
    p = spark.createDataFrame([("*", "a", 0), ("org/*", "b", 1), ("org/model-?", "c", 2), ("org/model-a", "d", 3), ("q[0-9]", "e", 4)], "pattern string, value string, ord int")
    got = {r["model"]: r["value"] for r in matching.resolve_patterns(names, p).collect()}
    assert got == {"org/model-a": "d", "ORG/x": "b", "other": "a", "org/model-b": "c", "q1": "e"}


def test_monitor_closed_form_equals_loop():
    rng = random.Random(5)
    p0, logs, k = 0.03, [0.0] * 8, 0
    for n in range(1, 400):
        x = rng.random() < 0.06
        k += x
        logs = [m + math.log1p(b / p0 * (x - p0)) for m, b in zip(logs, stats.BETS)]
        top = max(logs)
        want = top + math.log(sum(math.exp(m - top) for m in logs) / 8)
        assert math.isclose(endpoint.log_evidence(n, k, p0), want, rel_tol=1e-9, abs_tol=1e-9)


def test_monitor_flags_soon_and_restarts_on_new_p0(spark):
    rows = [("k", i, True, 5, 100, 0.03) for i in range(10)] + [("k", i, True, 5, 100, 0.05) for i in range(10, 14)]
    df = spark.createDataFrame(rows, "key string, seq int, rejected boolean, extra int, tokens int, p0 double")
    got = {r["epoch"]: (r["flagged_at"], r["tested"]) for r in monitor.first_flags(df).collect()}
    assert got[0][0] <= 8 and got[0][1] == 10 and got[1][1] == 4


def counted(values):
    return sorted(Counter(values).items())


def test_permutation_test():
    draw = random.Random(6)
    honest = counted(draw.choice((0, 0, 0, 1, 2)) for _ in range(70))
    fresh = [draw.choice((0, 0, 0, 1, 2)) for _ in range(40)]
    assert monitor.permutation_p([(g, 50) for g in fresh], honest, 0.0, 500) > 0.05
    assert monitor.permutation_p([(g + 2, 50) for g in fresh], honest, 0.001, 500) < 0.01
    assert monitor.permutation_p([(0, 0)] * 5, [(0, 3)], 0.0, 50) == 1.0
    assert monitor.permutation_p([(3, 0)] * 100, [(0, 4 * 10**9), (3, 10)], 0.0, 50) == 1 / 51


def exact_p(batch, reference, shift):
    """The chance that a random group of the batch's size has at least its sum, by convolution: one own value is its gap less a constant shift."""
    n, m = len(batch), sum(t for _, t in reference)
    ways = {(0, 0): 1}  # (own values, sum of gaps) -> subsets of the batch
    for g in batch:
        more = dict(ways)
        for (k, s), w in ways.items():
            more[k + 1, s + g] = more.get((k + 1, s + g), 0) + w
        ways = more
    rest = {(0, 0): 1}
    for g, t in reference:
        more = {}
        for (k, s), w in rest.items():
            for j in range(min(t, n - k) + 1):
                more[k + j, s + j * g] = more.get((k + j, s + j * g), 0) + w * math.comb(t, j)
        rest = more
    by_size = {}
    for (k, s), w in rest.items():
        by_size.setdefault(k, []).append((s, w))
    bar = sum(batch) - n * shift
    hit = sum(w * v for (k, s), w in ways.items() for t, v in by_size.get(n - k, []) if s + t - k * shift >= bar - 1e-9)
    return hit / math.comb(n + m, n)


def test_permutation_test_is_exact_on_average():
    draw = random.Random(8)
    for _ in range(6):
        reference = counted(draw.choices((0, 1, 2), (6, 2, 1), k=50))
        batch = draw.choices((0, 1, 2), (5, 2, 2), k=12)
        p = exact_p(batch, reference, 0.05)
        got = monitor.permutation_p([(g, 100) for g in batch], reference, 0.0005, 20_000)
        assert abs(got - p) < 4 * math.sqrt(max(p * (1 - p), 1e-4) / 20_000) + 1e-4


def test_parts_of_a_burst_are_even(spark, monkeypatch):
    """99 % of the rows lie within 1 % of the range of seq; ids are unique."""
    monkeypatch.setattr(monitor, "PART_ROWS", 500)
    df = spark.range(40_000).select(F.lit("k").alias("key"), F.when(F.col("id") % 100 == 0, F.col("id") * 1_000).otherwise(20_000_000 + F.col("id")).alias("seq"), F.lit(1).alias("x"))
    p = monitor.parted(df)
    sizes = [r["count"] for r in p.groupBy("part").count().collect()]
    assert len(sizes) == 80 and max(sizes) <= 1_000 and sum(sizes) == 40_000
    assert p.groupBy("part").agg(F.min("seq").alias("a"), F.max("seq").alias("z")).orderBy("part").selectExpr("a > coalesce(lag(z) over (order by part), -1) as ok").where("not ok").count() == 0
    n = monitor.numbered(df.unionByName(spark.createDataFrame([("one", 5, 1)], "key string, seq long, x int")))
    assert n.where("key = 'k'").orderBy("seq").select("nth").limit(3).collect() == [(1,), (2,), (3,)] and n.where("key = 'one'").first()["nth"] == 1


def test_count_rule(spark):
    g = spark.createDataFrame([("k", i % 4, 30) for i in range(27)] + [("z", -1, 5)], "key string, gap int, canonical int")
    r = {x["key"]: (x["max_gap"], x["n"], x["level"]) for x in calibration.gap_rule(g).collect()}
    assert r == {"k": (3, 27, pytest.approx(1 / 28)), "z": (-1, 1, 0.5)}


def test_placeholders_align_in_two_ways():
    hole = align.spelling(align.PLACEHOLDER, None)
    assert len(align.readings([hole, hole], "漢".encode())) == 2
    assert align.readings([align.spelling("a", None), align.spelling("b", None)], b"ac") == []
    assert align.readings([hole] * 40, "漢".encode() * 20) is None


@given(st.text(max_size=12))
@settings(max_examples=50, deadline=None)
def test_readings_spell_the_text(text):
    data_of = [c.encode("utf-8", "ignore") for c in text]
    patterns = [p for b in data_of for p in ([align.spelling(align.PLACEHOLDER, None)] * 2 if len(b) == 2 else [align.spelling("", b)])]
    data = text.encode("utf-8", "ignore")
    for r in align.readings(patterns, data) or []:
        assert b"".join(r) == data


def test_decision_prefers_the_provider(spark):
    df = spark.createDataFrame([(-6.0, -4.0, 0, 0.0), (-6.0, -4.0, 3, 1.0), (-1.0, 2.0, 0, 0.0), (-9.0, None, 0, 0.0)], "llr double, tau double, spans int, margin double")
    got = [r[0] for r in df.select(calibration.decision(F.col("llr"), F.col("tau"), F.col("spans"), F.col("margin"))).collect()]
    assert got == ["reject", "pass", "reject", "uncalibrated"]


def test_entry_bytes(spark):
    entry = "token string, token_id long, bytes array<int>"
    df = spark.createDataFrame([("é", None, None), ("bytes:\\xe6\\xbc", None, None), ("x", None, [226, 130]), ("stop", None, [])], entry)
    got = [bytes(r[0]) for r in df.select(tokens.entry_bytes(F.struct("token", "token_id", "bytes"))).collect()]
    assert got == ["é".encode(), b"\xe6\xbc", b"\xe2\x82", b""]


def test_settings_file(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('alpha = 0.05\n[checks]\nover_cap = false\n[models."m*"]\ntolerance = 2.0\n')
    s = files.settings(str(f), batch_size=10)
    assert (s["alpha"], s["over_cap"], s["batch_size"], s["models"]["m*"]["tolerance"]) == (0.05, False, 10, 2.0)
    f.write_text("alhpa = 1\n")
    with pytest.raises(ValueError, match="alhpa"):
        files.settings(str(f))


def test_ledger_reader_counts_malformed_lines(spark, tmp_path):
    good = '{"provider":"p","model_short_key":"m","prompt":"q","billed_completion_tokens":5,"finish_reason":"stop"}\n'
    (tmp_path / "full_p.jsonl").write_text(good + "{broken\n" + good)
    (tmp_path / "note_p.jsonl").write_text(good)
    df = files.ledger(spark, str(tmp_path)).cache()
    assert {r["block"]: (r["malformed"], r["lines"]) for r in files.malformed(df).collect()} == {"full": (1, 3)}
    assert df.where("provider = 'p'").first()["max_tokens"] == files.DEFAULT_CAP


def test_stream_equals_batch(spark, sf, tmp_path):
    from tallyspark.plans.queries import chunks

    c = chunks(spark, sf)
    c = c.unionByName(c.select("stream_id").distinct().select("stream_id", F.lit(2_000_000).cast("long").alias("seq"), F.lit(None).cast("string").alias("raw")))  # closed
    for low, high in ((0, 3), (3, 10**5), (10**5, 10**9)):  # chunks of a stream come in order, over several batches
        c.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sse.reassembled_stream(stream).writeStream.format("memory").queryName("sse_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(25)  # its time-outs keep it running
    q.stop()
    cols = ["stream_id", "id", "index", "content", "finish_reason", "completion_tokens"]
    got = sorted(map(tuple, spark.table("sse_out").select(*cols).collect()))
    want = sorted(map(tuple, sse.reassembled(c).select(*cols).collect()))
    assert got == want and got


def test_monitor_stream_equals_batch(spark, sf, tmp_path):
    from tallyspark.plans.adapters import outcomes

    o = outcomes(spark, sf).select("key", "seq", "rejected", "extra", "tokens", F.lit(0.03).alias("p0"))
    o.repartitionByRange(3, "seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(o.schema).parquet(str(tmp_path / "in"))
    q = endpoint.monitored(stream).writeStream.format("memory").queryName("mon_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["key"]: (r["tested"], r["rejected"], round(r["log_evidence"], 8)) for r in spark.table("mon_out").collect()}
    want = {r["key"]: (r["tested"], r["rejected"], round(r["log_evidence"], 8)) for r in monitor.first_flags(o).collect()}
    assert got == want


def test_public_tokenizers_agree_and_round_trip(spark):
    import os

    from tallyspark.functions import bpe

    texts = ["Hello world, 42!", "漢字 é\n\n x", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    files_ = [f"/opt/tokenizers/{n}" for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    if not all(map(os.path.exists, files_)):
        pytest.skip("no tokenizer files here")
    for f in files_:
        n = [r[0] for r in df.select(bpe.bpe_count(F.col("t"), f)).collect()]
        assert n == [len(bpe.encoder(f)(t)) if t else 0 for t in texts] and n[0] > 2 and n[3] == 0
