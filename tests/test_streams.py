"""Batches, alerts and states as streams, cut and restarted anywhere, against their twins over tables; the facade's count path."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import monitor
from tallyspark.sources import files
from tallyspark.streaming import endpoint
from tests.test_exchange import SPEC, captured, entry

GAPS = "key string, seq long, gap long, canonical long, host string"


def gap_rows(n=730, seed=3):
    draw = random.Random(seed)
    return [(draw.choice("aab") + "|latin", i, draw.choice((0, 0, 1, 3)), 40 + i % 7, f"h{i % 3}") for i in range(n)]


def view(df):
    return sorted(tuple(r) for r in df.select("key", "batch", "host", F.col("seq").cast("long"), "n", "gap", "canonical", "gaps", "canonicals").collect())


@pytest.mark.parametrize("cuts", [(200, 333, 700), (5, 6)])
def test_count_batches_as_a_stream(spark, tmp_path, cuts):
    """Each micro-batch is a run of its own from the same checkpoint, so the remainder outlives a restart."""
    rows = gap_rows()
    want = view(monitor.whole_batches(spark.createDataFrame(rows, GAPS)))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    endpoint.keep_in_rocksdb(spark)
    try:
        for low, high in zip((0, *cuts), (*cuts, len(rows))):
            spark.createDataFrame(rows[low:high], GAPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = endpoint.count_batches(spark.readStream.schema(GAPS).parquet(f"{tmp_path}/in"))
            q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.schema(endpoint.BATCH).parquet(f"{tmp_path}/out")
    assert view(out) == want and len(want) == 6
    reference = spark.createDataFrame([(k, g) for k in ("a|latin", "b|latin") for g in (0, 0, 0, 1)], "key string, gap long")
    got = endpoint.batch_outcomes(out, reference)
    assert sorted(got.collect()) == sorted(endpoint.batch_outcomes(monitor.whole_batches(spark.createDataFrame(rows, GAPS)), reference).collect())
    for r in got.collect():
        assert r["key"].startswith("batch|h") and r["p0"] == pytest.approx(0.15) and (r["extra"] > 0) == r["rejected"]


def test_evidence_is_running_sums(spark, tmp_path):
    draw = random.Random(12)
    rows = [("k", i, draw.random() < (0.4 if i > 60 else 0.02), draw.randrange(4), 10, 0.03 if i < 150 else 0.05) for i in range(220)]
    o = spark.createDataFrame(rows, "key string, seq long, rejected boolean, extra long, tokens long, p0 double")
    flags = {}
    for low, high in ((0, 70), (70, 71), (71, 160), (160, 220)):
        o.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = endpoint.monitored(spark.readStream.schema(o.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp")
        q.foreachBatch(lambda b, n: flags.update({r["tested"]: (r["p0"], r["newly_flagged"], round(r["log_evidence"], 9)) for r in b.collect()})).trigger(availableNow=True).start().awaitTermination()
    want = {r["n_tested"]: round(r["log_evidence"], 9) for r in monitor.evidence(o).where("epoch = 1").collect()}
    # the last micro-batch ends in the second epoch, of which 70 outcomes were tested
    assert flags[70] == (0.05, flags[70][1], want[70]) and sum(f for _, f, _ in flags.values()) <= 2


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_alerts_are_raised_once_and_forgotten(spark, tmp_path):
    schema = "key string, kind string, time timestamp, text string"
    parts = [
        [("k", "response", at(0), "1"), ("k", "response", at(1), "2"), ("k", "likelihood", at(2), "first"), ("k", "count", at(2), "other kind")],
        [("k", "likelihood", at(30), "again"), ("k", "response", at(31), "3"), ("j", "likelihood", at(31), "other key")],
        [("j", "size", at(600), "much later")],
        [("k", "likelihood", at(601), "forgotten by now"), ("k", "response", at(601), "4")],
    ]
    seen = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = endpoint.once_per_key(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "2 hours")
        q = endpoint.alerts(stream, f"{tmp_path}/cp", lambda b, n: seen.extend(r["text"] for r in b.collect()))
        q.processAllAvailable()
        q.stop()
    assert sorted(seen) == sorted(["1", "2", "first", "other kind", "3", "other key", "much later", "forgotten by now", "4"])
    whole = endpoint.once_per_key(spark.createDataFrame([r for p in parts for r in p], schema))
    assert sorted(r["text"] for r in whole.collect()) == sorted(["1", "2", "3", "4", "first", "other kind", "other key", "much later"])


def test_state_grows_with_keys_only(spark, tmp_path):
    o = spark.createDataFrame([(f"k{i % 3}", i, True, 1, 10, 0.03) for i in range(30)], "key string, seq long, rejected boolean, extra long, tokens long, p0 double")
    for n in range(3):
        o.where(f"seq % 3 <= {n}").where(f"seq >= {10 * n} and seq < {10 * n + 10}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        endpoint.keep_state(endpoint.monitored(spark.readStream.schema(o.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    s = files.read_state(spark, f"{tmp_path}/state")
    assert s.count() == 3 and {r["key"]: r["tested"] for r in s.collect()} == {f"k{k}": len([i for i in range(30) if i % 3 == k and k <= i // 10]) for k in range(3)}
    endpoint.kept_states(spark, f"{tmp_path}/state").upsert(s.withColumn("batch", F.lit(0).cast("long")).withColumn("tested", F.lit(99).cast("long")), ["key"], ["batch", "tested"])
    assert files.read_state(spark, f"{tmp_path}/state").where("key = 'k2' and tested = 99").isEmpty()  # an older batch changes nothing


def test_periods(spark):
    assert files.period(spark, "2024-01-01", "2024-01-01T01:00:00+01:00") == (1704067200.0, 1704067200.0)
    assert files.period(spark, None, "2024-01-01 00:00:01.5Z") == (float("-inf"), 1704067201.5)
    with pytest.raises(ValueError, match="ISO"):
        files.period(spark, "yesterday", None)


def test_count_rules_reach_the_monitor(spark, tmp_path):
    """Responses without token arrays: gaps against the calibration, one by one and in batches."""
    from tallyspark.facade import Ledger

    own = Ledger(spark, config="", tokenizers={"m": SPEC}, calibration_path=f"file://{tmp_path}/cal", batch_size=10, alpha=0.1)
    bare = ("the", None, "stop", None, False)

    def exchanges(gaps, first=0):
        x = captured(spark, [bare]).select("host", "language", "request", "response")
        rows = x.crossJoin(spark.createDataFrame([(first + i, float(first + i), g) for i, g in enumerate(gaps)], "exchange long, time double, g long"))
        usage = F.struct((F.col("g") + 2).alias("completion_tokens"), F.col("response.usage.completion_tokens_details").alias("completion_tokens_details"))
        return rows.select("exchange", "host", "time", "language", "request", F.col("response").withField("usage", usage).alias("response"))

    honest = own.audit(exchanges([0, 0, 0, 1] * 10))
    rule = own.calibrate_counts(honest, "m", None, until="1970-01-01T00:00:39Z").first()
    assert (rule["key"], rule["n"], rule["max_gap"]) == ("m|latin", 40, 1)
    padded = own.audit(exchanges([0, 3] * 30, first=100))
    o = {(r["key"], r["rejected"]): r for r in own.outcomes(padded).groupBy("key", "rejected").agg(F.count(F.lit(1)).alias("n"), F.sum("extra").alias("extra"), F.sum("tokens").alias("tokens"), F.max("p0").alias("p0")).collect()}
    assert {k: (r["n"], r["extra"]) for k, r in o.items()} == {("request|h|m|latin", True): (30, 60), ("request|h|m|latin", False): (30, 0), ("batch|h|m|latin", True): (6, 72)}
    assert o["batch|h|m|latin", True]["p0"] == pytest.approx(0.15) and o["request|h|m|latin", True]["p0"] == pytest.approx(3 / 41)
    flags = {r["key"]: r["flagged_at"] for r in own.monitor(padded).collect()}
    assert set(flags) == {"request|h|m|latin", "batch|h|m|latin"} and flags["request|h|m|latin"] is not None
    off = Ledger(spark, config="", tokenizers={"m": SPEC}, calibration_path=f"file://{tmp_path}/cal", count_rules=False)
    assert off.outcomes(padded).isEmpty()


def test_study_entry_points(spark, tmp_path):
    from tallyspark.facade import Ledger

    own = Ledger(spark, config="", tokenizers={"m": SPEC}, calibration_path=f"file://{tmp_path}/cal", alpha=0.1)
    fair = ("the", [entry("th"), entry("e")], "stop", None, False)
    assert own.calibrate(captured(spark, [fair] * 5)) == 5
    assert [(r["key"], r["n"], r["warning"]) for r in own.thresholds().collect()] == [("m|latin", 5, "never_rejects")]
    rows = [("p", "m", "b", f"q{i}", i, 100 + i % 2, 100, 480, "stop") for i in range(60)]
    ledger = spark.createDataFrame(rows, "provider string, model string, block string, prompt string, response_id long, billed long, canonical long, max_tokens long, finish_reason string")
    assert own.bounds(ledger).count() == 1
    assert [tuple(r) for r in own.integrity(ledger, 60).collect()] == [] and own.integrity(ledger).first()["check"] == "row_count"
    found = {r["effect"]: r["detected"] for r in own.control(ledger).collect()}
    assert found[11.2] == 1.0 and len(found) == 6
