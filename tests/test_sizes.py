"""What only shows on larger tables: tasks without rows, and work or memory that grows faster than the input."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tallyspark.functions.tokens import entry_bytes
from tallyspark.operators import align, exchange, likelihood, monitor
from tallyspark.plans.adapters import exchanges
from tallyspark.plans.queries import QUERIES
from tallyspark.streaming import endpoint


def test_detection_rate_with_tasks_without_rows(spark):
    x = spark.createDataFrame([("a", i, i % 3, 100) for i in range(20)], "cell string, id long, delta long, billed long")
    want = monitor.detection_rate(x.coalesce(1), [1.0]).collect()
    assert monitor.detection_rate(x.coalesce(1).union(x.where("id < 0")), [1.0]).collect() == want
    assert monitor.detection_rate(x.repartition(4, "cell"), [1.0]).collect() == want
    assert monitor.detection_rate(x.where("id < 0"), [1.0]).collect() == []


def test_few_rows_are_python_objects_at_a_time():
    columns = {"text": ["the"] * 250, "tokenizer": [None] * 250, "hole_tokens": [None] * 250, "hole_raws": [None] * 250, "hole_special": [None] * 250}
    got = list(exchange._read_batches(iter([pa.record_batch({k: pa.array(v, pa.string()) for k, v in columns.items()})])))
    assert sum(b.num_rows for b in got) == 250 and max(b.num_rows for b in got) <= exchange.READ_ROWS


def test_named_ids(spark):
    t = spark.createDataFrame([("token_id:12",), ("token_id:",), ("the",), ("token_id:99999999999999999999",), (None,)], "t string")
    assert [r[0] for r in t.select(exchange._named_id(F.col("t"))).collect()] == [12, None, None, None, None]


def test_a_changed_text_is_made_once_for_its_script(spark, sf):
    plan = QUERIES["q43_script_bucket"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2


def test_window_scores_of_lists_are_medians_and_move_rows_once(spark, sf):
    rows = [(1, 1, "reported", [3.0, None, 1.0]), (1, 1, "reported", [2.0, 8.0]), (1, 2, "canonical", [5.0, 1.0, 9.0]), (2, 1, "reported", [None])]
    w = spark.createDataFrame(rows, "id long, span int, side string, scores array<double>")
    long = w.select("id", "span", "side", F.explode("scores").alias("score"))
    assert sorted(align.window_scores(w).collect()) == sorted(align.window_scores(long).collect())
    plan = QUERIES["q50_windowed_llr"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_aligned_texts_leave_in_bounded_batches(spark, monkeypatch):
    t = spark.createDataFrame([(i, "aé" * 40, ["a", "�", "�"] * 40) for i in range(300)], "id long, text string, tokens array<string>").coalesce(1)
    sizes = align.align_holes(t).groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in sizes] == [300]
    assert {(r["state"], len(r["readings"][0])) for r in align.align_holes(t).collect()} == {("ok", 120)}
    assert "MapInArrow" in align.align_holes(t)._jdf.queryExecution().optimizedPlan().toString()


def test_batches_are_tested_by_all_tasks(spark):
    gaps = spark.createDataFrame([("k", i, i % 3, 100, "h") for i in range(4_000)], "key string, seq long, gap long, canonical long, host string")
    ref = gaps.select("key", "gap")
    n = endpoint.batch_outcomes(monitor.whole_batches(gaps), ref).select(F.spark_partition_id()).distinct().count()
    assert n > 4
    assert monitor.batch_pvalues(gaps, ref).select(F.spark_partition_id()).distinct().count() > 4


def test_exchanges_are_dealt_over_all_tasks_before_they_are_unfolded(spark, sf):
    plan = exchanges(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.index("from_json") < plan.index("RepartitionByExpression")


def test_scores_are_asked_for_once(spark):
    made = spark.sparkContext.accumulator(0)

    def score(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b.select(["key", "replicate", "repeat"]).append_column("score", pa.array([1.0] * b.num_rows))

    own = likelihood.WindowStore(spark)
    windows = spark.createDataFrame([(str(n), "m", [1], [n]) for n in range(20)], "key string, model string, context array<int>, body array<int>")
    own.fill(windows, lambda w: w.mapInArrow(score, "key string, replicate int, repeat int, score double"), 3)
    assert made.value == 60 == own.scores().count()


def test_spans_within_rows_equal_spans_of_unfolded_rows(spark):
    draw, rows = random.Random(5), []
    for n in range(60):
        data = draw.randrange(12)

        def side():
            left, ids, sizes = data, [], []
            while left or draw.random() < 0.2:
                size = draw.randint(0, min(3, left))
                left -= size
                ids.append(draw.randrange(2))
                sizes.append(size)
            return ids, sizes

        rows.append((n, *side(), *side()))
    df = spark.createDataFrame(rows, "id long, ids array<int>, bytes array<int>, other_ids array<int>, other_bytes array<int>")
    sides = [df.select("id", F.lit(s).alias("side"), F.posexplode(F.arrays_zip(F.col(i).alias("token_id"), F.col(b).alias("bytes")).cast("array<struct<token_id:int,bytes:int>>")).alias("nth", "x")) for s, i, b in (("a", "ids", "bytes"), ("b", "other_ids", "other_bytes"))]
    flat = sides[0].unionByName(sides[1]).select("id", "side", F.col("nth").cast("long").alias("nth"), "x.token_id", "x.bytes")
    want = sorted((r["id"], r["start"], r["a_lo"], r["a_hi"], r["b_lo"], r["b_hi"]) for r in align.divergent_spans(flat).collect())
    columns = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(1, 5)]
    got = [(n, *s.values()) for n, spans in enumerate(align.divergent_bounds(*columns).to_pylist()) for s in spans]
    assert got == want and len(got) > 60


def test_escaped_tokens(spark):
    tokens = ["bytes:", r"bytes:\xe2\x80", r"bytes:a\xe2b", r"bytes:\xzz", "bytes:\\xe2\n", "x", None]
    e = F.struct(F.col("t").alias("token"), F.lit(None).cast("array<int>").alias("bytes"))
    got = [bytes(r[0]) for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(entry_bytes(e)).collect()]
    assert got == [b"", b"\xe2\x80", b"a\xe2b", rb"\xzz", b"\xe2\n", b"x", b""]
