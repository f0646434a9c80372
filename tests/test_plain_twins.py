"""Statistics, streams and lookups against plain versions, and functions that no query calls."""

import fnmatch
import itertools
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.tokens import glob_regex
from tallyspark.operators import align, ledger, matching, monitor, report
from tallyspark.sources import files
from tallyspark.streaming import endpoint, sse


def test_shell_patterns_equal_fnmatch(spark):
    draw = random.Random(3)
    patterns = ["".join(draw.choice("ab*?[]!-^.\\&") for _ in range(draw.randrange(7))) for _ in range(300)] + ["[", "a[", "[!", "[]a]", "[!]a]", "[a-b]*", "m[0-9", "x.y", "[[]", "a\\b"]
    names = ["".join(draw.choice("ab[]-!.^&\\") for _ in range(draw.randrange(4))) for _ in range(25)]
    p = spark.createDataFrame(list(enumerate(patterns)), "i int, p string")
    n = spark.createDataFrame([(x,) for x in names], "n string")
    got = {(r["i"], r["n"]) for r in p.withColumn("r", glob_regex(F.col("p"))).crossJoin(n).where(F.rlike(F.lower("n"), F.col("r"))).collect()}
    odd = {i for i, x in enumerate(patterns) if any(c in x for c in ("--", "-]", "[-", "&&")) or "[[" in x and x not in ("[[]",)}  # ranges without ends are read differently
    want = {(i, x) for i, q in enumerate(patterns) for x in names if fnmatch.fnmatchcase(x, q)}
    assert {g for g in got if g[0] not in odd} == {w for w in want if w[0] not in odd}
    assert matching.resolve_patterns(spark.createDataFrame([("m[x",)], "model string"), spark.createDataFrame([("m[*", "v", 0)], "pattern string, value string, ord int")).first()["value"] == "v"


def test_monitor_over_many_parts(spark, monkeypatch):
    draw = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, draw.random() < 0.1, draw.randrange(3), 100, 0.03 if i % 400 < 250 else 0.05) for i in range(1_500)]
    o = spark.createDataFrame(rows, "key string, seq long, rejected boolean, extra long, tokens long, p0 double").repartition(5)
    cols = ["key", "seq", "epoch", "n_tested", "n_rejected", "sum_extra", "sum_tokens"]
    monkeypatch.setattr(monitor, "PART_ROWS", 37)
    got = {(r["key"], r["seq"]): tuple(r)[2:] for r in monitor.evidence(o).select(*cols).collect()}
    state, want = {}, {}
    for k, s, rej, x, t, p in rows:
        old = state.get(k, (None, -1, 0, 0, 0, 0))
        old = old if old[0] == p else (p, old[1] + 1, 0, 0, 0, 0)
        state[k] = (p, old[1], old[2] + 1, old[3] + rej, old[4] + x, old[5] + t)
        want[k, s] = state[k][1:]
    assert got == want
    b = monitor.batches(o.select("key", "seq", F.col("extra").alias("gap"), F.col("tokens").alias("canonical"), F.lit("h").alias("host")), 10).collect()
    own = {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}
    assert {(r["key"], r["batch"], r["gap"]) for r in b} == {(k, i, sum(r[3] for r in v[10 * i : 10 * i + 10])) for k, v in own.items() for i in range(len(v) // 10)}
    rule = spark.createDataFrame([("hot", 0.5)], "key string, mean_gap double")
    assert all(r["excess"] == max(0, round(r["gap"] - 5.0)) and r["tokens"] == r["gap"] + r["canonical"] for r in monitor.batch_excess(spark.createDataFrame(b), rule).collect())
    assert spark.range(1).select(monitor.alert_level(F.lit(0.05)), monitor.alert_level(F.lit(0.4))).first()[:] == (pytest.approx(0.15), 0.5)


def test_batch_pvalues_approach_exact_ones(spark):
    gaps = [("k", i, g, 10) for i, g in enumerate([3, 1, 0, 2, 0, 0])]
    ref = [("k", g) for g in (0, 0, 1, 0, 2, 1)]
    got = {r["batch"]: r["p_value"] for r in monitor.batch_pvalues(spark.createDataFrame(gaps, "key string, seq long, gap long, canonical long"), spark.createDataFrame(ref, "key string, gap long"), size=3, margin=0.0).collect()}
    for n in (0, 1):
        own, other = [g for _, _, g, _ in gaps[3 * n : 3 * n + 3]], [g for _, g in ref]
        every = own + other
        seen = sum(own) / 3 - sum(other) / 6
        ways = [sum(every[i] for i in c) for c in itertools.combinations(range(9), 3)]
        exact = sum(w / 3 - (sum(every) - w) / 6 >= seen - 1e-12 for w in ways) / len(ways)
        assert abs(got[n] - exact) < 0.05


def test_detection_rate_is_that_of_a_plain_bootstrap(spark):
    draw = random.Random(8)
    cells = {
        "even": [(draw.choice([-1, 0, 1]), 50) for _ in range(120)], "uneven": [(0, 10)] * 198 + [(0, 20_000)] * 2, "few": [(1, 5)] * 4, "exact": [(0, 40)] * 50,
    }
    rows = [(c, i, d, b) for c, v in cells.items() for i, (d, b) in enumerate(v)]
    effects = [0.05, 0.5, 11.2]
    got = {(r["cell"], r["effect"]): r["detected"] for r in monitor.detection_rate(spark.createDataFrame(rows, "cell string, id long, delta long, billed long").repartition(4), effects).collect()}
    for cell, v in cells.items():
        for e in effects:
            hits = 0
            for _ in range(600):
                x = [d + e / 100 * b for d, b in draw.choices(v, k=len(v))]
                hits += statistics.mean(x) > 1.645 * (statistics.pstdev(x) or 1e-9) / len(x) ** 0.5
            assert got[cell, e] is None if len(v) < 5 else abs(got[cell, e] - hits / 600) < 0.1, (cell, e, got[cell, e], hits / 600)


def test_seeded_sample_is_in_hash_order(spark):
    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id") % 3).alias("key"), F.col("id"), F.xxhash64("id", F.lit(0)).alias("h"))
    want = set()
    for k in ("k0", "k1", "k2"):
        want |= {r["id"] for r in sorted((r for r in rows.collect() if r["key"] == k), key=lambda r: (r["h"], r["id"]))[:7]}
    assert {r["id"] for r in matching.hashed_sample(rows, ["key"], "id", 7).collect()} == want


def bodies():
    """Event streams: (name, whole text, expected rows)."""
    def e(**j):
        return "data: " + json.dumps(j)

    part = e(id="a", model="m", choices=[{"index": 0, "delta": {"role": "assistant", "content": "hé"}, "logprobs": {"content": [{"token": "hé", "bytes": [104, 195, 169]}]}}])
    more = e(choices=[{"index": 0, "delta": {"content": "llo", "tool_calls": [{"id": 1}]}, "logprobs": {"content": [{"token": "llo", "token_id": 7}]}}, {"index": 1, "delta": {"content": "z"}}])
    end, usage = e(choices=[{"index": 0, "delta": {}, "finish_reason": "stop"}]), e(choices=[], usage={"completion_tokens": 4})
    want = [("a", "m", 0, "héllo", "stop", 4, True, ["hé", "llo"]), ("a", "m", 1, "z", None, 4, False, None)]
    late = e(choices=[{"index": 0, "delta": {"content": "ignored"}}])
    yield "whole", "\r\n\r\n".join([part, more, end, usage, "data: [DONE]", late, ""]), want
    yield "open", "\n\n".join([part, more, end, usage]), want  # ends without [DONE], nor a blank line
    yield "odd", "\n\n".join([": ping", "data: [1]", "data: not json", part, "data: [DONE]", more, end, usage, "data: [DONE]", ""]), want  # nothing was finished at the first [DONE]
    yield "cut", "\n\n".join([part, more, ""]), []
    yield "lines", "\n\n".join([part.replace(", ", ",\ndata: ", 1), more, end, usage, "data: [DONE]", ""]), want


def test_streams_cut_at_any_byte(spark, tmp_path):
    draw, rows, want = random.Random(4), [], []
    for name, text, expected in bodies():
        for k in range(4):
            data, at, seq = text.encode(), 0, 0
            while at < len(data):
                n = draw.choice([1, 2, 3, 40, 400])
                rows.append((f"{name}{k}", seq, data[at : at + n]))
                at, seq = at + n, seq + 1
            rows.append((f"{name}{k}", seq, None))  # closed
            want += [(f"{name}{k}", *r) for r in expected]
    c = spark.createDataFrame(rows, "stream_id string, seq long, raw binary")

    def view(df):
        return sorted(((*tuple(r)[:8], None if r["entries"] is None else [x["token"] for x in r["entries"]]) for r in df.collect()), key=repr)

    assert view(sse.reassembled(c)) == sorted(want, key=repr)
    for low, high in ((0, 4), (4, 30), (30, 10**6)):
        c.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = sse.reassembled_stream(stream).writeStream.format("memory").queryName("cut_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    for _ in range(40):  # its time-outs keep it running
        q.awaitTermination(2)
        if spark.table("cut_out").count() >= len(want):
            break
    q.stop()
    assert view(spark.table("cut_out")) == sorted(want, key=repr)


def test_caller_view(spark):
    own = 'data: {"choices":[{"index":0,"delta":{"content":"x"},"logprobs":{"content":[{"token":"x","bytes":[1]}]}}],"usage":null}'
    nested = {"id": "7", "choices": [{"index": k, "delta": {"content": "}{"}, "logprobs": {"content": [{"token": "{", "logprob": -1.5, "top_logprobs": [{"token": '}"', "bytes": [125]}]}]}} for k in (0, 1)], "usage": {"completion_tokens": 4}}
    rows = [
        (1, own), (2, 'data: {"choices":[],"usage":{"completion_tokens":3,"completion_tokens_details":{"reasoning_tokens":1}}}'), (3, "data: [DONE]"), (4, "data: " + json.dumps(nested)),
        (5, 'data: {"choices":[{"index":0,  "logprobs":null}],"usage":null}'), (6, ": ping"), (7, 'data: {"error":{"logprobs":{"x":1}}}'), (8, "data: not json {"), (9, 'data: {"choices":[],"usage":{}}'),
    ]
    e = spark.createDataFrame(rows, "seq int, raw string")
    raw = dict(rows)
    seen = {r["seq"]: r["raw"] for r in sse.caller_view(e, F.lit(True), F.lit(True)).collect()}
    assert sorted(seen) == [1, 3, 4, 5, 6, 7, 8, 9] and '"logprobs":null' in seen[1] and '"content":"x"' in seen[1]
    assert all(seen[k] == raw[k] for k in (3, 5, 6, 7, 8))
    want = nested | {"usage": None, "choices": [c | {"logprobs": None} for c in nested["choices"]]}
    assert json.loads(seen[4].removeprefix("data: ")) == want
    some = {r["seq"]: r["raw"] for r in sse.caller_view(e, F.lit(False), F.lit(True)).collect()}
    assert sorted(some) == [r[0] for r in rows] and json.loads(some[4].removeprefix("data: "))["usage"] == {"completion_tokens": 4}
    assert {r["seq"]: r["raw"] for r in sse.caller_view(e, F.lit(False), F.lit(False)).collect()} == raw


def test_states_alerts_and_warnings(spark, tmp_path):
    o = spark.createDataFrame([("h|m", i, True, 5, 10, 0.03) for i in range(20)] + [("request|h|m|latin", i, False, 0, 10, 0.03) for i in range(3)], "key string, seq long, rejected boolean, extra long, tokens long, p0 double")
    o.write.parquet(f"{tmp_path}/in")
    assert files.read_state(spark, f"file://{tmp_path}/state").isEmpty()
    stream = endpoint.monitored(spark.readStream.schema(o.schema).parquet(f"{tmp_path}/in"))
    endpoint.keep_state(stream, f"file://{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    state = files.read_state(spark, f"file://{tmp_path}/state")
    got = {r["kind"]: (r["host"], r["model"], r["tested"]) for r in report.endpoint_state(spark.createDataFrame([("h", "m")], "host string, model string"), state).collect()}
    assert got == {"likelihood": ("h", "m", 20), "request": ("h", "m", 3)}
    seen = []
    q = endpoint.alerts(endpoint.monitored(spark.readStream.schema(o.schema).parquet(f"{tmp_path}/in")).where("newly_flagged"), f"{tmp_path}/cp2", lambda b, n: seen.extend(r["key"] for r in b.collect()))
    q.processAllAvailable()
    q.stop()
    assert seen == ["h|m"]


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "p.txt").write_text('plain prompt\n\n{"messages":[{"role":"user","content":"x"}]}\n')
    got = [[(m["role"], m["content"]) for m in r["messages"]] for r in files.prompts(spark, f"{tmp_path}/p.txt", "be brief").collect()]
    assert got == [[("system", "be brief"), ("user", "plain prompt")], [("system", "be brief"), ("user", "x")]]
    a = spark.createDataFrame([(5.0, "h", "m", "ok")], "time double, host string, model string, status string")
    schema = "time double, host string, model string, status string"
    assert files.read_audit(spark, f"file://{tmp_path}/log", schema).isEmpty()
    files.append_audit(a, f"{tmp_path}/log")
    files.append_audit(a, f"{tmp_path}/log")
    assert files.read_audit(spark, f"file://{tmp_path}/log", schema).count() == 2
    files.append_ledger(spark.createDataFrame([("full", "p")], "block string, provider string"), f"{tmp_path}/study")
    assert spark.read.json(f"{tmp_path}/study").count() == 1
    files.write_summary(spark.createDataFrame([("t", 8)], "target string, n long"), f"{tmp_path}/sum")
    assert [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/sum").collect()] == [{"target": "t", "n": 8}]
    body = "usageMetadata struct<promptTokenCount:bigint,candidatesTokenCount:bigint,totalTokenCount:bigint,thoughtsTokenCount:bigint>"
    native = files.usage(spark.createDataFrame([((3, 4, 12, 5),)], body), "native")
    messages = files.usage(spark.createDataFrame([((3, 4),)], "usage struct<input_tokens:bigint,output_tokens:bigint>"), "messages")
    chat = files.usage(spark.createDataFrame([((3, 4, 7, (2,)),)], "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,completion_tokens_details:struct<reasoning_tokens:bigint>>"), "chat")
    every = native.union(messages).union(chat).withColumn("logprob_entries", F.lit(4).cast("long"))
    got = {r["target"]: (r["reconciled"], r["median_hidden"], r["reasoning_absent"], r["entries_agree"]) for r in ledger.reconciliation(every).collect()}
    assert got == {"native": (1, 0.0, 0, 1), "messages": (0, None, 1, 1), "chat": (1, 0.0, 0, 1)}
    names = spark.createDataFrame([("gpt-4o-mini",), ("gpt-4-x",), ("own/model",), ("plain",), ("gpt-4-own",)], "model string")
    got = {r["model"]: (r["tokenizer"], r["origin"]) for r in files.resolved_tokenizers(names, {"*-own": "file:/x.json"}).collect()}
    assert got == {"gpt-4o-mini": ("tiktoken:o200k_base", "bundled"), "gpt-4-x": ("tiktoken:cl100k_base", "bundled"), "own/model": ("hf:own/model", "guess"), "plain": (None, None), "gpt-4-own": ("file:/x.json", "user")}
    assert files.resolved_tokenizers(names, guess=False).where("model = 'own/model'").first()["tokenizer"] is None
    home = tmp_path / "home" / ".config"
    home.mkdir(parents=True)
    (home / "tallyspark.toml").write_text("alpha = 0.2\n")
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("TALLYSPARK_CONFIG", raising=False)
    assert files.settings()["alpha"] == 0.2
    monkeypatch.setenv("TALLYSPARK_CONFIG", "")
    assert files.settings()["alpha"] == 0.01


def test_ledger_parts(spark):
    p = spark.createDataFrame([([(True, "a"), (None, "b"), (False, "c"), (True, None)],)], "p array<struct<thought:boolean,text:string>>")
    assert p.select(ledger.split_parts(F.col("p"))).first()[0][:] == ("a", "bc")
    two = spark.createDataFrame([("m", 30, 70), ("m", 0, 100)], "model string, billed_thought long, billed_answer long")
    assert tuple(ledger.hidden_share(two).first()) == ("m", 2, 30, 0.15)
    bounds = spark.createDataFrame([(0.2,), (-1.0,)], "upper_percent double")
    assert tuple(ledger.worst_bound(bounds).first()) == (2, 0.2)
    d = spark.createDataFrame([("c", 5, 5, "ab", "a", "b", 0, True), ("c", 6, 5, "ab", "a", "b", 0, True), ("c", 5, 5, "a", "a", "b", 0, True)], "cell string, billed long, entries long, stream string, reasoning string, text string, stored_f long, stored_complete boolean")
    assert tuple(ledger.recompute_errors(d).first()) == ("c", 3, 2)
    pin = spark.createDataFrame([("b", 5, 4), ("b", 5, 7), ("b", None, 1)], "backend string, billed long, canonical long")
    assert tuple(ledger.pinned_summary(pin).first()) == ("b", 2, -0.5, -2, 1)
    one = spark.createDataFrame([("p", "m", 10, 10), ("p", "m", 10**7, 10)], "provider string, model string, billed long, canonical long")
    h = ledger.delta_histogram(one.where("billed < 100")).collect()
    assert [(r["delta"], r["n"]) for r in h] == [(0, 1)] and ledger.delta_histogram(one).count() == 10**7 - 9
    s = matching.with_stats(spark.createDataFrame([("r1",), ("r2",)], "response_id string"), spark.createDataFrame([("r1", 3)], "response_id string, native_tokens long"))
    assert {r["response_id"]: r["native_tokens"] for r in s.collect()} == {"r1": 3, "r2": None}


def test_prompts_with_fallback_and_overlay(spark):
    rows = [(1, 0, "user", "a first question here", "English"), (1, 1, "assistant", "x", "English"), (2, 0, "assistant", "not the user's", "English"), (3, 0, "user", "une question", "French"), (4, 0, "user", "a first question here", "English")]
    turns = matching.first_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, language string"), "English")
    assert sorted(map(tuple, turns.collect())) == [("a first question here", 1), ("a first question here", 4)]
    other = spark.createDataFrame([("fallback one", 1), ("fallback two", 2)], "prompt string, position long")
    assert [r["prompt"] for r in matching.prompts_or_fallback(turns, other, 5, 100, 1).collect()] == ["a first question here"]
    assert [r["prompt"] for r in matching.prompts_or_fallback(turns, other, 5, 100, 2).collect()] == ["fallback one", "fallback two"]
    names = spark.createDataFrame([("m1",), ("n1",)], "model string")
    over = spark.createDataFrame([("m*", None, ["alpha"]), ("n*", None, [])], "pattern string, alpha double, given array<string>")
    resolved = matching.resolve_patterns(names, over.select("pattern", F.col("pattern").alias("value"), F.lit(0).alias("ord")))
    assert {r["model"]: r["alpha"] for r in matching.overlay(names, resolved, over, {"alpha": 0.01}).collect()} == {"m1": None, "n1": 0.01}


def test_reports(spark):
    s = spark.createDataFrame([("h", "m", 10, 3, 5, 1, 2, 4, 1.5)], "host string, model string, tested long, rejected long, responses long, alerts long, unverifiable long, mismatched_responses long, shadow_percent double")
    assert report.with_tail(s.select("host", "model", "tested", "rejected")).first()["tail"] < 0.001
    text = report.text_report(s.withColumn("distinct_offsets", F.lit(1)))
    assert text.splitlines()[0] == "h m: 5 responses, 1 alerts, 2 unverifiable" and "+1.50%" in text


def test_windows_and_readings(spark):
    ids = spark.createDataFrame([(list(range(40)), 35, 37), (list(range(40)), 2, 3)], "ids array<int>, lo int, hi int")
    got = [tuple(r[0]) for r in ids.select(align.window_around(F.col("ids"), F.col("lo"), F.col("hi"), 4, 2)).collect()]
    assert got == [([31, 32, 33, 34], [37, 38]), ([0, 1], [3, 4])]
    s = spark.createDataFrame([(1, 0, -3.0, 2), (1, 1, -1.0, 1), (1, 2, -1.0, 5)], "id long, reading int, llr double, spans int")
    assert [tuple(r) for r in align.best_reading(s).collect()] == [(1, 1, -1.0, 1)]
    t = spark.createDataFrame([(1, "a", 0, "ab", 7), (1, "a", 1, "c", 8), (1, "b", 0, "ab", 9), (1, "b", 1, "c", 8)], "id long, side string, nth long, token string, token_id long")
    assert [(r["start"], r["end"]) for r in align.divergent_spans(t).collect()] == [(0, 2)]
    assert align.divergent_spans(t.drop("token_id")).count() == 0
