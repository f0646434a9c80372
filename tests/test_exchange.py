"""Raw exchanges to verdicts, on worked examples with a vocabulary of bytes and a few pairs of letters."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import bpe
from tallyspark.operators import align, audit, calibration, exchange, likelihood
from tallyspark.plans.adapters import pairs_vocabulary
from tallyspark.sources import files

SPEC = "pairs:th,he,in,er,hé"
HOLE = align.PLACEHOLDER


def entry(token, raw=None, token_id=None):
    return (token, token_id, None if raw is None else list(raw))


def captured(spark, choices, usage=10, **request):
    """One exchange of several choices: (text, entries or None, finish, reasoning, tools)."""
    rows = [
        (i, f, (t, None, r, ["{}"] if tools else None), None if e is None else (e,)) for i, (t, e, f, r, tools) in enumerate(choices)]
    fields = {"model": "m", "max_tokens": None, "max_completion_tokens": None, "temperature": None, "top_p": None, "stream": None, "messages": None} | request
    row = (1, "h", 5.0, None, tuple(fields.values()), ("id", "m", (usage, (0,)), rows))
    return spark.createDataFrame([row], "exchange long, " + files.CAPTURED)


def choices(spark, *given, **more):
    known = spark.createDataFrame([("m", SPEC)], "model string, tokenizer string")
    return exchange.choices_of(captured(spark, given, **more), known).orderBy("index").collect()


def test_slices_and_candidates(spark):
    the = [entry("th"), entry("e")]
    got = choices(
        spark, ("the", the, "stop", None, False), ("the", [entry("t"), entry("he")], "stop", None, False), ("the", [entry("x"), *the], "stop", "why", False),
        ("the", [entry("q")], "stop", None, False), ("the", None, "length", None, False), ("the", the, "length", None, False), ("the", the, "stop", None, True),
        ("漢", [entry(HOLE), entry(HOLE), entry(HOLE)], "stop", None, False), ("é", [entry("é")], "stop", None, False), ("", [], "stop", None, False),
        ("the", [entry("th", None, 256), entry("e", None, 101)], "stop", None, False), ("the", [entry("th", None, 99), entry("e")], "stop", None, False),
        ("the", [entry("token_id:256", b"th"), entry("e")], "stop", None, False), ("漢" * 9, [entry(HOLE * 2)] * 18, "stop", None, False))
    view = [(c["reported"], c["canonical"], c["array"], c["answer"], c["readings"], c["token_mismatch"], c["noncanonical"]) for c in got]
    assert view[0] == (2, 2, "content", 2, 1, False, False)  # as the encoder cuts it
    assert view[1] == (2, 2, "content", 2, 1, False, True)  # the same length, another cut
    assert view[2] == (3, 2, "full", 2, 1, False, False) and got[2]["reasoning"]
    assert view[3] == (1, 2, None, None, 0, False, False) and got[3]["reason"]
    assert view[4][:3] == (None, 2, None) and got[4]["capped"]
    assert view[5][:4] == (2, 2, "content", 2) and got[5]["capped"]
    assert view[6][:3] == (2, 2, None) and got[6]["tool_calls"]
    assert view[7] == (3, 3, "content", 3, 1, False, False)  # three placeholders of one byte each
    assert view[8] == (1, 2, "content", 1, 1, True, False)  # 'é' is no token of this vocabulary
    assert view[9] == (0, 0, "content", 0, 1, False, False)
    assert view[10][5:] == (False, False) and view[11][5] is True and view[12][5:] == (False, False)
    assert view[13][4] is None and got[13]["reason"] == "too many readings"
    assert got[0]["language"] == "latin" and got[7]["language"] == "cjk" and got[9]["language"] == "none"


def test_unknown_model_has_no_canonical_counts(spark):
    known = spark.createDataFrame([("other", SPEC)], "model string, tokenizer string")
    c = exchange.choices_of(captured(spark, [("the", [entry("th"), entry("e")], "stop", None, False)]), known).first()
    assert (c["canonical"], c["reported"], c["array"]) == (None, 2, "content")


def scored_by_id(spark, c, scores):
    scorer = likelihood.id_scorer(spark.createDataFrame([("m", i, p) for i, p in scores.items()], "model string, token_id int, logprob double"))
    store = likelihood.WindowStore(spark)
    return exchange.scored(c, exchange.resolved_readings(c, store, scorer), store, scorer)


def judged(spark, given, scores, honest=None, meta=None, margin=0.25):
    known = spark.createDataFrame([("m", SPEC)], "model string, tokenizer string")
    x = captured(spark, given)
    c = exchange.choices_of(x, known).withColumn("scorer", F.lit("s"))
    s = scored_by_id(spark, c, scores)
    cal = spark.createDataFrame(honest or [], "key string, score double")
    m = spark.createDataFrame(meta or [], files.CALIBRATION["meta"])
    v = exchange.verdicts(exchange.calibrated(s, cal, m, spark.createDataFrame([("m", margin)], "model string, margin double"), 0.1))
    return exchange.records(x, v).first()


def test_calibrated_verdicts(spark):
    scores = {i: -4.0 if i < 256 else -5.0 for i in range(261)}
    split = [entry("t"), entry("h"), entry("e")]
    honest = [("m|latin", float(-(n == 0))) for n in range(20)]  # the 2nd smallest of 20 is the threshold: 0
    given = [("the", split, "stop", None, False), ("the", [entry("th"), entry("e")], "stop", None, False)]
    r = judged(spark, given, scores, honest)
    assert [(c["llr"], c["spans"], c["verdict"]) for c in r["choices"]] == [(-3.0, 1, "reject"), (None, None, "pass")]
    assert r["findings"] == ["count_mismatch", "likelihood_reject"] and r["status"] == "alert"
    assert [c["verdict"] for c in judged(spark, given, scores, honest, margin=3.5)["choices"]] == ["pass", "pass"]  # within the noise of one span
    assert [c["verdict"] for c in judged(spark, given, scores)["choices"]] == ["uncalibrated", "uncalibrated"]
    wrong = [("m|latin", SPEC, "other scorer", 1.0, 1.0, None)]
    assert [c["verdict"] for c in judged(spark, given, scores, honest, wrong)["choices"]] == ["uncalibrated", "uncalibrated"]
    right = [("m|latin", SPEC, "s", 1.0, 1.0, None)]
    assert [c["verdict"] for c in judged(spark, given, scores, honest, right)["choices"]] == ["reject", "pass"]
    assert [c["verdict"] for c in judged(spark, given, {}, honest)["choices"]] == ["unverifiable", "pass"]  # no scores for these ids


def test_honest_scores_and_scorer_host(spark):
    scores = {i: -4.0 if i < 256 else -5.0 for i in range(261)}
    known = spark.createDataFrame([("m", SPEC)], "model string, tokenizer string")
    x = captured(spark, [("the", [entry("t"), entry("h"), entry("e")], "stop", None, False), ("the", [entry("th"), entry("e")], "stop", None, False), ("the", [entry("th")], "length", None, False), ("q", None, "stop", None, False)])
    c = scored_by_id(spark, exchange.choices_of(x, known), scores)
    assert sorted(tuple(r) for r in exchange.honest_scores(c).collect()) == [("m|latin", -3.0), ("m|latin", 0.0)]
    urls = spark.createDataFrame([("m", "https://h/v1"), ("n", "https://z/v1")], "model string, url string")
    assert [tuple(r) for r in exchange.scorer_is_audited(x, urls).collect()] == [("h", "m")]


def test_readings_equal_enumeration():
    draw = random.Random(5)
    for _ in range(600):
        data = "".join(draw.choice(["a", "é", "漢", "b"]) for _ in range(draw.randrange(5))).encode()
        tokens = [draw.choice(["a", "b", HOLE, HOLE + "a", "a" + HOLE, HOLE * 2, "é", ""]) for _ in range(draw.randrange(5))]
        ways = []
        for cuts in itertools.product(range(len(data) + 1), repeat=max(0, len(tokens) - 1)):
            ends = [0, *cuts, len(data)] if tokens else [0]
            if list(ends) != sorted(ends) or not tokens and data:
                continue
            pieces = [data[a:b] for a, b in zip(ends, ends[1:])]
            if all(fits(t, p) for t, p in zip(tokens, pieces)):
                ways.append(pieces)
        got = align.readings([align.spelling(t, None) for t in tokens], data, limit=4)
        assert got is None if len(ways) > 4 else sorted(got) == sorted(ways), (tokens, data)


def fits(token, piece):
    """Each placeholder is one to three bytes of 0x80 or more, the rest is literal."""
    if not token:
        return not piece
    if token[0] != HOLE:
        c = token[0].encode()
        return piece.startswith(c) and fits(token[1:], piece[len(c) :])
    return any(len(piece) >= k and min(piece[:k]) >= 0x80 and fits(token[1:], piece[k:]) for k in (1, 2, 3))


def test_canonical_encoding_of_any_bytes(spark):
    v = pairs_vocabulary("th,he")
    for data in (b"the", b"\xff", b"th\xffhe", "é漢".encode(), b"\xe6\xbc", b"\xe6\xbcA", b"", b"\xf0\x9f\x98th\x80\x80"):
        ids = v.canonical(data)
        assert b"".join(v.pieces[i] for i in ids) == data
    assert v.canonical(b"th\xffhe") == [256, 255, 257]
    special = bpe.Vocabulary("s", lambda t: [7], {7: b"<e>"}, {"<e>": 7}, {})
    with pytest.raises(bpe.Unverifiable, match="special"):
        special.canonical(b"<e>")
    with pytest.raises(bpe.Unverifiable, match="no token for byte"):
        special.canonical(b"\xff")
    with pytest.raises(bpe.Unverifiable, match="spell"):
        bpe.Vocabulary("b", lambda t: [1], {1: b"x"}, {}, {}).canonical(b"y")
    assert list(special.rows()) == [(7, b"<e>", "<e>", 0)]
    two = bpe.Vocabulary("t", lambda t: [2], {1: b"a", 2: b"a"}, {}, {})
    assert list(two.rows()) == [(1, b"a", None, 1), (2, b"a", None, 0)]
    rows = spark.createDataFrame([(0, b"the"), (1, b"\xff\xfe"), (2, None)], "i int, b binary")
    got = {r["i"]: (r["c"]["ids"], r["c"]["error"]) for r in rows.select("i", bpe.canonical_ids(F.col("b"), SPEC).alias("c")).collect()}
    assert got == {0: ([256, 101], None), 1: ([255, 254], None), 2: ([], None)}
    with pytest.raises(ValueError, match="OPENERS"):
        bpe.vocabulary("hf:someone/model")


def test_public_vocabularies_spell_every_text():
    import os

    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"):
        path = f"/opt/tokenizers/{name}"
        if not os.path.exists(path):
            pytest.skip("no tokenizer files here")
        v = bpe.vocabulary(f"file:{path}")
        for data in ("Hello world, 42! 漢字 é".encode(), b"ab\xffcd", b"\xe6\xbc", b"  x "):
            try:
                ids = v.canonical(data)
            except bpe.Unverifiable:
                assert name.endswith(".model")  # it writes a blank in front of words
                continue
            assert b"".join(v.pieces[i] for i in ids) == data
            rows = {i: (data, special) for i, data, special, _ in v.rows()}
            assert all(rows[i] == (v.pieces[i], None) for i in ids)


def test_topics_by_templates(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "topic string")
    f = spark.createDataFrame([("why {}?",), ("{} and {}",)], "template string")
    got = exchange.topics_by_templates(t, f, 2, 3).collect()
    assert sorted(r["part"] for r in got) == [0, 0, 1, 1, 1] and len({r["prompt"] for r in got}) == 5
    assert got == exchange.topics_by_templates(t, f, 2, 3).collect()


def test_projection_and_caps(spark):
    r = audit.projected(captured(spark, [("x", None, "stop", None, False)], max_tokens=50, max_completion_tokens=7, temperature=0.5)).first()
    assert (r["model"], r["max_tokens"], r["billed"], r["n"], r["temperature"], r["top_p"], r["system"]) == ("m", 7, 10, 1, 0.5, 1.0, None)


def test_canonical_readings_by_columns(spark):
    df = spark.createDataFrame([([[1, 2], [3]], [2, 3]), ([[1], [3]], [2, 3]), ([[2]], [2, 3])], "c array<array<int>>, k array<int>")
    assert [r[0] for r in df.select(align.is_canonical(F.col("c"), F.col("k"))).collect()] == [True, False, False]
    e = spark.createDataFrame([([entry("a", b"a")],), ([entry(HOLE)],)], "e array<struct<token:string,token_id:bigint,bytes:array<int>>>")
    assert [tuple(r) for r in e.select(align.spelled(F.col("e")), align.has_hole(F.col("e"))).collect()] == [("61", False), ("EFBFBD", True)]


def test_calibration_files(spark, tmp_path):
    path = f"file://{tmp_path}/cal"
    tables = files.read_calibration(spark, path)
    assert all(t.isEmpty() for t in tables.values())
    tables["scores"] = spark.createDataFrame([("k", -1.0)], "key string, score double")
    files.write_calibration(tables, path)
    assert [tuple(r) for r in files.read_calibration(spark, path)["scores"].collect()] == [("k", -1.0)]
    with pytest.raises(ValueError, match="path"):
        files.write_calibration(tables, None)
    small = calibration.size_warnings(spark.createDataFrame([("k", 0.0)] * 5, "key string, score double"), 0.01, 3.0).first()
    assert small["warning"] == "never_rejects"
    meta = spark.createDataFrame([("k", "t", None, 1.0, 1.0, None), ("k", "u", None, 1.0, 1.0, None), ("l", "t", None, 1.0, 1.0, None)], files.CALIBRATION["meta"])
    assert [r["key"] for r in calibration.conflicts(meta).collect()] == ["k"]


def test_facade(spark, tmp_path):
    """Calibrated on honest responses, a padded one is rejected and an honest one passes; counts are calibrated from the audit."""
    from tallyspark.facade import Ledger

    scorer = likelihood.id_scorer(spark.createDataFrame([("m", i, -4.0 if i < 256 else -5.0) for i in range(261)], "model string, token_id int, logprob double"))
    own = Ledger(spark, config="", tokenizers={"m": SPEC}, calibration_path=f"file://{tmp_path}/cal", scorer=scorer, scorer_name="s", alpha=0.1)
    fair = ("the", [entry("th"), entry("e")], "stop", None, False)
    assert own.calibrate(captured(spark, [fair] * 20, usage=40)) == 20
    padded = ("the", [entry("t"), entry("h"), entry("e")], "stop", None, False)
    a = own.audit(captured(spark, [padded, fair], usage=5)).cache()
    assert [c["verdict"] for c in a.first()["choices"]] == ["reject", "pass"] and a.first()["findings"] == ["likelihood_reject"]
    assert own.report(a).first()["responses"] == 1
    m = own.monitor(a).first()
    assert (m["key"], m["tested"], m["rejected"], m["extra"]) == ("h|m", 2, 1, 1)
    one = own.audit(captured(spark, [fair], usage=2))
    rule = own.calibrate_counts(one, None, None, 0.0, 10.0).first()
    assert (rule["key"], rule["n"], rule["max_gap"]) == ("m|latin", 1, 0)
    with pytest.raises(ValueError, match="different settings"):
        own.calibrate(captured(spark, [fair], temperature=0.2))
