"""Registered classifier queries against plain scoring, one text after another, with what they have learned."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import langid, mix, quality, toxicity
from tallyspark.llm.queries import fold_of, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def plain_features(text):
    """Group -> hash within its range -> how often."""
    tokens = (text or "").split()
    words = [t.lower() for t in tokens]
    h = [crc32(w.encode()) for w in words]
    s = [crc32(quality._runs(t).encode()) for t in tokens]
    shapes = s + [a * quality.JOIN + b for a, b in zip([crc32(b"^"), *s], s)]
    for i, t in enumerate(tokens):
        if i and t == tokens[i - 1]:
            shapes.append(crc32(b"=last"))
        elif t in tokens[max(0, i - quality.RECENT) : i]:
            shapes.append(crc32(b"=recent"))
    data = f" {' '.join(words)} ".encode() if words else b""
    three = [(int.from_bytes(data[i : i + 3], "big") * quality.SPREAD & 0xFFFFFFFF) >> 12 for i in range(len(data) - 2)]
    raw = {"shape": shapes, "word": h, "pair": [a * quality.JOIN + b for a, b in zip(h, h[1:])], "trigram": three}
    return max(1, len(tokens)), {k: Counter(x % quality.GROUPS[k][0] for x in v) for k, v in raw.items()}


def plain_score(model, text):
    n, hashed = plain_features(text)
    at, s = 0, 0.0
    for name, (size, length) in quality.GROUPS.items():
        values = {h: math.sqrt(c / n) for h, c in hashed[name].items()}
        norm = math.sqrt(sum(v * v for v in values.values())) or 1.0
        s += sum(v * length / norm * model.weights[at + h] for h, v in values.items())
        at += size
    s += 0.1 * model.weights[at + int(math.log2(n))]
    return [1 / (1 + math.exp(t - s)) for t in model.thresholds]


def test_quality_query(spark, docs, labels):
    model = quality.train(docs, quality.graded(labels), "grade")
    assert model.levels == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in queries()["op10_quality"](spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        tails, y = plain_score(model, r["text"]), got[r["doc_id"]]
        assert abs(y["tail"] - tails[0]) < 1e-4 and abs(y["expected_grade"] - sum(tails)) < 2e-4
        assert y["kept"] == (tails[0] >= quality.LEAST_TAIL) or abs(tails[0] - quality.LEAST_TAIL) < 1e-4


def test_language_query(spark, docs):
    import zstandard as zstd

    dicts = langid.dictionaries(docs, ~F.coalesce(fold_of(4) == 2, F.lit(False)))
    got = {r["doc_id"]: r for r in queries()["op7_language_id"](spark, SF).collect()}
    params = zstd.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.BLOCK_BYTES, dict_size=langid.DICT_BYTES, write_content_size=False, write_checksum=False, write_dict_id=False)
    coders = {k: [zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)) for d in ds] for k, ds in dicts.items()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        data = langid.folded(r["text"] or "").encode()
        blocks = [data[i : i + langid.BLOCK_BYTES] for i in range(0, len(data), langid.BLOCK_BYTES)]
        sizes = {k: sum(len(c.compress(b)) for b in blocks for c in cs) / len(cs) for k, cs in coders.items()}
        assert got[r["doc_id"]]["lang_pred"] == (min(sorted(sizes), key=sizes.get) if data else "und")


def test_toxicity_query(spark, docs, labels):
    lex = toxicity.learn(docs, labels, ~F.coalesce(fold_of(5) == 0, F.lit(False)))
    got = {r["doc_id"]: r for r in queries()["op8_toxicity"](spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        t = toxicity.fold(r["text"] or "") if r["text"] else ""

        def every(needle, t=t):
            at = t.find(needle)
            while at >= 0:
                yield at
                at = t.find(needle, at + 1)

        spared = [(s, s + len(p) + 2) for p in toxicity.EXCEPTIONS for s in every(f" {p} ")]
        best = {}
        for k, w in lex.weights.items():
            for s in every(k):
                if not any(a <= s and s + len(k) <= b for a, b in spared):
                    best[s] = max(best.get(s, -1.0), w)
        raw = sum(best.values()) / math.sqrt(1 + t.count(" ") / 100) if best else 0.0
        want = 1 / (1 + math.exp(-(lex.slope * math.log1p(raw) + lex.bias)))
        y = got[r["doc_id"]]
        assert abs(y["score"] - want) < 1e-9 and y["predicted"] == int(want >= 0.5)


def test_mix_equals_plain_apportionment(spark):
    """Quotas by the highest quotients one seat at a time, targets by resharing in a loop; small sources next to large ones."""
    sizes = {"a": 60_000, "b": 30_000, "c": 7_000, "d": 600, "e": 100, None: 20, "g": 0}
    rows, k = [], 0
    for s, n in sizes.items():
        while True:
            take = min(n, 97 + k % 50)
            rows.append((k, "w " * take, s, "x", 1))
            n, k = n - take, k + 1
            if n <= 0:
                break
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, key int")
    got = mix.mix(d).toPandas()
    assert len(got) == len(rows)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: mix.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
        left -= sum(target[s] for s in over)
    target |= {s: weight[s] * rate for s in open_}
    tiers = {}
    for s in order:
        tiers.setdefault(2 ** int(math.log2(max(1, min(mix.BLOCK_WORDS, sizes[s] / 1000)))), []).append(s)
    for b, of in tiers.items():
        won = dict.fromkeys(of, 0)
        for _ in range(round(sum(target[s] for s in of) / b)):
            can = [s for s in of if target[s] > 0 and won[s] < 2 * -(-sizes[s] // b)]
            best = max(can, key=lambda s: (target[s] / (2 * won[s] + 1), -order.index(s)))
            won[best] += 1
        for s in of:
            own = got[got["source"].isna()] if s is None else got[got["source"] == s]
            assert np.allclose(own["target"], target[s]) and (own["source_size"] == sizes[s]).all()
            assert abs(own["taken"].sum() - won[s] * b) <= 2 * b and abs(own["taken"].sum() - target[s]) <= 0.01 * target[s] + 1
