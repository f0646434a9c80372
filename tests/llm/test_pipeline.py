"""Each pipeline stage against a plain version, on real rows and awkward ones, with columns whose names might clash."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, mix, near_dedup, quality
from tallyspark.llm.common import words_of

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EXTRA = ("d", "found", "key", "at", "_maybe", "row", "size")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    sf = f"{tmp_path_factory.mktemp('sf')}"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = [r["text"] for r in real.sparkSession.read.parquet(f"{sf}/benchmark.parquet").limit(3).collect()]
    some = [r["text"] for r in real.where("lang = 'en' and n_chars between 1500 and 4000").limit(6).collect()]
    odd = [
        (None, some[0].upper()), (None, None), (900_001, ""), (900_001, some[1] + " tail words"), (900_001, some[2]), (900_001, some[2]), ((1 << 53) + 1, some[3] + " one more"),
        (900_002, some[4] + " " + bench[0] + " and on"), (900_003, bench[1]), (900_004, "$$$ !!!"), (900_005, " ".join(some * 3)), (900_006, "Hello"), (900_007, "hello"),
    ]
    more = spark.createDataFrame([(i, t, "en", None if k % 2 else "web", len(t or "")) for k, (i, t) in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = real.unionByName(more)
    docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in EXTRA]).write.parquet(f"{sf}/documents.parquet")
    return sf


def rows_of(df):
    got = [r.asDict() for r in df.collect()]
    assert all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for r in got for c in EXTRA if c in r)
    return got


def ids(rows):
    return sorted(((r["doc_id"], r["text"] or "") for r in rows), key=repr)


def test_stages_equal_plain_versions(spark, table):
    import corpus_pipeline as cp

    stages = dict(cp.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    docs = spark.read.parquet(f"{table}/documents.parquet")
    columns = docs.columns

    model = quality.train(docs, quality.graded(spark.read.parquet(f"{table}/labels.parquet")), "grade")
    features = quality.Hasher()
    kept = stages["quality"](spark, docs, table)
    assert kept.columns == columns
    want = [r for r in rows_of(docs) if model.tails(features(r["text"]))[0] >= cp.LEAST_TAIL]
    assert ids(rows_of(kept)) == ids(want) and 0 < len(want) < docs.count()

    before = rows_of(docs)  # the later stages also see what the classifier would drop
    best = {}
    for r in before:
        t = (r["text"] or "").translate(str.maketrans(UP, LOW))
        best[t] = max(best.get(t, (-1, None)), (-1 if r["doc_id"] is None else r["doc_id"], r["doc_id"]))
    exact = stages["exact_dedup"](spark, docs, table)
    assert exact.columns == columns
    got = sorted(((r["doc_id"], (r["text"] or "").translate(str.maketrans(UP, LOW))) for r in rows_of(exact)), key=repr)
    assert got == sorted(((i, t) for t, (_, i) in best.items()), key=repr)

    exact = exact.cache()
    rows = rows_of(exact)
    hashed = [near_dedup.counted(near_dedup.shingle_hashes(words_of(r["text"]), {})) for r in rows]
    at, root = {}, {i: i for i in range(len(rows))}
    for i, (x, _) in enumerate(hashed):
        for e in x.tolist():
            at.setdefault(e, []).append(i)
    for a, b in {p for of in at.values() for p in itertools.combinations(of, 2)}:
        if near_dedup._find(root, a) != near_dedup._find(root, b) and near_dedup.probability_jaccard(hashed[a], hashed[b]) >= 0.8:
            near_dedup._join(root, a, b)
    classes = {}
    for i in root:
        classes.setdefault(near_dedup._find(root, i), []).append(i)
    near = stages["near_dedup"](spark, exact, table)
    assert near.columns == columns
    got = ids(rows_of(near))
    assert len(got) == len(classes)
    largest = {max((-1 if rows[i]["doc_id"] is None else rows[i]["doc_id"]) for i in of) for of in classes.values()}
    assert {-1 if i is None else i for i, _ in got} == largest

    items = [words_of(r["text"]) for r in spark.read.parquet(f"{table}/benchmark.parquet").collect()]
    windows = {}
    for w in items:
        n = min(decontaminate.WINDOW, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))
    want = []
    for r in before:
        w = words_of(r["text"])
        hit = {k for n, of in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in of for k in range(i, i + n)}
        if len(hit) <= cp.MAX_HIT_SHARE * max(1, len(w)):
            want.append((r["doc_id"], [x for k, x in enumerate(w) if k not in hit], len(hit)))
    clean = stages["decontaminate"](spark, docs, table)
    assert clean.columns == columns
    after = rows_of(clean)
    assert sorted(((r["doc_id"], words_of(r["text"])) for r in after), key=repr) == sorted(((i, w) for i, w, _ in want), key=repr)
    assert all(r["n_chars"] == len(r["text"] or "") for r in after) and any(n for _, _, n in want)

    mixed = stages["mix"](spark, docs, table).toPandas()
    assert len(mixed) == len(before) and (mixed["taken"] <= 2 * mixed["size"]).all()
    per = mixed.groupby(mixed["source"].fillna("~")).agg(size=("size", "sum"), own=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (per["size"] == per["own"]).all() and ((per["taken"] - per["target"]).abs() <= 0.005 * per["target"] + 2).all()
    assert abs(per["target"].sum() - 1.5 * per["size"].sum()) < 1e-6 * per["size"].sum()
    assert set(mix.sizes(docs).agg(F.sum("size")).first()) == {per["size"].sum()}


def test_run_chains_the_stages(spark, table):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{table}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, table).cache()
    assert sorted(map(tuple, cp.run(spark, table).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    empty = spark.read.parquet(f"{table}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, table)
        assert empty.count() == 0
