"""Several blocks of benchmark items find what one does, whatever the identifiers are."""

from tallyspark.llm import decontaminate
from tallyspark.llm.common import words_of

ITEMS = [(i, " ".join(f"i{i}w{k}" for k in range(14))) for i in range(6)] + [(6, "two words"), (None, "no id at all"), (2, " ".join(f"again{k}" for k in range(12)))]
PAD = " ".join(f"p{k}" for k in range(40))
DOCS = [
    (None, f"{PAD} {ITEMS[0][1]} end"), (None, "clean"), (None, f"{PAD} {ITEMS[3][1]}"), (None, ""), (None, None),
    (7, f"{PAD} {ITEMS[1][1]} x {ITEMS[4][1]} y"), (7, "short clean text"), (7, f"{ITEMS[5][1]} {PAD} two words"), (7, "i1w0 i1w1 i1w2 i1w3"),
    (8, ITEMS[2][1]), (8, f"{PAD} {ITEMS[8][1]}"), (8, f"{PAD} {ITEMS[8][1]}"),
]


BIG = (1 << 53) + 1


def test_blocks_with_null_and_repeated_ids(spark, monkeypatch):
    docs = [*DOCS, (BIG, ITEMS[7][1]), (None, f"{PAD} {ITEMS[7][1]} {PAD} no id at all")]
    d = spark.createDataFrame([(i, t, "x", [1], 5) for i, t in docs], "doc_id long, text string, found string, _now array<int>, n_chars long").repartition(3)
    b = spark.createDataFrame(ITEMS, "item_id long, text string")

    def both(block):
        report = sorted(map(tuple, decontaminate.report(d, b, block_words=block).collect()), key=repr)
        kept = decontaminate.clean(d, b, block_words=block)
        assert kept.columns == d.columns and kept.where("found <> 'x' or _now[0] <> 1").count() == 0
        return report, sorted(map(tuple, kept.collect()), key=repr)

    one = both(decontaminate.BLOCK_WORDS)
    assert len(one[0]) == len(docs) and all(r[2] <= r[1] for r in one[0])
    want = {(i, t or ""): brute(t) for i, t in docs}
    got = sorted(((r[0], r[2], r[3]) for r in one[0]), key=repr)
    assert got == sorted(((i, *want[i, t or ""]) for i, t in docs), key=repr)
    assert BIG in {r[0] for r in one[0]}
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)  # several passes
    for block in (1, 20, 60, 200_000):
        assert both(block) == one


def brute(text):
    words, hit, items = words_of(text), set(), set()
    for item, t in ITEMS:
        w = words_of(t)
        n = min(decontaminate.WINDOW, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows]
        hit.update(k for i in at for k in range(i, i + n))
        items.update({item} if at and item is not None else ())
    return len(hit), len(items)


def test_long_items_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 7)
    words = [f"w{i % 23}x{i % 17}" for i in range(60)]
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [" ".join(words[s : s + n]) for n in (9, 10, 11, 25) for s in range(0, 60 - n)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(d, b).collect()} == {i: (len(t.split()) if len(t.split()) >= 10 else 0) for i, t in enumerate(texts)}


def test_empty_tables(spark):
    d, b = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(d, b).where("contaminated").count() == 0 and decontaminate.clean(d, b).count() == len(DOCS)
    assert decontaminate.report(d.where("false"), b).count() == 0
