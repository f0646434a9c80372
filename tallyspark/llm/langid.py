"""Language identification by compression: the language whose dictionary compresses a text best.

For each language zstandard raw-content dictionaries are cut from training texts drawn by hash whatever their length, and of
each from a block drawn by hash from anywhere in it (`dict_bytes` per dictionary and text, `dicts` dictionaries per language). A text's letters are encoded block by block, all of it, with every
dictionary of every language; the smallest total wins. The margin is the gap to the second smallest relative to the
smallest, and `confident` is false where it is below `least_margin`: callers reject those.

Training takes bounded samples (`languages` x `dicts` x `dict_bytes` bytes reach the driver and the tasks).

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the language that comes first;
without any training text everything is `und`; languages are taken as they are spelled; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, small_batches

DICT_BYTES, DICTS = 24_000, 2
BLOCK_BYTES = 4_096
#: Tables are sized for a block and a dictionary, which at this level finds matches short enough to tell languages apart.
LEVEL = 6
SAMPLE_DOCS = 400
LEAST_MARGIN = 0.02
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Lower-cased words with single blanks between and around them, one of equal neighbours; empty if there is no letter."""
    words = _OTHER.sub(" ", text.lower()).split()
    if not "".join(words).isalpha():  # numerals other than digits, for one
        words = [w for w in words if any(map(str.isalpha, w))]
    words = [w for w, before in zip(words, ["", *words]) if w != before]
    return f" {' '.join(words)} " if words else ""


def dictionaries(docs: DataFrame, train: Column, dict_bytes: int = DICT_BYTES, dicts: int = DICTS) -> dict[str, list[bytes]]:
    """language -> raw-content dictionaries, from the rows that `train` selects and that name a language."""
    given = docs.where(train).where("lang is not null and text is not null").select("doc_id", "text", "lang")
    # of a longer text a block that begins anywhere, drawn by hash
    begin = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.greatest(F.length("text") - dict_bytes, F.lit(0)) + 1)
    d = given.select("doc_id", "lang", F.substring("text", (begin + 1).cast("int"), F.lit(dict_bytes)).alias("text"), (F.length("text") < 200).alias("_short"))
    # a hash threshold from the counts leaves about 4 x SAMPLE_DOCS rows a language to be ranked, whatever the table's size
    counts = d.groupBy("lang", "_short").agg(F.count(F.lit(1)).alias("_rows"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 32))
    d = d.join(F.broadcast(counts), ["lang", "_short"]).where(place < F.least(F.lit(1.0), 4.0 * SAMPLE_DOCS / F.col("_rows")) * float(1 << 32))
    drawn = Window.partitionBy("lang", "_short").orderBy(place, "doc_id")
    d = d.withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= SAMPLE_DOCS)
    texts: dict[str, list[str]] = defaultdict(list)
    for r in d.orderBy("lang", "_short", "_n", "text").toLocalIterator():
        if sum(map(len, texts[r["lang"]])) < 2 * dicts * dict_bytes and (t := folded(r["text"])):
            texts[r["lang"]].append(t)
    out = {}
    for lang, some in sorted(texts.items()):
        parts: list[bytearray] = [bytearray() for _ in range(dicts)]
        for t in some:
            least = min(parts, key=len)
            if len(least) < dict_bytes:
                least += t.encode("utf-8", "replace")[: dict_bytes - len(least)]
        out[lang] = [bytes(p) for p in parts if p]
    return {k: v for k, v in out.items() if v}


def predict(docs: DataFrame, dictionaries: dict[str, list[bytes]], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, confident, and the columns of docs but its text) for every row."""
    small_batches(docs.sparkSession)
    names = sorted(dictionaries)
    held = [dictionaries[n] for n in names]  # bounded: see above

    @F.pandas_udf("struct<lang_pred:string,score:double,margin:double>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        import zstandard as zstd

        raw = zstd.DICT_TYPE_RAWCONTENT
        params = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK_BYTES, dict_size=DICT_BYTES, write_content_size=False, write_checksum=False, write_dict_id=False)
        each = [[zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(d, dict_type=raw)) for d in ds] for ds in held]
        for ds in each:
            for c in ds:
                c.compress(b" ")
        rows = []
        for text in texts:
            t = folded(text) if text else ""
            if not t or not names:
                rows.append((UNKNOWN, 0.0, 0.0))
                continue
            data = t.encode("utf-8", "replace")
            sizes = [0.0] * len(names)
            for at in range(0, len(data), BLOCK_BYTES):
                block = data[at : at + BLOCK_BYTES]
                for k, ds in enumerate(each):
                    sizes[k] += sum(len(c.compress(block)) for c in ds) / len(ds)
            order = sorted(range(len(names)), key=lambda k: (sizes[k], k))
            best = sizes[order[0]]
            margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
            rows.append((names[order[0]], margin / (margin + 0.05), margin))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "margin"])

    d = packed(docs).withColumn("judged", judge(F.col("d")["text"]))
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "margin", "confident", "doc_id")]
    return d.select(F.col("d")["doc_id"].alias("doc_id"), "judged.*", (F.col("judged.margin") >= least_margin).alias("confident"), *[F.col("d")[c].alias(c) for c in rest])
