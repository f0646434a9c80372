"""Importance resampling towards a target collection, with hashed n-gram features and a dictionary of distinct ones.

N-gram strings are counted over all documents and all target texts; each distinct string is then hashed once, in the
dictionary, and its counts are added to its bucket's. A bucket's gain is the log ratio of its smoothed shares, a document's
weight the mean gain of its features. Gumbel noise drawn from a hash of the identifier turns the largest scores into a sample
without replacement.

Gains go back to documents through the dictionary. The most frequent strings, a bounded number of bounded length, travel to
every task, so a document's share of them is summed where it is read; what is left of it (distinct strings and their counts)
is joined by string. What is frequent never takes part in that join, so no key of it holds more than a small share of the
rows (1.1 / HOT of all features), but for strings longer than HOT_BYTES, which Spark's skew join splits.

Defined results: null texts have no words; a document without features has weight 0 and can't be drawn unless least_words is
0; null identifiers are drawn like an empty one; rows that repeat an identifier are documents of their own, of which the order
among equals is arbitrary, but fixed. No documents give no rows; no target texts give all buckets the same target share.
Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, shared_dir, small_batches, stored

#: Words of the longest n-gram, buckets, and the natural logarithm's scale.
MAX_N, BUCKETS, SCALE = 1, 10_000, 1_000
#: Strings that travel to every task, and bytes of the longest of them: 4 MB at most.
HOT, HOT_BYTES = 50_000, 80
#: Distinct strings, and bytes of texts, that one task counts before it hands them on.
FLUSH, FLUSH_BYTES = 200_000, 64 << 20
#: Index of a row within its partition, below the partition's number in monotonically_increasing_id.
WITHIN = (1 << 33) - 1


def features(text: bytes | None, max_n: int = MAX_N) -> tuple[list[bytes], int]:
    """All runs of 1 to max_n consecutive words, and the number of words."""
    words = text.translate(WORD_BYTES).split() if text else []
    out = words
    for n in range(2, max_n + 1):
        out = out + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out, len(words)


def counted(texts: DataFrame, max_n: int) -> DataFrame:
    """(feature, n): occurrences of each distinct string, some of them in several rows still."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        size = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(features(t, max_n)[0])
            size += b.nbytes
            if len(counts) >= FLUSH or size >= FLUSH_BYTES:
                yield table(counts)
                counts, size = Counter(), 0
        yield table(counts)

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

    return texts.select(F.col("text").cast("binary")).mapInArrow(count, "feature binary, n long")


def dictionary(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(feature, in_docs, in_target, bucket): every distinct string with its counts and the bucket it is hashed to."""
    both = counted(docs, max_n).select("feature", F.col("n").alias("d"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(counted(target, max_n).select("feature", F.lit(0).cast("long").alias("d"), F.col("n").alias("t")))
    per = both.groupBy("feature").agg(F.sum("d").alias("in_docs"), F.sum("t").alias("in_target"))
    return per.withColumn("bucket", F.pmod(F.crc32("feature"), F.lit(buckets)).cast("int"))


def gains(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): how much more of the target than of the documents falls into each bucket, in thousandths of a natural logarithm."""
    per = words.groupBy("bucket").agg(F.sum("in_docs").alias("s"), F.sum("in_target").alias("t"))
    whole = per.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()  # two numbers
    ours, theirs = (F.lit(float(x + buckets)) for x in whole)
    ratio = (F.col("t") + 1).cast("double") * ours / ((F.col("s") + 1).cast("double") * theirs)
    return per.select("bucket", F.floor(SCALE * F.log(ratio)).cast("long").alias("gain"))


def with_gains(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, in_docs, gain): the dictionary with its buckets' gains, at most one row a bucket being broadcast."""
    return words.join(F.broadcast(gains(words, buckets)), "bucket").select("feature", "in_docs", "gain")


def frequent(words: DataFrame) -> DataFrame:
    """The most frequent strings of words (feature, in_docs, ...), HOT of them at most, by a least count.

    Counts are graded in eighths of a power of two, of which there are a few hundred, and whole grades are taken while they fit.
    So a string that isn't taken has at most 1.1 / HOT of all features.
    """
    short = words.where((F.octet_length("feature") <= HOT_BYTES) & (F.col("in_docs") > 0)).withColumn("_grade", F.floor(8 * F.log2(F.col("in_docs").cast("double"))))
    least, taken = None, 0
    for r in short.groupBy("_grade").count().orderBy(F.desc("_grade")).collect():  # a row a grade
        taken += r["count"]
        if taken > HOT:
            break
        least = r["_grade"]
    return short.where(F.lit(False) if least is None else F.col("_grade") >= least).drop("_grade")


def weights(docs: DataFrame, words: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of each row of docs (doc_id, text); words has (feature, in_docs, gain)."""
    spark = docs.sparkSession
    small_batches(spark)
    hot = spark.sparkContext.broadcast({bytes(r["feature"]): r["gain"] for r in frequent(words).select("feature", "gain").collect()})  # HOT rows at most

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for b in batches:
            n_words, n_features, sums, rest, times = [], [], [], [], []
            for t in b.column("text").to_pylist():
                found, n = features(t, max_n)
                total, left = 0, []
                for f, c in Counter(found).items():
                    gain = known.get(f)
                    if gain is None:
                        left.append((f, c))
                    else:
                        total += c * gain
                n_words.append(n)
                n_features.append(len(found))
                sums.append(total)
                rest.append([f for f, _ in left])
                times.append([c for _, c in left])
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *arrays], names=["row", "doc_id", "n_words", "n_features", "known", "rest", "times"])

    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    d = d.mapInArrow(look_up, f"row long, doc_id {kind}, n_words long, n_features long, known long, rest array<binary>, times array<long>")
    d = stored(d, f"{shared_dir(spark)}/rows")  # row numbers are fixed from here on
    rest = d.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("feature"), F.col("x.times").alias("times"))
    rest = rest.join(words.select("feature", "gain"), "feature").select("row", (F.col("times") * F.col("gain")).alias("part"))
    parts = d.select("row", "doc_id", "n_words", "n_features", F.col("known").alias("part")).unionByName(rest, allowMissingColumns=True)
    per = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("part").alias("sum"))
    floored = F.expr("(sum - pmod(sum, n_features)) div n_features")
    return per.select("row", "doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, floored).otherwise(0).cast("long").alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the seed and the identifier."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank: 1, 2, 3, ... of the highest scores (ties to the smaller doc_id) among documents of least_words, percent of them; others null.

    One range shuffle of numbers orders them; ranks follow from the sizes of the partitions.
    """
    scored = scored.withColumn("other", F.col("n_words") < least_words)
    keys = [F.col("other"), F.desc("score"), F.col("doc_id"), F.col("row")]
    ordered = stored(scored.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("other"), 1)).alias("drawable"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    quota = F.floor(F.sum("drawable").over(Window.partitionBy()) * percent / 100)
    starts = sizes.select("part", before.alias("before"), quota.alias("quota"))
    out = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    rank = F.col("before") + F.col("at").bitwiseAND(WITHIN) + 1
    return out.withColumn("rank", F.when(~F.col("other") & (rank <= F.col("quota")), rank).cast("long")).drop("other", "at", "part", "before", "quota")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least_words: int = 20, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of docs (doc_id, text) against target (text); rank is null for those not drawn."""
    docs, target = docs.select("doc_id", "text"), target.select("text")
    words = stored(dictionary(docs, target, max_n, buckets))
    words = with_gains(words, buckets)
    scored = weights(docs, words, max_n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The texts drawn: (doc_id, text, rank). Rows that share an identifier are told apart by nothing else, so they come and go together."""
    picked = resample(docs, target, **settings).where("rank is not null").groupBy("doc_id").agg(F.min("rank").alias("rank"))
    return docs.select("doc_id", "text").join(picked, docs["doc_id"].eqNullSafe(picked["doc_id"])).select(docs["doc_id"], "text", "rank")
