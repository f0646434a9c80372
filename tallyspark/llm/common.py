"""Helpers shared by the training-data operators: word rule, shared folder, skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of digits, lower-cased ASCII letters and any non-ASCII characters (fixed by the contract).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same runs before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: UTF-8 byte table that lower-cases A-Z and turns every other ASCII byte outside a word into a space.
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b) in LOWER else b + 32 if chr(b) in UPPER else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure-ASCII values take the built-in's fast path, where both rules agree."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column of the input can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


#: Rows and bytes of one Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as rows, so that a batch of very long documents fits a Python worker.

    These are settings of the session (there is no per-query way); they are only ever lowered.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}", str(most)).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def packed(docs: DataFrame, name: str = "d") -> DataFrame:
    """All columns of docs in one struct, so that whatever an operator adds can't clash with them; `name.*` unpacks it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))


def row_at(doc_id: Column, text: Column) -> Column:
    """Locator of a row's content: rows have the same one if they agree in identifier and text (else by a 64-bit collision)."""
    return F.xxhash64(doc_id, text)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; it goes when the session's JVM ends.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tallyspark-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame, where: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends, and a lost executor loses nothing."""
    path = where or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_heavy(classes: DataFrame, key: str, rows: str, total: int, share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Keys holding at least total/share rows, and the rest. Of the former there are at most `share`, so they may be broadcast."""
    least = max(2, -(-total // share))
    return classes.where(F.col(rows) >= least), classes.where(F.col(rows) < least)


def join_classes(left: DataFrame, classes: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Left join of many rows to one row per key, where one key may hold a third of the rows.

    Rows of heavy keys (at most 1,000 by count) are joined by broadcast and never shuffled, however often a row repeats; the
    others take a shuffled join, in which no key has more than a thousandth of the rows. left is read for either.
    """
    heavy, light = split_heavy(classes, key, rows, total)
    keys = F.broadcast(heavy.select(key))
    return left.join(F.broadcast(heavy), key).select(*[F.col(f"`{c}`") for c in left.columns], *[c for c in classes.columns if c != key]).unionByName(
        left.join(keys, key, "left_anti").join(light, key, "left"))


#: Bits of the largest key filter: 128 MB when broadcast.
FILTER_BITS = 1 << 30


def maybe_among(left: DataFrame, key: str, keys: DataFrame, count: int, name: str = "_maybe") -> DataFrame:
    """Adds a boolean: false only where left's key is certainly not among keys (one column of the same name, no nulls).

    The keys travel as one bitmap of their hashes, 16 bits a key up to FILTER_BITS, so what is broadcast is bounded for any
    number of keys; past that more rows are merely undecided. Undecided rows go on to an exact join, the others need no shuffle.
    """
    bits = 1 << 15
    while bits < min(FILTER_BITS, 16 * count):
        bits *= 2
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    maps = keys.select(F.bitmap_bucket_number(h).alias("_bucket"), F.bitmap_bit_position(h).alias("_at"))
    maps = maps.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    at = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2.0), at % 8)).cast("int") % 2 == 1, F.lit(False))
    out = left.withColumn("_bucket", F.bitmap_bucket_number(h)).join(F.broadcast(maps), "_bucket", "left")
    return out.withColumn(name, hit).drop("_bucket", "_bits")
