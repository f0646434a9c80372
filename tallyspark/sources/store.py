"""Tables in a folder that driver and executors share: cut lineage, keyed tables that are replaced as a whole, batches that can't double."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _folder(spark, path)
    return fs.exists(where)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which goes when the session's JVM ends. Only a local session may have that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/ledger-{uuid.uuid4().hex}"
    where, fs = _folder(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: what is used several times is computed once, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows over all tasks. They are few bytes and much work, so partitions that are merged by bytes would leave a few tasks all of it."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


class Versioned:
    """A table that is replaced as a whole, by one writer: each version is a folder, and counts once it is complete.

    Readers keep the version they began with: the one before the newest stays until the next replacement.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        where, fs = _folder(self.spark, self.path)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self) -> DataFrame:
        """The newest complete version; empty if there is none."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{known[-1]}")

    def replace(self, rows: DataFrame) -> None:
        known = self.versions()
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/v{known[-1] + 1 if known else 0}")
        for old in known[:-1]:
            where, fs = _folder(self.spark, f"{self.path}/v{old}")
            fs.delete(where, True)

    def upsert(self, rows: DataFrame, keys: list[str], order: list[str]) -> None:
        """Of each key the row that is largest by `order` stays, old or new, so the same rows again change nothing and size grows with keys."""
        both = self.read().unionByName(rows.select(*self.read().columns))
        rest = [c for c in both.columns if c not in keys]
        best = F.max_by(F.struct(*rest), F.struct(*order))
        self.replace(both.groupBy(*keys).agg(best.alias("_s")).select(*keys, "_s.*"))


def digest_of(rows: DataFrame) -> str:
    """A name for a set of rows: the same rows have the same, in whatever order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    a = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0)).alias("s")).first()
    return f"{a['n']}-{a['x'] & (1 << 64) - 1:016x}-{a['s']}"


def add_batch(rows: DataFrame, path: str, batch: str | None = None) -> str:
    """Adds rows to a table as one batch, named by what it holds unless it is given a name; a batch of the same name is replaced."""
    if not batch:
        rows = stored(rows)  # named by the very rows that are written, which are made once
    name = batch or digest_of(rows)
    rows.write.mode("overwrite").parquet(f"{path}/batch={name}")
    return name


def add_text(lines: DataFrame, path: str, name: str) -> None:
    """Writes lines (value) as one file path/name.jsonl, for readers that tell files by their names; a few lines only, as one task writes them."""
    spark = lines.sparkSession
    work = f"{path}/_{name}"
    lines.coalesce(1).write.mode("overwrite").text(work)
    where, fs = _folder(spark, work)
    part = next(s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.jsonl"))
    fs.delete(where, True)
