"""Exact deduplication with keyed streaming state.

A compact ledger (digest, stable identifier, content locator) is streamed through a stateful aggregation whose state is
kept on disk by RocksDB and never expires: for each digest it retains the identifier and locator of the row that stays
and the number of rows. The locator is a hash of identifier and text as stored, so it finds that very row again even
where identifiers are null or shared. Spark combines rows of a digest before the shuffle, so a digest that holds a third of all rows
sends one row per task. Every hit is then compared with the retained row's full bytes; rows that share a digest but not
their bytes are classed by the bytes themselves.

Defined results: null text counts as empty; empty texts equal each other; an empty table gives no rows; rows that repeat
both identifier and text are all reported, as one and the same document (`kept` follows the identifier); other columns
are ignored, and pass through `drop_copies` whatever their names. A null identifier is smaller than any other. Identifiers are
whole numbers (64 bits): others have to be numbered first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, id_text, join_classes, maybe_among, packed, row_at, shared_dir, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows whose state one store holds, about.
STORE_ROWS = 1_000_000
#: Copies of one text that a single task compares with the row that stays.
SALT_ROWS = 2_000


def whole(sha: Column) -> Column:
    return sha


def with_digest(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, norm, locator, sha, digest). key maps the SHA-256 to the state's key: all of it, but tests shorten it to make texts collide."""
    d = id_text(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm"), row_at(F.col("doc_id"), F.col("text")).alias("locator"))
    return d.withColumn("sha", F.sha2("norm", 256)).withColumn("digest", key(F.col("sha")))


def ledger(docs: DataFrame, key: Callable[[Column], Column] = whole) -> DataFrame:
    """(doc_id, sha, digest, locator): what the state needs of each row."""
    return with_digest(docs, key).select("doc_id", "sha", "digest", "locator")


def stream_state(spark: SparkSession, ledger_path: str, work: str, files_per_trigger: int = 4096, partitions: int = 8) -> DataFrame:
    """Feeds new ledger files through the stateful query and returns the newest state of every digest.

    The same `work` folder continues from its checkpoint: a second call after files were added reads only those.
    """
    schema = "doc_id long, sha string, digest string, locator long"
    keys = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
        "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        # otherwise every store reserves 4 MB of disk for its manifest, however little it holds
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
        # each partition is a store of its own; their number is fixed by the first batch
        "spark.sql.shuffle.partitions": str(partitions),
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        newest = (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger)
            .parquet(ledger_path)
            .groupBy("digest")
            .agg(
                F.max("doc_id").alias("keep_id"),
                F.max_by("locator", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("keep_locator"),  # a null order would be left out
                F.count(F.lit(1)).alias("group_size"),
            )
        )

        def sink(batch: DataFrame, batch_id: int) -> None:
            # keyed by batch, so a batch that is run again after a failure replaces itself
            batch.write.mode("overwrite").parquet(f"{work}/state/batch={batch_id}")

        query = (
            newest.writeStream.outputMode("update")
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(sink)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out_schema = "digest string, keep_id long, keep_locator long, group_size long, batch int"
    versions = spark.read.schema(out_schema).parquet(f"{work}/state")
    if versions.select("batch").distinct().count() < 2:
        return versions.drop("batch")
    cols = ["keep_id", "keep_locator", "group_size"]
    return versions.groupBy("digest").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("digest", "s.*")


def assign(docs: DataFrame, key: Callable[[Column], Column] = whole, files_per_trigger: int = 4096) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row; the largest doc_id of equal texts stays."""
    spark = docs.sparkSession
    work = shared_dir(spark)
    entries = stored(ledger(docs, key), f"{work}/ledger")
    total = entries.count()
    if total:
        stores = max(8, -(-total // STORE_ROWS))
        state = stream_state(spark, f"{work}/ledger", f"{work}/stream", files_per_trigger, stores)
        out = join_classes(entries, state, "digest", "group_size", total).select("doc_id", "digest", "sha", "keep_id", "group_size")
        if (shared := collisions(docs, state, key, total)) is not None:
            # a digest that different texts share: its rows are classed by their bytes
            d = with_digest(docs, key).join(shared, "digest", "left_semi")
            classes = d.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            again = d.join(classes, "norm").select(out.columns)
            out = out.join(shared, "digest", "left_anti").unionByName(again)
    else:
        out = entries.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(0).cast("long")})
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def collisions(docs: DataFrame, state: DataFrame, key: Callable[[Column], Column], total: int) -> DataFrame | None:
    """Compares the full bytes of every hit with the row its locator names; returns digests whose bytes differ, or None.

    Rows of one digest are dealt over as many salts as its size asks for, and the retained row goes to each of them.
    """
    multi = stored(state.where(F.col("group_size") > 1))
    if not (groups := multi.count()):
        return None
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    texts = maybe_among(with_digest(docs, key).drop("sha"), "digest", multi.select("digest"), groups).where("_maybe").drop("_maybe")
    hits = join_classes(texts, multi, "digest", "group_size", total).where(F.col("group_size").isNotNull())
    # a number of its own deals each row, also rows that repeat both identifier and text; it is fixed once it is written
    dealt = F.pmod(F.xxhash64("locator", F.monotonically_increasing_id()), salts)
    hits = stored(hits.withColumn("salt", dealt.cast("int")))
    kept = hits.where(F.col("locator") == F.col("keep_locator"))
    kept = kept.groupBy("digest").agg(F.min("norm").alias("kept_norm"), F.max(salts).alias("salts"))
    kept = kept.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    wrong = hits.select("digest", "salt", "norm").join(kept, ["digest", "salt"]).where(F.col("norm") != F.col("kept_norm"))
    wrong = stored(wrong.select("digest").distinct())
    return None if wrong.isEmpty() else wrong


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; one of rows that repeat both identifier and text.

    Rows that certainly have no copy pass without a shuffle; only the others are joined and counted.
    """

    def row_key(doc_id: Column, sha: Column) -> Column:
        return F.concat_ws(":", sha, doc_id)

    judged = assign(docs).where("group_size > 1")
    copies = judged.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"), "kept")
    copies = stored(copies.groupBy("key").agg(F.max("kept").alias("kept")))
    keyed = packed(docs).withColumn("key", row_key(F.col("d")["doc_id"], F.sha2(ascii_lower(F.col("d")["text"]), 256)))
    keyed = maybe_among(keyed, "key", copies.select("key"), copies.count())
    some = keyed.where("_maybe").join(copies.where("not kept").select("key"), "key", "left_anti")
    some = some.dropDuplicates(["key"])  # combined before the shuffle, however often a row repeats
    return keyed.where("not _maybe").select("d.*").unionByName(some.select("d.*"))
