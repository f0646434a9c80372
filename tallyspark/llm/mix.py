"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source has a target number of words. Sources of like size (within a factor of two) share a block size: the largest
power of two up to a thousandth of the source, 1 at least and BLOCK_WORDS at most, so that small sources come as near
their targets as large ones. What such sources take together is cut into blocks of that equal size, and blocks go to them
by highest quotients target / (2 seats + 1). A source's documents lie end to end, in seeded order, in shards of bounded size; its
blocks are apportioned to its shards in the same way by their words, which gives an integer quota per shard. Within a
shard, seeded order picks the blocks that fill the quota. A document takes its words in the picked blocks, so every
block, and with it every word, is taken at most twice.

Sources and shards are small tables (a row each); documents are only ever dealt by shard or block, never by source.

Defined results: null and wordless texts have size 0 and take nothing; a null source is a source of its own, last in
order; an empty table gives no rows; repeated rows, and rows that share an identifier, are rows of their own; other columns
are ignored. The same seed gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_classes, shared_dir, stored

#: Size counts runs of anything but ASCII blanks (fixed by the contract).
TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Words in a shard, about (its documents' sizes are ordered in one task), and the largest block.
SHARD_WORDS, BLOCK_WORDS = 5_000_000, 512
#: Rows alike in identifier, source and size that one task makes of their count.
COPIES = 1_000


def sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def numbered(d: DataFrame) -> DataFrame:
    """Adds copy to (doc_id, source, key, size): a number for each of the rows that are alike, which nothing else tells apart.

    They are counted before the shuffle and made again from their count, so that a third of all rows may be alike, and a rerun
    numbers them in the same way however the table is split.
    """
    alike = stored(d.groupBy("doc_id", "source", "key", "size").agg(F.count(F.lit(1)).alias("_n")))
    cols = ["doc_id", "source", "key", "size"]
    few = alike.where(F.col("_n") <= COPIES).select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("copy"))
    first = (F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES)))).alias("_first")
    many = alike.where(F.col("_n") > COPIES).select(*cols, "_n", first).repartition("doc_id", "size", "_first")
    begin = F.col("_first") * COPIES
    many = many.select(*cols, F.explode(F.sequence(begin + 1, F.least(F.col("_n"), begin + COPIES))).alias("copy"))
    return few.unionByName(many)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds weight and target to (source, source_size): weights repeat in code-point order, nulls last; a target stops at
    cap times its source and the excess is shared again by weight until none is above."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    t = sources.withColumn("weight", of).withColumn("most", F.col("source_size") * cap)
    total = t.agg(F.sum("source_size")).first()[0] or 0
    capped, rate = 0, 0.0
    while True:  # each round fixes at least one more source at its cap
        left = total * share
        over = F.col("most") < F.col("weight") * F.lit(rate)
        x = t.agg(
            F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
            F.sum(over.cast("int"))).first()
        if rate and (x[2] == capped or not x[1]):
            break
        capped = x[2] or 0
        rate = (left - (x[0] or 0.0)) / x[1] if x[1] else 0.0
        if not rate:
            break
    return t.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(float(rate))).cast("double")).drop("most")


def apportioned(claims: DataFrame, by: list[str], group: list[str], claim: Column, seats: Column, most: Column) -> DataFrame:
    """Sainte-Laguë: (…claims, quota). Within each group, `seats` seats go to the highest quotients claim / (2 a + 1).

    Every claimant is sure of the seats far below its exact share and can't reach those far above; only quotients in
    between are ranked: half the claimants times its share, and three more, on either side. `most` bounds a claimant.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    c = claims.withColumn("_claim", claim.cast("double")).withColumn("_seats", seats.cast("long")).withColumn("_most", most.cast("long"))
    c = c.withColumn("_sum", F.sum("_claim").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    part = F.when(F.col("_sum") > 0, F.col("_claim") / F.col("_sum")).otherwise(0.0)
    c = c.withColumn("_exact", part * F.col("_seats")).withColumn("_slack", F.ceil(part * F.col("_n") / 2).cast("long") + 3)
    c = c.withColumn("_sure", F.greatest(F.lit(0).cast("long"), F.floor("_exact") - F.col("_slack")))
    c = c.withColumn("_sure", F.least("_sure", "_most"))
    c = c.withColumn("_last", F.least(F.floor("_exact") + F.col("_slack"), F.col("_most")))
    c = c.withColumn("_rest", F.col("_seats") - F.sum("_sure").over(w))
    q = c.where("_claim > 0 and _last > _sure").select(
        *by, "_rest", "_claim", F.explode(F.sequence("_sure", F.col("_last") - 1)).alias("_a"))
    order = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    order = order.orderBy(F.desc(F.col("_claim") / (2 * F.col("_a") + 1)), *[F.col(b).asc_nulls_last() for b in by])
    won = q.withColumn("_rank", F.row_number().over(order)).where("_rank <= _rest")
    won = won.groupBy(*[F.col(b).alias(f"_by_{b}") for b in by]).agg(F.count(F.lit(1)).alias("_won"))
    on = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    out = c.join(won, on, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.select(*claims.columns, "quota")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17,
    block_words: int | None = None, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, n_blocks) for every row; taken is what the mix takes of it.

    block_words sets one block size for all sources.
    """
    work = shared_dir(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # of a source, also a null one
    d = stored(numbered(sizes(docs).withColumn("key", key)), f"{work}/sizes")
    per = d.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    src = stored(targets(per, weights, share, cap), f"{work}/sources")
    tier = F.floor(F.log2(F.greatest(F.lit(1.0), F.least(F.col("source_size") / 1000, F.lit(float(BLOCK_WORDS))))) + 1e-9)
    src = src.withColumn("b", F.lit(block_words).cast("long") if block_words else F.pow(F.lit(2.0), tier).cast("long"))
    src = src.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int"))
    seats = F.round(F.sum("target").over(Window.partitionBy("b")) / F.col("b"))
    src = src.withColumn("all_seats", seats)
    src = apportioned(src, ["b", "source"], ["b"], F.col("target"), F.col("all_seats"), F.ceil(F.col("source_size") / F.col("b")) * 2)
    src = stored(src.withColumnRenamed("quota", "seats"), f"{work}/seats")

    # documents: end to end within a shard
    named = src.select("key", "docs", "source_size", "target", "shards", "seats", "b")
    placed = join_classes(d, named, "key", "docs", max(1, d.count())).drop("docs", "key")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy"))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("copy")), F.col("shards")).cast("int"))
    w = Window.partitionBy("source", "shard").orderBy(order, "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0).cast("long")))
    placed = stored(placed.withColumn("row", F.monotonically_increasing_id()), f"{work}/placed")

    # quotas per shard, then seeded blocks
    b = F.col("b")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("seats").alias("seats"), F.max("b").alias("b"))
    shards = shards.where("words > 0").withColumn("blocks", F.ceil(F.col("words") / b).cast("long"))
    shards = apportioned(shards, ["source", "shard"], ["source"], F.col("words"), F.col("seats"), F.col("blocks") * 2)
    blocks = shards.select("source", "shard", "quota", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    pick = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "block"), "block")
    times = F.floor(F.col("quota") / F.col("blocks")) + (F.row_number().over(pick) <= F.col("quota") % F.col("blocks")).cast("long")
    blocks = blocks.withColumn("times", times).where("times > 0")
    blocks = blocks.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"), "shard", "block", "times")

    end = F.col("start") + F.col("size")
    parts = placed.where("size > 0").select(
        "row", "b", "start", end.alias("end"), F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"), "shard",
        F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))).alias("block"))
    inside = F.least(F.col("end"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
    got = parts.join(blocks, ["_s", "_null", "shard", "block"]).groupBy("row").agg(
        F.sum(inside * F.col("times")).alias("taken"), F.count(F.lit(1)).alias("n_blocks"))
    zero = F.lit(0).cast("long")
    return placed.join(got, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", zero).cast("long").alias("taken"),
        F.coalesce("n_blocks", zero).alias("n_blocks"))
