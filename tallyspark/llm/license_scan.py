"""Licence scan by ordered signature rules, in DataFrame functions only.

Rules (license_rules.py, some three hundred) are regular expressions with a keyword, a priority, a label and a confidence:
tags, clauses of licence texts and headers, notices, addresses, names. A text must pass a cheap gate, then a rule's keyword
must occur, before its expression runs; detections are intervals of the lower-cased text with single blanks. A detection inside another of
higher or equal priority is suppressed (equal intervals: the first rule stays).

Base places come from words: each place where a base phrase's words stand consecutively.

Defined results: null counts as empty; texts without words have n_words 0; nothing found gives empty labels, null places
and score 0; overlapping places count one by one; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RAW_WORD, WORD, ascii_lower, id_text, shared_dir, stored
from .license_rules import GATE, rules

#: Fixed base phrases and labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

def places(words: Column, phrase: str) -> Column:
    """Word numbers, from 0, where the phrase's words stand consecutively."""
    need = phrase.split(" ")
    at = F.filter(F.transform(words, lambda w, i: F.when(w == need[0], i)), lambda i: i.isNotNull())

    def follows(k: int, w: str) -> Callable[[Column], Column]:
        return lambda i: F.coalesce(F.get(words, i + k) == w, F.lit(False))

    for k, w in enumerate(need[1:], 1):
        at = F.filter(at, follows(k, w))
    return at


def intervals(text: Column, pattern: Column) -> Column:
    """array<struct<start,end>> of the matches: lengths between and of matches, summed up."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.char_length(x))
    pairs = F.transform(hits, lambda n, i: F.struct(F.get(gaps, i).alias("gap"), n.alias("n")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        one = F.array(F.struct(start.cast("int").alias("start"), (start + p["n"]).cast("int").alias("end")))
        return F.struct((start + p["n"]).cast("int").alias("at"), F.concat(acc["out"], one).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base places, base_labels, found) for every row; found: intervals of all rules, before suppression."""
    d = id_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = F.array(*[
        F.struct(F.lit(i).alias("rule"), F.lit(r[0]).alias("label"), F.lit(r[1]).alias("keyword"), F.lit(r[2]).alias("pattern"),
                 F.lit(r[3]).alias("priority"), F.lit(r[4]).alias("confidence")) for i, r in enumerate(rules())])
    gated = d.withColumn("low", F.when(F.col("text").rlike(GATE), ascii_lower(F.col("text"))))
    words = F.regexp_extract_all(F.col("low"), F.lit(WORD), F.lit(0))
    gated = gated.withColumn("words", F.when(F.col("low").isNotNull(), words))
    per = [F.when(F.col("low").isNotNull(), places(F.col("words"), p)) for p, _ in BASE]
    gated = gated.withColumn("flat", F.when(F.col("low").isNotNull(), F.regexp_replace("low", r"\s+", " ")))
    live = F.filter(table, lambda r: F.contains(F.col("flat"), r["keyword"]))
    found = F.flatten(F.transform(live, lambda r: F.transform(
        intervals(F.col("flat"), r["pattern"]),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"),
                           r["label"].alias("label"), r["confidence"].alias("confidence")))))
    return gated.select(
        "doc_id", F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"), F.array(*per).alias("places"),
        F.when(F.col("low").isNotNull(), found).alias("found"))


def resolve(found: DataFrame) -> DataFrame:
    """(row, start, end, priority, rule, label, confidence) of detections that no other suppresses.

    In order of start, longest first, a detection is inside an earlier one of priority k or more if the furthest end so
    far at such priorities reaches its own; priorities are few, so each is one running maximum over the row's detections.
    """
    order = [F.col("start"), F.desc("end"), F.desc("priority"), F.col("rule")]
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r[3] for r in rules()})
    covered = F.lit(False)
    for k in levels:
        reach = F.max(F.when(F.col("priority") >= k, F.col("end"))).over(before)
        covered = covered | ((F.col("priority") == k) & (F.coalesce(reach, F.lit(-1)) >= F.col("end")))
    return found.withColumn("_covered", covered).where("not _covered").drop("_covered")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) for every row."""
    t = stored(scan(docs).withColumn("row", F.monotonically_increasing_id()), shared_dir(docs.sparkSession))
    kept = resolve(t.where(F.size("found") > 0).select("row", F.inline("found")))
    kept = kept.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n_detections"))
    kept = kept.withColumnRenamed("row", "_row")
    every = F.flatten(F.filter("places", lambda x: x.isNotNull()))
    base = F.filter(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    out = t.withColumn("at", every).withColumn("base", base).join(kept, F.col("row") == F.col("_row"), "left")
    none = F.array().cast("array<string>")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"), score.alias("score"),
        F.coalesce("n_detections", F.lit(0).cast("long")).alias("n_detections"))
