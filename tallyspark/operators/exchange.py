"""Captured requests and responses to audited rows: choices with counts, slices, candidate ids, scores and calibrated verdicts.

A captured row is as sources.files.CAPTURED has it. `choices_of` adds what the audit needs of each choice. Python sees each
text once, for the canonical encoding, and of token entries only those with placeholders for partial characters; everything
else is columns, and candidate ids come from joins with the vocabulary as a table, for the few choices that are not cut as the
encoder would. Unknown stays null: a model without a tokenizer has no canonical counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import bpe
from tallyspark.functions.bpe import Unverifiable, vocabulary
from tallyspark.functions.tokens import calibration_key, entry_bytes, script_bucket
from tallyspark.operators import align, audit, likelihood
from tallyspark.operators.align import spelling, spelt_part
from tallyspark.operators.calibration import applicability, thresholds
from tallyspark.sources.store import dealt, stored

#: Vocabularies with this token write reasoning on a channel of its own, which the returned text doesn't have.
CHANNEL = "<|channel|>"
READ = "read struct<ids:array<int>,bytes:array<int>,array:string,start:int,end:int,readings:int,pieces:array<array<binary>>>"
_IDS = pa.list_(pa.int32())
_READ = pa.struct([("ids", _IDS), ("bytes", _IDS), ("array", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("readings", pa.int32()), ("pieces", pa.list_(pa.list_(pa.binary())))])


def _read(text: str, spec: str | None, tokens: list | None, raws: list | None, special: list | None) -> dict:
    """The canonical encoding of a text, with the bytes of its ids, and how entries with placeholders (where given) spell it."""
    data, out = text.encode("utf-8", "surrogatepass"), {}
    if spec is not None:
        v = vocabulary(spec)
        try:
            out["ids"] = v.canonical(data)
            out["bytes"] = [len(v.pieces[i]) for i in out["ids"]]
        except Unverifiable:
            pass
    if tokens is not None:
        forms = [spelling(t, r) for t, r in zip(tokens, raws)]
        out["array"], out["start"], out["end"], out["pieces"] = spelt_part(forms, data, special)
        out["readings"] = None if out["array"] and out["pieces"] is None else len(out["pieces"] or [])
    return out


#: Rows that are Python objects at a time.
READ_ROWS = 100


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds read; other columns pass as they are. Few rows are Python objects at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, READ_ROWS):
            b = whole.slice(at, READ_ROWS)
            rows = [_read(*x) for x in zip(*(b.column(c).to_pylist() for c in ("text", "tokenizer", "hole_tokens", "hole_raws", "hole_special")))]
            yield b.append_column("read", pa.array(rows, _READ))


def choices_of(captured: DataFrame, tokenizers: DataFrame) -> DataFrame:
    """(exchange, host, time, model, ..., index, language, reported, answer, canonical, ...): a row for each choice, written once.

    captured has an `exchange` that names the row. tokenizers has (model, tokenizer): a spec for each model that has one.
    Responses without choices have no rows here; `records` brings them back.
    """
    known = tokenizers.select("model", "tokenizer").where("tokenizer is not null")
    traits = known.join(bpe.traits(known), "tokenizer")
    flat = audit.projected(captured, "exchange", "language", F.col("response.choices").alias("choice_list"))
    cols = [x for x in flat.columns if x not in ("choice_list", "language")]
    # there are few models: dealt by them, rows would go to a few tasks. A row a model with a tokenizer is small. With a plain
    # explode the optimizer asks of the list whether it is empty before, for which a request would be parsed again.
    c = flat.join(F.broadcast(traits), "model", "left").select("*", F.posexplode_outer("choice_list").alias("nth", "c")).where("nth is not null").drop("choice_list", "nth")
    entries = F.col("c.logprobs.content")
    tools = F.coalesce(F.size("c.message.tool_calls") > 0, F.lit(False))
    reasoning = (F.coalesce("c.message.reasoning", F.lit("")) != "") | (F.coalesce("c.message.reasoning_content", F.lit("")) != "")
    c = c.select(
        *cols, "tokenizer", "special_tokens", "special_ids", "newline", F.coalesce("c.index", F.lit(0)).alias("index"), F.coalesce("c.message.content", F.lit("")).alias("text"), "language",
        F.when(entries.isNotNull(), F.size(entries)).cast("long").alias("reported"), reasoning.alias("reasoning"), F.coalesce(F.col("c.finish_reason") == "length", F.lit(False)).alias("capped"),
        tools.alias("tool_calls"), F.when(~tools, entries).alias("e"))
    # entries are looked through once, for all that is asked of each. What passes through Python has no lists inside of them: Spark
    # measures a batch after each row, and null lists all over again
    c = c.withColumn("e", F.transform("e", _entry))
    c = c.withColumns({"special": F.col("e.special"), "hole": F.coalesce(F.array_contains("e.holed", True), F.lit(False))})
    holed = lambda x: F.when(F.col("hole"), x)
    only = F.transform("e", lambda e: F.when(~e["holed"], e["raw"]))
    c = c.withColumns({"hole_tokens": holed(F.col("e.token")), "hole_raws": holed(only), "hole_special": holed(F.col("special"))})
    c = c.mapInArrow(_read_batches, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema), READ])).drop("hole_tokens", "hole_raws", "hole_special")
    c = c.withColumn("raws", F.col("e.raw"))
    c = c.withColumn("hexes", F.transform("raws", lambda b: F.coalesce(F.hex(b), F.lit(""))))
    c = c.withColumn("cut", F.when(~F.col("hole") & F.col("e").isNotNull(), align.slice_of(F.col("e"), F.col("text"), F.col("special"), F.col("hexes"))))
    c = c.withColumns({k: F.coalesce(f"cut.{k}", f"read.{k}") for k in ("array", "start", "end")})
    aligned = F.col("array").isNotNull()
    answer = lambda x: F.slice(x, F.col("start") + 1, F.col("end") - F.col("start"))
    whole = F.array(answer("raws"))
    c = c.withColumns({
        "readings": F.when(F.col("e").isNotNull() & ~aligned, 0).when(F.col("hole"), F.col("read.readings")).when(aligned, 1),
        "pieces": F.when(F.col("hole"), F.col("read.pieces")).when(aligned, whole), "given": answer("e.given"), "tokens": answer("e.token")})
    sizes = F.transform("pieces", lambda r: F.transform(r, lambda b: F.octet_length(b)))
    agree = F.array_max("given").isNull() | F.forall(F.arrays_zip("given", "read.ids"), lambda x: F.coalesce(x["given"] == x["ids"], F.lit(True)))
    same = F.exists("sizes", lambda r: r == F.col("read.bytes")) & agree
    judged = aligned & F.col("read.ids").isNotNull() & ~F.col("capped") & F.coalesce(F.size("pieces") > 0, F.lit(False))
    c = c.withColumn("sizes", sizes).withColumn("other", F.coalesce(judged & ~same, F.lit(False)))
    kept = lambda x: F.when(F.col("other"), x)
    c = stored(c.select(
        *cols, "tokenizer", "newline", "index", F.coalesce("language", script_bucket(F.col("text"))).alias("language"), "reported", (F.col("end") - F.col("start")).cast("long").alias("answer"),
        F.when(F.col("read.ids").isNotNull(), F.size("read.ids")).cast("long").alias("canonical"), "array", "reasoning", "capped", "tool_calls",
        F.when(F.col("e").isNotNull(), F.col("readings")).alias("readings"), F.col("read.ids").alias("canonical_ids"), F.col("read.bytes").alias("canonical_bytes"),
        F.coalesce(F.array_contains("special_tokens", CHANNEL), F.lit(False)).alias("channels"), "other", kept(F.col("pieces")).alias("pieces"), kept(F.col("sizes")).alias("reading_bytes"),
        kept(F.col("given")).alias("given"), kept(F.col("tokens")).alias("tokens")))
    c = c.join(stored(_candidates(c.where("other"), known)), ["exchange", "index"], "left")
    mismatch = F.col("other") & F.col("candidates").isNull()
    reason = (
        F.when(F.col("tool_calls") | F.col("reported").isNull(), F.lit(None)).when(F.col("array").isNull(), "the entries do not spell the text")
        .when(F.col("readings").isNull(), "too many readings").when(mismatch, "an entry is not a token of the vocabulary"))
    return c.withColumns({"token_mismatch": mismatch, "noncanonical": F.col("other") & ~mismatch, "reason": reason}).drop("other", "pieces", "given", "tokens", "reading_bytes")


def _holed(e: Column) -> Column:
    return e["bytes"].isNull() & ~F.startswith(e["token"], F.lit("bytes:")) & F.contains(e["token"], F.lit(align.PLACEHOLDER))


def _entry(e: Column) -> Column:
    given = F.coalesce(e["token_id"], F.when(F.startswith(e["token"], F.lit("token_id:")), _named_id(e["token"])))
    return F.struct(
        F.coalesce(e["token"], F.lit("")).alias("token"), given.alias("given"), entry_bytes(e).alias("raw"), _is_special(e).alias("special"),
        F.coalesce(_holed(e), F.lit(False)).alias("holed"))


def _named_id(token: Column) -> Column:
    """The number in `token_id:123`, else null. A failing cast costs an exception, so other tokens are not cast."""
    return F.nullif(F.regexp_extract(token, "^token_id:([0-9]+)$", 1), F.lit("")).try_cast("bigint")


def _is_special(e: Column) -> Column:
    by_id = F.array_contains("special_ids", e["token_id"].cast("int"))
    return F.coalesce(F.when(e["token_id"].isNotNull(), by_id).otherwise(F.array_contains("special_tokens", F.coalesce(e["token"], F.lit("")))), F.lit(False))


def _candidates(others: DataFrame, tokenizers: DataFrame) -> DataFrame:
    """(exchange, index, candidates, candidate_bytes): of each reading with an id for every entry, the ids each entry may stand for.

    An entry with an id stands for it if the bytes agree; else for all ids of its bytes, the encoder's own first; else for the
    control token of its name. Distinct entries are looked up once; where they are few they travel to all tasks, and the entries
    of a choice are not moved: choices are dealt before they are unfolded.
    """

    def unfolded(rows: DataFrame) -> DataFrame:
        r = rows.select("exchange", "index", "tokenizer", "given", "tokens", F.posexplode("pieces").alias("reading", "p"))
        r = r.select("exchange", "index", "reading", "tokenizer", F.posexplode(F.arrays_zip("p", "given", "tokens")).alias("at", "x"))
        r = r.select("exchange", "index", "reading", "tokenizer", "at", F.col("x.p").alias("bytes"), F.col("x.given").cast("int").alias("given"), F.col("x.tokens").alias("token"))
        return r.withColumn("entry", F.concat_ws("|", "tokenizer", F.hex("bytes"), F.coalesce(F.col("given").cast("string"), F.lit("-")), "token"))

    v = stored(bpe.vocabularies(tokenizers))
    by_bytes = v.where("special is null").groupBy("tokenizer", "bytes").agg(F.sort_array(F.collect_list(F.struct("rank", "token_id"))).alias("of"))
    by_bytes = by_bytes.select("tokenizer", "bytes", F.transform("of", lambda x: x["token_id"]).alias("same_bytes"))
    by_id = v.select("tokenizer", F.col("token_id").alias("given"), F.col("bytes").alias("given_bytes"))
    by_name = v.where("special is not null").select("tokenizer", F.col("special").alias("token"), F.array("token_id").alias("control"))
    each = unfolded(others).groupBy("entry").agg(F.first(F.struct("tokenizer", "bytes", "given", "token")).alias("e")).select("entry", "e.*")
    each = each.join(by_bytes, ["tokenizer", "bytes"], "left").join(by_id, ["tokenizer", "given"], "left").join(by_name, ["tokenizer", "token"], "left")
    ids = F.when(F.col("given").isNotNull(), F.when(F.col("given_bytes") == F.col("bytes"), F.array("given"))).otherwise(F.coalesce("same_bytes", "control"))
    own = unfolded(dealt(others.select("exchange", "index", "tokenizer", "given", "tokens", "pieces"), "exchange", "index"))
    found = own.select("exchange", "index", "reading", "at", "bytes", "entry").join(stored(each.select("entry", ids.alias("ids"))), "entry")
    per = found.groupBy("exchange", "index", "reading").agg(F.array_sort(F.collect_list(F.struct("at", "ids", F.octet_length("bytes").alias("n")))).alias("x"), F.bool_and(F.col("ids").isNotNull()).alias("whole"))
    per = per.where("whole").select("exchange", "index", F.struct("reading", F.transform("x", lambda e: e["ids"]).alias("ids"), F.transform("x", lambda e: e["n"]).alias("bytes")).alias("r"))
    g = per.groupBy("exchange", "index").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return g.select("exchange", "index", F.transform("rs", lambda r: r["ids"]).alias("candidates"), F.transform("rs", lambda r: r["bytes"]).alias("candidate_bytes"))


def readings_of(choices: DataFrame) -> DataFrame:
    """(id, exchange, index, reading, model, candidates, bytes, canonical_ids, canonical_bytes, newline): a row for each reading of noncanonical choices."""
    own = choices.where("noncanonical").select("exchange", "index", "model", "canonical_ids", "canonical_bytes", "newline", F.posexplode(F.arrays_zip("candidates", "candidate_bytes")).alias("reading", "x"))
    name = F.concat_ws(":", "exchange", "index", "reading")
    return own.select(name.alias("id"), "exchange", "index", "reading", "model", F.col("x.candidates").alias("candidates"), F.col("x.candidate_bytes").alias("bytes"), "canonical_ids", "canonical_bytes", "newline")


def resolved_readings(choices: DataFrame, store: likelihood.WindowStore, scorer: likelihood.Scorer, settings: likelihood.Settings = likelihood.Settings()) -> DataFrame:
    """readings_of with ids and unclear, written once."""
    return likelihood.resolved(readings_of(choices), store, scorer, settings)


def scored(choices: DataFrame, readings: DataFrame, store: likelihood.WindowStore, scorer: likelihood.Scorer, settings: likelihood.Settings = likelihood.Settings()) -> DataFrame:
    """Adds llr, spans and unresolved to choices, from their resolved readings: those of the reading with the highest ratio.

    A choice with a reading that can't be resolved or scored can't be judged.
    """
    llr = likelihood.ratios(readings.where(~F.col("unclear")), store, scorer, settings)
    each = readings.select("id", "exchange", "index", "reading", "unclear").join(llr, "id", "left")
    best = each.groupBy("exchange", "index").agg(
        F.max_by(F.struct("llr", "spans"), F.struct("llr", -F.col("reading"))).alias("best"), F.bool_or(F.col("unclear") | F.col("llr").isNull()).alias("unclear"))
    out = choices.join(best, ["exchange", "index"], "left")
    fine = ~F.coalesce("unclear", F.lit(False))
    return out.withColumns({"llr": F.when(fine, F.col("best.llr")), "spans": F.when(fine, F.col("best.spans")), "unresolved": F.coalesce(F.col("noncanonical") & ~fine, F.lit(False))}).drop("best", "unclear")


def unscored(choices: DataFrame) -> DataFrame:
    """The same without a scorer: noncanonical choices can't be judged."""
    return choices.withColumns({"llr": F.lit(None).cast("double"), "spans": F.lit(None).cast("int"), "unresolved": F.col("noncanonical")})


def calibrated(choices: DataFrame, scores: DataFrame, meta: DataFrame, margins: DataFrame, alpha: float) -> DataFrame:
    """Adds tau, margin and mismatch: the threshold of a choice's key, the model's noise margin (0 by default), and why the
    calibration does not apply, if so. choices also have tokenizer, scorer, temperature, top_p, system."""
    c = choices.withColumn("key", calibration_key(F.col("model"), F.col("language")))
    c = c.join(thresholds(scores, alpha).select("key", "tau"), "key", "left").join(margins.select("model", "margin"), "model", "left")
    c = applicability(c.withColumn("margin", F.coalesce("margin", F.lit(0.0))).drop("reason"), meta)
    return c.withColumnRenamed("reason", "mismatch")


def records(captured: DataFrame, choices: DataFrame) -> DataFrame:
    """Audited rows: choices of an exchange put back together, with the record checks. verdict is that of `verdicts`."""
    flat = audit.projected(captured, "exchange").drop("n")
    fields = ["index", "language", "reported", "answer", "canonical", "array", "reasoning", "capped", "tool_calls", "readings", "token_mismatch", "noncanonical", "llr", "spans", "tau", "verdict"]
    per = choices.groupBy("exchange").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("choices"), F.bool_or("channels").alias("channels"))
    return audit.checked(flat.join(per, "exchange", "left").withColumn("choices", F.coalesce("choices", F.array().cast(per.schema["choices"].dataType))))


def verdicts(choices: DataFrame) -> DataFrame:
    """Adds the verdict of each scored and calibrated choice: the ladder first, then the settings, then the test."""
    row = F.struct("reported", "tool_calls", "array", "readings", "canonical", "capped", "token_mismatch")
    tau = F.when(F.col("mismatch").isNull(), F.col("tau"))
    return choices.withColumn("verdict", audit.verdict(row, F.coalesce("noncanonical", F.lit(False)), F.col("llr"), F.col("spans"), tau, F.col("margin"), F.col("unresolved")))


def scorer_is_audited(captured: DataFrame, scorers: DataFrame) -> DataFrame:
    """(host, model) whose scorer runs on the audited host, so that its scores are not independent; scorers has (model, url)."""
    own = audit.projected(captured).select("host", "model").distinct()
    return own.join(scorers, "model").where(F.parse_url("url", F.lit("HOST")) == F.col("host")).select("host", "model")


def usable(choices: DataFrame) -> DataFrame:
    """Scored choices of honest responses that can calibrate the test: cut, unaligned and unverifiable ones are left out."""
    c = choices.where("not capped and not tool_calls and reported is not null and array is not null and readings is not null and canonical is not null")
    return c.where("not token_mismatch and not unresolved")


def honest_scores(choices: DataFrame) -> DataFrame:
    """(key, score) of usable choices: 0 for canonical reports, else the ratio."""
    return usable(choices).select(calibration_key(F.col("model"), F.col("language")).alias("key"), F.when(F.col("noncanonical"), F.col("llr")).otherwise(0.0).alias("score"))


def topics_by_templates(topics: DataFrame, templates: DataFrame, first: int, second: int, seed: int = 0) -> DataFrame:
    """(prompt, part): every topic in every template ('{}' stands for it), in seeded order, the first `first` as part 0, the next `second` as part 1."""
    every = topics.select("topic").crossJoin(templates.select("template"))  # two hand-written lists
    p = every.select(F.replace("template", F.lit("{}"), F.col("topic")).alias("prompt"))
    order = p.orderBy(F.xxhash64(F.lit(seed), "prompt"), "prompt").limit(first + second)
    nth = order.agg(F.collect_list("prompt").alias("p")).select(F.posexplode("p").alias("nth", "prompt"))
    return nth.select("prompt", F.when(F.col("nth") < first, 0).otherwise(1).alias("part"))

