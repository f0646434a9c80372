"""Personal data: exact base patterns, and bootstrapped contextual extraction of identifiers that they miss.

Base spans (email, ip, card, phone) and secrets (long runs of hexadecimal digits) seed the bootstrap. Identifier-like
strings are its candidates: tokens with three digits or more or an @, and runs of neighbouring tokens of digits and signs.
Each occurrence of a seed or candidate induces lexical patterns: its exact shape alone, and its coarse class with the words
before it, after it, or both. Spark builds the graph of patterns and distinct values over all documents and scores it in
rounds: a pattern's confidence is the mean score of its values (shrunk by `prior` unknown ones), a value's score is the
noisy-or of its patterns' confidence, seeds stay at 1. Patterns with enough distinct seeds and confidence then mark the
occurrences of unseen values as their seeds' kind.

Defined results: null counts as empty; spans are code points, end exclusive; base spans always stay, and no other span
overlaps a base span of the row; repeated rows are judged one by one; without seeds nothing is discovered; an empty table
gives no rows; other columns are ignored; identifiers never pass through Python, so any value is fine.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, id_text, join_classes, shared_dir, stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of spans that start together.
ALL_KINDS = (*KINDS, "secret")
ROUNDS, LEAST_CONFIDENCE, LEAST_SEEDS, PRIOR = 3, 0.75, 5, 1.0

_AT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins, so the look-behind changes nothing but the time for long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{24,}(?![0-9A-Za-z])")
_ANY = re.compile(r"[0-9@]")
_DIGIT, _RUN = re.compile(r"[0-9]"), re.compile(r"[0-9+()./\-]*[0-9][0-9+()./\-]*$")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`.,;:!?()[]{}<>*&%$#|=_-"
#: Values up to this length stand for themselves in the graph, longer ones for their hash.
KEY_LENGTH = 64


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind."""
    if not _ANY.search(text):
        return []
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _AT_DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(value: str) -> str:
    """Runs of letters as a, of digits as 0, other characters as they are; then the length, in fours."""
    return f"{re.sub(r'[0-9]+', '0', re.sub(r'[^\W\d_]+', 'a', value))}/{len(value) // 4}"


def coarse(value: str) -> str:
    """d for digits, p for digits and signs, e for an @ between letters or digits, m for letters and digits."""
    return "d" if value.isdigit() else "e" if "@" in value else "m" if any(c.isalpha() for c in value) else "p"


def _union(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """(kind or None, start, end, value, patterns) of base spans, secrets, and candidates outside both."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    spans: list[tuple] = [*base]
    taken = _union(spans)

    def free(start: int, end: int) -> bool:
        near = bisect_left(taken, (end, 0))  # of disjoint spans only the last that begins before the end can reach the start
        return not near or taken[near - 1][1] <= start

    spans += [("secret", *m.span()) for m in _SECRET.finditer(text) if free(*m.span())]
    taken = _union(spans)
    run: tuple[int, int, int] | None = None  # start, end and tokens of a run of digits and signs
    for s, e in [*tokens, (len(text) + 9, len(text) + 9)]:
        t = text[s:e]
        core = t.strip(_EDGE)
        a = s + t.find(core) if core else s
        digits = len(_DIGIT.findall(core))
        joins = bool(core) and _RUN.match(t.rstrip(".,;:!?")) is not None and free(a, a + len(core))
        if run and not (joins and s == run[1] + 1):
            if run[2] > 1 and len(_DIGIT.findall(text[run[0] : run[1]])) >= 7:
                spans.append((None, run[0], run[1]))
            run = None
        if joins:
            run = (run[0] if run else s, s + len(t.rstrip(".,;:!?")), run[2] + 1 if run else 1)
        if (digits >= 3 or 0 < core.find("@") < len(core) - 1) and free(a, a + len(core)):
            spans.append((None, a, a + len(core)))
    starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
    out = []
    for kind, s, e in spans:
        value = text[s:e]
        i, j = bisect_left(ends, s + 1), bisect_left(starts, e)  # the token that s stands in, and the first one after e
        head = [text[starts[i] : s]] if i < len(starts) and starts[i] < s else []
        left = [text[starts[k] : ends[k]] for k in range(max(0, i - 2), i)] + head
        one = left[-1].lower() if left else "^"
        two = " ".join(left[-2:]).lower() if left else "^"
        right = text[starts[j] : ends[j]].lower() if j < len(starts) else "$"
        c = coarse(value)
        key = value if len(value) <= KEY_LENGTH else hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((kind, s, e, key, [f"S {shape(value)}", f"L {one} | {c}", f"LL {two} | {c}", f"R {c} | {right}", f"LR {one} | {c} | {right}"]))
    return out


FOUND = "base array<struct<kind:string,start:long,end:long>>, seen array<struct<kind:string,start:long,end:long,value:string,patterns:array<string>>>"


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, base, seen) for every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(f"struct<{FOUND.replace('base array', 'base:array').replace('seen array', 'seen:array')}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text) if text else []
            seen = occurrences(text, base) if text and _ANY.search(text) else []
            rows.append((
                [{"kind": k, "start": s, "end": e} for k, s, e in base],
                [{"kind": k, "start": s, "end": e, "value": v, "patterns": p} for k, s, e, v, p in seen]))
        return pd.DataFrame(rows, columns=["base", "seen"])

    return id_text(docs).select("doc_id", run.asNondeterministic()("text").alias("f")).select("doc_id", "f.*")


def bootstrap(
    seen: DataFrame, work: str, rounds: int = ROUNDS, least_confidence: float = LEAST_CONFIDENCE, least_seeds: int = LEAST_SEEDS, prior: float = PRIOR
) -> DataFrame:
    """(pattern, kind, confidence, times) of the patterns that may discover, from (kind, value, patterns) occurrences."""
    edges = seen.select("kind", "value", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("times"))
    edges = stored(edges, f"{work}/edges")
    total = max(1, edges.count())
    score = edges.groupBy("value").agg(F.when(F.max("kind").isNotNull(), 1.0).otherwise(0.0).alias("score"), F.count(F.lit(1)).alias("degree"))
    score = stored(score, f"{work}/score0")
    confidence = None
    for nth in range(1, rounds + 1):
        scored = join_classes(edges, score, "value", "degree", total).drop("degree")
        confidence = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + F.lit(prior))).alias("confidence"),
            F.count("kind").alias("seeds"), F.mode("kind", True).alias("kind"), F.count(F.lit(1)).alias("values"), F.sum("times").alias("times"))
        confidence = stored(confidence, f"{work}/confidence{nth}")
        if nth == rounds:
            break
        sure = confidence.where(F.col("seeds") >= least_seeds).select("pattern", "confidence", "values")
        back = join_classes(edges, sure, "pattern", "values", total)
        doubt = F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1 - 1e-9))))
        score = back.groupBy("value").agg(
            F.when(F.max("kind").isNotNull(), 1.0).otherwise(1 - F.exp(doubt)).alias("score"), F.count(F.lit(1)).alias("degree"))
        score = stored(score, f"{work}/score{nth}")
    return confidence.where((F.col("confidence") >= least_confidence) & (F.col("seeds") >= least_seeds)).select("pattern", "kind", "confidence", "times")


def find(docs: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, base, extra) for every row: base spans and discovered spans, arrays of struct(kind, start, end)."""
    work = shared_dir(docs.sparkSession)
    rows = stored(extract(docs).withColumn("row", F.monotonically_increasing_id()), f"{work}/rows")
    seen = rows.where(F.size("seen") > 0).select("row", F.inline("seen"))
    sure = stored(bootstrap(seen.select("kind", "value", "patterns"), work, **limits), f"{work}/sure")
    own = seen.where(F.col("kind") == "secret").select("row", "kind", "start", "end")
    unseen = seen.where("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    total = max(1, rows.agg(F.sum(F.size("seen"))).first()[0] or 0)
    hits = join_classes(unseen, sure, "pattern", "times", total).where("kind is not null")
    best = hits.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    every = best.select("row", "kind", "start", "end").unionByName(own)
    extra = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("extra"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.join(extra, "row", "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def report(docs: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra, n_spans) for every row; n_email to n_phone are of base spans."""

    def joined(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, ALL_KINDS)), s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    f = find(docs, **limits)
    counts = [count(k) for k in KINDS]
    return f.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_extra"), F.size(F.concat("base", "extra")).cast("long").alias("n_spans"))
