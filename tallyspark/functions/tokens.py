"""Column functions over texts, token entries and usage fields."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A partition of any text into tokens that SQL engines agree on.
TOKEN_PATTERN = r"\p{L}+|\p{N}|[^\p{L}\p{N} \n]+| |\n"
#: Billing text between reasoning and answer, by format (fixed values).
REASONING = {
    "harmony": ("assistant<|channel|>analysis<|message|>", "<|end|><|start|>assistant<|channel|>final<|message|>"),
    "gemma_thinking": ("<|channel>thought\n", "\n<channel|>"),
    "think_tags": ("<think>", "</think>"),
    "glm_thinking": ("<think>", "</think>"),
}
#: Letters of each script that has a bucket of its own (fixed ranges); all other letters are latin.
SCRIPTS = {
    "cjk": r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}&&\p{L}]",
    "devanagari": r"[\x{0900}-\x{097F}&&\p{L}]",
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}&&\p{L}]",
    "cyrillic": r"[\x{0400}-\x{04FF}&&\p{L}]",
}


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("long")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def script_bucket(text: Column) -> Column:
    """Dominant script of the letters; of equally frequent ones the script seen first; none without letters."""
    patterns = SCRIPTS | {"latin": r"[\p{L}&&[^\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{0900}-\x{097F}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{0400}-\x{04FF}]]"}
    letters = lambda p: F.char_length(F.array_join(F.regexp_extract_all(text, F.lit(f"{p}+"), F.lit(0)), ""))
    ranked = F.array_max(F.array(*[
        F.struct(
            letters(p).alias("n"), (-F.regexp_instr(text, F.lit(p))).alias("first"), F.lit(name).alias("name"))
        for name, p in patterns.items()]))
    # most texts have one script, which a look for any other tells
    alone = ~F.rlike(text, F.lit("[" + "".join(p[1:].removesuffix("&&\\p{L}]") for p in SCRIPTS.values()) + "&&\\p{L}]"))
    latin = F.when(F.rlike(text, F.lit(r"\p{L}")), F.lit("latin")).otherwise(F.lit("none"))
    return F.when(alone, latin).when(ranked["n"] > 0, ranked["name"]).otherwise(F.when(text.isNotNull(), F.lit("none")))


def system_hash(messages: Column) -> Column:
    """First 16 hex digits of the SHA-256 of system and developer contents, joined by newlines; null if that is empty."""
    kept = F.filter(messages, lambda m: m["role"].isin("system", "developer"))
    text = F.array_join(F.transform(kept, lambda m: F.coalesce(m["content"], F.lit("None"))), "\n")
    return F.when(text != "", F.left(F.sha2(text, 256), F.lit(16)))


def effective_finish(billed: Column, finish_reason: Column, max_tokens: Column) -> Column:
    """A response billed exactly at its cap was cut, whatever its label says."""
    return F.when((billed == max_tokens) & (finish_reason == "stop"), F.lit("length")).otherwise(finish_reason)


def reconstructed(reasoning: Column, text: Column, fmt: Column) -> Column:
    """What a faithful provider tokenizes: reasoning and answer with the format's markers; the second only before an answer."""
    out = F.concat(reasoning, text)
    for name, (opening, closing) in REASONING.items():
        full = F.when(text != "", F.concat(F.lit(opening), reasoning, F.lit(closing), text)).otherwise(F.concat(F.lit(opening), reasoning))
        out = F.when(fmt == name, full).otherwise(out)
    return F.when(F.coalesce(reasoning, F.lit("")) == "", text).otherwise(out)


def appends_eos(fmt: Column, append_eos: Column, finish_reason: Column, has_eos: Column | bool = True) -> Column:
    """Whether an end token is billed: only after a natural stop and if the tokenizer has one, by the cell's override or else the format's rule."""
    rule = F.coalesce(append_eos, ~fmt.isin(*REASONING))
    return F.coalesce((finish_reason == "stop") & rule & has_eos, F.lit(False))


def canonical_count(
    reasoning: Column, text: Column, fmt: Column, append_eos: Column, finish_reason: Column, has_eos: Column | bool = True, count: Callable[[Column], Column] = token_count
) -> Column:
    """Tokens that a faithful provider bills; `count` counts those of a text (functions.bpe has real tokenizers)."""
    return count(reconstructed(reasoning, text, fmt)) + appends_eos(fmt, append_eos, finish_reason, has_eos).cast("long")


def entry_bytes(entry: Column) -> Column:
    """Bytes of a token entry: its bytes field, else an escaped `bytes:` token, else the token's UTF-8."""
    token = F.coalesce(entry["token"], F.lit(""))
    field = F.unhex(F.array_join(F.transform(entry["bytes"], lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), ""))
    hexes = F.regexp_extract_all(token, F.lit(r"\\x([0-9a-fA-F]{2})"), F.lit(1))
    plain = F.split(F.substring(token, 7, 2**30), r"\\x[0-9a-fA-F]{2}", -1)
    parts = F.transform(plain, lambda p, i: F.concat(F.hex(F.encode(p, "UTF-8")), F.coalesce(F.get(hexes, i), F.lit(""))))
    mixed = F.unhex(F.array_join(parts, ""))
    escaped = F.when(F.rlike(token, F.lit(r"^bytes:(?:\\x[0-9a-fA-F]{2})*+\z")), F.unhex(F.replace(F.substring(token, 7, 2**30), F.lit("\\x"), F.lit("")))).otherwise(mixed)
    return F.coalesce(field, F.when(F.startswith(token, F.lit("bytes:")), escaped).otherwise(F.encode(token, "UTF-8")))


def identity_overhead(reasoning_tokens: Column) -> Column:
    """Structural tokens billed around reasoning and answer: 9 with reasoning, 3 without (fixed values)."""
    return F.when(reasoning_tokens > 0, F.lit(9)).otherwise(F.lit(3)).cast("long")


def calibration_key(model: Column, language: Column) -> Column:
    return F.concat_ws("|", model, language)


def shell_regex(pattern: str) -> str:
    """An anchored expression for a shell pattern with * ? and [...]; what doesn't make a class stands for itself."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        k = i + (pattern[i : i + 1] == "!")
        end = pattern.find("]", k + 1) if c == "[" else -1  # the first character of a class may be ]
        if end > 0:
            body, items = pattern[k:end], ""
            while body:
                n = 3 if body[1:2] == "-" and len(body) > 2 else 1
                low, high, body = body[0], body[n - 1], body[n:]
                items += f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}" if low <= high else ""
            inverse = k > i
            out += f"[{'^' * inverse}{items}]" if items else "." if inverse else "(?!)"
            i = end + 1
        else:
            out += ".*" if c == "*" else "." if c == "?" else f"\\x{{{ord(c):x}}}"
    return f"^(?s:{out})\\z"


def glob_regex(pattern: Column) -> Column:
    """A case-insensitive expression for each of a few shell patterns, to be held against lower-cased names."""

    @F.pandas_udf("string")
    def translate(patterns: pd.Series) -> pd.Series:
        return patterns.map(shell_regex, na_action="ignore")

    return translate(F.lower(pattern))


def literal_length(pattern: Column) -> Column:
    return F.length(F.regexp_replace(pattern, "[*?]", ""))
