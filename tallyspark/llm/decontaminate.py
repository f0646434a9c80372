"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Training words are streamed through the automaton, which tracks the longest suffix that is a substring of some item.
A window is `window` consecutive words of an item (a shorter, non-empty item is one window); every word inside an
occurrence is hit. `clean` removes hit spans, or whole documents whose hit share passes a limit.

Items are cut into overlapping segments, dealt over blocks of about `block_words` words and built into one automaton a
block by Spark tasks. Blocks are stored in the shared folder and broadcast one by one (a few MB each, bounded by
`block_words`); a task applies them one after another to each batch of texts. PASS_BLOCKS blocks at most travel at once:
more take further passes over the rows, which carry what was found so far along. What is found never depends on the
number of blocks. Only the text goes through Python: identifiers and other columns stay where they are, so they may be
null, repeated or of any size, and no row is joined to anything.

Defined results: null or empty text has no words and no hits; items without words are ignored; an empty benchmark hits
nothing; repeated items count by their item_id; an item without item_id hits words but is not listed; the longest match
is measured within segments; columns of any name pass through `clean` unchanged.
"""

from __future__ import annotations

import marshal
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RAW_WORD, WORD_BYTES, packed, small_batches, stored, words_of

WINDOW = 10
#: Words of items in one automaton, about: some 20 MB in a task, 3 MB when broadcast.
BLOCK_WORDS = 100_000
#: Windows that start in one segment of a long item.
SEGMENT = 10_000
#: Blocks that are broadcast at once, and that a task keeps decoded.
PASS_BLOCKS, HELD_BLOCKS = 16, 4


class SuffixAutomaton:
    """States have `length`, suffix `link` and transitions by word number; segments are added one after another."""

    def __init__(self, window: int):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        self.words: dict[bytes, int] = {}
        self.added: list[tuple[str | None, list[int]]] = []

    def add(self, item_id: str | None, words: list[bytes]) -> None:
        ids = [self.words.setdefault(w, len(self.words)) for w in words]
        last = 0
        for c in ids:
            last = self._extend(last, c)
        self.added.append((item_id, ids))

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def encoded(self) -> bytes:
        """Plain numbers for the tasks, with one table of transitions. home: the state of a match's last `window` words;
        held: the items that have the window of such a state; short: those below the window, by their word numbers."""
        window, link, length = self.window, self.link, self.length
        home = [0] * len(length)
        for s in sorted(range(1, len(length)), key=length.__getitem__):  # a link is shorter than its state
            home[s] = home[link[s]] or (s if length[s] >= window else 0)
        held: dict[int, set] = {}
        short: dict[tuple[int, ...], set] = {}
        for item, ids in self.added:
            if len(ids) < window:
                short.setdefault(tuple(ids), set()).add(item)
            state = 0
            for n, c in enumerate(ids, 1):
                state = self.next[state][c]
                if n >= window:
                    held.setdefault(home[state], set()).add(item)
        to = {s << 32 | c: t for s, after in enumerate(self.next) for c, t in after.items()}
        numbers = [array("q", x).tobytes() for x in (link, length, home)]
        lists = {k: sorted(x for x in v if x is not None) for k, v in held.items()}
        return marshal.dumps((self.words, to, *numbers, lists, {k: sorted(x for x in v if x is not None) for k, v in short.items()}, window))


class Scanner:
    """A decoded block."""

    def __init__(self, data: bytes):
        self.number, self.to, link, length, home, self.held, self.short, self.window = marshal.loads(data)
        self.link, self.length, self.home = (array("q", x) for x in (link, length, home))
        self.ends = sorted({len(k) for k in self.short})

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (start, end exclusive) by end, items with occurring windows, and the longest match."""
        to, link, length, number, window, ends = self.to, self.link, self.length, self.number, self.window, self.ends
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = longest = 0
        ids = [number.get(w, -1) for w in words]
        for i, c in enumerate(ids):
            if c < 0:
                state = matched = 0
                continue
            t = to.get(state << 32 | c)
            while t is None:  # the root has a transition for every word of an item
                state = link[state]
                matched = length[state]
                t = to.get(state << 32 | c)
            state = t
            matched += 1
            if matched > longest:
                longest = matched
            for n in ends:
                if n <= matched and (held := self.short.get(tuple(ids[i + 1 - n : i + 1]))) is not None:
                    items.update(held)
                    spans.append((i + 1 - n, i + 1))
            if matched >= window:
                items.update(self.held[self.home[state]])
                if spans and spans[-1][0] <= i + 1 - window <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i + 1 - window, i + 1))
        return spans, items, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlaps, in order; touching ones are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """(block, data), stored: one automaton for every `block_words` words of items, about."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    words = b.agg(F.sum(F.regexp_count("text", F.lit(RAW_WORD)))).first()[0] or 0
    n = max(1, -(-words // block_words))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for item, text in zip(x["item_id"], x["text"]):
                w = words_of(text)
                starts = range(0, max(1, len(w) - window + 1), SEGMENT) if w else []
                rows = [(item, nth, b" ".join(w[s : s + SEGMENT + window - 1])) for nth, s in enumerate(starts)]
                yield pd.DataFrame(rows, columns=["item_id", "nth", "words"])

    def build(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton(window)
        for item, _, w in sorted(zip(x["item_id"], x["nth"], x["words"]), key=lambda r: (r[0] or "", r[1], r[2])):
            automaton.add(item, w.split(b" "))
        return pd.DataFrame({"block": [key[0]], "data": [automaton.encoded()]})

    parts = b.mapInPandas(cut, "item_id string, nth long, words binary")
    parts = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "nth", "words"), F.lit(n)))
    return stored(parts.groupBy("block").applyInPandas(build, "block long, data binary"))


SPANS = "array<struct<start:long,end:long>>"


def searched(rows: DataFrame, text: Column, benchmark: DataFrame, window: int, block_words: int, cut: bool = False) -> DataFrame:
    """rows with `found`: struct(n_words, longest, spans, items, share, text), a row at a time.

    share is the share of hit words; text is the text without them, if `cut` and there are some, else null.
    """
    small_batches(rows.sparkSession)
    blocks = blocks_of(benchmark, window, block_words)
    numbers = sorted(r[0] for r in blocks.select("block").collect())  # a number for each block
    passes = [numbers[at : at + PASS_BLOCKS] for at in range(0, len(numbers), PASS_BLOCKS)] or [[]]
    found = None
    for of in passes:
        data = blocks.where(F.col("block").isin(of)).select("data").toLocalIterator()
        held = [rows.sparkSession.sparkContext.broadcast(bytes(r[0])) for r in data]
        last = of is passes[-1]
        # not deterministic for the optimizer's eyes only, so that it never evaluates the search twice
        search = F.pandas_udf(_search(held, cut and last), f"n_words long, longest long, spans {SPANS}, items array<string>, share double, text string", F.PandasUDFType.SCALAR_ITER).asNondeterministic()
        before = found["spans"] if found is not None else F.lit(None).cast(SPANS)
        rows = rows.withColumn("_now", search(text, before))
        if found is not None:
            both = F.array_sort(F.array_union(F.col("found.items"), F.col("_now.items")))
            longest = F.greatest(F.col("found.longest"), F.col("_now.longest"))
            rows = rows.withColumn("_now", F.col("_now").withField("items", both).withField("longest", longest))
        rows = rows.drop("found").withColumnRenamed("_now", "found")
        rows, found = (rows if last else stored(rows)), F.col("found")
    return rows


def _search(held: list, cut: bool):  # noqa: ANN202
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        kept: dict[int, Scanner] = {}
        for texts, before in batches:
            results = [([(s["start"], s["end"]) for s in (b if b is not None else [])], set(), 0) for b in before]
            n_words = [0] * len(results)
            for k, block in enumerate(held or [None]):
                scanner = kept.get(k) or (Scanner(block.value) if block else None)
                if scanner and k < HELD_BLOCKS:
                    kept[k] = scanner
                for i, text in enumerate(texts):
                    words = words_of(text)
                    n_words[i] = len(words)
                    if scanner:
                        spans, items, longest = scanner.scan(words)
                        results[i] = (results[i][0] + spans, results[i][1] | items, max(results[i][2], longest))
            rows = []
            for text, n, (spans, items, longest) in zip(texts, n_words, results):
                spans = merged(spans)
                share = sum(e - s for s, e in spans) / max(1, n)
                rows.append((n, longest, [{"start": s, "end": e} for s, e in spans], sorted(items), share, without(text, spans) if cut and spans else None))
            yield pd.DataFrame(rows, columns=["n_words", "longest", "spans", "items", "share", "text"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, longest, spans, items) for every row: word spans hit, items that occur, longest match in words."""
    out = searched(docs.select("doc_id", "text"), F.col("text"), benchmark, window, block_words)
    return out.select("doc_id", "found.n_words", "found.longest", "found.spans", "found.items")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest) for every row."""
    f = find(docs, benchmark, window, block_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return f.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest",
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """docs without hit words: their spans are cut from the text, and rows whose hit share exceeds max_share are dropped.

    Text outside the spans stays as it is, down to the last byte; n_chars follows the new text where the column exists.
    """
    rows = searched(packed(docs), F.col("d")["text"], benchmark, window, block_words, cut=True)
    rows = rows.where(F.col("found.share") <= max_share)
    cut = F.col("found.text")
    new = {"text": F.coalesce(cut, F.col("d.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut.isNotNull(), F.char_length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
    return rows.select(*[new.get(c, F.col("d")[c]).alias(c) for c in docs.columns])


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words numbered in spans, nor what stands between those words."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(WORD_BYTES)
    bounds, at = [], 0
    for w in folded.split():
        at = folded.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at : bounds[start][0]])
        at = bounds[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
