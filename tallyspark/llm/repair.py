"""Conversation structure repair by a dynamic programme over a trie of role and fault signatures.

A conversation is reduced to a signature, one letter a row: whether the row has to go, and else the initial of its role, as a
capital if its text is cut off. Few distinct signatures stand for many conversations, so each is solved once. Signatures are
read from the last row back, range-partitioned and sorted; a task walks them in that order and keeps the path of the prefix
trie on which it stands, a layer of the programme for each letter. Signatures that share a prefix share its layers, so each
layer is computed once, and where a signature ends its answer is read off the path.

A layer holds, for each state of the role grammar `(s?(ua)+)?`, the least cost from there to the end of the conversation, and
the first letter of the ASCII-least of the cheapest audits. Costs are to the end, not from the start, because only so the
ASCII-least continuation of a state is independent of what came before it. In every state each edit leads to one next state,
so an audit says exactly what the repaired conversation is.

Texts are never gathered: faults are found with digests, and the repaired conversation is digested row by row from a sorted
stream. What is kept whole for a conversation is one letter a row, as its audit is by contract.

Defined results: rows of a conversation are ordered by turn (nulls first), then by a digest of role and text, which tells rows
of one turn apart (equal rows are interchangeable). Null roles and texts count as one space, a null conv_id or turn too where
damage is drawn. A null conv_id is a conversation of its own. A role whose initial is none of s, u, a, or
that is empty, can't be kept.
Conversations without rows have zeros, an empty audit and the digest of the empty string. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_classes, small_batches, stored

#: What counts as no content: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State that a user or assistant row leads to: what Rerole and Insert make is settled by the state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FINAL = (START, ASSISTANT)
NEVER = 1 << 60
#: Letters of a signature: a row that must be deleted, and others by initial; `o` is any other initial.
MUST_GO = "x"

Layer = tuple[tuple[int, ...], str]


def kept_in(state: int, initial: str) -> int | None:
    """The state that keeping a row leads to, if the grammar has it there."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if NEXT[state] == ASSISTANT else "u") else None


def with_inserts(costs: list[int], edits: list[str]) -> Layer:
    """A layer from the costs and first edits that insert nothing here: at most two rows are inserted in a row.

    An empty edit stands for the end. Of equal costs the letter that comes first in ASCII wins.
    """
    whole = list(costs)
    for _ in range(2):
        whole = [min(c, INSERT + whole[NEXT[q]]) for q, c in enumerate(whole)]
    first = "".join(min([e or " "] * (costs[q] == whole[q]) + ["I"] * (INSERT + whole[NEXT[q]] == whole[q])) for q, e in enumerate(edits))
    return tuple(whole), first


#: The layer at the end of every conversation.
END: Layer = with_inserts([0 if q in FINAL else NEVER for q in range(4)], [""] * 4)


def layer(letter: str, after: Layer) -> Layer:
    """The layer in front of a row, given the one behind it."""
    then, costs, edits = after[0], [], []
    cut = CUT_OFF if letter.isupper() else 0
    for q in range(4):
        options = [(DELETE + then[q], "D")]
        if letter != MUST_GO:
            options.append((REROLE + cut + then[NEXT[q]], "R"))
            to = kept_in(q, letter.lower())
            if to is not None:
                options.append((KEEP + cut + then[to], "K"))
        cost, edit = min(options)
        costs.append(cost)
        edits.append(edit)
    return with_inserts(costs, edits)


def audit_of(path: list[Layer], reverse: str) -> str:
    """Follows the first edits down the path, from the whole conversation to its end."""
    q, i, out = START, len(reverse), []
    while True:
        edit = path[i][1][q]
        if edit == " ":
            return "".join(out)
        out.append(edit)
        if edit == "I":
            q = NEXT[q]
            continue
        if edit == "K":
            q = kept_in(q, reverse[i - 1].lower())
        elif edit == "R":
            q = NEXT[q]
        i -= 1


def walk_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds cost and audit to sorted reversed signatures; the path stays from one signature and batch to the next."""
    path, last = [END], ""
    for batch in batches:
        costs, audits = [], []
        for reverse in batch.column("reverse").to_pylist():
            shared = len(os.path.commonprefix((last, reverse)))
            del path[shared + 1 :]
            for letter in reverse[shared:]:
                path.append(layer(letter, path[-1]))
            last = reverse
            costs.append(path[-1][0][START])
            audits.append(audit_of(path, reverse))
        yield batch.append_column("cost", pa.array(costs, pa.int64())).append_column("audit", pa.array(audits, pa.string()))


def solved(signatures: DataFrame) -> DataFrame:
    """Adds cost and audit to distinct signatures (reverse, ...), which are read from the last row back."""
    ordered = signatures.repartitionByRange("reverse").sortWithinPartitions("reverse")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(walk_trie, f"{kept}, cost long, audit string")


def plain_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one space for null roles and texts."""
    return conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after damage; a dropped row stays as one that is gone, so no conversation is lost."""
    rows = plain_rows(conversations)
    lot = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))), F.lit(20))
    text = F.when(lot == 1, "").when(lot == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(lot == 4, "user").otherwise(F.col("role"))
    times = F.when(lot == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (lot == 0).alias("gone"), F.explode(times).alias("_copy")).drop("_copy")


def digest() -> Column:
    """Digest of role and text; the role's length keeps the two apart."""
    return F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("digest")]


def diagnosed(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, reverse) of (conv_id, turn, role, text, gone).

    One shuffle, of digests and a few letters for each row; both windows and the sums use its partitioning.
    """
    ending = F.rtrim("text", F.lit(SPACE))
    last = F.substring(ending, -1, 1)
    slim = rows.select("conv_id", "turn", "gone", digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), (ending == "").alias("empty"), (~last.isin(".", "!", "?")).alias("cut"))
    slim = slim.withColumn("digest", F.when(~F.col("gone"), F.col("digest")))
    # rows that are gone come after the others, so that neighbours are neighbours
    w = Window.partitionBy("conv_id").orderBy("gone", *in_order())
    slim = slim.withColumns({
        "nth": F.row_number().over(w), "before": F.lag("initial").over(w),
        "new_turn": F.coalesce(F.col("turn") != F.lag("turn").over(w), F.col("turn").isNotNull())})
    slim = slim.withColumn("first", F.min("nth").over(Window.partitionBy("conv_id", "gone", "digest")))
    duplicate = ~F.col("empty") & (F.col("nth") > F.col("first"))
    truncated = ~F.col("empty") & (F.col("nth") == F.col("first")) & F.col("cut")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("empty") | duplicate, MUST_GO).otherwise(F.when(truncated, F.upper(initial)).otherwise(initial))
    here = ~F.col("gone")
    pair = F.concat(F.col("before"), F.col("initial"))
    slim = slim.select(
        "conv_id", "nth", F.when(here, letter).alias("letter"), F.when(here, F.col("turn")).alias("turn"), (here & F.col("new_turn")).alias("new_turn"), (here & F.col("empty")).alias("empty"),
        (here & duplicate).alias("duplicate"), (here & truncated).alias("truncated"), (here & F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"))

    def total(name: str) -> Column:
        return F.sum(F.col(name).cast("long"))

    span = F.max("turn") - F.min("turn") + 1 - total("new_turn")
    letters = F.sort_array(F.collect_list(F.when(F.col("letter").isNotNull(), F.struct("nth", "letter"))), asc=False)
    return slim.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), total("empty").alias("blank"), total("duplicate").alias("duplicate"), total("truncated").alias("truncated"),
        total("illegal").alias("illegal"), F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("reverse"))


#: What is known of a conversation before its rows are read again.
PLAN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def planned(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation of `damaged`.

    One signature may stand for a third of all conversations (the faultless short ones do): heavy ones are joined by broadcast.
    """
    seen = stored(diagnosed(rows))
    signatures = seen.groupBy("reverse").agg(F.count(F.lit(1)).alias("conversations"))
    answers = stored(solved(signatures))
    return join_classes(seen, answers, "reverse", "conversations", max(1, seen.count())).select("conv_id", *PLAN)


def edited(role_text: tuple[str, str] | None, edit: str, state: int) -> tuple[tuple[str, str] | None, int]:
    """The row that an edit leaves, if any, and the state after it."""
    if edit == "D":
        return None, state
    if edit == "K":
        return role_text, kept_in(state, role_text[0][:1])
    return (ROLE[NEXT[state]], role_text[1] if edit == "R" else ""), NEXT[state]


class _Repair:
    """One conversation as its rows come by: which edit is next, and the digest so far."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.n = audit, 0, START, hashlib.sha256(), 0

    def _put(self, row: tuple[str, str] | None) -> list[tuple[int, str, str]]:
        if row is None:
            return []
        self.digest.update(("\n" * (self.n > 0) + f"{row[0]}:{row[1]}").encode("utf-8", "surrogatepass"))
        self.n += 1
        return [(self.n - 1, *row)]

    def inserts(self) -> list[tuple[int, str, str]]:
        """Rows inserted before the next one, or at the end."""
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            row, self.state = edited(None, "I", self.state)
            self.at += 1
            out += self._put(row)
        return out

    def row(self, role: str, text: str) -> list[tuple[int, str, str]]:
        """(nth, role, text) that come out for this row, with those inserted before it."""
        out = self.inserts()
        row, self.state = edited((role, text), self.audit[self.at], self.state)
        self.at += 1
        return out + self._put(row)


def _stream(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows behind the plan of their conversation: (conv_id, is_row, turn, digest, role, text, ...plan), sorted by conversation."""
    r = rows.where("not gone").select("conv_id", F.lit(True).alias("is_row"), "turn", digest().alias("digest"), "role", "text")
    p = plans.select("conv_id", F.lit(False).alias("is_row"), *PLAN)
    both = r.unionByName(p, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *in_order())


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text): the rows of the repaired conversations, nth from 0."""
    small_batches(rows.sparkSession)
    s = _stream(rows, plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        conv, kind = None, pa.null()
        for b in batches:
            out, kind = [], b.schema.field("conv_id").type
            for c, is_row, role, text, audit in zip(*(b.column(x).to_pylist() for x in ("conv_id", "is_row", "role", "text", "audit"))):
                if is_row:
                    out += [(conv, *x) for x in now.row(role, text)]
                    continue
                if now:
                    out += [(conv, *x) for x in now.inserts()]
                now, conv = _Repair(audit), c
            yield _batch(out, kind)
        if now:
            yield _batch([(conv, *x) for x in now.inserts()], kind)

    return s.mapInArrow(run, f"conv_id {s.schema['conv_id'].dataType.simpleString()}, nth long, role string, text string")


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "nth", "role", "text"])


def digested(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): plans with the digest of the repaired `role:text` lines."""
    small_batches(rows.sparkSession)
    s = _stream(rows, plans)
    names = ["conv_id", *PLAN, "repaired_sha256"]
    kinds = ", ".join(f"{c} {s.schema[c].dataType.simpleString()}" for c in names[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        plan: pa.RecordBatch | None = None  # one row: the conversation that is open
        for b in batches:
            done, hashes = [], []
            given = (b.column(x).to_pylist() for x in ("is_row", "role", "text", "audit"))
            for i, (is_row, role, text, audit) in enumerate(zip(*given)):
                if is_row:
                    now.row(role, text)
                    continue
                if now:
                    now.inserts()
                    done.append(plan)
                    hashes.append(now.digest.hexdigest())
                now, plan = _Repair(audit), b.slice(i, 1).select(names[:-1])
            if done:
                yield _with(done, hashes)
        if now:
            now.inserts()
            yield _with([plan], [now.digest.hexdigest()])

    def _with(done: list[pa.RecordBatch], hashes: list[str]) -> pa.RecordBatch:
        t = pa.Table.from_batches(done).combine_chunks()
        return t.append_column("repaired_sha256", pa.array(hashes, pa.string())).combine_chunks().to_batches()[0]

    return s.mapInArrow(run, f"{kinds}, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) after damage, a row for each conv_id."""
    rows = damaged(conversations)
    return digested(rows, planned(rows))
