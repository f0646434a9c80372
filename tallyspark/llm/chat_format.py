"""Chat formatting by a grammar round trip: turns are rendered, parsed again, compared, and escaped until nothing is lost.

A template gives each role the marker that opens its turn and the one that closes it. The grammar is that of a conversation
as a sequence of turns: at its start state a parser expects an opening marker, inside a turn it reads text up to the turn's
own closing marker, and any other marker there is an error. It is deterministic, and a rendered turn that parses leads from
the start state back to it, so turns may be rendered, parsed and compared one by one, in any task, and a conversation parses if
its turns do.

What a text contains may look like a marker. An escape is a backslash behind the first character of what looks like one; the
parser takes one off wherever a marker has any. A text is rendered plainly first. Where the parse differs from the source, what
is at fault is escaped and the turn is parsed again, until source and parse are identical; so only conflicting texts change,
those that look escaped already among them.

Conversations come out as pieces, a row for each turn with its place in the formatted text and the place of what is learned
from (the texts of assistant turns), so no conversation is ever gathered; `joined` puts pieces together where one string is
wanted. Turns are sorted by conversation and read as a stream, for the output and for reading it back.

Defined results: turns are ordered by turn (nulls first), then role and text; null roles and texts count as empty; rows that
repeat are turns of their own; a null conv_id is a conversation. Roles without markers of their own are written out inside
their turn. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Opening and closing markers by role; `other` has those of any other role: before its name, between name and text, after it."""

    roles: tuple[tuple[str, str, str], ...] = (("user", "[INST] ", " [/INST]"), ("assistant", "<s>", "</s>"), ("system", "<<SYS>>\n", "\n<</SYS>>\n"))
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if any(len(m) < 2 or ESCAPE in m for m in self.markers):
            raise ValueError("a marker has at least two characters and no escape")

    @functools.cached_property
    def markers(self) -> tuple[str, ...]:
        """What must not stand in a text: all markers without the space around them, longest first."""
        every = {m.strip() for _, *pair in self.roles for m in pair} | {m.strip() for m in self.other}
        return tuple(sorted(every, key=lambda m: (-len(m), m)))

    @functools.cached_property
    def lookalike(self) -> re.Pattern:
        """A marker with any number of escapes behind its first character."""
        return re.compile("|".join(f"{re.escape(m[0])}(?:{re.escape(ESCAPE)})*{re.escape(m[1:])}" for m in self.markers))


class NotInGrammar(ValueError):
    """A text that isn't a sequence of turns."""


@dataclass(frozen=True)
class Turn:
    """A parsed turn: its role and text without escapes, and where its (escaped) text begins and ends."""

    role: str
    text: str
    start: int
    end: int
    stop: int


def _text(template: Template, data: str, start: int, closing: str) -> tuple[str, int]:
    """The text from start on up to the closing marker, without escapes, and where that marker begins."""
    at, out = start, []
    core = closing.strip()
    lead = closing.index(core)
    for m in template.lookalike.finditer(data, start):
        found = m.group()
        if found == core and m.start() - lead >= at and data.startswith(closing, m.start() - lead):
            out.append(data[at : m.start() - lead])
            return "".join(out), m.start() - lead
        if found[1] != ESCAPE:
            raise NotInGrammar(f"{found!r} at {m.start()}")
        out += [data[at : m.start() + 1], found[2:]]
        at = m.end()
    raise NotInGrammar(f"no {core!r} from {start} on")


def parse(template: Template, data: str) -> list[Turn]:
    """The turns of a formatted text; NotInGrammar if it has other things in it."""
    at, out = 0, []
    while at < len(data):
        for role, opening, closing in template.roles:
            if data.startswith(opening, at):
                start = at + len(opening)
                break
        else:
            opening, between, closing = template.other
            if not data.startswith(opening, at):
                raise NotInGrammar(f"no turn begins at {at}")
            role, end = _text(template, data, at + len(opening), between)
            start = end + len(between)
        text, end = _text(template, data, start, closing)
        at = end + len(closing)
        out.append(Turn(role, text, start, end, at))
    return out


def _core(lookalike: str) -> str:
    return lookalike[0] + lookalike[1:].lstrip(ESCAPE)


def escaped(template: Template, text: str, markers: set[str]) -> str:
    """text with one more escape in whatever looks like one of these markers."""
    return template.lookalike.sub(lambda m: m.group()[0] + ESCAPE * (_core(m.group()) in markers) + m.group()[1:], text)


def written(template: Template, role: str, text: str) -> str:
    """A turn with its markers."""
    for known, opening, closing in template.roles:
        if role == known:
            return opening + text + closing
    opening, between, closing = template.other
    return opening + role + between + text + closing


def render(template: Template, role: str, text: str) -> tuple[str, Turn, int]:
    """A turn as the template writes it, as it is parsed again, and how often it had to be rendered.

    While the parse differs from the source, the marker that the first unescaped lookalike of the source stands for (where the
    two part) is escaped in all places of that field. There are few markers, so this ends after as many rounds.
    """
    own = {r for r, *_ in template.roles}
    conflicts: tuple[set[str], set[str]] = (set(), set())
    rounds = 1
    while True:
        name = role if role in own else escaped(template, role, conflicts[0])
        piece = written(template, name, escaped(template, text, conflicts[1]) if conflicts[1] else text)
        try:
            turns = parse(template, piece)
        except NotInGrammar:
            turns = []
        if len(turns) == 1 and (turns[0].role, turns[0].text) == (role, text):
            return piece, turns[0], rounds
        fields = ((n, x) for n, x in enumerate((role, text)) if n or role not in own)
        first = next(((n, core) for n, x in fields for m in template.lookalike.finditer(x) if (core := _core(m.group())) not in conflicts[n]), None)
        if first is None:
            raise ValueError(f"the template can't hold a turn of role {role!r}: its markers run into each other")
        conflicts[first[0]].add(first[1])
        rounds += 1


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), each conversation's rows together and in order."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


PIECE = "nth long, piece string, start long, learn_start long, learn_end long, rounds int"


def pieces(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, nth, piece, start, learn_start, learn_end, rounds): a row for each turn, in order within its conversation.

    Joined by nth from 0 the pieces of a conversation are its formatted text. start is where a piece begins in it, learn_start
    and learn_end bound what is learned from (null for turns that are not); all count code points.
    """
    small_batches(conversations.sparkSession)
    rows = turns_in_order(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nth, at = (), 0, 0
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now != (conv,):
                    now, nth, at = (conv,), 0, 0
                piece, turn, rounds = render(template, role, text)
                learn = (at + turn.start, at + turn.end) if role in template.learned else (None, None)
                out.append((nth, piece, at, *learn, rounds))
                nth += 1
                at += len(piece)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            arrays = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *arrays], names=["conv_id", "nth", "piece", "start", "learn_start", "learn_end", "rounds"])

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {PIECE}")


def joined(out: DataFrame) -> DataFrame:
    """(conv_id, text, spans): one string for each conversation, and the stretches to learn from; for conversations that fit in memory."""
    parts = F.sort_array(F.collect_list(F.struct("nth", "piece", "learn_start", "learn_end")))
    g = out.groupBy("conv_id").agg(parts.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["learn_start"].isNotNull()), lambda x: F.struct(x["learn_start"].alias("start"), x["learn_end"].alias("end")))
    return g.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), spans.alias("spans"))


def read_back(out: DataFrame, template: Template = Template(), in_order: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, max_rounds) of formatted pieces, by parsing them.

    Whether a piece is learned from is read from its mask, not from its role. in_order: the rows come as `pieces` gives them.
    """
    if not in_order:
        out = out.repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    kind = out.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
        for b in batches:
            id_type = b.schema.field("conv_id").type
            columns = (b.column(c).to_pylist() for c in ("conv_id", "piece", "start", "learn_start", "learn_end", "rounds"))
            for conv, piece, start, a, z, rounds in zip(*columns):
                if now is None or now.conv != conv:
                    done += [now.result()] if now else []
                    now = _Reading(conv)
                now.read(parse(template, piece), piece, start, a, z, rounds)
            if done:
                yield batch(done, id_type)
                done = []
        if now:
            yield batch([now.result()], id_type)

    def batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "max_rounds"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return out.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, max_rounds int")


class _Reading:
    """Digests of one conversation as its pieces come by."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.rounds = 0

    def read(self, turns: list[Turn], piece: str, start: int, learn_start: int | None, learn_end: int | None, rounds: int) -> None:
        for t in turns:
            self.n += 1
            self.turns.update(f"{t.role}\n{t.text}\n".encode("utf-8", "surrogatepass"))
            # of a turn's text what lies under the mask: texts are masked whole, so escapes are never cut
            if learn_start is not None and learn_start <= start + t.start and start + t.end <= learn_end:
                self.loss_chars += len(t.text)
                self.loss.update(t.text.encode("utf-8", "surrogatepass"))
        self.chars += len(piece)
        self.rounds = max(self.rounds, rounds)

    def result(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rounds)


def report(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """The digests of `read_back` for a table of (conv_id, turn, role, text)."""
    return read_back(pieces(conversations, template), template, in_order=True)
