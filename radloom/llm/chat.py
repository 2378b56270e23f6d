"""Chat formatting with a grammar round trip.

The template of a turn is ``### role: text </turn>`` and a line feed; a conversation is its turns in order:

    conversation = { "### ", role, ": ", text, " </turn>\\n" }

:class:`Reader` parses that grammar deterministically, chunk by chunk.  A turn is first rendered as it is,
parsed again and compared with its source; a field that comes back otherwise is escaped, until the turn comes
back identical.  So only content that conflicts with the template is changed, by a backslash before it, and the
reader takes those backslashes away.  Where a turn ends depends on its own characters alone, hence turns that
come back one by one also come back in sequence.

The formatted output is a table of parts, one a turn, whose concatenation in order is the conversation's text;
each has the span of its loss mask.  So a conversation of any length is formatted by many tasks and read back
as a stream; nothing holds a whole one but :func:`assembled`, for conversations known to fit a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
#: Roles whose text carries loss.
LEARNED = ("assistant",)

# A backslash is doubled only where the reader would take it for an escape.
_TEXT_CONFLICT = re.compile(r"\\(?=[\\#<:])|#(?=## )|<(?=/turn>)")
_ROLE_CONFLICT = re.compile(r"\\(?=[\\#<:]|\Z)|#(?=## )|<(?=/turn>)|:")
_ESCAPED = re.compile(r"\\([\\#<:])")
_END = re.compile(r"(?<!\\)</turn>")
_START = re.compile(r"(?<!\\)### ")
_ROLE_END = re.compile(r"(?<!\\)(?:\\\\)*(: )")


class GrammarError(ValueError):
    """The text is not of the grammar."""


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONFLICT if role else _TEXT_CONFLICT).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Reader:
    """The parser: takes chunks, gives (role, text, place of the raw text, raw text) per finished turn; places count from the first chunk."""

    def __init__(self):
        self.rest, self.at, self.seen = "", 0, 0

    def feed(self, chunk: str) -> Iterator[tuple[str, str, int, str]]:
        self.rest += chunk
        while (end := _END.search(self.rest, self.seen)) is not None:
            if end.end() == len(self.rest):
                break  # its line feed is still to come
            yield self._turn(end.start())
        else:
            self.seen = max(0, len(self.rest) - len(CLOSE))

    def _turn(self, end: int) -> tuple[str, str, int, str]:
        turn = self.rest[:max(0, end - 1)]
        colon = _ROLE_END.search(turn, len(OPEN))
        if not turn.startswith(OPEN) or colon is None or self.rest[end - 1:end + len(CLOSE) - 1] != CLOSE or _START.search(turn, len(OPEN)):
            raise GrammarError(turn[:80])
        raw, start = turn[colon.end():], self.at + colon.end()
        role = turn[len(OPEN):colon.start(1)]
        length = end - 1 + len(CLOSE)
        self.rest, self.at, self.seen = self.rest[length:], self.at + length, 0
        return unescape(role), unescape(raw), start, raw

    def close(self) -> None:
        if self.rest:
            raise GrammarError(self.rest[:80])


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    reader = Reader()
    turns = [(role, body) for role, body, _, _ in reader.feed(text)]
    reader.close()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the reader gives it back identically, with the start and end of its text in it."""
    fields = [role, text]
    while True:
        part = OPEN + fields[0] + COLON + fields[1] + CLOSE
        try:
            got = parse(part)
        except GrammarError:
            got = []
        if got == [(role, text)]:
            start = len(OPEN) + len(fields[0]) + len(COLON)
            return part, start, start + len(fields[1])
        # What came back otherwise is escaped; where no single turn came back, the text first, as it may hold an end.
        escaped = [escape(role, role=True), escape(text)]
        if fields == escaped:
            raise GrammarError(part[:80])
        wrong = [len(got) == 1 and got[0][0] != role, len(got) != 1 or got[0][1] != text]
        if [f for f, w in zip(fields, wrong) if w] == [e for e, w in zip(escaped, wrong) if w]:
            wrong = [True, True]
        fields = [e if w else f for f, e, w in zip(fields, escaped, wrong)]


def format_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """The formatted output: ``conversation``, ``turn``, ``part``, ``loss_start`` and ``loss_end`` (code points within the part, null without loss).

    Rows are independent.  A null text or role is an empty one; other columns, of any name, are left out.
    """
    schema = StructType([StructField("conversation", df.schema[key].dataType), StructField("turn", df.schema[turn].dataType),
                         StructField("part", StringType()), StructField("loss_start", LongType()), StructField("loss_end", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, starts, ends = [], [], []
            for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                part, start, end = render(r or "", t or "")
                loss = r in learned
                parts.append(part)
                starts.append(start if loss else None)
                ends.append(end if loss else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=schema.names)

    return df.select(F.col(f"`{key}`").alias("conversation"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"),
                     F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


class _Digest:
    """What is read back of one conversation."""

    def __init__(self):
        self.reader, self.turns, self.chars, self.loss_chars = Reader(), 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, part: str, start: int | None, end: int | None) -> None:
        mask = (self.chars + start, self.chars + end) if start is not None else None
        self.chars += len(part)
        for role, text, place, raw in self.reader.feed(part):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if mask is not None and (place, place + len(raw)) != mask:
                raise GrammarError("the loss mask is not the text of its turn")
        if mask is not None:
            learned = unescape(part[start:end])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def row(self) -> tuple:
        self.reader.close()
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, read from its parts in order: ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    ``turns_sha256`` is over role, line feed, text, line feed of every turn; ``loss_sha256`` over the unescaped
    text under the loss mask.  Turns of one number are taken in the order of their parts, null turns first; a null conversation is one
    of its own.  The rows of a conversation pass through one task as a sorted stream, a batch at a time.
    """
    schema = StructType([StructField("conversation", parts.schema["conversation"].dataType), StructField("n_turns", LongType()),
                         StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
                         StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_one, done = None, None, []

        def rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind)] + [pa.array(c, pa.string() if i in (1, 3) else pa.int64()) for i, c in enumerate(columns[1:])], names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for k, part, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if open_one is None or k != key:
                    if open_one is not None:
                        done.append((key, *open_one.row()))
                    key, open_one = k, _Digest()
                open_one.feed(part, start, end)
            if done:
                yield rows(done, kind)
                done = []
        if open_one is not None:
            yield rows([(key, *open_one.row())], kind)

    ordered = parts.repartition("conversation").sortWithinPartitions("conversation", "turn", "part")
    return ordered.select("conversation", "part", "loss_start", "loss_end").mapInArrow(run, schema)


def assembled(parts: DataFrame) -> DataFrame:
    """``conversation``, ``formatted`` and ``loss_spans`` (start and end in it), for conversations that fit a row."""
    before = F.sum(F.length("part")).over(Window.partitionBy("conversation").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.withColumn("at", F.coalesce(before, F.lit(0)))
    turns = F.array_sort(F.collect_list(F.struct("at", "part", "loss_start", "loss_end")))
    spans = F.transform(F.filter("turns", lambda t: t["loss_start"].isNotNull()),
                        lambda t: F.struct((t["at"] + t["loss_start"]).alias("start"), (t["at"] + t["loss_end"]).alias("end")))
    return placed.groupBy("conversation").agg(turns.alias("turns")).select(
        "conversation", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), spans.alias("loss_spans"))
