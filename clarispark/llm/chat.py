"""Chat formatting from event logs.

A log holds events of conversations: ``message`` opens a message, ``delta`` appends to it,
``edit`` replaces its text, ``regenerate`` drops it and all that came after it and opens it
anew, ``delete`` drops it.  Logs are partitioned by conversation and sorted by sequence, and a
streaming pass folds them into final messages and renders these.  Each event carries the first
message that a later event still touches, so the pass holds messages only from that one on.

Rendering marks turns with control strings; a control string inside a text gets a backslash
after its first character (one more if it has some), so reading back is exact.  The loss mask
covers the assistant's escaped texts.  ``read_back`` recovers turns and mask from the output.

Edge cases: a null text counts as empty; texts of any length are folded and rendered whole; a null
role is rendered as an empty name; a null conversation id is a conversation of its own; ties in
sequence are ordered by kind, role, text and message; repeated rows are turns each; an empty table
gives an empty result; other columns, whatever their names, are ignored.  An event for a message
that isn't open is left out, but for ``delta``, ``edit`` and ``regenerate``, which open it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarispark.llm.common import arrow_map, batch_of, slices

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}

_ESCAPE = re.compile(r"([<\[])(\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[/TURN\]", re.S
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's output, and where in it the loss mask begins and how long it is."""
    body = escape(text)
    head, tail = MARKS.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "[/TURN]")
    return head + body + tail, len(head), len(body) if role == "assistant" else 0


def read_back(output: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted output."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


EVENTS_SQL = "conv_id long, seq long, kind string, message long, role string, text string"
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("output", pa.string()), ("loss_from", pa.int64()), ("loss_length", pa.int64()), ("last", pa.bool_())])
TURNS_SQL = "conv_id long, turn long, role string, output string, loss_from long, loss_length long, last boolean"


class Fold:
    """The messages of one conversation while its events come in, in the order of their opening."""

    def __init__(self):
        self.messages: dict[object, tuple[str, list[str], int]] = {}

    def apply(self, kind: str, message, role: str, text: str, opened: int = 0) -> None:
        """``opened`` is the number of the message's first event."""
        if kind == "delete":
            self.messages.pop(message, None)
            return
        if kind == "regenerate" and message in self.messages:
            keys = list(self.messages)
            for key in keys[keys.index(message) :]:
                del self.messages[key]
        if kind in ("edit", "delta") and message in self.messages:
            own = self.messages[message]
            if kind == "edit":
                own[1].clear()
            own[1].append(text)
        else:
            self.messages[message] = (role, [text], opened)

    def final(self, touched: int | None) -> Iterator[tuple[str, str]]:
        """Takes out the first messages, as far as no later event touches them; ``touched``: the least ``opened`` of those that will be."""
        while self.messages:
            key, (role, parts, opened) = next(iter(self.messages.items()))
            if touched is not None and opened >= touched:
                return
            del self.messages[key]
            yield role, "".join(parts)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by conversation and event; a row per final turn."""
    conv, fold, n, held, out = None, None, 0, None, []

    def emit(turns: Iterator[tuple[str, str]]) -> None:
        nonlocal n, held
        for role, text in turns:
            if held is not None:
                out.append((*held, False))
            held = (conv, n, role, *render_turn(role, text))
            n += 1

    def close() -> None:
        nonlocal n, held
        emit(fold.final(None))
        if held is not None:
            out.append((*held, True))
        n, held = 0, None

    columns = ("conv_id", "kind", "message", "role", "text", "opened", "touched")
    for b in slices(batches, 512):
        for c, kind, message, role, text, opened, touched in zip(*(b.column(x).to_pylist() for x in columns), strict=True):
            if fold is None or c != conv:
                if fold is not None:
                    close()
                conv, fold = c, Fold()
            fold.apply(kind, message, role or "", text or "", opened)
            emit(fold.final(touched))
        if out:
            yield batch_of(TURNS, [list(x) for x in zip(*out, strict=True)])
            out.clear()
    if fold is not None:
        close()
    if out:
        yield batch_of(TURNS, [list(x) for x in zip(*out, strict=True)])


def format_events(events: DataFrame) -> DataFrame:
    """A row per final turn, in order within its conversation: conv_id, turn, role, output, loss_from, loss_length, last.

    A conversation's formatted text is its outputs joined, and its loss mask the spans of its rows.
    Events move once, by conversation; the windows need no other partitioning.
    """
    conv = Window.partitionBy("conv_id")
    log = events.select("conv_id", "seq", "kind", "message", "role", "text")
    log = log.withColumn("nth", F.row_number().over(conv.orderBy("seq", "kind", "role", "text", "message")))
    log = log.withColumn("opened", F.min("nth").over(Window.partitionBy("conv_id", "message")))
    later = conv.orderBy(F.desc("nth")).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("touched", F.min(F.when(F.col("opened") < F.col("nth"), F.col("opened"))).over(later))
    return arrow_map(log.sortWithinPartitions("conv_id", "nth").drop("seq", "nth"), _rendered, TURNS_SQL)


#: Deltas in which ``events_of`` logs a message that is streamed.
DELTAS = 4


def events_of(conversations: DataFrame) -> DataFrame:
    """The log that a chat server keeps of rows (conv_id, turn, role, text); equal rows are messages each.

    A user sends the beginning and edits it to the whole text; an assistant's message is opened
    empty, gets its first delta, is regenerated and then streamed in DELTAS parts; other roles
    send their text at once.
    """
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(own).cast("long")).withColumn("size", F.greatest(F.lit(1), F.ceil(F.length("text") / DELTAS)).cast("int"))
    part = lambda i: F.substring(F.col("text"), F.lit(1) + F.col("size") * i, F.col("size") if i < DELTAS - 1 else F.length("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    whole, none = F.col("text"), F.lit("")
    log = (
        F.when(F.col("role") == "user", F.array(event("message", part(0)), event("edit", whole)))
        .when(F.col("role") == "assistant", F.array(event("message", none), event("delta", part(0)), event("regenerate", none), *(event("delta", part(i)) for i in range(DELTAS))))
        .otherwise(F.array(event("message", whole)))
    )
    return rows.select("conv_id", "message", "role", F.posexplode(log).alias("step", "event")).select(
        "conv_id", (F.col("message") * 16 + F.col("step")).alias("seq"), "event.kind", "message", "role", "event.text")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGESTS_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a reader finds in the formatted output; hashes run over the turns, so no conversation is held."""
    turns, loss, n, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for b in batches:
        rows = []
        for conv, output, start, size, last in zip(*(b.column(x).to_pylist() for x in ("conv_id", "output", "loss_from", "loss_length", "last")), strict=True):
            for role, text in read_back(output):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            masked = unescape(output[start : start + size])
            loss.update(masked.encode("utf-8", "surrogatepass"))
            chars += len(masked)
            length += len(output)
            if last:
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))
                turns, loss, n, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        if rows:
            yield batch_of(DIGESTS, [list(x) for x in zip(*rows, strict=True)])


def digest_turns(turns: DataFrame) -> DataFrame:
    """A row per conversation of ``format_events``, whose partitions and order it relies on."""
    return arrow_map(turns, _digested, DIGESTS_SQL)


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, t.* FROM VALUES (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') AS t(turn, role, text)")
    return digest_turns(format_events(events_of(rows.unionByName(own))))


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|/TURN\])', '\1\2\\\3', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 18 END AS chars
  FROM turns
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
