"""Chat formatting from event logs.

An event has conv_id, turn, seq, kind, role and text. Kinds: `message` opens a message with its text, `edit` replaces
the text, `delta` appends to it, `regenerate` empties it so that later deltas write
it anew. Logs are dealt out and sorted by conversation, turn and seq, and each message is folded
as its events stream by; messages follow each other, so only the one at hand is held,
and no conversation, however long, is gathered. The role is the last that is not null.

Template: `<s>` before the first turn; system `<<SYS>>..</SYS>>`-like marks, user
`[INST] .. [/INST]`, assistant ` .. </s>`, any other role `<|role|>..<|end|>`. Inside texts and
role names a backslash becomes two, and a control string (or anything that
begins one of the role marks) becomes a backslash and a digit; so no text can forge a
mark, texts without them stay as they are, and `read_turns` finds every turn in the joined output and restores it.
The loss mask covers assistant texts alone.

The output is one row a conversation, and goes on in further rows where it is longer than CHUNK characters: a very long
text or a conversation of very many turns is cut wherever that length is reached. One conversation stays in one task, for its
digest is one running hash; memory stays at one message and one chunk.
Null text is empty, a null role is the role "". Null turns come first; rows that agree in turn are separate messages
in the order of seq, role and text when `seq` is null or equal and the kind is `message`. Rows with a null conv_id
are one conversation. Other columns are not read, whatever their names; an empty log gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BOS, CHUNK, BATCH = "<s>", 1 << 20, 4 << 20
#: Control strings, by the digit that stands for each.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
MARKS = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
_UNSAFE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_SAFE = re.compile(r"\\([\\0-9])")
_CODE = {"\\": "\\\\"} | {c: f"\\{i}" for i, c in enumerate(CONTROL)}


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: _CODE[m[0]], text)


def unescape(text: str) -> str:
    return _SAFE.sub(lambda m: "\\" if m[1] == "\\" else CONTROL[int(m[1])], text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's part of the output, and where in it the loss mask begins and ends."""
    before, after = MARKS.get(role) or (f"<|{escape(role)}|>", "<|end|>")
    text = escape(text)
    at = len(before)
    return before + text + after, at if role == "assistant" else 0, at + len(text) if role == "assistant" else 0


def _opening(text: str, at: int):
    """Role, where the body begins, and what closes it, of the turn at `at`; None if the text ends before that is clear."""
    for role, (before, after) in MARKS.items():
        if text.startswith(before, at):
            return role, at + len(before), after
    end = text.find("|>", at + 2)
    return (unescape(text[at + 2 : end]), end + 2, "<|end|>") if text.startswith("<|", at) and end >= 0 else None


def read_turns(chunks):
    """(role, text) of every turn of one conversation's output, given in chunks that are cut anywhere."""
    left, seen, begun = "", 0, False
    for chunk in chunks:
        left, at = left + chunk, 0
        if not begun:
            if len(left) < len(BOS):
                continue
            at, begun = len(BOS), True
        while found := _opening(left, at):
            role, body, close = found
            end = left.find(close, max(body, seen))
            if end < 0:
                seen = max(body, len(left) - len(close) + 1)
                break
            yield role, unescape(left[body:end])
            at, seen = end + len(close), 0
        left, seen = left[at:], max(0, seen - at)


def fold(events):
    """(conv, turn, role, text) of events (conv, turn, kind, role, text) in order; one turn is held at a time."""
    key, role, parts = None, "", []
    for conv, turn, kind, who, text in events:
        if key is None or key != (conv, turn) or kind == "message":
            if key is not None:
                yield *key, role, "".join(parts)
            key, role, parts = (conv, turn), "", []
        if who is not None:
            role = who
        if kind == "delta":
            parts.append(text or "")
        else:
            parts = [] if kind == "regenerate" else [text or ""]
    if key is not None:
        yield *key, role, "".join(parts)


def _sorted(events: DataFrame) -> DataFrame:
    order = ["conv_id", "turn", "seq", "role", "text"]
    x = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"), "kind", "role", "text")
    return x.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "kind", "role", "text")


def _events(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def chunks_of(turns):
    """(conv, ord, text, spans) of (conv, turn, role, text) in order; spans (start, end) of the text are under the loss mask."""
    conv, n, parts, spans, size = None, -1, [], [], 0
    for this, _, role, text in turns:
        if n < 0 or this != conv:
            if n >= 0:
                yield conv, n, "".join(parts), spans
            conv, n, parts, spans, size = this, 0, [BOS], [], len(BOS)
        part, a, b = render_turn(role, text)
        while True:
            room = CHUNK - size
            if a < min(b, room):
                spans.append((size + a, size + min(b, room)))
            parts.append(part[:room])
            size += len(parts[-1])
            if size < CHUNK:
                break
            yield conv, n, "".join(parts), spans
            part, a, b = part[room:], max(0, a - room), max(0, b - room)
            n, parts, spans, size = n + 1, [], [], 0
    if n >= 0:
        yield conv, n, "".join(parts), spans


def render(events: DataFrame) -> DataFrame:
    """conv_id, ord, formatted, loss: a conversation's output is its rows' `formatted` in the order of ord; loss lists the masked (start, end) of each."""
    loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 4
        spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in columns[3]], loss)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), spans], ["conv_id", "ord", "formatted", "loss"])

    def run(batches):
        rows, held = [], 0
        for row in chunks_of(fold(_events(batches))):
            rows.append(row)
            held += len(row[2])
            if held > BATCH:
                yield batch_of(rows)
                rows, held = [], 0
        yield batch_of(rows)

    return _sorted(events).mapInArrow(run, "conv_id long, ord long, formatted string, loss array<struct<start: int, end: int>>")


class _Told:
    """What can be read back of one conversation from its (formatted, loss) rows, as they stream by."""

    def __init__(self, rows):
        self.size, self.masked, self.left, self.mask = 0, 0, "", hashlib.sha256()
        turns, n = hashlib.sha256(), 0
        for role, text in read_turns(self.texts(rows)):
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
        self.row = n, turns.hexdigest(), self.masked, self.mask.hexdigest(), self.size

    def texts(self, rows):
        for _, text, spans in rows:
            self.size += len(text)
            for s in spans:
                self.hear(text[s["start"] : s["end"]])
            yield text

    def hear(self, part: str):
        """A part under the mask; an escape that is cut waits for its other half."""
        part = self.left + part
        whole = len(part) - (len(part) - len(part.rstrip("\\"))) % 2
        self.left, text = part[whole:], unescape(part[:whole])
        self.masked += len(text)
        self.mask.update(text.encode())


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation of what can be read back from its joined output; streams over render()'s rows where they lie."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True)

    def run(batches):
        rows = []
        for conv, group in groupby(rows_of(batches), key=itemgetter(0)):
            rows.append((conv, *_Told(group).row))
            if len(rows) >= 4096:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def messages(conversations: DataFrame) -> DataFrame:
    """Finished messages as events."""
    return conversations.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")


def dealt(conversations: DataFrame, seed: int = 6) -> DataFrame:
    """The log that a chat service would have written for these finished messages, by seed: whole, in deltas, regenerated after a draft, or edited; events in reverse."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(role, text)) - 1
    half = F.floor(F.char_length(text) / 2).cast("int")
    begin, rest, draft = F.left(text, half), F.substring(text, half + 1, F.char_length(text)), F.concat(F.lit("</s> Draft \\"), F.reverse(text))

    def events(*steps):
        return F.array(*[F.struct((F.col("copy") * 8 + i).alias("seq"), F.lit(kind).alias("kind"), (role if kind == "message" else F.lit(None).cast("string")).alias("role"), what.alias("text")) for i, (kind, what) in enumerate(steps)])

    none = F.lit(None).cast("string")
    case = F.pmod(F.xxhash64("conv_id", "turn", role, text, F.lit(seed)), F.lit(4))
    log = F.when(case == 0, events(("message", text))).when(case == 1, events(("message", none), ("delta", begin), ("delta", rest)))
    log = log.when(case == 2, events(("message", draft), ("regenerate", none), ("delta", begin), ("delta", rest))).otherwise(events(("message", draft), ("delta", draft), ("edit", text)))
    numbered = conversations.select("conv_id", "turn", "role", "text", copy.alias("copy"))
    return numbered.select("conv_id", "turn", F.explode(F.reverse(log)).alias("e")).select("conv_id", "turn", "e.*")


def op6_chat_format(spark, sf_dir):
    talk = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", talk), (-1, 1, "assistant", talk)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return digests(render(dealt(every)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\||\|>', '\\0', 'g')) AS escaped FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(escaped + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 11 + length(role) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
