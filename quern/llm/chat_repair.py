"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?`, by a lazily determinised weighted automaton.

A row is kept (0), reroled to user or assistant (2) or deleted (3; a blank or repeated row must be); an empty
user or assistant turn may be inserted anywhere (2); a truncated row that isn't deleted costs 1 more.
Four states suffice (nothing yet, a system turn, a user turn, a finished pair), and of user and assistant only one is
ever legal next, so the string of edits tells the repaired roles.

The rows are read from the last to the first. What the rest of a conversation costs from each state is a vector; less its smallest
entry it is a state of the determinised automaton. A dozen such states or so are ever met: `Table` makes them when they are
first needed and keeps every step, so a scan is a table lookup for each row, and its offsets add up to the cost. The trace goes
back over the scan, from the first row on, along tight arcs (those that give a vector's entry); where several are tight, the
ASCII-least edit is taken, which gives the least string of all cheapest ones.

On Spark: rows without their texts are counted by (conversation, turn, role, digest), so that exact repeats meet before any
shuffle; a range sort gives every group its place, `at`, whatever the size of a conversation; tasks pack neighbouring rows of one
conversation into segments, a byte for each row. The segments of a conversation, not its rows, are scanned
in one task, in reverse and one at a time; each leaves what its rows do from each of the four states. The last pass streams segments and texts in
order, picks the right one of the four, and feeds the running hash; nothing of a conversation is held but its audit, which the result has as one string.

Nulls in any column of a row count as one space (a null turn comes first and is no turn for the gaps; a null conv_id is a conversation of
its own). A role without a first letter s, u or a can't be kept. Ties of a turn come in the order of role and of the text's SHA-256.
Repeated rows are duplicates; very long texts are only hashed; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Next state by role (s, u, a), from: nothing yet, after a system turn, after a user turn, after a pair.
STEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None))
#: The one state that a user or assistant turn leads to, and which of them it is.
FORWARD, SPEAKS = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Cost of ending in each state, insertions included, and what those are.
FINAL, LAST = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: Symbols: 0 must go, 1 to 8 are role class (s, u, a, other) and truncation, 9 is a further copy of the row before (and must go).
CLASS, AGAIN = {"s": 0, "u": 1, "a": 2}, 9
#: Rows in a segment.
SEGMENT = 4096


class Table:
    """The determinised automaton, as far as it was met: vectors, steps and tight edits, each found once."""

    def __init__(self):
        self.vectors, self.number, self.steps, self.edits = [], {}, {}, {}

    def of(self, costs) -> tuple[int, int]:
        """(state, offset) of a vector of costs."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    def rows(self, symbol: int, q: int):
        """(edit, cost, state after) of the row edits from state q, ASCII-least edit first."""
        yield "D", DELETE, q
        if 0 < symbol < AGAIN:
            role, cut_off = divmod(symbol - 1, 2)
            to = STEP[role][q] if role < len(STEP) else None
            if to is not None:
                yield "K", KEEP + cut_off * TRUNCATED, to
            yield "R", REROLE + cut_off * TRUNCATED, FORWARD[q]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(state, offset) with one more row in front."""
        found = self.steps.get((state, symbol))
        if found is None:
            after = self.vectors[state]
            costs = [min(cost + after[to] for _, cost, to in self.rows(symbol, q)) for q in range(4)]
            for _ in range(2):  # two insertions in a row reach whatever insertions reach
                costs = [min(costs[q], INSERT + costs[FORWARD[q]]) for q in range(4)]
            found = self.steps[state, symbol] = self.of(costs)
        return found

    def tight(self, state: int, symbol: int, q: int) -> tuple[str, int]:
        """The least cheapest edits from q until this row is done, and the state then; `state` is the vector after the row."""
        found = self.edits.get((state, symbol, q))
        if found is None:
            after, (before, offset) = self.vectors[state], self.step(state, symbol)
            here, done, at = self.vectors[before], "", q
            while True:
                left = here[at] + offset
                arcs = [(edit, cost + after[to], to, True) for edit, cost, to in self.rows(symbol, at)]
                arcs.append(("I", INSERT + here[FORWARD[at]] + offset, FORWARD[at], False))
                edit, _, at, over = min(arc for arc in arcs if arc[1] == left)
                done += edit
                if over:
                    break
            found = self.edits[state, symbol, q] = done, at
        return found

    def scan(self, symbols: bytes, state: int) -> tuple[list[int], int]:
        """The states after each row of a segment, from its first row on, with the one before it in front; and the sum of offsets."""
        states, total = [state], 0
        for symbol in reversed(symbols):
            state, offset = self.step(state, symbol)
            total += offset
            states.append(state)
        states.reverse()
        return states, total

    def trace(self, symbols: bytes, states: list[int], q: int) -> tuple[str, int]:
        """The edits of a segment that is entered in state q, and the state that it is left in."""
        done = []
        for i, symbol in enumerate(symbols):
            edits, q = self.tight(states[i + 1], symbol, q)
            done.append(edits)
        return "".join(done), q


def repair(symbols: bytes) -> tuple[int, str]:
    """Cost and audit of one conversation."""
    known = Table()
    state, offset = known.of(FINAL)
    states, total = known.scan(symbols, state)
    edits, q = known.trace(symbols, states, 0)
    return known.vectors[states[0]][0] + total + offset, edits + LAST[q]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows that stay, damaged by the hash of `conv_id:turn`."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.filter("fate != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _placed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copies, fault, fresh (the first row with its role and text), at: the order of all rows, without texts."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", "blank").when(end.isin(".", "!", "?"), "none").otherwise("truncated")
    keys = ["conv_id", "turn", "role", "digest", "fault"]
    groups = rows.select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), fault.alias("fault"), "copies").groupBy(*keys).agg(F.sum("copies").alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = groups.filter("fault != 'blank'").groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first")).withColumnsRenamed({"conv_id": "_conv", "role": "_role", "digest": "_digest"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    marked = groups.join(first, same, "left").select(*keys, "copies", F.coalesce(F.col("first.turn").eqNullSafe(F.col("turn")) & (F.col("fault") != "blank"), F.lit(False)).alias("fresh"))
    line = ["conv_id", "turn", "role", "digest"]
    return cut(marked.repartitionByRange(*line).sortWithinPartitions(*line).withColumn("at", F.monotonically_increasing_id()))


SEGMENTS = "conv_id long, at long, part long, symbols binary, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long"
_SEGMENT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
PAIRS = {"su", "ua", "au"}


class _Segment:
    """Neighbouring rows of one conversation, as they are gathered."""

    def __init__(self, conv, at, part):
        self.conv, self.at, self.part, self.symbols = conv, at, part, bytearray()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first_role = self.last_role = self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn, initial, fault, fresh, again, n):
        kind = fault if fault == "blank" else "duplicate" if not fresh or again else fault
        symbol = AGAIN if again else 0 if kind in ("blank", "duplicate") else 1 + 2 * CLASS.get(initial, len(CLASS)) + (kind == "truncated")
        self.symbols += bytes([symbol]) * n
        if kind in self.counts:
            self.counts[kind] += n
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in PAIRS:
            self.counts["illegal"] += 1
        self.counts["illegal"] += n - 1
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self):
        return self.conv, self.at, self.part, bytes(self.symbols), *self.counts.values(), self.first_role, self.last_role, self.first_turn, self.last_turn, self.turns


def _segments(batches):
    """Segments of rows (conv_id, at, turn, initial, fault, fresh, copies), which come in order but for breaks between files."""
    here, last, out = None, None, []
    for batch in batches:
        for conv, at, turn, initial, fault, fresh, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here is None or conv != here.conv or at != last + 1 or len(here.symbols) >= SEGMENT:
                if here:
                    out.append(here.row())
                here = _Segment(conv, at, 0)
            last, left, again = at, copies, False
            while left:
                if len(here.symbols) >= SEGMENT:
                    out.append(here.row())
                    here = _Segment(conv, at, here.part + 1 if here.at == at else 1)
                n = min(left, SEGMENT - len(here.symbols)) if again else 1
                here.add(turn, initial, fault, fresh, again, n)
                left, again = left - n, True
            if len(out) >= 4096:
                yield _batch(out, SEGMENTS, _SEGMENT_TYPES)
                out = []
    if here:
        out.append(here.row())
    yield _batch(out, SEGMENTS, _SEGMENT_TYPES)


def _batch(rows, schema, types):
    names = [f.split()[0] for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


TRACED = "conv_id long, at long, part long, edits array<string>, ends binary, cost long"
_TRACED_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.int64()]


def _traced(batches):
    """Of each segment, its edits and last state from each of the four states; segments come with a conversation's last first."""
    known, out, conv, begun, size = Table(), [], None, False, 0
    state = total = 0
    for batch in batches:
        for this, at, part, symbols in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "part", "symbols")), strict=True):
            if not begun or this != conv:
                conv, begun = this, True
                state, total = known.of(FINAL)
            states, offset = known.scan(symbols, state)
            state, total = states[0], total + offset
            found = [known.trace(symbols, states, q) for q in range(4)]
            out.append((conv, at, part, [e for e, _ in found], bytes(q for _, q in found), known.vectors[state][0] + total))
            size += sum(len(e) for e, _ in found)
            if size > 1 << 20 or len(out) >= 4096:
                yield _batch(out, TRACED, _TRACED_TYPES)
                out, size = [], 0
    yield _batch(out, TRACED, _TRACED_TYPES)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_TYPES = [pa.int64()] * 7 + [pa.string(), pa.string()]


class _Conversation:
    """One conversation as its segments and texts stream by."""

    def __init__(self, conv):
        self.conv, self.hash, self.any, self.q, self.audit = conv, hashlib.sha256(), False, 0, []
        self.counts, self.cost, self.role, self.turns = [0, 0, 0, 0], None, None, [None, None, 0]
        self.edits, self.symbols, self.next, self.row, self.speaker = "", b"", 0, -1, 0

    def segment(self, s):
        self.flush()
        self.edits, self.next, self.symbols = s["edits"][self.q], 0, s["symbols"]
        self.speaker, self.q = self.q, s["ends"][self.q]
        self.audit.append(self.edits)
        # the group that comes next; a segment may begin within the copies of one
        self.row, self.place = s["at"] - (s["part"] == 0), 0
        self.counts = [a + s[c] for a, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
        if self.role is not None and self.role + s["first_role"] not in PAIRS:
            self.counts[3] += 1
        self.role = s["last_role"]
        if self.cost is None:
            self.cost = s["cost"]
        if s["turns"]:
            low, high, n = self.turns
            self.turns = [s["first_turn"] if low is None else low, s["last_turn"], n + s["turns"] - (high is not None and high == s["first_turn"])]

    def say(self, role, text):
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def insert(self):
        self.say(SPEAKS[self.speaker], "")
        self.speaker = FORWARD[self.speaker]

    def until(self, at, role="", text=""):
        """All edits up to and including the row of group `at`."""
        while self.next < len(self.edits) and self.row < at:
            edit = self.edits[self.next]
            self.next += 1
            if edit == "I":
                self.insert()
                continue
            self.row += self.symbols[self.place] != AGAIN
            self.place += 1
            if edit != "D":
                # kept and reroled rows are fresh, so theirs is the text at hand
                if edit == "R":
                    role, self.speaker = SPEAKS[self.speaker], FORWARD[self.speaker]
                else:
                    self.speaker = STEP[CLASS[role[:1]]][self.speaker]
                self.say(role, text)

    def flush(self):
        self.until(1 << 63)

    def result(self):
        self.flush()
        for _ in LAST[self.q]:
            self.insert()
        low, high, n = self.turns
        gaps = 0 if low is None else high - low + 1 - n
        audit = "".join(self.audit) + LAST[self.q]
        return self.conv, gaps, *self.counts, self.cost or 0, audit, self.hash.hexdigest()


def _told(batches):
    """One row for each conversation of rows in order: one that names it, its segments, each followed by its texts."""
    names = ("conv_id", "at", "kind", "role", "text", "segment")
    here, out, size = None, [], 0
    for batch in batches:
        for conv, at, kind, role, text, segment in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if here is None or conv != here.conv:
                if here:
                    out.append(here.result())
                    size += len(out[-1][7])
                here = _Conversation(conv)
            if kind == 1:
                here.segment(segment)
            elif kind == 2 and here.row < at:
                here.until(at, role, text)
            if len(out) >= 4096 or size > 1 << 20:
                yield _batch(out, RESULT, _RESULT_TYPES)
                out, size = [], 0
    if here:
        out.append(here.result())
    yield _batch(out, RESULT, _RESULT_TYPES)


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`: faults, cost, audit and the digest of the repaired conversation; rows: conv_id, turn, role, text, copies."""
    placed = _placed(rows)
    slim = placed.select("conv_id", "at", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "fresh", "copies")
    segments = cut(slim.mapInArrow(_segments, SEGMENTS))
    back = segments.select("conv_id", "at", "part", "symbols").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at"), F.desc("part"))
    traced = back.mapInArrow(_traced, TRACED).withColumnsRenamed({"conv_id": "_conv", "at": "_at", "part": "_part"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at")) & (F.col("part") == F.col("_part"))
    whole = segments.join(traced, same).drop("_conv", "_at", "_part")

    # a text goes to the place of its group; further copies of a group have the same place and are passed over
    fresh = placed.filter("fresh").select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), "digest", "at")
    texts = rows.withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    texts = texts.join(fresh, same).select("conv_id", "at", F.lit(0).cast("long").alias("part"), F.lit(2).alias("kind"), "role", "text", F.lit(None).alias("segment"))

    none = F.lit(None).cast("string")
    named = conversations.select(F.col("conv_id").cast("long")).distinct().select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("kind"), none.alias("role"), none.alias("text"), F.lit(None).alias("segment"))
    parts = whole.select("conv_id", "at", "part", F.lit(1).alias("kind"), none.alias("role"), none.alias("text"), F.struct(*[c for c in whole.columns if c != "conv_id"]).alias("segment"))
    line = parts.union(texts).union(named).repartition("conv_id").sortWithinPartitions("conv_id", "at", "part", "kind")
    return line.mapInArrow(_told, RESULT)


def op13_chat_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    return repaired(damaged(given), given)


SQL = r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT), lambda h, b:
  list_reduce([1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(h, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fate FROM given),
rows AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
  lag(left(role, 1)) OVER w AS before, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS e
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
judged AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  max(i) OVER (PARTITION BY conv_id) AS n FROM placed),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, max(n) AS i, {'c': 0, 'a': '', 'o': ''} AS h0, {'c': 4, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:'} AS h1,
    {'c': 2, 'a': 'I', 'o': 'assistant:'} AS h2, {'c': 0, 'a': '', 'o': ''} AS h3 FROM judged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i - 1, list_min([g0, {'c': g2.c + 2, 'a': 'I' || g2.a, 'o': 'user:' || CASE WHEN g2.o = '' THEN '' ELSE chr(10) || g2.o END}, {'c': g3.c + 4, 'a': 'II' || g3.a, 'o': 'user:' || chr(10) || 'assistant:' || CASE WHEN g3.o = '' THEN '' ELSE chr(10) || g3.o END}]),
    list_min([g1, {'c': g2.c + 2, 'a': 'I' || g2.a, 'o': 'user:' || CASE WHEN g2.o = '' THEN '' ELSE chr(10) || g2.o END}, {'c': g3.c + 4, 'a': 'II' || g3.a, 'o': 'user:' || chr(10) || 'assistant:' || CASE WHEN g3.o = '' THEN '' ELSE chr(10) || g3.o END}]),
    list_min([g2, {'c': g3.c + 2, 'a': 'I' || g3.a, 'o': 'assistant:' || CASE WHEN g3.o = '' THEN '' ELSE chr(10) || g3.o END}]),
    list_min([g3, {'c': g2.c + 2, 'a': 'I' || g2.a, 'o': 'user:' || CASE WHEN g2.o = '' THEN '' ELSE chr(10) || g2.o END}])
  FROM (SELECT w.conv_id, w.i,
    CASE WHEN gone THEN d0 ELSE list_min(list_filter([d0, CASE WHEN l = 's' THEN {'c': h1.c + t, 'a': 'K' || h1.a, 'o': own || CASE WHEN h1.o = '' THEN '' ELSE chr(10) || h1.o END} END, CASE WHEN l = 'u' THEN {'c': h2.c + t, 'a': 'K' || h2.a, 'o': own || CASE WHEN h2.o = '' THEN '' ELSE chr(10) || h2.o END} END, {'c': h2.c + t + 2, 'a': 'R' || h2.a, 'o': 'user:' || text || CASE WHEN h2.o = '' THEN '' ELSE chr(10) || h2.o END}], lambda x: x IS NOT NULL)) END AS g0,
    CASE WHEN gone THEN d1 ELSE list_min(list_filter([d1, CASE WHEN l = 'u' THEN {'c': h2.c + t, 'a': 'K' || h2.a, 'o': own || CASE WHEN h2.o = '' THEN '' ELSE chr(10) || h2.o END} END, {'c': h2.c + t + 2, 'a': 'R' || h2.a, 'o': 'user:' || text || CASE WHEN h2.o = '' THEN '' ELSE chr(10) || h2.o END}], lambda x: x IS NOT NULL)) END AS g1,
    CASE WHEN gone THEN d2 ELSE list_min(list_filter([d2, CASE WHEN l = 'a' THEN {'c': h3.c + t, 'a': 'K' || h3.a, 'o': own || CASE WHEN h3.o = '' THEN '' ELSE chr(10) || h3.o END} END, {'c': h3.c + t + 2, 'a': 'R' || h3.a, 'o': 'assistant:' || text || CASE WHEN h3.o = '' THEN '' ELSE chr(10) || h3.o END}], lambda x: x IS NOT NULL)) END AS g2,
    CASE WHEN gone THEN d3 ELSE list_min(list_filter([d3, CASE WHEN l = 'u' THEN {'c': h2.c + t, 'a': 'K' || h2.a, 'o': own || CASE WHEN h2.o = '' THEN '' ELSE chr(10) || h2.o END} END, {'c': h2.c + t + 2, 'a': 'R' || h2.a, 'o': 'user:' || text || CASE WHEN h2.o = '' THEN '' ELSE chr(10) || h2.o END}], lambda x: x IS NOT NULL)) END AS g3
    FROM (SELECT w.*, left(r.role, 1) AS l, r.role || ':' || r.text AS own, r.text AS text, r.fault IN ('blank', 'duplicate') AS gone, CASE r.fault WHEN 'truncated' THEN 1 ELSE 0 END AS t,
      {'c': h0.c + 3, 'a': 'D' || h0.a, 'o': h0.o} AS d0, {'c': h1.c + 3, 'a': 'D' || h1.a, 'o': h1.o} AS d1, {'c': h2.c + 3, 'a': 'D' || h2.a, 'o': h2.o} AS d2, {'c': h3.c + 3, 'a': 'D' || h3.a, 'o': h3.o} AS d3
      FROM walk AS w JOIN judged AS r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i) AS w)),
ends AS (SELECT conv_id, h0 FROM walk WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(h0.c, 0)::BIGINT AS cost, coalesce(h0.a, '') AS audit, sha256(coalesce(h0.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN told AS t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
