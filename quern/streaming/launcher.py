"""Batches of work that are launched one after the other, with time-outs: as a stream with timers, and as a batch over the same events.

Events of a run are `queue` (a url), `start`, `closed` (the url's tab or worker went away) and `result` (ok, error). A run opens `size` urls
at a time and the next ones when none of these is open. A url that was closed and has no result `grace` later has failed; so have all
urls of a batch that are open `limit` after its launch. A result for a url that isn't open is a stray, unless it repeats one that was fine.

`Run` is the rule for one run, event by event in the order of time. The stream holds events back until the watermark has
passed them, so late and disordered events give what the batch gives; what falls behind the watermark is dropped by Spark. State is a run's open
and waiting urls, those that are done, and events that wait; a task of the batch streams through its runs and holds no more than that either.

Null urls are urls like any other (one, of an empty text); nulls in ok count as false; an event of another kind does nothing; a run without `start` launches nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SIZE, GRACE_MS, LIMIT_MS = 5, 5_000, 90_000
OUTCOMES = "run string, url string, outcome string, error string, at long"
NEVER = 1 << 62


class Run:
    """Open, waiting and finished urls of one run; `event` and `settle` give (url, outcome, error, at)."""

    def __init__(self, size: int, grace: int, limit: int, held: str | None = None):
        self.size, self.grace, self.limit = size, grace, limit
        kept = json.loads(held) if held else {"waiting": [], "open": {}, "begun": None, "active": False, "fine": []}
        self.waiting, self.open, self.begun, self.active, self.fine = kept["waiting"], kept["open"], kept["begun"], kept["active"], set(kept["fine"])

    def held(self) -> str:
        return json.dumps({"waiting": self.waiting, "open": self.open, "begun": self.begun, "active": self.active, "fine": sorted(self.fine)})

    def due(self) -> int:
        """When the next time-out is, if no event comes before."""
        if not self.open:
            return NEVER
        return min(self.begun + self.limit, *(c + self.grace for c in self.open.values() if c is not None), NEVER)

    def launch(self, now: int):
        if self.active and not self.open and self.waiting:
            self.open, self.waiting, self.begun = dict.fromkeys(self.waiting[: self.size]), self.waiting[self.size :], now

    def settle(self, before: int) -> Iterator[tuple]:
        """Time-outs due before `before`."""
        while (now := self.due()) < before:
            gone = sorted(u for u, c in self.open.items() if c is not None and c + self.grace <= now)
            error = "closed before reporting"
            if not gone:
                gone, error = sorted(self.open), "batch timeout"
            for url in gone:
                del self.open[url]
                yield url, "failed", error, now
            self.launch(now)

    def event(self, now: int, kind: str, url: str, ok: bool, error: str | None) -> Iterator[tuple]:
        yield from self.settle(now)
        if kind == "queue":
            self.waiting.append(url)
        elif kind == "start":
            self.active = True
        elif kind == "closed" and url in self.open:
            self.open[url] = now if self.open[url] is None else self.open[url]
        elif kind == "result" and url in self.open:
            del self.open[url]
            if ok:
                self.fine.add(url)
            yield url, "done" if ok else "failed", None if ok else error or "error", now
        elif kind == "result" and url not in self.fine:
            yield url, "stray", None if ok else error or "error", now
        if kind in ("queue", "start", "result"):
            self.launch(now)


def _events(events: DataFrame) -> DataFrame:
    return events.select(F.col("run").cast("string"), F.col("ts").cast("timestamp"), F.col("seq").cast("long"), F.col("kind").cast("string"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("ok").cast("boolean"), F.lit(False)).alias("ok"), F.col("error").cast("string"))


def outcomes(events: DataFrame, size: int = SIZE, grace_ms: int = GRACE_MS, limit_ms: int = LIMIT_MS) -> DataFrame:
    """run, url, outcome (done, failed, stray), error, at (milliseconds) of a table of events (run, ts, seq, kind, url, ok, error), all time-outs passed."""
    names = [f.split()[0] for f in OUTCOMES.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        here, state, out = None, None, []
        for batch in batches:
            for name, now, kind, url, ok, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or name != here:
                    out += [(here, *o) for o in state.settle(NEVER)] if state else []
                    here, state = name, Run(size, grace_ms, limit_ms)
                out += [(name, *o) for o in state.event(now, kind, url, ok, error)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        out = [(here, *o) for o in state.settle(NEVER)] if state else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    rows = _events(events).select("run", F.unix_millis("ts").alias("now"), "kind", "url", "ok", "error", "seq")
    return rows.repartition("run").sortWithinPartitions("run", "now", "seq", "kind", "url").drop("seq").mapInArrow(run, OUTCOMES)


class Launcher(StatefulProcessor):
    """The rule as a stateful processor: events wait for the watermark, a timer is set for the next event or time-out."""

    def __init__(self, size: int, grace_ms: int, limit_ms: int):
        self.size, self.grace_ms, self.limit_ms = size, grace_ms, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "held string")
        self.pending = handle.getListState("pending", "now long, seq long, kind string, url string, ok boolean, error string")

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r) for part in rows for r in part[["now", "seq", "kind", "url", "ok", "error"]].itertuples(index=False)]
        self.pending.appendList([(int(n), int(s), k, u, bool(o), None if pd.isna(e) else e) for n, s, k, u, o, e in new])
        self._timer(min(n for n, *_ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.pending.get(), key=lambda e: e[:4]) if self.pending.exists() else []
        state = Run(self.size, self.grace_ms, self.limit_ms, self.state.get()[0] if self.state.exists() else None)
        found, left = [], []
        for event in waiting:
            now, _, kind, url, ok, error = event
            if now > seen:
                left.append(tuple(event))
            else:
                found += state.event(now, kind, url, ok, error)
        found += state.settle(seen)
        self.state.update((state.held(),))
        self.pending.put(left) if left else self.pending.clear()
        due = min([state.due() + 1, *(e[0] for e in left)])
        if due < NEVER:
            self._timer(max(due, seen + 1))
        if found:
            yield pd.DataFrame([(key[0], *o) for o in found], columns=["run", "url", "outcome", "error", "at"])

    def _timer(self, at: int) -> None:
        if at not in list(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def launched(events: DataFrame, late: str = "1 minute", size: int = SIZE, grace_ms: int = GRACE_MS, limit_ms: int = LIMIT_MS) -> DataFrame:
    """`outcomes` of a stream of events, each given once the watermark (`late` behind the latest event) has passed it. Needs a state store with timers (RocksDB)."""
    rows = _events(events).withColumn("now", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("run").transformWithStateInPandas(statefulProcessor=Launcher(size, grace_ms, limit_ms), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
