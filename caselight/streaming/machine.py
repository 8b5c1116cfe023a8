"""The life of cases as a keyed state machine: turns start, are published, fail, give way or grow stale.

Commands of a case may come in any order and in any number of batches: they wait in the case's
state until the watermark has passed them, and are then applied by time and id. A turn that is
still open when its time is over grows stale at that moment, by a timer of event time, before any
later command is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Minutes that a turn may stay open.
TTL_MINUTES = 5
OUTCOMES = "case_id long, event_id long, revision long, outcome string"
_STATE = "revision long, closed boolean, open boolean, opened_ms long, turn_event long"
_WAITING = "at_ms long, event_id long, command string, target long"


class CaseMachine(StatefulProcessor):
    """State: the case's turn (revision, open or not, since when), and the commands that wait for the watermark."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", _STATE)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            if len(batch):
                self.waiting.appendList(list(batch[["at_ms", "event_id", "command", "target"]].astype(object).itertuples(index=False, name=None)))
                first = int(batch["at_ms"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(max(earliest + 1, 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] < now]
        left = rows[len(due) :]
        revision, closed, open_, opened, turn = self.case.get() or (0, False, False, 0, 0)
        out = []

        def expire(at: int) -> None:
            nonlocal open_
            if open_ and opened + self.ttl_ms <= at:
                open_ = False
                out.append((key[0], turn, revision, "STALE"))

        for at, event_id, command, target in due:
            expire(at)
            if command == "START":
                if closed:
                    outcome = "REJECTED"
                else:
                    if open_:
                        out.append((key[0], turn, revision, "SUPERSEDED"))
                    revision, open_, opened, turn, outcome = revision + 1, True, at, event_id, "STARTED"
            elif command == "COMPLETE":
                outcome = "IGNORED" if closed else "COMPLETED"
                closed = True
            elif command is None:
                continue
            elif open_ and target == revision:
                open_, outcome = False, "PUBLISHED" if command == "PUBLISH" else "FAILED"
            else:
                outcome = "IGNORED"
            out.append((key[0], event_id, revision, outcome))
        expire(now - 1)
        self.case.update((revision, closed, open_, opened, turn))
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] + 1)
        if open_:
            self.handle.registerTimer(opened + self.ttl_ms + 1)
        yield pd.DataFrame(out, columns=["case_id", "event_id", "revision", "outcome"])

    def close(self) -> None:
        pass


def case_machine(commands: DataFrame, ttl_minutes: int = TTL_MINUTES, late: str = "0 seconds") -> DataFrame:
    """What becomes of each command (case_id, event_id, at, command, target), and of turns that end without one.

    command: START, PUBLISH or FAIL (target: the revision it is meant for), COMPLETE. outcome:
    STARTED, PUBLISHED, FAILED, COMPLETED; REJECTED (a start in a closed case); IGNORED (meant for
    another turn, or for one that is over; closed already); and, under the event that started the
    turn, SUPERSEDED or STALE. Commands without a case, a time or an id are left out; those older
    than the watermark are dropped by Spark. A row without a command only tells the time. Needs the
    state store of ROCKS.
    """
    sound = commands.where("case_id is not null and at is not null and event_id is not null")
    timed = sound.withWatermark("at", late).select("case_id", "at", F.unix_millis("at").alias("at_ms"), "event_id", "command", F.coalesce("target", F.lit(-1)).cast("long").alias("target"))
    return timed.groupBy("case_id").transformWithStateInPandas(CaseMachine(ttl_minutes * 60_000), OUTCOMES, "append", "eventTime")


#: Windows of a baseline, how many it needs at least, and deviations above it that make a spike.
BASELINE, LEAST_WINDOWS, DEVIATIONS = 24, 6, 2.0
SPIKES = "kind string, start_ms long, n long, mean double, deviation double, spike boolean"


class Baselines(StatefulProcessor):
    """State: the counts of a kind's last windows, those without events as zeros, and the last one's start."""

    def __init__(self, window_ms: int, baseline: int, least: int, deviations: float) -> None:
        self.window_ms, self.baseline, self.least, self.deviations = window_ms, baseline, least, deviations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "start_ms long")
        self.counts = handle.getListState("counts", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        windows = sorted((int(s), int(n)) for batch in rows for s, n in batch[["start_ms", "n"]].itertuples(index=False))
        last = self.last.get()
        last, counts, out = last[0] if last else None, [c[0] for c in self.counts.get()], []
        for start, n in windows:
            if last is not None:
                counts += [0] * min(self.baseline, (start - last) // self.window_ms - 1)
            counts = counts[-self.baseline :]
            mean = deviation = None
            if counts:
                mean = sum(counts) / len(counts)
                deviation = max(sum(c * c for c in counts) / len(counts) - mean * mean, 0.0) ** 0.5
            spike = len(counts) >= self.least and n > mean + self.deviations * deviation
            out.append((key[0], start, n, mean, deviation, spike))
            counts.append(n)
            last = start
        if windows:
            self.last.update((last,))
            self.counts.put([(c,) for c in counts[-self.baseline :]])
        yield pd.DataFrame(out, columns=["kind", "start_ms", "n", "mean", "deviation", "spike"])

    def close(self) -> None:
        pass


def spikes(events: DataFrame, minutes: int = 60, late: str = "10 minutes", baseline: int = BASELINE, least: int = LEAST_WINDOWS, deviations: float = DEVIATIONS) -> DataFrame:
    """Every closed window of each kind (kind, at), compared with the windows before it.

    mean and deviation are those of the last `baseline` windows, empty ones included; a window with
    `least` of them or more is a spike if its count is more than so many deviations above the mean.
    Events without a kind or time are left out. Needs the state store of ROCKS.
    """
    timed = events.where("kind is not null and at is not null").withWatermark("at", late)
    counted = timed.groupBy(F.window("at", f"{minutes} minutes"), "kind").agg(F.count("*").alias("n"))
    rows = counted.select("kind", F.unix_millis("window.start").alias("start_ms"), "n")
    return rows.groupBy("kind").transformWithStateInPandas(Baselines(minutes * 60_000, baseline, least, deviations), SPIKES, "append", "none")
