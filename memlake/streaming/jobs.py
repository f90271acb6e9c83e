"""Stateful streams over ordered events: the job machine and approvals, right under late, repeated and shuffled arrival.

A processor buffers a key's events and takes them in the order of their time once the watermark has passed them, so what comes out does not
depend on how the events were dealt over files and batches. The last state of a key is kept after its
last event for `keep_s` seconds of event time, so that an event which comes later cannot open a closed key again; then a timer ends it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memlake.functions.text import affirmation
from memlake.operators.jobs import HISTORY, START, stepped

#: What `transformWithState` needs of a session.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
APPROVED = "session long, ordinal long, reply long"


def with_rocks(spark: SparkSession) -> SparkSession:
    for key, value in ROCKS.items():
        spark.conf.set(key, value)
    return spark


class InOrder(StatefulProcessor):
    """Buffers events (ordinal, at, and `payload` columns) by ordinal; a timer at the earliest of them releases all that the watermark has
    passed. Subclasses say what an event does to the key's state."""

    payload: tuple[tuple[str, str], ...] = ()
    state_schema = ""
    start: tuple = ()
    keep_s = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = ", ".join(f"{name} {kind}" for name, kind in self.payload)
        self.buffer = handle.getMapState("buffer", "ordinal long", f"at long, {kinds}")
        # Event time knows no TTL of its own, so the state has the time of its last event, and a timer ends it.
        self.state = handle.getValueState("state", f"{self.state_schema}, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for r in frame.itertuples(index=False):
                at = int(r.ts.timestamp())
                ordinal = (int(r.ordinal),)
                if not self.buffer.containsKey(ordinal):
                    self.buffer.updateValue(ordinal, (at, *(getattr(r, name) for name, _ in self.payload)))
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(max(first * 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [(v[0], k[0], tuple(v[1:])) for k, v in self.buffer.iterator()]
        due = sorted(x for x in held if x[0] * 1000 < passed)
        *state, last = tuple(self.state.get()) if self.state.exists() else (*self.start, 0)
        state, out = tuple(state), []
        for at, ordinal, values in due:
            state, row = self.taken(key, state, at, ordinal, values)
            if row is not None:
                out.append(row)
            self.buffer.removeKey((ordinal,))
        if due:
            last = due[-1][0]
            self.state.update((*state, last))
            self.handle.registerTimer((last + self.keep_s) * 1000 + 1)
        elif len(held) == 0 and self.state.exists() and (last + self.keep_s) * 1000 < passed:
            self.state.clear()
        if waiting := [x[0] for x in held if x[0] * 1000 >= passed]:
            self.handle.registerTimer(min(waiting) * 1000 + 1)
        if out:
            yield pd.DataFrame(out)

    def taken(self, key: Any, state: tuple, at: int, ordinal: int, values: tuple) -> tuple[tuple, dict | None]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Jobs(InOrder):
    """The job machine. A committed job's state stays for thirty days, so an event of it that comes later is refused."""

    payload = (("action", "string"),)
    state_schema = "status string, attempt long, since long"
    start = START
    keep_s = 30 * 86_400

    def taken(self, key, state, at, ordinal, values):
        state, accepted, expired = stepped(state, values[0], at)
        return state, {"job": key[0], "ordinal": ordinal, "action": values[0], "at_s": at, "accepted": accepted, "expired": expired, "status": state[0], "attempt": state[1]}


class Approvals(InOrder):
    """Remembers a session's last turn, so that an approval pairs with a proposal of an earlier batch."""

    payload = (("role", "string"), ("approves", "boolean"))
    state_schema = "role string, ordinal long"
    start = ("", -1)
    keep_s = 7 * 86_400

    def taken(self, key, state, at, ordinal, values):
        role, approves = values
        pair = {"session": key[0], "ordinal": state[1], "reply": ordinal} if state[0] == "assistant" and role == "user" and approves else None
        return (role, ordinal), pair


def job_history_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """`operators.jobs.job_history` of a stream (job, ordinal, action, ts): each event once the watermark has passed it."""
    rows = events.select("job", "ordinal", "action", "ts").withWatermark("ts", delay)
    return rows.groupBy("job").transformWithStateInPandas(Jobs(), HISTORY, "append", "EventTime")


def approvals_stream(turns: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(session, ordinal, reply) of a stream of turns (session, ordinal, role, content, ts): assistant turns that the next turn, a user's,
    approves, also where the two come in different batches."""
    rows = turns.select("session", "ordinal", "role", affirmation(F.coalesce("content", F.lit(""))).alias("approves"), "ts").withWatermark("ts", delay)
    return rows.groupBy("session").transformWithStateInPandas(Approvals(), APPROVED, "append", "EventTime")
