"""Streaming forms of the capture operators: incremental sources, idempotent enqueueing, leases with timers, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.operators.capture import ATTEMPTS, LEASE_S

LEDGER = "ordinal long, session long, job long, action string, attempt long, ts timestamp"


def ledger_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The ledger as it grows: JSON lines in `path`, each file read once; the checkpoint remembers which."""
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_per_trigger).json(path)


def enqueued_once(stream: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first event of each key; repeats within the watermark's delay are acknowledged by being dropped, and state ends with it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(started, action, n) over closed tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", delay).groupBy(w.alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "action", "n")


def sessions_by_gap(stream: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """(session, started, n) of closed sessions; open ones are held back by the watermark."""
    return stream.withWatermark("ts", delay).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("session", F.col("w.start").alias("started"), "n")


def lease_verdicts(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(job, verdict, attempt): COMMITTED or DEAD_LETTER when the ledger says so, REQUEUE or DEAD_LETTER when a claim outlives its lease.

    One small row of state per open job; an event-time timer ends a claim that nobody renews.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            action, attempt = state.get
            state.remove()
            verdict = "DEAD_LETTER" if attempt >= ATTEMPTS else "REQUEUE"
            yield pd.DataFrame({"job": [key[0]], "verdict": [verdict], "attempt": [attempt]})
            return
        events = pd.concat(list(frames)).sort_values(["ts", "ordinal"])
        last = events.iloc[-1]
        if last["action"] in ("COMMITTED", "DEAD_LETTER"):
            if state.exists:
                state.remove()
            yield pd.DataFrame({"job": [key[0]], "verdict": [last["action"]], "attempt": [int(last["attempt"])]})
            return
        state.update((str(last["action"]), int(last["attempt"])))
        if last["action"] in ("CLAIMED", "PROCESSING"):
            due = int(last["ts"].timestamp() * 1000) + LEASE_S * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    jobs = stream.withWatermark("ts", delay).groupBy("job")
    return jobs.applyInPandasWithState(step, "job long, verdict string, attempt long", "action string, attempt long", "append", GroupStateTimeout.EventTimeTimeout)
