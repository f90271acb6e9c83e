"""The capture queue's job machine: what each ledger event does to its job, in batch. `memlake.streaming.jobs` runs the same machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .capture import ATTEMPTS, LEASE_S
from .state import _streamed

HISTORY = "job long, ordinal long, action string, at_s long, accepted boolean, expired boolean, status string, attempt long"
HELD = ("CLAIMED", "PROCESSING")
START = ("", 0, 0)  # status, attempt, since when it is claimed


def leased(state: tuple[str, int, int], at: int) -> tuple[str, int, int]:
    """The state at a time: a claim that nobody renewed within its lease goes back to the queue, or to the dead letters after the last attempt."""
    status, attempt, since = state
    if status in HELD and at >= since + LEASE_S:
        return ("DEAD_LETTER" if attempt >= ATTEMPTS else "QUEUED", attempt, since)
    return state


def moved(state: tuple[str, int, int], action: str, at: int) -> tuple[str, int, int] | None:
    """The state after an event, null if a job in this state does not take it. What is committed stays so."""
    status, attempt, since = state
    if action == "ENQUEUED":
        return ("QUEUED", 0, 0) if status == "" else None
    if action == "CLAIMED":
        return ("CLAIMED", attempt + 1, at) if status == "QUEUED" else None
    if action == "REQUEUED":
        return ("QUEUED", 0, since) if status == "DEAD_LETTER" else None
    if action == "PROCESSING":
        return ("PROCESSING", attempt, since) if status == "CLAIMED" else None
    if status not in HELD:
        return None
    if action == "RENEWED":
        return (status, attempt, at)
    if action == "COMMITTED":
        return ("COMMITTED", attempt, since)
    if action == "TERMINAL" or (action == "FAILED" and attempt >= ATTEMPTS):
        return ("DEAD_LETTER", attempt, since)
    return ("QUEUED", attempt, since) if action == "FAILED" else None


def stepped(state: tuple[str, int, int], action: str, at: int) -> tuple[tuple[str, int, int], bool, bool]:
    """(state, accepted, expired) after an event at a time: first the lease, then the event."""
    now = leased(state, at)
    after = moved(now, action, at)
    return (now if after is None else after), after is not None, now != state


def job_history(events: DataFrame) -> DataFrame:
    """(job, ordinal, action, at_s, accepted, expired, status, attempt): every event in its job's order of time and ordinal, whether the
    job took it, whether a lease ran out before it, and the job after it. An ordinal counts once. A task holds one job's state at a time,
    however many events it has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(state, r, out):
            (status, attempt, since), accepted, expired = stepped(state, r.action, r.at_s)
            out.append({"job": r.job, "ordinal": r.ordinal, "action": r.action, "at_s": r.at_s, "accepted": accepted, "expired": expired, "status": status, "attempt": attempt})
            return (status, attempt, since)

        return _streamed(frames, ["job"], lambda r: START, row, lambda *_: None)

    once = events.select("job", "ordinal", "action", "at_s").dropDuplicates(["job", "ordinal"])
    return once.repartition("job").sortWithinPartitions("job", "at_s", "ordinal").mapInPandas(run, HISTORY)


def job_states(events: DataFrame, as_of: int) -> DataFrame:
    """(job, status, attempt, recovered): each job at a time, after its last event and the lease that runs from its last claim or renewal."""
    renewing = F.col("accepted") & F.col("action").isin("CLAIMED", "RENEWED")
    done = job_history(events.where(F.col("at_s") <= as_of)).groupBy("job").agg(
        F.max(F.struct("at_s", "ordinal", "status", "attempt")).alias("x"), F.max(F.when(renewing, F.struct("at_s", "ordinal"))).alias("since")
    )
    over = F.col("x.status").isin(*HELD) & (F.lit(as_of) >= F.col("since.at_s") + LEASE_S)
    status = F.when(over & (F.col("x.attempt") >= ATTEMPTS), "DEAD_LETTER").when(over, "QUEUED").otherwise(F.col("x.status"))
    return done.select("job", status.alias("status"), F.col("x.attempt").alias("attempt"), over.alias("recovered"))
