"""Capture: evidence turns, the job ledger, gap audit, usage and session figures, all as grouped aggregates that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import affirmation, commitment, memory_kind, state_operation

LEASE_S, ATTEMPTS = 300, 3


def labelled(turns: DataFrame) -> DataFrame:
    """session, ordinal, label, kind, operation of each turn."""
    content = F.coalesce("content", F.lit(""))
    return turns.select("session", "ordinal", commitment(content, F.col("role")).alias("label"), memory_kind(content).alias("kind"), F.coalesce(state_operation(content), F.lit("")).alias("operation"))


def confirmed_proposals(turns: DataFrame) -> DataFrame:
    """(session, ordinal, reply): assistant turns that the next turn, a user's, approves."""
    order = Window.partitionBy("session").orderBy("ordinal")
    ahead = turns.select("session", "ordinal", "role", F.lead("role").over(order).alias("next_role"), F.lead("content").over(order).alias("next"), F.lead("ordinal").over(order).alias("reply"))
    return ahead.where((F.col("role") == "assistant") & (F.col("next_role") == "user") & affirmation(F.col("next"))).select("session", "ordinal", "reply")


def session_cards(turns: DataFrame) -> DataFrame:
    """Per session: turns, first and last user text and last assistant text (80 characters)."""
    said = lambda role, by: by(F.when(F.col("role") == role, F.substring("content", 1, 80)), F.when(F.col("role") == role, F.col("ordinal")))
    return turns.groupBy("session").agg(F.count("*").alias("turns"), said("user", F.min_by).alias("first_user"), said("user", F.max_by).alias("last_user"), said("assistant", F.max_by).alias("last_assistant"))


def unanswered(turns: DataFrame) -> DataFrame:
    """Sessions with a user turn and no assistant turn."""
    return turns.groupBy("session").agg(F.bool_or(F.col("role") == "user").alias("asked"), F.bool_or(F.col("role") == "assistant").alias("answered")).where("asked and not answered").select("session")


def latest_status(ledger: DataFrame) -> DataFrame:
    """Per job: the last action in ledger order, its attempt and time."""
    return ledger.groupBy("job").agg(F.max(F.struct("ordinal", "action", "attempt", "at_s")).alias("x")).select("job", "x.action", "x.attempt", "x.at_s")


def first_events(ledger: DataFrame) -> DataFrame:
    """(session, job, ordinal, repeats): the first event of each session and job, the batch form of idempotent enqueueing."""
    return ledger.groupBy("session", "job").agg(F.min("ordinal").alias("ordinal"), (F.count("*") - 1).alias("repeats"))


def expired_leases(ledger: DataFrame, as_of: int) -> DataFrame:
    """Jobs whose last event is a claim older than the lease: REQUEUE, or DEAD_LETTER after the last attempt."""
    held = latest_status(ledger).where(F.col("action").isin("CLAIMED", "PROCESSING") & (F.lit(as_of) - F.col("at_s") >= LEASE_S))
    return held.select("job", "attempt", F.when(F.col("attempt") >= ATTEMPTS, "DEAD_LETTER").otherwise("REQUEUE").alias("verdict"))


def session_outcomes(ledger: DataFrame) -> DataFrame:
    """Per session: outcome (missing, committed, dead_letter or pending) and whether a dead letter was recovered."""
    seen = lambda action: F.bool_or(F.col("action") == action)
    facts = ledger.groupBy("session").agg(seen("ENQUEUED").alias("enqueued"), seen("COMMITTED").alias("committed"), seen("DEAD_LETTER").alias("dead"), F.max_by("action", "ordinal").alias("last_action"))
    outcome = F.when(~F.col("enqueued"), "missing").when(F.col("committed"), "committed").when(F.col("dead"), "dead_letter").otherwise("pending")
    return facts.select("session", outcome.alias("outcome"), (F.col("committed") & F.col("dead")).alias("recovered"))


def gap_audit(outcomes: DataFrame) -> DataFrame:
    """(client, outcome, sessions): by client and outcome, by client, and in all, as one pass of grouping sets ('' for all)."""
    own = outcomes.withColumn("client", F.when(F.col("session") % 2 == 0, "a").otherwise("b"))
    sets = own.groupingSets([[F.col("client"), F.col("outcome")], [F.col("client")], []], F.col("client"), F.col("outcome")).agg(F.count("*").alias("sessions"))
    return sets.select(F.coalesce("client", F.lit("")).alias("client"), F.coalesce("outcome", F.lit("")).alias("outcome"), "sessions")


def gap_verdict(outcomes: DataFrame, least_sessions: int = 10) -> DataFrame:
    """FAIL, INSUFFICIENT_EVIDENCE or PASS, in this order."""
    n = outcomes.agg(F.count("*").alias("sessions"), F.count_if(F.col("outcome").isin("missing", "dead_letter")).alias("lost"), F.count_if(F.col("outcome") == "pending").alias("pending"))
    return n.select("sessions", "lost", "pending", F.when(F.col("lost") > 0, "FAIL").when((F.col("sessions") < least_sessions) | (F.col("pending") > 0), "INSUFFICIENT_EVIDENCE").otherwise("PASS").alias("verdict"))


def usage(deliveries: DataFrame) -> DataFrame:
    """Per memory: deliveries, those of kind click, sessions and the last time."""
    return deliveries.groupBy("memory_id").agg(F.count("*").alias("delivered"), F.count_if(F.col("kind") == "click").alias("clicked"), F.count_distinct("session").alias("sessions"), F.max("at_s").alias("last_at"))


def sessions_by_gap(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, started, n): events of a user closer than `gap`."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("started"), "n")


def windowed_counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """(started, event_type, n) over tumbling or sliding windows of ts."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("started"), "event_type", "n")


def reconciled(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(job, repair): jobs (job, status) against the last ledger action: missing_job, missing_ledger, status_differs; agreeing ones are left out."""
    met = jobs.join(latest_status(ledger), "job", "full")
    repair = F.when(F.col("status").isNull(), "missing_job").when(F.col("action").isNull(), "missing_ledger").when(F.col("status") != F.col("action"), "status_differs")
    return met.select("job", repair.alias("repair")).where("repair is not null")
