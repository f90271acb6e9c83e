"""The review store's changes as set operations: adding candidates, expiring, deciding groups, rejecting what matches.

Waiting items of a project with one content are a group; its first (the surest, the oldest, the least id) stands for it, and a decision on any
of them ends them all. Groups are reduced to their first before anything meets them, so a content with most of the items is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days until a waiting item expires, days a person adds, and days it may be kept at most.
EXPIRES_DAYS, TERMINAL = 7, ("ACCEPTED", "REJECTED", "EXPIRED")
GROUP = ["project_id", "content_key"]


def added(items: DataFrame, candidates: DataFrame, rejected: Column) -> DataFrame:
    """(candidate_id, project_id, outcome, id) for each of `candidates` (ordinal, candidate_id, project_id, event_key) against `items` (id,
    project_id, event_key): REJECTED by the rules, EXISTING where an item or an earlier candidate of the project has its event (`id` is that
    one's), REFUSED where its id stands for another event, else ADDED."""
    name = F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat_ws("/", "candidate_id", "project_id"), 256), 1, 26))
    own = candidates.select("ordinal", "candidate_id", "project_id", "event_key", name.alias("own_id"), F.coalesce(rejected, F.lit(False)).alias("rejected"))
    stored = items.groupBy("project_id", "event_key").agg(F.min("id").alias("stored_id"))
    taken = items.select(F.col("id").alias("own_id"), F.lit(True).alias("taken")).distinct()
    met = own.join(stored, ["project_id", "event_key"], "left").join(taken, "own_id", "left")
    free = met.where("not rejected and stored_id is null and taken is null")
    by_event = free.groupBy("project_id", "event_key").agg(F.min(F.struct("ordinal", "own_id")).alias("first"))
    met = met.join(by_event, ["project_id", "event_key"], "left")
    # of the first candidates of different events that share an id, the first has it
    holder = by_event.groupBy(F.col("first.own_id").alias("own_id")).agg(F.min("first.ordinal").alias("held_by"))
    met = met.join(holder, "own_id", "left")
    outcome = (
        F.when(F.col("rejected"), "REJECTED").when(F.col("stored_id").isNotNull(), "EXISTING").when(F.col("taken").isNotNull(), "REFUSED")
        .when(F.col("ordinal") == F.col("held_by"), "ADDED").when(F.col("ordinal") == F.col("first.ordinal"), "REFUSED").otherwise("EXISTING")
    )
    rated = met.withColumn("outcome", outcome)
    found = F.when(F.col("outcome") == "ADDED", F.col("own_id")).when(F.col("outcome") == "EXISTING", F.coalesce("stored_id", "first.own_id"))
    return rated.select("candidate_id", "project_id", "outcome", found.alias("id"))


def expired(items: DataFrame, as_of: int) -> DataFrame:
    """`items` with the waiting ones whose time is over as EXPIRED, each for itself: another of its group may come to stand for it."""
    return items.withColumn("status", F.when((F.col("status") == "PENDING") & (F.col("expires_s") <= as_of), "EXPIRED").otherwise(F.col("status")))


def primaries(items: DataFrame) -> DataFrame:
    """(project_id, content_key, primary, waiting): the item that stands for each group of waiting ones, and how many they are."""
    order = F.struct((-F.col("confidence")).alias("c"), "created_s", "id")
    return items.where("status = 'PENDING'").groupBy(*GROUP).agg(F.min(order).alias("x"), F.count("*").alias("waiting")).select(*GROUP, F.col("x.id").alias("primary"), "waiting")


def decided(items: DataFrame, decisions: DataFrame, as_of: int) -> DataFrame:
    """(id, status, duplicate_of, note) of all `items` (id, project_id, content_key, status, confidence, created_s, expires_s) after expiry
    and `decisions` (ordinal, id, status, note). The first decision on any waiting item of a group ends the group: its first keeps the note,
    the others become duplicates of it. Later decisions, and those on items that do not wait, change nothing."""
    now = expired(items, as_of)
    on = decisions.where(F.col("status").isin(*TERMINAL)).select("ordinal", "id", F.col("status").alias("verdict"), "note")
    ends = now.where("status = 'PENDING'").select("id", *GROUP).join(on, "id").groupBy(*GROUP).agg(F.min(F.struct("ordinal", "verdict", "note")).alias("end"))
    groups = primaries(now).join(ends, GROUP)
    return _ended(now, groups.select(*GROUP, "primary", F.col("end.verdict").alias("verdict"), F.col("end.note").alias("note")))


def rejected_matching(items: DataFrame, matches: Column, note: str, as_of: int) -> DataFrame:
    """`decided` for the groups whose first item `matches`: all of each are rejected, with the note on the first."""
    now = expired(items, as_of)
    groups = primaries(now)
    chosen = now.where("status = 'PENDING'").where(matches).select(F.col("id").alias("primary"))
    hit = groups.join(chosen, "primary", "left_semi")
    return _ended(now, hit.select(*GROUP, "primary", F.lit("REJECTED").alias("verdict"), F.lit(note).alias("note")))


def _ended(items: DataFrame, groups: DataFrame) -> DataFrame:
    met = items.select("id", *GROUP, "status").join(groups, GROUP, "left")
    ends = (F.col("status") == "PENDING") & F.col("verdict").isNotNull()
    first = F.col("id") == F.col("primary")
    return met.select("id", F.when(ends, F.col("verdict")).otherwise(F.col("status")).alias("status"), F.when(ends & ~first, F.col("primary")).otherwise("").alias("duplicate_of"), F.when(ends & first, F.col("note")).otherwise("").alias("note"))
