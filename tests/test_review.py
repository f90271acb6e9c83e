from pyspark.sql import functions as F

from memlake.operators import review

ITEM = "id string, project_id string, content_key string, status string, confidence double, created_s long, expires_s long, type string"
ROWS = [
    ("a", "p", "k", "PENDING", 0.5, 1, 100, "x"), ("b", "p", "k", "PENDING", 0.9, 2, 100, "y"), ("c", "p", "k", "ACCEPTED", 1.0, 1, 100, "x"), ("d", "q", "k", "PENDING", 0.5, 1, 100, "x"),
    ("e", "p", "j", "PENDING", 0.9, 1, 5, "x"), ("f", "p", "j", "PENDING", 0.1, 1, 100, "x"), ("g", "p", "j", "PENDING", 0.1, 1, 100, "x"),
]


def table(spark, df):
    return {r["id"]: (r["status"], r["duplicate_of"], r["note"]) for r in df.collect()}


def test_a_decision_ends_its_group(spark):
    items = spark.createDataFrame(ROWS, ITEM)
    said = spark.createDataFrame([(1, "a", "ACCEPTED", "good"), (2, "b", "REJECTED", "late"), (3, "c", "REJECTED", "done"), (4, "e", "ACCEPTED", "expired"), (5, "nobody", "ACCEPTED", "")], "ordinal long, id string, status string, note string")
    got = table(spark, review.decided(items, said, 10))
    assert got["b"] == ("ACCEPTED", "", "good") and got["a"] == ("ACCEPTED", "b", "")
    assert got["c"] == ("ACCEPTED", "", "") and got["d"] == ("PENDING", "", "") and got["e"] == ("EXPIRED", "", "") and got["f"] == ("PENDING", "", "")


def test_rejects_groups_by_their_first(spark):
    items = spark.createDataFrame(ROWS, ITEM)
    got = table(spark, review.rejected_matching(items, F.col("type") == "x", "noise", 10))
    assert got["a"] == ("PENDING", "", "") and got["b"] == ("PENDING", "", "")  # the group's first is no x
    assert got["d"] == ("REJECTED", "", "noise") and got["f"] == ("REJECTED", "", "noise") and got["g"] == ("REJECTED", "f", "") and got["e"] == ("EXPIRED", "", "")
    assert table(spark, review.rejected_matching(items.where("false"), F.lit(True), "n", 0)) == {}


def test_one_event_is_added_once(spark):
    asked = spark.createDataFrame([(1, "c1", "p", "e1"), (2, "c2", "p", "e1"), (3, "c1", "p", "e2"), (4, "c1", "p", "e1"), (5, "c1", "q", "e1"), (6, "bad", "p", "e9")], "ordinal long, candidate_id string, project_id string, event_key string")
    none = spark.createDataFrame([], "id string, project_id string, event_key string")
    rows = {(r["candidate_id"], r["project_id"], r["outcome"]) for r in review.added(none, asked, F.col("candidate_id") == "bad").collect()}
    assert rows == {("c1", "p", "ADDED"), ("c2", "p", "EXISTING"), ("c1", "p", "REFUSED"), ("c1", "p", "EXISTING"), ("c1", "q", "ADDED"), ("bad", "p", "REJECTED")}
    stored = review.added(none, asked, F.lit(False)).where("outcome = 'ADDED'").join(asked.groupBy("candidate_id", "project_id").agg(F.min("event_key").alias("event_key")), ["candidate_id", "project_id"]).select("id", "project_id", "event_key")
    assert {r["outcome"] for r in review.added(stored, asked.where("ordinal in (1, 2, 5)"), F.lit(False)).collect()} == {"EXISTING"}
