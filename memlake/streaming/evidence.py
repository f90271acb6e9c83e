"""Evidence kept as metadata, once: an idempotent upsert of batches, with what contradicts the stored metadata set apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("evidence_id", "session", "role", "captured_s", "content_hash", "n_chars")
STORED = "evidence_id string, session long, role string, captured_s long, content_hash string, n_chars long"
CONFLICT = "evidence_id string, stored_hash string, other_hash string"


def evidence_rows(turns: DataFrame, captured_s: int) -> DataFrame:
    """`turns` (session, ordinal, role, content) as evidence: identity, origin, role, time, and the content's hash and length, never the
    content. The identity is that of the place a turn stands at."""
    content = F.coalesce("content", F.lit(""))
    name = F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws(":", F.col("session").cast("string"), F.col("ordinal").cast("string")), 256), 1, 26))
    return turns.select(name.alias("evidence_id"), "session", "role", F.lit(captured_s).cast("long").alias("captured_s"), F.sha2(content, 256).alias("content_hash"), F.length(content).cast("long").alias("n_chars"))


def _metadata() -> Column:
    """What must agree when evidence comes again; the first capture's time is kept, so it is no part of it."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("session").cast("string"), F.lit("")), F.coalesce("role", F.lit("")), F.coalesce("content_hash", F.lit("")), F.coalesce(F.col("n_chars").cast("string"), F.lit(""))), 256)


def merged(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, conflicts): the evidence of `batch` that is to be added, the earliest capture of each id, and (evidence_id, stored_hash,
    other_hash) of rows whose metadata differ from what is stored or from the earliest. Ids are aggregated before they meet."""
    own = batch.select(*COLUMNS, _metadata().alias("hash"))
    first = own.groupBy("evidence_id").agg(F.min(F.struct("captured_s", "hash", "session", "role", "content_hash", "n_chars")).alias("x"))
    known = stored.select("evidence_id", _metadata().alias("stored_hash"))
    met = first.join(known, "evidence_id", "left")
    new = met.where("stored_hash is null").select("evidence_id", *[F.col(f"x.{c}").alias(c) for c in COLUMNS[1:]])
    valid = met.select("evidence_id", F.coalesce("stored_hash", "x.hash").alias("stored_hash"))
    others = own.select("evidence_id", F.col("hash").alias("other_hash")).distinct()
    return new, valid.join(others, "evidence_id").where("stored_hash != other_hash").select("evidence_id", "stored_hash", "other_hash")


def upsert_into(path: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that keeps evidence in `path`/rows and conflicts in `path`/conflicts, partitioned by batch.

    A batch writes its own partition and reads the others, so a batch that runs again, after a failure or twice, replaces what it wrote and
    changes nothing else. Conflicts go first: what is cut short before the rows is done again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def table(name: str, schema: str) -> DataFrame:
            return spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/{name}").option("ignoreMissingFiles", True).parquet(f"{path}/{name}")

        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        stored = table("rows", STORED).where(F.col("batch") != number).select(*COLUMNS) if there else spark.createDataFrame([], STORED)
        new, conflicts = merged(stored, batch)
        for name, rows in (("conflicts", conflicts), ("rows", new)):
            rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")

    return run
