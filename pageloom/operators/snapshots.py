"""Task state kept as a table: bucketed by task, with the sequence number up to which events are in it.

A refresh reads the events after that number and the state, and works out only the tasks that
new events touch. A single task is read from one bucket. Every refresh writes a new folder, so a
lost job leaves the one before whole.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.operators.ledger import ledger_state

BUCKETS = 64
STATE_SCHEMA = (
    "task_id string, status string, url string, records_count int, records string, error_message string, "
    "created_at timestamp, updated_at timestamp, born_seq bigint, changed_seq bigint, bucket int"
)
#: Before any event.
NOTHING = -(1 << 63)


def bucket_of(task_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(task_id), F.lit(buckets)).cast("int")


def _as_events(state: DataFrame) -> DataFrame:
    """Events that lead to a state: the create of each task, and its last update if there was one."""
    none = F.lit(None).cast("string")
    made = state.select(
        F.col("born_seq").alias("seq"), "task_id", F.lit("create").alias("kind"), none.alias("status"), "url",
        F.lit(0).alias("records_count"), none.alias("records"), none.alias("error_message"), F.col("created_at").alias("at"))
    changed = state.where("changed_seq is not null").select(
        F.col("changed_seq").alias("seq"), "task_id", F.lit("update").alias("kind"), "status", "url",
        "records_count", "records", "error_message", F.col("updated_at").alias("at"))
    return made.union(changed)


def refreshed(state: DataFrame, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """State after ``new`` events, all later than those in ``state``: untouched tasks pass as they are."""
    touched = new.select(F.col("task_id").alias("_task")).distinct()
    same = F.col("task_id").eqNullSafe(F.col("_task"))
    columns = ["seq", "task_id", "kind", "status", "url", "records_count", "records", "error_message", "at"]
    events = _as_events(state.join(touched, same, "left_semi")).union(new.select(*columns))
    moved = ledger_state(events, with_seq=True).withColumn("bucket", bucket_of(F.col("task_id"), buckets))
    return state.join(touched, same, "left_anti").unionByName(moved)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """State of a snapshot and the sequence number it has seen."""
    state = spark.read.schema(STATE_SCHEMA).parquet(os.path.join(path, "state"))
    return state, spark.read.parquet(os.path.join(path, "mark")).first().seq


def save_snapshot(events: DataFrame, path: str, previous: str | None = None, buckets: int = BUCKETS) -> str:
    """Write the state after ``events`` below ``path``, from the snapshot in ``previous`` if there is one.

    Of the events only those after the earlier snapshot's number are read: the filter reaches
    the scan, so files and row groups of older ones are skipped. A snapshot keeps its number of
    buckets from one refresh to the next.
    """
    spark = events.sparkSession
    if previous is None:
        state, seen = spark.createDataFrame([], STATE_SCHEMA), NOTHING
    else:
        state, seen = read_snapshot(spark, previous)
    new = events.where(F.col("seq") > seen)
    # one sort per bucket's file would be idle work; a hash shuffle gives each bucket few files
    refreshed(state, new, buckets).repartition("bucket").write.partitionBy("bucket").parquet(os.path.join(path, "state"))
    new.agg(F.coalesce(F.max("seq"), F.lit(seen)).alias("seq")).write.parquet(os.path.join(path, "mark"))
    return path


def snapshot_task(state: DataFrame, task_id: str, buckets: int = BUCKETS) -> DataFrame:
    """One task out of a snapshot's state; the bucket is a constant, so one folder is read."""
    hit = (F.col("bucket") == bucket_of(F.lit(task_id), buckets)) & (F.col("task_id") == task_id)
    return state.where(hit).drop("created_at", "updated_at", "born_seq", "changed_seq", "bucket")
