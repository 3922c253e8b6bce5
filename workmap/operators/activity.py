"""Sessions, tasks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_session_order():
    return Window.partitionBy("session").orderBy("ts", "seq")


def with_tasks(events: DataFrame) -> DataFrame:
    """events(seq, session, ts, kind, node) with `task`: a prompt opens the next task of its session; 0 before the first."""
    so_far = in_session_order().rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("task", F.sum((F.col("kind") == "prompt").cast("long")).over(so_far))


def tasks_of(tasked: DataFrame) -> DataFrame:
    return tasked.where("task > 0").groupBy("session", "task").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count("*").alias("events"), F.min("seq").alias("first_seq"))


def tool_calls(tasked: DataFrame) -> DataFrame:
    """Rows of one call (equal task, time, kind, node) collapse to one, then count for each task."""
    calls = tasked.where("task > 0 and kind <> 'prompt'").groupBy("session", "task", "ts", "kind", "node").agg(F.min("seq").alias("seq"))
    return calls.groupBy("session", "task").agg(F.count("*").alias("calls"), F.min("seq").alias("first_seq"))


def quiet_tasks(tasks: DataFrame, events: DataFrame, now_ms: int, quiet_ms: int) -> DataFrame:
    """Latest task of each session whose task and session have been still for quiet_ms."""
    latest = tasks.groupBy("session").agg(F.max(F.struct("task", "last_at", "started_at")).alias("t")).select("session", "t.*")
    seen = events.groupBy("session").agg(F.max("ts").alias("seen_at"))
    last = F.greatest(F.col("last_at"), F.col("started_at"), F.coalesce("seen_at", "started_at"))
    return latest.join(seen, "session", "left").select("session", "task", last.alias("last_at")).where(F.col("last_at") < now_ms - quiet_ms)


def newest(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n newest rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("_k") <= n).drop("_k")


def file_reads(events: DataFrame) -> DataFrame:
    return events.where("node is not null").groupBy("node").agg(F.count_if(F.col("kind") == "read").alias("reads"), F.max("ts").alias("last_at"))


def since_last(events: DataFrame, mark: str) -> DataFrame:
    """Events after the last one of kind `mark` in their session; all if there is none."""
    last = events.groupBy("session").agg(F.max(F.when(F.col("kind") == mark, F.struct("ts", "seq"))).alias("m"))
    return events.join(last, "session").where("m is null or struct(ts, seq) > m").drop("m")


def as_of(facts: DataFrame, marks: DataFrame, key: str, value: str) -> DataFrame:
    """facts(key, ts, ...) with the latest mark's value at or before each: union and a running last, one sort for each key and no range join."""
    left = facts.withColumn("_tag", F.lit(1)).withColumn(value, F.lit(None).cast(marks.schema[value].dataType))
    right = marks.select(key, "ts", F.col("seq").alias("_seq"), value).withColumn("_tag", F.lit(0))
    both = left.withColumn("_seq", F.lit(None).cast("long")).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("ts", "_tag", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_tag = 1").drop("_tag", "_seq")
