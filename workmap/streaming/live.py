"""Streams of events: sessions, bursts, deduplication, held positions, attribution of changes.

Streams have columns seq, session, ts (a timestamp), kind, node. Late rows are waited for as long as the
watermark says; state is dropped behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long late rows are waited for; a path is quiet after this; a burst is so many changes in so long.
LATE, QUIET, BURST_WINDOW, BURST = "30 seconds", "200 milliseconds", "2 seconds", 500
#: A change seen on disk belongs to an event of its file from so long before it to so long after.
BEFORE, AFTER = "30 seconds", "2 seconds"


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """(session, started_at, ended_at, events): a session's rows with no gap as long as `gap`."""
    windowed = events.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return windowed.select("session", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


def quiet_paths(changes: DataFrame, quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """A changed path once it has been quiet: its changes in a row count as one."""
    w = changes.withWatermark("ts", late).groupBy("node", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("changes"))
    return w.select("node", F.col("w.end").alias("quiet_at"), "changes")


def bursts(changes: DataFrame, window: str = BURST_WINDOW, most: int = BURST, late: str = LATE) -> DataFrame:
    """Windows with more changes than are worth following one by one."""
    w = changes.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("changes"))
    return w.where(F.col("changes") > most).select(F.col("w.start").alias("started_at"), "changes")


def once(rows: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def positions(events: DataFrame) -> DataFrame:
    """(session, node, mode, until): of a session's reads and edits of a node the one that holds longest, 10 and 30 minutes.

    A running aggregate: its state is one row for each session and node.
    """
    until = F.col("ts") + F.when(F.col("kind") == "edit", F.expr("interval 30 minutes")).otherwise(F.expr("interval 10 minutes"))
    held = events.where("kind in ('read', 'edit') and node is not null").withColumn("until", until)
    best = held.groupBy("session", "node").agg(F.max(F.struct("until", "ts", "seq", "kind")).alias("p"))
    return best.select("session", "node", F.col("p.kind").alias("mode"), F.col("p.until").alias("until"))


#: Events of a task that its state remembers the nodes of; past them only counts go on.
REMEMBERED = 4096


def tasks(events: DataFrame, quiet_ms: int, late: str = LATE) -> DataFrame:
    """(session, opened, closed, how, events): a prompt opens a task and closes the one before, a stop closes it, and so does quiet: a session without events for quiet_ms of event time.

    The state of a session is its open task, a row of five numbers; it times out by the watermark, so it never outlives the
    session. Rows of a batch are taken in the order of time, and a closed task is given out once.
    """
    state = "opened long, last long, n long, nodes long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        session = int(key[0])
        if held.hasTimedOut:
            opened, last, n, _ = held.get
            held.remove()
            yield pd.DataFrame([(session, opened, None, "quiet", n)], columns=["session", "opened", "closed", "how", "events"])
            return
        now = tuple(held.get) if held.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for seq, ms, kind in zip(rows["seq"], rows["ts"].astype("datetime64[ms]").astype("int64"), rows["kind"], strict=True):
            if kind in ("prompt", "stop") and now is not None:
                out.append((session, now[0], int(seq), "next_prompt" if kind == "prompt" else "stop", now[2]))
                now = None
            if kind == "prompt":
                now = (int(seq), int(ms), 1, 0)
            elif now is not None and kind != "stop":
                now = (now[0], max(now[1], int(ms)), now[2] + 1, min(now[3] + 1, REMEMBERED))
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update(now)
            held.setTimeoutTimestamp(max(now[1] + quiet_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "opened", "closed", "how", "events"]).astype({"session": "int64", "opened": "int64", "closed": "Int64", "events": "int64"})

    e = events.withWatermark("ts", late).select("session", "seq", "ts", "kind")
    return e.groupBy("session").applyInPandasWithState(run, "session long, opened long, closed long, how string, events long", state, "append", GroupStateTimeout.EventTimeTimeout)


def expired(events: DataFrame, holds: dict[str, int], late: str = LATE) -> DataFrame:
    """(session, node, mode, until): positions whose time is over. Of a session's events on a node that follow each other while it is held, the one that holds longest counts; its state lives until then and goes.

    A position is a session window whose gap is what each event holds for, so its state is one row, kept by Spark itself.
    """
    gap = F.coalesce(*[F.when(F.col("kind") == k, f"{ms} milliseconds") for k, ms in holds.items()])
    until = F.unix_millis("ts") + F.coalesce(*[F.when(F.col("kind") == k, ms) for k, ms in holds.items()])
    e = events.where(F.col("kind").isin(*holds) & F.col("node").isNotNull()).withWatermark("ts", late)
    w = e.groupBy("session", "node", F.session_window("ts", gap).alias("w")).agg(F.max(F.struct(until.alias("until"), F.unix_millis("ts").alias("at"), "seq", "kind")).alias("p"))
    return w.select("session", "node", F.col("p.kind").alias("mode"), F.col("p.until").alias("until"))


def attributed(changes: DataFrame, events: DataFrame, before: str = BEFORE, after: str = AFTER, late: str = LATE) -> DataFrame:
    """Changes with the events of their node in the window around them, both streams bounded by their watermarks; the caller keeps the latest."""
    # a change lies in one stretch of time as long as the window, an event in those of all changes it can belong to, two at most
    span = F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {before}") + F.expr(f"interval {after}")) + 1
    c = changes.withWatermark("ts", late).select(F.col("seq").alias("change"), F.col("node").alias("changed"), F.col("ts").alias("at"))
    c = c.withColumn("slot", F.floor(F.unix_millis("at") / span))
    e = events.withWatermark("ts", late).select("session", "node", "ts")
    slots = [F.floor(F.unix_millis(t) / span) for t in (F.col("ts") - F.expr(f"interval {after}"), F.col("ts") + F.expr(f"interval {before}"))]
    e = e.withColumn("reached", F.explode(F.array_distinct(F.array(*slots))))
    near = (F.col("changed") == F.col("node")) & (F.col("slot") == F.col("reached")) & (F.col("ts") >= F.col("at") - F.expr(f"interval {before}")) & (F.col("ts") <= F.col("at") + F.expr(f"interval {after}"))
    return c.join(e, near, "leftOuter").select("change", "changed", "at", "session", "ts")


def event_stream(spark: SparkSession, pattern: str, schema, files: int = 16) -> DataFrame:
    """A stream over parquet files of events, `files` of them in each batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over what is there and reads its result: each batch replaces (complete) or adds to (append) the table, keyed by the batch, so that a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
