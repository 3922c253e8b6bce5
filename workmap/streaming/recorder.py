"""Stateful operators of the recorder, each with a bound on its state: open tasks, changes on disk and who made them, bursts, shedding.

Streams have columns repo, session, seq, ts (a timestamp), kind, node. A repository is the unit: its rows meet in one state.
Rows wait in the state until the watermark has passed them, so they are taken in the order of time whatever batches they came in,
and results are those of the same rows in one batch. What comes behind the watermark is dropped.
"""

from __future__ import annotations

import bisect
import contextlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from workmap.streaming.live import LATE

#: Sessions that a recorder knows, rows that it keeps of a task, paths of a window that are worth following one by one, events that may wait, what gives way first.
MOST_SESSIONS, MOST_ROWS, MOST_PATHS, MOST_WAITING, YIELDING = 1000, 4096, 500, 10_000, ("read", "search")
#: Fixed values, in ms: how long a change is held for an edit that claims it; from when on a session's events count for it.
HELD, BEFORE = 2_000, 30_000
#: Rows that a task sorts at once, that it reads of each sorted run, and that it hands on.
RUN, CHUNK, PIECE = 200_000, 2_000, 50_000
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which states of several columns and timers need."""
    name, provider = _PROVIDER
    was = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def _millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ms]").astype("int64")


class _InOrder(StatefulProcessor):
    """Rows of a key wait in the state until the watermark has passed them; `take` gets them in the order of time, then `seq`.

    A few rows that come wait as they are; more wait in runs: sorted, a run for RUN rows, in chunks of CHUNK rows. Runs are merged as
    they are read, so a task holds a run that is being filled, a chunk of each other, and the PIECE rows that `take` gets at
    once. One timer a key wakes it when the next row, or what `due` says, is behind the watermark.
    """

    row = "ts long, seq long, session long, kind string, node long"
    fields = pa.schema([("ts", pa.int64()), ("seq", pa.int64()), ("session", pa.int64()), ("kind", pa.string()), ("node", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.runs = handle.getMapState("runs", "run long", "since long, first long, after long")
        self.chunks = handle.getMapState("chunks", "run long, chunk long", "rows binary")
        self.timer = handle.getValueState("timer", "at long")
        self.more_state(handle)

    def more_state(self, handle: StatefulProcessorHandle) -> None: ...

    def take(self, key: tuple, rows: list[tuple], now: int) -> list[tuple]:
        """What follows from all rows until `now`: those given before, and these."""

    def due(self) -> int | None:
        """When the key must be woken though no row waits."""

    columns: list[str]

    def _put(self, rows: pa.Table, run: int) -> None:
        """A run of rows in any order."""
        rows = rows.sort_by([("ts", "ascending"), ("seq", "ascending")])
        for k, at in enumerate(range(0, rows.num_rows, CHUNK)):
            self._put_chunk(run, k, rows.slice(at, CHUNK))
        self.runs.updateValue((run,), (rows["ts"][0].as_py(), 0, -(-rows.num_rows // CHUNK)))

    def _put_chunk(self, run: int, chunk: int, rows: pa.Table) -> None:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.fields) as writer:
            writer.write_table(rows.combine_chunks())
        self.chunks.updateValue((run, chunk), (out.getvalue().to_pybytes(),))

    def _passed(self, run: int, now: int) -> Iterator[tuple]:
        """A run's rows until `now`, in order; they leave the state."""
        _, first, after = self.runs.getValue((run,))
        for chunk in range(first, after):
            rows = pa.ipc.open_stream(self.chunks.getValue((run, chunk))[0]).read_all()
            n = int(np.searchsorted(rows["ts"].to_numpy(), now, side="right"))
            yield from zip(*(c.to_pylist() for c in rows.slice(0, n).columns), strict=True)
            if n < rows.num_rows:
                if n:
                    self._put_chunk(run, chunk, rows.slice(n))
                self.runs.updateValue((run,), (rows["ts"][n].as_py(), chunk, after))
                return
            self.chunks.removeKey((run, chunk))
        self.runs.removeKey((run,))

    def _since(self) -> dict[int, int]:
        """Each run's time of its first row."""
        return {k[0]: v[0] for k, v in self.runs.iterator()}

    def _woken(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        few = sorted(map(tuple, self.waiting.get()), key=lambda r: (r[0], r[1]))
        cut = next((k for k, r in enumerate(few) if r[0] > now), len(few))
        passed = [self._passed(run, now) for run, since in sorted(self._since().items()) if since <= now]
        rows: list[tuple] = []
        for row in heapq.merge(few[:cut], *passed, key=lambda r: (r[0], r[1])):
            if len(rows) >= PIECE and row[0] > rows[-1][0]:
                yield pd.DataFrame(self.take(key, rows, rows[-1][0]), columns=self.columns)
                rows = []
            rows.append(row)
        yield pd.DataFrame(self.take(key, rows, now), columns=self.columns)
        self.waiting.clear()
        if few[cut:]:
            self.waiting.put(few[cut:])
        times = [t for t in (*(r[0] for r in few[cut : cut + 1]), *self._since().values(), self.due()) if t is not None]
        old = self.timer.get()
        if old is not None and old[0] > now:
            self.handle.deleteTimer(old[0])
        self.timer.clear()
        if times:
            at = max(min(times), now + 1)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        run = max(self._since(), default=-1) + 1
        held: list[pa.Table] = []
        for frame in rows:
            parts = [_millis(frame["ts"]), frame["seq"], frame["session"], frame["kind"], frame["node"]]
            new = pa.table([pa.array(x, f.type, from_pandas=True) for x, f in zip(parts, self.fields, strict=True)], schema=self.fields)
            held.append(new.filter(pc.greater_equal(new["ts"], now)))
            if sum(x.num_rows for x in held) >= RUN:
                self._put(pa.concat_tables(held), run)
                held, run = [], run + 1
        n = sum(x.num_rows for x in held)
        if 0 < n <= CHUNK - len(few := [*map(tuple, self.waiting.get())]):
            self.waiting.clear()
            self.waiting.put(few + [r for x in held for r in zip(*(c.to_pylist() for c in x.columns), strict=True)])
        elif n:
            self._put(pa.concat_tables(held), run)
        held.clear()
        yield from self._woken(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._woken(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None: ...


class Recorder(_InOrder):
    """Open tasks of the sessions that were active last; see `record`."""

    columns = ["repo", "session", "opened", "closed", "how", "events", "kept"]

    def __init__(self, most_sessions: int, most_rows: int, quiet_ms: int):
        self.most_sessions, self.most_rows, self.quiet = most_sessions, most_rows, quiet_ms

    def more_state(self, handle):
        self.known = handle.getMapState("known", "session long", "last long, place long, opened long, events long")

    def take(self, key, rows, now):
        repo = int(key[0])
        held = {k[0]: tuple(v) for k, v in self.known.iterator()}
        order = sorted(held, key=lambda s: held[s][:2])  # the one touched longest ago first
        known = {s: held[s] for s in order}
        out: list[tuple] = []

        def ended(session: int, closed: int | None, how: str) -> None:
            _, _, opened, n = known.pop(session)
            if opened is not None:
                out.append((repo, session, opened, closed, how, n, min(n, self.most_rows)))

        def quiet(at: int) -> None:
            while known and (first := next(iter(known))) is not None and known[first][0] + self.quiet <= at:
                ended(first, None, "quiet")

        for ts, seq, session, kind, _ in rows:
            quiet(ts)
            _, _, opened, n = known.get(session, (0, 0, None, 0))
            if kind == "prompt":
                if session in known:
                    ended(session, seq, "next_prompt")
                opened, n = seq, 0
            known.pop(session, None)
            known[session] = (ts, seq, opened, n + (opened is not None))
            if len(known) > self.most_sessions:
                ended(next(iter(known)), seq, "evicted")
        quiet(now)
        for session in held.keys() - known.keys():
            self.known.removeKey((session,))
        for session, value in known.items():
            if held.get(session) != value:
                self.known.updateValue((session,), value)
        self.next_quiet = min((v[0] for v in known.values()), default=None)
        return out

    def due(self):
        return None if self.next_quiet is None else self.next_quiet + self.quiet


def record(events: DataFrame, quiet_ms: int, most_sessions: int = MOST_SESSIONS, most_rows: int = MOST_ROWS, late: str = LATE) -> DataFrame:
    """(repo, session, opened, closed, how, events, kept): tasks as they end, from events of all sessions.

    A prompt opens a task and ends the session's one before (`next_prompt`); a session without events for quiet_ms is forgotten
    (`quiet`), and so is the one touched longest ago when more than most_sessions of a repository are known (`evicted`). `kept` is
    how many of a task's rows its state holds a place for, most_rows at most; `events` counts them all. A repository's state is
    a row for each known session and the rows that wait for the watermark.
    """
    e = events.withWatermark("ts", late).select("repo", "session", "seq", "ts", "kind", "node")
    out = "repo long, session long, opened long, closed long, how string, events long, kept long"
    return e.groupBy("repo").transformWithStateInPandas(Recorder(most_sessions, most_rows, quiet_ms), out, "append", "EventTime")


class Watcher(_InOrder):
    """Changes seen on disk, until it is known whose they are; see `owned`."""

    columns = ["repo", "change", "node", "session", "how"]

    def __init__(self, held_ms: int, before_ms: int):
        self.held, self.before = held_ms, before_ms

    def more_state(self, handle):
        self.near = handle.getListState("near", self.row)

    def take(self, key, rows, now):
        """What has been passed is kept as long as a change may ask for it."""
        near = sorted([*map(tuple, self.near.get()), *rows])
        changes = [r for r in near if r[3] == "change"]
        ready = [r for r in changes if r[0] + self.held <= now]
        others = [r for r in near if r[3] != "change"]
        first: dict[int, int] = {}  # of the events of one time the first session; times ascend, as rows do
        edits: dict[int | None, dict[int, tuple]] = {}  # of a file's edits of one time the first
        for r in others if ready else ():
            first[r[0]] = min(first.get(r[0], r[2]), r[2])
            if r[3] == "edit":
                edits.setdefault(r[4], {}).setdefault(r[0], r)
        times, edited = list(first), {node: list(at) for node, at in edits.items()}
        out = []
        for ts, seq, _, _, node in ready:
            own = edited.get(node, [])
            k = bisect.bisect_left(own, ts)
            claims = [(abs(t - ts), t) for t in own[max(k - 1, 0) : k + 1] if abs(t - ts) <= self.held]
            k = bisect.bisect_right(times, ts + self.held) - 1
            if claims:
                session, how = edits[node][min(claims)[1]][2], "claimed"
            elif k >= 0 and times[k] >= ts - self.before:
                session, how = first[times[k]], "latest"
            else:
                session, how = None, "nobody"
            out.append((int(key[0]), seq, node, session, how))
        open_ = [r for r in changes if r[0] + self.held > now]
        since = min([now, *(r[0] for r in open_)]) - self.before - self.held
        kept = [*open_, *(r for r in others if r[0] >= since)]
        self.near.clear()
        if kept:
            self.near.put(kept)
        self.next_due = min((r[0] + self.held for r in open_), default=None)
        return out

    def due(self):
        return self.next_due


def owned(changes: DataFrame, events: DataFrame, held_ms: int = HELD, before_ms: int = BEFORE, late: str = LATE) -> DataFrame:
    """(repo, change, node, session, how): each change on disk once, held for held_ms of event time.

    The nearest edit of its file within held_ms claims it (`claimed`; of equally near ones the earlier); else it is the session's
    with the latest event from before_ms before it to held_ms after it (`latest`; of equally late ones the first by id); else
    nobody's. Both streams are one, keyed by repository; state reaches back before_ms + held_ms from the oldest open change.
    """
    c = changes.select("repo", F.lit(-1).cast("long").alias("session"), "seq", "ts", F.lit("change").alias("kind"), "node")
    both = c.unionByName(events.select("repo", "session", "seq", "ts", "kind", "node")).withWatermark("ts", late)
    return both.groupBy("repo").transformWithStateInPandas(Watcher(held_ms, before_ms), "repo long, change long, node long, session long, how string", "append", "EventTime")


def collapsed(changes: DataFrame, window_ms: int = 2000, most: int = MOST_PATHS, late: str = LATE) -> DataFrame:
    """(repo, since, node, changes): the changed paths of each window of time, or one row without a path where they are over `most`: everything changed.

    The gate holds a window's distinct paths, most + 1 of them at most, until the watermark has passed its end. Windows without
    changes give nothing; `changes` counts all rows of a path or of the window.
    """
    state = "nodes array<long>, counts array<long>, changes long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["repo", "since", "node", "changes"]
        repo, slot = int(key[0]), int(key[1])
        if held.hasTimedOut:
            nodes, counts, n = held.get
            held.remove()
            rows = [(repo, slot, None, n)] if len(nodes) > most else [(repo, slot, a, b) for a, b in zip(nodes, counts, strict=True)]
            yield pd.DataFrame(rows, columns=columns).astype({"node": "Int64"})
            return
        nodes, counts, n = held.get if held.exists else ([], [], 0)
        now = dict(zip(nodes, counts, strict=True))
        for frame in frames:
            n += len(frame)
            for node, k in frame["node"].value_counts().items():
                if node in now or len(now) <= most:
                    now[int(node)] = now.get(int(node), 0) + int(k)
        held.update((list(now), list(now.values()), n))
        held.setTimeoutTimestamp(max(slot + window_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=columns).astype({"repo": "int64", "since": "int64", "node": "Int64", "changes": "int64"})

    slot = (F.floor(F.unix_millis("ts") / window_ms) * window_ms).cast("long")
    c = changes.where("node is not null").withWatermark("ts", late).select("repo", slot.alias("since"), "ts", "node")
    return c.groupBy("repo", "since").applyInPandasWithState(run, "repo long, since long, node long, changes long", state, "append", GroupStateTimeout.EventTimeTimeout)


def admitted(events: DataFrame, slot_ms: int, most: int = MOST_WAITING, yielding: tuple[str, ...] = YIELDING, late: str = LATE) -> DataFrame:
    """(repo, since, kind, seq, n): what a writer takes of each slot of time, `most` events at most, and what was dropped, counted.

    Reads and searches give way: one that comes when `most` events wait is dropped, and the oldest waiting one makes room for any
    other event. Only when all that wait are others does one of those go. Admitted events have a seq and n = 1; dropped ones are a row
    for each kind without. A slot's state is twice `most` events and a count for each kind: the first of all, among which
    are the reads that could stay, and the first of the others.
    """
    state = "ts array<long>, seq array<long>, kind array<string>, kinds array<string>, counts array<long>"

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["repo", "since", "kind", "seq", "n"]
        repo, slot = int(key[0]), int(key[1])
        ts, seq, kind, kinds, counts = held.get if held.exists else ([], [], [], [], [])
        rows, seen = list(zip(ts, seq, kind, strict=True)), dict(zip(kinds, counts, strict=True))
        if held.hasTimedOut:
            others = [r for r in rows if r[2] not in yielding][:most]
            soft = [r for r in rows[:most] if r[2] in yielding]
            kept = sorted(others + soft[max(0, len(soft) - (most - len(others))) :])
            for r in kept:
                seen[r[2]] -= 1
            held.remove()
            out = [(repo, slot, r[2], r[1], 1) for r in kept] + [(repo, slot, k, None, n) for k, n in seen.items() if n]
            yield pd.DataFrame(out, columns=columns).astype({"seq": "Int64"})
            return
        for frame in frames:
            for k, n in frame["kind"].value_counts().items():
                seen[k] = seen.get(k, 0) + int(n)
            new = zip(_millis(frame["ts"]).tolist(), frame["seq"].tolist(), frame["kind"].tolist(), strict=True)
            rows = sorted([*rows, *new])
            # of the rows, the first of all and the first of those that don't give way; a read's place among all is lost with no row before it
            others = 0
            kept = []
            for place, r in enumerate(rows):
                others += r[2] not in yielding
                if place < most or (r[2] not in yielding and others <= most):
                    kept.append(r)
            rows = kept
        columns_ = [list(x) for x in zip(*rows, strict=True)] or [[], [], []]
        held.update((*columns_, list(seen), list(seen.values())))
        held.setTimeoutTimestamp(max(slot + slot_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=columns).astype({"repo": "int64", "since": "int64", "kind": "object", "seq": "Int64", "n": "int64"})

    slot = (F.floor(F.unix_millis("ts") / slot_ms) * slot_ms).cast("long")
    e = events.withWatermark("ts", late).select("repo", slot.alias("since"), "ts", "seq", "kind")
    return e.groupBy("repo", "since").applyInPandasWithState(run, "repo long, since long, kind string, seq long, n long", state, "append", GroupStateTimeout.EventTimeTimeout)
