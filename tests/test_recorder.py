"""Bounded states, claims, bursts, shedding, growing files: hand-made rows, late rows in other batches, restarts."""

from __future__ import annotations

import datetime
import random
import time

import pandas as pd
import pytest

from workmap.sources import growing
from workmap.streaming import live, recorder

EVENTS = "repo long, session long, seq long, ts timestamp, kind string, node long"
T0 = datetime.datetime(2024, 1, 1)


def at(seconds: float) -> datetime.datetime:
    return T0 + datetime.timedelta(seconds=seconds)


def stream(spark, folder, *files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1 if k < len(files) - 1 else 0)
    return live.event_stream(spark, str(folder), spark.createDataFrame([], EVENTS).schema, files=1)


def run(spark, tmp_path, s):
    with recorder.state_store(spark):
        return [tuple(r) for r in live.to_table(s, str(tmp_path / "table"), str(tmp_path / "state"), "append").collect()]


END = [(9, 9, 10_000, at(90_000), "read", 1)], [(9, 9, 10_001, at(99_000), "read", 1)]


class Held:
    """A state's stand-in that remembers how large it ever was."""

    def __init__(self):
        self.rows, self.most = {}, 0

    def _grew(self):
        self.most = max(self.most, len(self.rows))

    def get(self):
        return self.rows.get("value") if "value" in self.rows else iter(self.rows.get("list", []))

    def iterator(self):
        return iter(list(self.rows.items()))

    def put(self, rows):
        self.rows = {"list": rows}
        self.most = max(self.most, len(rows))

    def update(self, value):
        self.rows = {"value": value}

    def clear(self):
        self.rows = {}

    def updateValue(self, key, value):  # noqa: N802
        self.rows[key] = value
        self._grew()

    def removeKey(self, key):  # noqa: N802
        self.rows.pop(key, None)


class Value(Held):
    def get(self):
        return self.rows.get("value")


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getListState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, Held())

    def getMapState(self, name, key, value):  # noqa: N802
        return self.states.setdefault(name, Held())

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, Value())

    def registerTimer(self, at_ms):  # noqa: N802
        self.timers.add(at_ms)

    def deleteTimer(self, at_ms):  # noqa: N802
        self.timers.discard(at_ms)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_a_recorder_state_stays_under_its_bounds():
    handle, r = Handle(), random.Random(1)
    own = recorder.Recorder(most_sessions=5, most_rows=3, quiet_ms=50_000)
    own.init(handle)
    out = []
    for batch in range(200):
        rows = [(batch * 1000 + k, batch * 10 + k, r.randrange(40), r.choice(["prompt", "read", "read", "edit"]), 1) for k in range(10)]
        frame = pd.DataFrame(rows, columns=["ts", "seq", "session", "kind", "node"])
        frame["ts"] = pd.to_datetime(frame["ts"], unit="ms")
        out += [x for f in own.handleInputRows((1,), iter([frame]), Clock(batch * 1000)) for x in f.itertuples(index=False)]
        assert sum(t > batch * 1000 for t in handle.timers) <= 1
    assert handle.states["known"].most <= 5 and handle.states["waiting"].most <= 20
    assert {x.how for x in out} >= {"evicted", "next_prompt"} and all(x.kept == min(x.events, 3) for x in out)
    for f in own.handleExpiredTimer((1,), Clock(10**9), None):
        assert "quiet" in set(f["how"])
    assert not handle.states["known"].rows and not handle.states["waiting"].rows


def test_tasks_end_for_room_quiet_and_prompts_whatever_batch_rows_come_in(spark, tmp_path):
    rows = [(1, s, k, at(k), kind, 1) for k, (s, kind) in enumerate([(1, "prompt"), (1, "read"), (2, "prompt"), (3, "prompt"), (1, "edit"), (2, "read"), (1, "prompt"), (4, "prompt"), (3, "read"), (3, "prompt")])]
    expected = sorted([(1, 1, 0, 3, "evicted", 2, 2), (1, 2, 2, 4, "evicted", 1, 1), (1, 3, 3, 5, "evicted", 1, 1), (1, 1, 6, 8, "evicted", 1, 1), (1, 4, 7, None, "quiet", 1, 1), (1, 3, 9, None, "quiet", 1, 1)], key=str)
    mixed = [rows[::2], rows[1::2]]  # the second file's rows come late, but not behind the watermark
    for k, files in enumerate(([rows], mixed)):
        s = stream(spark, tmp_path / f"in{k}", *files, *END)
        got = [x for x in run(spark, tmp_path / str(k), recorder.record(s, 3_600_000, most_sessions=2, most_rows=2, late="60 seconds")) if x[0] == 1]
        assert sorted(got, key=str) == expected


def test_changes_are_claimed_once_or_go_to_the_latest_session(spark, tmp_path):
    changes = [(1, 0, 1, at(10), "check", 5), (1, 0, 2, at(40), "check", 5), (1, 0, 3, at(100), "check", 6), (1, 0, 4, at(500), "check", 7), (1, 0, 5, at(200), "check", 8)]
    events = [(1, 7, 11, at(11.5), "edit", 5), (1, 8, 12, at(9), "edit", 5), (1, 9, 13, at(13), "edit", 5), (1, 8, 14, at(39), "read", 1), (1, 6, 15, at(75), "read", 1), (1, 5, 16, at(99), "edit", 5), (1, 4, 17, at(99), "prompt", None), (1, 3, 18, at(202), "read", 2), (2, 2, 19, at(500), "edit", 7)]
    expected = [(1, 1, 5, 8, "claimed"), (1, 2, 5, 8, "latest"), (1, 3, 6, 4, "latest"), (1, 4, 7, None, "nobody"), (1, 5, 8, 3, "latest")]
    for k, files in enumerate(([changes + events], [changes[:3], events, changes[3:]])):
        s = stream(spark, tmp_path / f"in{k}", *files, *END)
        found = recorder.owned(s.where("kind = 'check'"), s.where("kind <> 'check'"), late="600 seconds")
        assert sorted(run(spark, tmp_path / str(k), found), key=str) == expected


def test_many_paths_at_once_are_one_change_to_everything(spark, tmp_path):
    few = [(1, 1, k, at(1 + k / 100), "edit", k % 3) for k in range(10)]
    many = [(1, 1, 100 + k, at(20 + k / 100), "edit", k) for k in range(40)] + [(2, 1, 200, at(20), "edit", 1), (2, 1, 201, at(20), "edit", None)]
    s = stream(spark, tmp_path / "in", few[:5] + many[:20], few[5:] + many[20:], *END)
    got = run(spark, tmp_path, recorder.collapsed(s, 2000, 5, late="60 seconds"))
    ms = int(T0.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    assert sorted((x for x in got if x[0] != 9), key=str) == sorted([(1, ms, 0, 4), (1, ms, 1, 3), (1, ms, 2, 3), (1, ms + 20_000, None, 40), (2, ms + 20_000, 1, 1)], key=str)


def shed(rows, most):
    """A queue of `most` places, event by event."""
    waiting, dropped = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        if len(waiting) >= most:
            soft = next((x for x in waiting if x[4] in recorder.YIELDING), None)
            gone = r if r[4] in recorder.YIELDING or soft is None else soft
            dropped[gone[4]] = dropped.get(gone[4], 0) + 1
            if gone is r:
                continue
            waiting.remove(gone)
        waiting.append(r)
    return {x[2] for x in waiting}, dropped


@pytest.mark.parametrize("share", [0.2, 0.8])
def test_reads_give_way_as_in_a_queue(spark, tmp_path, share):
    r = random.Random(3)
    rows = [(1, 1, k, at(k // 3), r.choice(["read", "search"]) if r.random() < share else r.choice(["edit", "prompt"]), 1) for k in range(90)]
    r.shuffle(rows)
    for most in (1, 20):
        s = stream(spark, tmp_path / f"in{most}", rows[:50], rows[50:], *END)
        got = [x for x in run(spark, tmp_path / str(most), recorder.admitted(s, 3_600_000, most, late="600 seconds")) if x[0] == 1]
        kept, dropped = shed(rows, most)
        assert {x[3] for x in got if x[3] is not None} == kept and {x[2]: x[4] for x in got if x[3] is None} == dropped


def tailed(spark, tmp_path, **options):
    s = spark.readStream.format("growing_lines").options(**options).load(str(tmp_path / "logs"))
    return sorted((r.path.rsplit("/", 1)[1], r.at, r.line) for r in live.to_table(s, str(tmp_path / "table"), str(tmp_path / "state"), "append").collect())


def test_lines_of_growing_files_come_once(spark, tmp_path):
    growing.register(spark)
    logs = tmp_path / "logs"
    (logs / "deep").mkdir(parents=True)
    (logs / "a.log").write_bytes("één\ntwo\nthr".encode())
    (logs / "deep" / "b.log").write_bytes(b"x" * 200_000)
    (logs / "_c.log").write_bytes(b"hidden\n")
    first = [("a.log", 0, "één"), ("a.log", 6, "two")]
    assert tailed(spark, tmp_path, pieceBytes=4) == first
    assert tailed(spark, tmp_path, pieceBytes=4) == first  # nothing new: an unfinished line waits
    with (logs / "a.log").open("ab") as f:
        f.write(b"ee\r\n\nlast")
    with (logs / "deep" / "b.log").open("ab") as f:
        f.write(b"y\nz\n")
    (logs / "d.log").write_bytes(b"new\n")
    more = [("a.log", 10, "three"), ("a.log", 17, ""), ("b.log", 0, "x" * 200_000 + "y"), ("b.log", 200_002, "z"), ("d.log", 0, "new")]
    assert tailed(spark, tmp_path, pieceBytes=50_000) == sorted(first + more)
    (logs / "d.log").write_bytes(b"n\n")  # shorter: another file
    assert tailed(spark, tmp_path) == sorted([*first, *more, ("d.log", 0, "n")])


def test_files_that_come_change_and_go(spark, tmp_path):
    growing.register(spark)
    watched = tmp_path / "watched"
    watched.mkdir()

    def changes():
        s = spark.readStream.format("changed_files").load(str(watched))
        got = live.to_table(s, str(tmp_path / "table"), str(tmp_path / "state"), "append")
        return sorted((r.path.rsplit("/", 1)[1], r.change, r.size) for r in got.collect())

    (watched / "a").write_text("1")
    (watched / "b").write_text("22")
    assert changes() == [("a", "created", 1), ("b", "created", 2)]
    (watched / "a").write_text("333")
    (watched / "b").unlink()
    (watched / ".hidden").write_text("x")
    assert changes() == [("a", "changed", 3), ("a", "created", 1), ("b", "created", 2), ("b", "removed", None)]
