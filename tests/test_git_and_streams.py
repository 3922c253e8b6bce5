"""A small repository read by the git program; streams whose rows come late, repeat, or stop."""

from __future__ import annotations

import datetime
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from workmap.functions.scalar import is_plain
from workmap.sources import git, history
from workmap.streaming import live

EVENTS = "seq long, session long, ts timestamp, kind string, node long"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    if not shutil.which("git"):
        pytest.skip("no git program here")
    at = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-C", str(at), "-c", "user.name=Ann", "-c", "user.email=a@b.c", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True, timeout=60)

    run("init", "-q")
    (at / "a.py").write_text("one\ntwo\nthree\n")
    run("add", ".")
    run("commit", "-q", "-m", "Add a (#12)\n\nBecause.\n")
    (at / "a.py").rename(at / "b.py")
    (at / "c.py").write_text("x\n")
    run("add", "-A")
    run("commit", "-q", "-m", "Fix typo")
    (at / "b.py").write_text("one\nnew\nthree\n")
    run("commit", "-q", "-a", "-m", "Change two")
    (at / "d.py").write_text("y\n")
    return str(at)


def test_history_of_a_repository(spark, repo):
    rows = git.log(spark, repo, days=10_000).collect()
    assert sorted((r.place, r.path, r.renamed_from) for r in rows) == [(0, "b.py", None), (1, "b.py", "a.py"), (1, "c.py", None), (2, "a.py", None)]
    oids = {r.place: r.oid for r in rows}
    assert git.head(repo) == oids[0] and git.log(spark, repo, since=oids[1], days=10_000).count() == 1
    runs = sorted((r.first, r.last, r.oid) for r in git.blame(spark, repo, "b.py").collect())
    assert runs == [(1, 1, oids[2]), (2, 2, oids[0]), (3, 3, oids[2])]
    assert [(r.path, r.state) for r in git.uncommitted(spark, repo).collect()] == [("d.py", "??")]
    cards = {r.oid: (r.kind, r.pull_request, r.reason) for r in history.cards(git.commits(spark, repo, [oids[2], oids[1]])).collect()}
    assert cards == {oids[2]: ("normal", 12, "Because."), oids[1]: ("trivial", None, None)}


def at(seconds: int) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def stream(spark, tmp_path, *files):
    """A stream that takes one file a batch, in the order given."""
    import time

    for k, rows in enumerate(files):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k < len(files) - 1 else 0)
    return live.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENTS).schema, files=1)


def run(spark, tmp_path, s, mode="append"):
    return live.to_table(s, str(tmp_path / "table"), str(tmp_path / "state"), mode)


def test_late_rows_are_waited_for_so_long(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 1, at(0), "read", 1), (2, 1, at(1000), "read", 1)], [(3, 1, at(985), "read", 1)], [(4, 1, at(100), "read", 1)], [(5, 1, at(5000), "read", 1)], [(6, 1, at(9000), "read", 1)])
    got = run(spark, tmp_path, live.sessions(s, "60 seconds", late="30 seconds"))
    # what comes 15 s late still counts; what comes 900 s late, when the watermark has been past it for a batch, does not
    assert sorted((r.started_at, r.events) for r in got.collect())[:2] == [(at(0), 1), (at(985), 2)]


def test_tasks_over_batches_and_quiet(spark, tmp_path):
    s = stream(
        spark,
        tmp_path,
        [(1, 1, at(0), "prompt", None), (2, 1, at(5), "edit", 4), (3, 2, at(6), "edit", 4)],
        [(4, 1, at(20), "prompt", None), (5, 1, at(25), "read", 4), (6, 1, at(26), "stop", None), (7, 2, at(30), "prompt", None)],
        [(8, 3, at(5000), "read", 1)],
        [(9, 3, at(6000), "read", 1)],
    )
    got = run(spark, tmp_path, live.tasks(s, 60_000, late="10 seconds"))
    assert sorted((r.session, r.opened, r.closed, r.how, r.events) for r in got.collect()) == [(1, 1, 4, "next_prompt", 2), (1, 4, 6, "stop", 2), (2, 7, None, "quiet", 1)]


def test_positions_expire_once(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 1, at(0), "read", 7), (2, 1, at(10), "edit", 7)], [(3, 1, at(4000), "read", 8)], [(4, 1, at(4001), "read", 9)])
    got = run(spark, tmp_path, live.expired(s, {"read": 600_000, "edit": 1_800_000}, late="10 seconds"))
    ends = [(r.node, r.mode, r.until) for r in got.collect()]
    assert ends == [(7, "edit", int(at(1810).replace(tzinfo=datetime.UTC).timestamp() * 1000))]


def test_a_second_run_adds_nothing(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 1, at(0), "read", 7), (2, 1, at(10), "edit", 7)])
    assert run(spark, tmp_path, s).count() == 2 and run(spark, tmp_path, s).count() == 2


def test_plain_text(spark):
    texts = ["plain", "tab\tand\nline", "zero​width", "bell\x07", "<system-reminder>x", "a < b"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(is_plain(F.col("t"))).collect()] == [True, True, False, False, False, True]
