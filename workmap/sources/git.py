"""A repository's history by the git program: log listings, work tree, blame, commit texts.

The program's output is text that the parsers of `readers` and `history` read. A window bounds what is asked for, so what passes
through the driver is bounded, too; histories that are longer come as listings in files, read by Spark.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workmap.sources import history, readers

#: The window of a mining: commits, days.
MOST_COMMITS, MOST_DAYS = 20_000, 730


def _git(folder: str, *args: str, timeout: int = 120) -> str:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, timeout=timeout, check=True)
    return done.stdout.decode("utf-8", "replace")


def log(spark: SparkSession, folder: str, since: str | None = None, most: int = MOST_COMMITS, days: int = MOST_DAYS) -> DataFrame:
    """(oid, parents, at, path, renamed_from, place): changes of first-parent commits, newest first, with renames; `since` leaves out what a commit can reach."""
    span = [f"{since}..HEAD"] if since else []
    text = _git(folder, "-c", "core.quotePath=false", "log", "--first-parent", "-M", "--name-status", f"--max-count={most}", f"--since={days} days ago", "--format=%x00%H %P|%ct", *span)
    records = [r for r in text.split("\0") if r.strip()]
    listing = spark.createDataFrame([(k, "\0" + r) for k, r in enumerate(records)], "place long, value string")
    commits = readers.commits_of_listing(listing.select("value"))
    return commits.join(listing.select("place", F.substring("value", 2, 40).alias("oid")), "oid")


def head(folder: str) -> str:
    return _git(folder, "rev-parse", "HEAD").strip()


def uncommitted(spark: SparkSession, folder: str) -> DataFrame:
    return history.uncommitted(spark.createDataFrame([(_git(folder, "-c", "core.quotePath=false", "status", "--porcelain"),)], "text string"))


def blame(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Runs of lines of one file, (file, oid, first, last, source)."""
    return history.blame_runs(spark.createDataFrame([(path, _git(folder, "blame", "--line-porcelain", "--", path))], "file string, text string"))


def commits(spark: SparkSession, folder: str, oids: list[str]) -> DataFrame:
    """(oid, author, subject, body, n_files) of some commits, as cards are made from."""
    rows = []
    for oid in oids:
        author, subject, body = (_git(folder, "show", "-s", "--format=%an%x00%s%x00%b", oid).rstrip("\n").split("\0") + ["", ""])[:3]
        files = _git(folder, "show", "--format=", "--name-only", oid).split("\n")
        rows.append((oid, author, subject, body, sum(map(bool, files))))
    return spark.createDataFrame(rows, "oid string, author string, subject string, body string, n_files int")
