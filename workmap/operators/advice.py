"""What to say after an edit, a run or a failure: warnings by rule, notes, hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workmap.functions.scalar import link_share

#: The rules in the order in which they are told, what each asks for, and how much is told.
RULES = ("cochange", "call_site", "test", "origin")
MIN_CONFIDENCE, MIN_COCHANGES, MIN_LINK_WEIGHT, MIN_LINK_TASKS, MIN_CALL_SITE, MOST_CALL_SITES, MOST_TESTS, MOST_PER_EDIT = 0.5, 3, 1.0, 3, 0.8, 5, 3, 3
#: Longest file a read hint leaves alone; most tests a narrow run names.
HINTED_ABOVE, MOST_HINTED, MOST_NARROW = 600, 3, 3
WARNING = ["edit", "task", "kind", "target", "strength"]


def untouched(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows whose target the task hasn't touched; touched(task, target)."""
    return rows.join(touched, ["task", "target"], "left_anti")


def cochange_companions(edits: DataFrame, partners: DataFrame, linked: DataFrame, touched: DataFrame) -> DataFrame:
    """Files that usually change with an edited one, by history (sure both ways and often enough) or else by work done together, not touched in the task.

    edits(edit, task, node); partners(node, target, confidence, reverse, together, commits); linked(node, target, weight, tasks).
    """
    often = (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("reverse") >= MIN_CONFIDENCE) & (F.col("together") >= MIN_COCHANGES) & (F.col("together") <= F.col("commits"))
    by_history = partners.where(often).select("node", "target", F.col("confidence").alias("strength"), F.lit(0).alias("by"))
    by_work = linked.where((F.col("weight") >= MIN_LINK_WEIGHT) & (F.col("tasks") >= MIN_LINK_TASKS)).select("node", "target", link_share(F.col("weight")).alias("strength"), F.lit(1).alias("by"))
    found = edits.join(by_history.unionByName(by_work), "node").where("node <> target")
    once = untouched(found, touched).groupBy("edit", "task", "target").agg(F.max_by("strength", F.struct(-F.col("by"), F.col("strength"))).alias("strength"))
    return once.withColumn("kind", F.lit("cochange")).select(*WARNING)


def call_site_drifts(drifts: DataFrame, sites: DataFrame, touched: DataFrame) -> DataFrame:
    """Files with sure references to a definition whose signature an edit changed: drifts(edit, task, node, symbol), sites(symbol, target, line, confidence).

    At most MOST_CALL_SITES sites of a definition are told, the surest first.
    """
    open_ = untouched(drifts.join(sites.where(F.col("confidence") >= MIN_CALL_SITE), "symbol").where("node <> target"), touched)
    order = Window.partitionBy("edit", "symbol").orderBy(F.desc("confidence"), "target", "line")
    told = open_.withColumn("k", F.row_number().over(order)).where(F.col("k") <= MOST_CALL_SITES)
    return told.groupBy("edit", "task", "target").agg(F.max("confidence").alias("strength")).withColumn("kind", F.lit("call_site")).select(*WARNING)


def test_companions(edits: DataFrame, tests: DataFrame, touched: DataFrame, warned: DataFrame) -> DataFrame:
    """An edited file's own tests that the task hasn't touched, once a task; tests(node, target, confidence), warned(task) had such a warning before."""
    open_ = untouched(edits.join(tests, "node").where("node <> target"), touched).join(warned, "task", "left_anti")
    order = Window.partitionBy("edit").orderBy(F.desc("confidence"), "target")
    return open_.withColumn("k", F.row_number().over(order)).where(F.col("k") <= MOST_TESTS).select("edit", "task", F.lit("test").alias("kind"), "target", F.col("confidence").alias("strength"))


def edit_origins(replaced: DataFrame, runs: DataFrame, cards: DataFrame) -> DataFrame:
    """The commit that owns most of the lines that an edit replaced, if it is a normal one that names an issue or touched a test.

    replaced(edit, task, node, lo, hi), runs(node, first, last, oid), cards(oid, at, kind, has_issue, has_test); of equal
    shares the newer commit, then the greater id.
    """
    owned = replaced.join(runs, "node").where("first <= hi and last >= lo").withColumn("lines", F.least("last", "hi") - F.greatest("first", "lo") + 1)
    sums = owned.groupBy("edit", "task", "node", "lo", "hi", "oid").agg(F.sum("lines").alias("lines"))
    told = sums.join(cards.where("kind = 'normal' and (has_issue or has_test)"), "oid")
    best = told.groupBy("edit", "task", "node", "lo", "hi").agg(F.max(F.struct("lines", "at", "oid")).alias("b"))
    return best.select("edit", "task", F.lit("origin").alias("kind"), F.col("node").alias("target"), (F.col("b.lines") / (F.col("hi") - F.col("lo") + 1)).alias("strength"), F.col("b.oid").alias("oid"))


def told(warnings: DataFrame, most: int = MOST_PER_EDIT) -> DataFrame:
    """The warnings that are told after an edit: in the rules' order, then the strongest, at most `most`."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(RULES)], F.lit(len(RULES)))
    order = Window.partitionBy("edit").orderBy(rank, F.desc(F.round("strength", 9)), "target")
    return warnings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def redundant_runs(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Runs of a command that the session ran before with no change of sources since: runs(session, seq, ts, command), changes(session, seq, ts).

    Changes are counted along the session; equal counts at two runs in a row mean that nothing changed between them.
    """
    both = runs.select("session", "seq", "ts", "command").unionByName(changes.select("session", "seq", "ts", F.lit(None).cast("string").alias("command")))
    so_far = F.sum(F.col("command").isNull().cast("int")).over(Window.partitionBy("session").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    marked = both.withColumn("changed", so_far).where("command is not null")
    before = Window.partitionBy("session", "command").orderBy("ts", "seq")
    return marked.withColumn("last_seq", F.lag("seq").over(before)).withColumn("last_changed", F.lag("changed").over(before)).where("last_changed = changed").select("session", "seq", "command", "last_seq")


def grounded(frames: DataFrame, files: DataFrame) -> DataFrame:
    """frames(failure, pos, path, line) that end in one indexed file's path which is unchanged: files(file, path, unchanged)."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    # a frame's path may be longer (from the root) or shorter (from a folder) than the indexed one
    shorter = frames.join(files.select("file", "unchanged", F.explode(ends).alias("path")), "path").select("failure", "pos", "line", "file", "unchanged")
    longer = frames.select("failure", "pos", "line", F.explode(ends).alias("path")).join(files, "path").select("failure", "pos", "line", "file", "unchanged")
    by = shorter.unionByName(longer).groupBy("failure", "pos", "line").agg(F.count_distinct("file").alias("n"), F.min("file").alias("file"), F.bool_and("unchanged").alias("unchanged"))
    return by.where("n = 1 and unchanged").select("failure", "pos", "line", "file")


def narrow_tests(edits: DataFrame, named: DataFrame, importing: DataFrame, edited: DataFrame, most: int = MOST_NARROW) -> DataFrame:
    """(task, test, why): tests that are worth running alone: named for an edited file, then importing one, then edited themselves; each once, by its first reason."""
    parts = [(named, 0, "named"), (importing, 1, "importing")]
    rows = edited.select("task", "test", F.lit(2).alias("rank"), F.lit("edited").alias("why"))
    for tests, rank, why in parts:
        rows = rows.unionByName(edits.join(tests, "node").select("task", "test", F.lit(rank).alias("rank"), F.lit(why).alias("why")))
    best = rows.groupBy("task", "test").agg(F.min(F.struct("rank", "why")).alias("b"))
    order = Window.partitionBy("task").orderBy("b.rank", "test")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("task", "test", F.col("b.why").alias("why"), "place")


def read_hints(reads: DataFrame, earlier: DataFrame, parts: DataFrame) -> DataFrame:
    """What to say before a read(read, session, file, lo, hi, lines): the range was read before, else parts of a long file that work orders named.

    earlier(session, file, first, last, read) are ranges read before; parts(file, part).
    """
    before = reads.join(earlier.select("session", "file", "first", "last", F.col("read").alias("e")), ["session", "file"]).where("e < read and first <= lo and hi <= last")
    known = before.select("read").distinct().withColumn("known", F.lit(True))
    top = parts.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("part"))).where(F.col("k") <= MOST_HINTED).groupBy("file").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    j = reads.join(known, "read", "left").join(top, "file", "left")
    kind = F.when(F.col("known"), "already_read").when((F.col("lines") > HINTED_ABOVE) & F.col("parts").isNotNull(), "parts")
    return j.withColumn("hint", kind).where("hint is not null").select("read", "hint", F.when(F.col("hint") == "parts", F.array_join(F.transform("parts", lambda p: p.cast("string")), ",")).alias("parts"))


def unfollowed(warnings: DataFrame, touched: DataFrame) -> DataFrame:
    """Call-site warnings whose file wasn't touched after them, as a task stops: warnings(task, kind, target, ts), touched(task, target, ts)."""
    last = touched.groupBy("task", "target").agg(F.max("ts").alias("last"))
    j = warnings.where("kind = 'call_site'").join(last, ["task", "target"], "left")
    return j.where("last is null or last <= ts").select("task", "target").distinct()


def experience(records: DataFrame, files: DataFrame, most: int = 200) -> DataFrame:
    """(query, task, common): the newest of the last `most` records(task, at, file) that shares half or more of the files(query, file) looked at."""
    newest = records.select("task", "at").distinct().orderBy(F.desc("at"), F.desc("task")).limit(most)
    n = files.groupBy("query").agg(F.count_distinct("file").alias("n"))
    held = records.join(newest, ["task", "at"], "left_semi").select("task", "at", "file").distinct()
    common = files.select("query", "file").distinct().join(held, "file").groupBy("query", "task", "at").agg(F.count("*").alias("common")).join(n, "query").where("2 * common >= n")
    best = common.groupBy("query").agg(F.max(F.struct("common", "at", "task")).alias("b"))
    return best.select("query", "b.task", "b.common")
