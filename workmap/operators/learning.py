"""What finished tasks teach: earned interest, roles, links and their take-back, outcomes, episodes, calibration, facts, approaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.functions.scalar import LINK_DECAY, decayed
from workmap.operators import learn

#: Interest earned by what was done; shares of a definition's interest that its file and folder get.
EDIT, PASSED, READ_RANGE, READ_FILE, GIVEN_USED, HIT_OPENED, HIT_UNOPENED = 1.0, 0.5, 0.4, 0.3, 0.3, 0.2, 0.05
FILE_SHARE, FOLDER_SHARE = 0.5, 0.25
#: What a reverted task takes from its links; the least alike claims that are one fact; days until a doubt retires it.
REVERTED, SAME_CLAIM, RETIRE_DAYS = -0.05, 0.8, 14
#: Labelled rows that a model is fitted on, what part of them is held out, rows of either label and the quality it must have to be kept.
WINDOW, HELD_OUT, LEAST_EACH, LEAST_AUC = 2000, 5, 20, 0.6


# ---------------------------------------------------------------- interest
def interest_earned(events: DataFrame, given: DataFrame, hits: DataFrame) -> DataFrame:
    """(task, node, folder, symbol, score) of events(task, seq, kind, node, range, passed, folder), given(task, node, span), hits(task, seq, node).

    An edit earns 1, a read 0.4 of a range and 0.3 of a file, a check that passes 0.5 for each file edited before it (once), what was
    given and then used 0.3, a search hit 0.2 if it was opened later and 0.05 if not.
    """
    touched = events.where("kind in ('read', 'edit') and node is not null")
    done = touched.select("task", "node", F.col("range").isNotNull().alias("symbol"), F.when(F.col("kind") == "edit", EDIT).when(F.col("range").isNotNull(), READ_RANGE).otherwise(READ_FILE).alias("score"))
    edits = touched.where("kind = 'edit'").groupBy("task", "node").agg(F.min("seq").alias("first"))
    passes = events.where("kind = 'check' and passed").groupBy("task").agg(F.max("seq").alias("last"))
    passed = edits.join(passes, "task").where("first < last").select("task", "node", F.lit(False).alias("symbol"), F.lit(PASSED).alias("score"))
    opened = touched.groupBy("task", "node").agg(F.max("seq").alias("opened"))
    used = given.join(opened, ["task", "node"]).select("task", "node", F.lit(True).alias("symbol"), F.lit(GIVEN_USED).alias("score"))
    found = hits.join(opened, ["task", "node"], "left").select("task", "node", F.lit(False).alias("symbol"), F.when(F.col("opened") > F.col("seq"), HIT_OPENED).otherwise(HIT_UNOPENED).alias("score"))
    return reduce(DataFrame.unionByName, (passed, used, found), done)


def shared_out(earned: DataFrame, folders: DataFrame) -> DataFrame:
    """(task, kind, id, score): a definition's interest counts half for its file and a quarter for the folder; a file's whole for itself."""
    rows = earned.join(folders, "node")
    parts = F.array(
        F.when(F.col("symbol"), F.struct(F.lit("symbol").alias("kind"), F.col("node").alias("id"), F.col("score").alias("s"))),
        F.struct(F.lit("file").alias("kind"), F.col("node").alias("id"), F.when(F.col("symbol"), F.col("score") * FILE_SHARE).otherwise(F.col("score")).alias("s")),
        F.struct(F.lit("dir").alias("kind"), F.col("folder").alias("id"), (F.col("score") * FOLDER_SHARE).alias("s")),
    )
    return rows.select("task", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("p")).groupBy("task", "p.kind", "p.id").agg(F.sum("p.s").alias("score"))


def sticky_tier(score: Column, was_landmark: Column) -> Column:
    """A landmark stays one until it is dark; others are interesting above 0.2."""
    return F.when(score <= 0.2, "dark").when(was_landmark, "landmark").otherwise("interesting")


def landmarks(scores: DataFrame, files: DataFrame, least: float = 3.0) -> DataFrame:
    """The best scores of `least` or more, a hundredth of the files but 5 to 50: the count is one row beside the ranking's first 50."""
    n = files.agg(F.least(F.greatest(F.ceil(F.count("*") / 100), F.lit(5)), F.lit(50)).alias("most"))
    top = scores.where(F.col("score") >= least).orderBy(F.desc("score"), "node").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "node"))).crossJoin(F.broadcast(n)).where("place <= most").select("node", "score", "place")


# ---------------------------------------------------------------- roles, links, outcomes
def roles(events: DataFrame, given: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, node, role): edited; else read, or given, and next to something the task edited; else read only; edges(src, dst)."""
    edited = events.where("kind = 'edit' and node is not null").select("task", "node").distinct()
    near = edited.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("task", F.col("dst").alias("node")).distinct().withColumn("used", F.lit(True))
    ranks = [(edited, 3), (events.where("kind = 'read' and node is not null"), 2), (given, 1)]
    rows = reduce(DataFrame.unionByName, [d.select("task", "node").distinct().withColumn("r", F.lit(r)) for d, r in ranks]).join(near, ["task", "node"], "left")
    used = F.coalesce("used", F.lit(False))
    rank = F.when(F.col("r") == 3, 3).when((F.col("r") == 2) & used, 2).when((F.col("r") == 1) & used, 1).when(F.col("r") == 2, 0)
    best = rows.withColumn("rank", rank).where("rank is not null").groupBy("task", "node").agg(F.max("rank").alias("rank"))
    return best.select("task", "node", F.element_at(F.array(*map(F.lit, ("read_only", "given_and_used", "read_and_used", "edited"))), F.col("rank") + 1).alias("role"))


def links(roles_: DataFrame, outcomes: DataFrame, most: int = 40) -> DataFrame:
    """(a, b, seq, add): pairs of a task's nodes by their roles and the outcome; a reverted task takes a little from each of its pairs."""
    best = Window.partitionBy("task").orderBy(F.desc(learn.role_weight(F.col("role"))), "node")
    own = roles_.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).join(outcomes, "task")
    gain = F.when(F.col("outcome") == "success", 1.0).when(F.col("outcome") == "unknown", 0.3).when(F.col("outcome") == "reverted", 1.0)
    own = own.select("task", "seq", "node", "outcome", gain.alias("gain"), learn.role_weight(F.col("role")).alias("w")).where("gain is not null")
    a = own.select("task", "seq", "outcome", "gain", F.col("node").alias("a"), F.col("w").alias("wa"))
    b = own.select("task", F.col("node").alias("b"), F.col("w").alias("wb"))
    add = F.when(F.col("outcome") == "reverted", REVERTED).otherwise(F.lit(learn.ETA) * F.col("wa") * F.col("wb") * F.col("gain"))
    return a.join(b, "task").where("a < b").select("a", "b", "seq", add.alias("add"))


def outcome(has_edit: Column, reverted: Column, check_after: Column, passed: Column) -> Column:
    """Reverted before all else; then the last check after the last edit; no edit is abandoned, no check unknown."""
    return F.when(reverted, "reverted").when(~has_edit, "abandoned").when(~check_after, "unknown").when(passed, "success").otherwise("failure")


def reverted_after(edits: DataFrame) -> DataFrame:
    """(task, reverted): whether each file that a task edited was back as before by the end of the session's next task; edits(task, next_task, file, before, after_next)."""
    return edits.groupBy("task").agg(F.bool_and(F.col("before").eqNullSafe(F.col("after_next"))).alias("reverted"))


def taken_back(steps: DataFrame, now, factor: float = LINK_DECAY) -> DataFrame:
    """(src, dst, weight): gains of steps(src, dst, seq, gain, reverted) decayed to now, those of tasks reverted later taken out again; what is spent goes."""
    kept = F.when(F.col("reverted"), 0.0).otherwise(F.col("gain"))
    sums = steps.groupBy("src", "dst").agg(F.sum(decayed(kept, F.col("seq"), now, factor)).alias("weight"), F.count_if(~F.col("reverted")).alias("n"))
    return sums.where("n > 0")


# ---------------------------------------------------------------- episodes, clusters
def episodes(events: DataFrame, most: int = 8) -> DataFrame:
    """(task, episode): what a task looked at, changed and checked, and where checks failed, as JSON with at most `most` of each."""

    def first(kind: str, value: str, extra: Column | None = None) -> Column:
        cond = F.col("kind") == kind
        return F.transform(F.slice(F.array_sort(F.collect_set(F.when(cond if extra is None else cond & extra, F.struct("seq", value)))), 1, most), lambda x: x[value])

    by = events.groupBy("task").agg(first("read", "node").alias("localize"), first("edit", "node").alias("change"), first("check", "node", F.col("passed")).alias("verify"), first("check", "node", ~F.col("passed")).alias("pitfalls"))
    return by.select("task", F.to_json(F.struct("localize", "change", "verify", "pitfalls")).alias("episode"))


def telling(in_cluster: Column, in_all: Column) -> Column:
    """How much a term says about a cluster: its square there over all."""
    return in_cluster * in_cluster / in_all


def model_inputs(features: DataFrame) -> DataFrame:
    """Eight inputs of the model from a question's features; what is unknown is 0 and says so."""
    cols = [
        F.col("top_lexical"), F.col("top_mass"), F.col("agreeing_kinds") / 6, F.col("supporting_kinds") / 6,
        F.coalesce("similar_task", F.lit(0.0)), F.coalesce("recent_precision", F.lit(0.0)), F.col("recent_precision").isNull().cast("double"), F.col("is_continuing").cast("double"),
    ]
    return features.select("query", F.array(*[c.cast("double") for c in cols]).alias("inputs"))


# ---------------------------------------------------------------- calibration
def calibrated(labelled: DataFrame, inputs: list[str], label: str, at: str, window: int = WINDOW) -> dict:
    """A model of the newest `window` labelled rows: the newest fifth is held out; it is kept if either label is there often enough and it ranks the held-out rows well."""
    recent = labelled.orderBy(F.desc(at)).limit(window)
    n = recent.count()
    order = Window.orderBy(F.desc(at))
    rows = recent.withColumn("_k", F.row_number().over(order)).withColumn("_held", F.col("_k") <= max(1, n // HELD_OUT)).persist()
    try:
        counts = rows.groupBy(F.col(label).cast("int").alias("y")).count().collect()
        least = min((r["count"] for r in counts), default=0) if len(counts) > 1 else 0
        w = learn.logistic_fit(rows.where("not _held"), inputs, label)
        z = reduce(Column.__add__, [F.lit(float(v)) * F.col(c).cast("double") for v, c in zip(w[1:], inputs, strict=True)], F.lit(float(w[0])))
        quality = learn.auc(rows.where("_held").select(z.alias("score"), F.col(label).cast("boolean").alias("label"))).first()
    finally:
        rows.unpersist()
    return {"coefficients": w, "rows": n, "auc": quality.auc, "kept": bool(least >= LEAST_EACH and quality.auc is not None and quality.auc >= LEAST_AUC)}


# ---------------------------------------------------------------- facts
def asserted(stored: DataFrame, given: DataFrame, bar: float = SAME_CLAIM) -> DataFrame:
    """(given, fact): the stored fact that a given claim only says again: of those with the same anchors the most alike, at `bar` or more; null for a new one.

    Both have (id, anchors, words). Sets of words that facts of one place share are compared once, and only with sets that have a
    word in common among the rarest of either: sets that are alike at the bar can't differ in all of those.
    """
    key = F.xxhash64(F.array_sort("anchors"))
    a = given.select(F.col("id").alias("given"), key.alias("k"), F.array_sort(F.array_distinct("words")).alias("s"))
    b = stored.select(F.col("id").alias("fact"), key.alias("k"), F.array_sort(F.array_distinct("words")).alias("s")).where("s is not null").groupBy("k", "s").agg(F.min("fact").alias("fact"))
    often = b.select("k", F.explode("s").alias("word")).groupBy("k", "word").agg(F.count("*").alias("n"))

    def rarest(sets: DataFrame) -> DataFrame:
        counted = sets.select("k", "s", F.explode("s").alias("word")).join(often, ["k", "word"], "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")))
        least = F.ceil(F.size("s") * F.lit(bar) - 1e-9).cast("int")
        return counted.groupBy("k", "s").agg(order.alias("o")).select("k", "s", F.explode(F.slice("o", F.lit(1), F.size("s") - least + 1)).alias("o")).select("k", "s", F.col("o.word").alias("word"))

    met = rarest(a.where("s is not null").select("k", "s").distinct()).join(rarest(b.select("k", "s")).withColumnRenamed("s", "v"), ["k", "word"]).select("k", "s", "v").distinct()
    like = F.size(F.array_intersect("s", "v")) / F.size(F.array_union("s", "v"))
    same = met.withColumn("like", like).where(F.col("like") >= bar).join(b.withColumnRenamed("s", "v"), ["k", "v"])
    of_set = same.groupBy("k", "s").agg(F.max(F.struct("like", (-F.col("fact")).alias("minus"))).alias("m"))
    best = a.join(of_set, ["k", "s"]).groupBy("given").agg(F.max("m").alias("m")).select("given", (-F.col("m.minus")).alias("fact"))
    return a.select("given").join(best, "given", "left")


def reviewed(facts: DataFrame, anchors: DataFrame, hashes: DataFrame, now_ms: int) -> DataFrame:
    """(fact, status): facts whose anchors' hashes have drifted become suspect; those suspect for 14 days retire."""
    drift = anchors.join(hashes.withColumnRenamed("hash", "now"), "node", "left").where(~F.col("hash").eqNullSafe(F.col("now"))).select("fact").distinct().withColumn("drifted", F.lit(True))
    old = F.col("changed_at") < now_ms - RETIRE_DAYS * 86_400_000
    status = F.when((F.col("status") == "suspect") & old, "retired").when(F.col("drifted") & F.col("status").isin("approved", "proposed"), "suspect").otherwise(F.col("status"))
    return facts.join(drift, "fact", "left").select("fact", status.alias("status"))


# ---------------------------------------------------------------- approaches, handoffs
def changed_back(edits: DataFrame) -> DataFrame:
    """(task, file): files that a task changed and that end as they began; edits(task, file, seq, before, after)."""
    ends = edits.groupBy("task", "file").agg(F.min_by("before", "seq").alias("first"), F.max_by("after", "seq").alias("last"), F.count("*").alias("n"))
    return ends.where("n > 1 and first = last").select("task", "file")


def persisted_failures(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """(task, signature, runs): a failing signature that stayed the same over two runs or more with an edit between each; runs(task, seq, signature), edits(task, seq)."""
    both = runs.select("task", "seq", "signature").unionByName(edits.select("task", "seq", F.lit(None).cast("string").alias("signature")))
    so_far = F.count_if(F.col("signature").isNull()).over(Window.partitionBy("task").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    r = both.withColumn("changes", so_far).where("signature is not null")
    w = Window.partitionBy("task").orderBy("seq")
    same = r.withColumn("again", (F.lag("signature").over(w) == F.col("signature")) & (F.lag("changes").over(w) < F.col("changes")))
    return same.where("again").groupBy("task", "signature").agg((F.count("*") + 1).alias("runs"))


def handoffs(tasks: DataFrame, events: DataFrame, most: int = 12) -> DataFrame:
    """(task, edited, open): what an unfinished task leaves: the files it edited and those it only read, the newest `most` of each."""
    open_ = tasks.where("outcome is null or outcome = 'unknown'").select("task")
    e = events.join(open_, "task", "left_semi").where("node is not null")
    edited = e.where("kind = 'edit'").groupBy("task", "node").agg(F.max("seq").alias("seq"))
    read = e.where("kind = 'read'").groupBy("task", "node").agg(F.max("seq").alias("seq")).join(edited.select("task", "node"), ["task", "node"], "left_anti")

    def newest(df: DataFrame, name: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("seq")))
        return df.withColumn("k", k).where(F.col("k") <= most).groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias(name))

    return open_.join(newest(edited, "edited"), "task", "left").join(newest(read, "open"), "task", "left").where("edited is not null or open is not null")

