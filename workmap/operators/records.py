"""Snapshots of keyed rows, intervals, resolution of names, metering and coordination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- snapshots
def latest(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Upsert: of each key the row of the greatest version."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*version))).where("_k = 1").drop("_k")


def latest_known(rows: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """Upsert that keeps stored values where new ones are missing."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in values], F.max(version).alias(version))


def within_cap(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """Retention: the first `cap` rows of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")


def guarded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose both ends exist."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


# ---------------------------------------------------------------- intervals
def overlapping(spans: DataFrame, asked: DataFrame, key: str, width: int) -> DataFrame:
    """spans(key, first, last, ...) that overlap asked(key, lo, hi), by equal buckets of `width`, each pair once: in its first common bucket."""
    a = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    b = asked.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return a.join(b, [key, "_b"]).where("first <= hi and last >= lo").where(F.col("_b") == F.greatest(F.floor(F.col("first") / width), F.floor(F.col("lo") / width))).drop("_b")


def covered_length(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the union of intervals [first, last] of each key: gaps and islands."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("_new", (F.coalesce(reach, F.col("first") - 2) < F.col("first")).cast("int"))
    islands = new.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = islands.groupBy(*keys, "_i").agg((F.max("last") - F.min("first") + 1).alias("n"))
    return one.groupBy(*keys).agg(F.sum("n").alias("covered"), F.count("*").alias("islands"))


# ---------------------------------------------------------------- names
def resolve(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs(ref, file, family, name) tied to names(symbol, file, family, name): unique in the file, else unique in the family; a name that is ambiguous in its file stays untied."""
    here = names.groupBy("file", "name").agg(F.count("*").alias("n_file"), F.min("symbol").alias("in_file"))
    wide = names.groupBy("family", "name").agg(F.count("*").alias("n_family"), F.min("symbol").alias("in_family"))
    tied = refs.join(here, ["file", "name"], "left").join(wide, ["family", "name"], "left")
    target = F.when(F.col("n_file") == 1, F.col("in_file")).when(F.col("n_file").isNull() & (F.col("n_family") == 1), F.col("in_family"))
    how = F.when(F.col("n_file") == 1, "same_file").when(F.col("n_file").isNull() & (F.col("n_family") == 1), "name_only")
    return tied.select("ref", target.alias("symbol"), how.alias("resolution"))


def matched(old: DataFrame, new: DataFrame, keys: list[str], order: str, ident: str) -> DataFrame:
    """k-th with k-th of equal keys; unmatched rows of either side stay."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    a, b = old.select(*keys, k.alias("k"), F.col(ident).alias("old")), new.select(*keys, k.alias("k"), F.col(ident).alias("new"))
    return a.join(b, [*keys, "k"], "full_outer")


# ---------------------------------------------------------------- metering
def fork_dedup(usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """A response counts in the earliest session that has it (of equal starts the smaller id); rows without a response all count, as do repeats inside one session."""
    u = usage.join(sessions, "session")
    named = u.where("response is not null")
    first = named.groupBy("response").agg(F.min(F.struct("started_at", "session")).alias("f"))
    # rows without a response are apart, so that they don't meet in one task
    kept = named.join(first, "response").where("struct(started_at, session) = f").select(*u.columns)
    return kept.unionByName(u.where("response is null"))


def picodollars(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Exact cost of rows(model, tier, speed, geo, input, cache_write, cache_write_1h, cache_read, output), or why there is none.

    A model is looked up by its id, else without a date of 8 digits behind its last dash.
    """
    exact = prices.select(F.col("model").alias("m1"), F.struct(*[c for c in prices.columns if c != "model"]).alias("p1"))
    dated = prices.select(F.col("model").alias("m2"), F.struct(*[c for c in prices.columns if c != "model"]).alias("p2"))
    undated = F.regexp_extract("model", r"^(.*)-[0-9]{8}$", 1)
    r = rows.join(exact, F.col("model") == F.col("m1"), "left").join(dated, undated == F.col("m2"), "left").withColumn("p", F.coalesce("p1", "p2")).drop("m1", "p1", "m2", "p2")
    hour = F.when(F.col("cache_write_1h") <= F.col("cache_write"), F.col("cache_write_1h")).when(F.col("cache_write_1h").isNull() & (F.col("cache_write") == 0), 0)
    per_mille = F.when(F.col("geo") == "global", 1000).when(F.col("geo") == "us", F.col("p.us_per_mille"))
    why = (
        F.when(F.col("p").isNull(), "model")
        .when(~F.col("tier").eqNullSafe("standard"), "tier")
        .when(per_mille.isNull(), "region")
        .when(hour.isNull(), "cache_split")
        .when(~F.coalesce(F.col("speed").isin("standard", "fast"), F.lit(False)), "speed")
        .when((F.col("speed") == "fast") & F.col("p.fast_per_mille").isNull(), "speed")
    )
    speed = F.when(F.col("speed") == "fast", F.col("p.fast_per_mille")).otherwise(1000)

    def cost(tokens: Column, rate: str) -> Column:
        return tokens.cast("decimal(20,0)") * F.col(f"p.{rate}").cast("decimal(12,0)")

    total = cost(F.col("cache_write") - hour, "write_5m") + cost(hour, "write_1h") + cost(F.col("input"), "input") + cost(F.col("cache_read"), "read") + cost(F.col("output"), "output")
    scaled = F.floor(total * speed * per_mille / 1_000_000).cast("decimal(38,0)")
    return r.withColumn("picodollars", F.when(why.isNull(), scaled)).withColumn("unpriced", why).drop("p")


def cache_breaks(usage: DataFrame) -> DataFrame:
    """Responses that wrote more than half of their cached tokens anew and read less than half of what the one before read."""
    w = Window.partitionBy("session").orderBy("turn", "ts")
    u = usage.withColumn("read_before", F.lag("cache_read").over(w))
    return u.where((F.col("cache_write") * 2 > F.col("cache_write") + F.col("cache_read")) & (F.col("cache_read") * 2 < F.col("read_before"))).drop("read_before")


# ---------------------------------------------------------------- coordination
#: How long positions hold, what counts as live, and how near two edits of a file are.
MINUTE = 60_000
READ_MS, EDIT_MS, AFTER_TASK_MS, CLAIM_MS, LIVE_MS, SAME_FILE_MS = 10 * MINUTE, 30 * MINUTE, 5 * MINUTE, 120 * MINUTE, 15 * MINUTE, 10 * MINUTE
#: A slot of time in which edits meet positions.
SLOT_MS = 1_800_000


def until(mode: Column, last: Column, task_ended: Column) -> Column:
    edit = last + EDIT_MS
    return F.when(mode == "read", last + READ_MS).when(mode == "claim", last + CLAIM_MS).otherwise(F.least(edit, F.coalesce(task_ended + AFTER_TASK_MS, edit)))


def concerned(edits: DataFrame, positions: DataFrame, seen: DataFrame, couplings: DataFrame) -> DataFrame:
    """Other live sessions that hold the edited node or one coupled to it, the best reason of each."""
    same = edits.select("edit", "session", "at", "node", F.col("node").alias("held"), F.lit(2).alias("rank"))
    near = edits.join(couplings.select(F.col("src").alias("node"), F.col("dst").alias("held")), "node").select("edit", "session", "at", "node", "held", F.lit(1).alias("rank"))
    p = positions.select(F.col("session").alias("other"), F.col("node").alias("held"), "mode", "last", until(F.col("mode"), F.col("last"), F.col("task_ended")).alias("until"))
    # an edit lies in one slot of time, a position in all that it is held in: a node's edits don't meet all its positions
    slots = F.sequence(F.floor(F.col("last") / SLOT_MS), F.floor((F.col("until") - 1) / SLOT_MS))
    p = p.where("last < until").withColumn("slot", F.explode(slots))
    found = same.unionByName(near).withColumn("slot", F.floor(F.col("at") / SLOT_MS)).join(p, ["held", "slot"]).where("other <> session and last <= at and at < until").drop("slot")
    live = found.join(seen.select(F.col("session").alias("other"), "ts"), "other").where(F.col("ts").between(F.col("at") - LIVE_MS + 1, F.col("at"))).select(*found.columns).distinct()
    best = Window.partitionBy("edit", "other").orderBy(F.desc("rank"), "held")
    return live.withColumn("k", F.row_number().over(best)).where("k = 1").select("edit", "other", "held", F.when(F.col("rank") == 2, "same").otherwise("coupled").alias("via"))
