"""Receipts: which task a response belongs to, what it cost, why a cache broke, how sure a comparison is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.operators import snapshot

#: How long a cache lives, by what was written; shares of tokens that make a break; tasks an arm needs to be compared.
FIVE_MINUTES, ONE_HOUR, ARM_TASKS = 300_000, 3_600_000, 30
#: The reasons for which a response has no price, in the order in which they are looked at.
UNPRICED = ("model", "tier", "region", "cache_split", "speed")
RATES = ("input", "write_5m", "write_1h", "read", "output")


def held_by_task(usage: DataFrame, tasks: DataFrame) -> DataFrame:
    """usage(session, ts, ...) with `task`: the latest task(session, task, started_at, ended_at) that began at or before it, unless that had ended before."""
    named = snapshot.as_of(usage, tasks.select("session", "started_at", "task"), "session", "ts", "started_at", "task")
    ends = tasks.select("task", F.col("ended_at").alias("_end"))
    joined = named.join(ends, "task", "left")
    return joined.withColumn("task", F.when(F.col("_end").isNull() | (F.col("_end") >= F.col("ts")), F.col("task"))).drop("_end")


def tallied(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Turns and tokens by kind; input counts cumulatively, cached or not, and by itself."""
    total = F.col("input") + F.col("cache_write") + F.col("cache_read")
    return usage.groupBy(*keys).agg(F.count("*").alias("turns"), F.sum(total).alias("cumulative_input"), F.sum("input").alias("uncached_input"), F.sum("cache_read").alias("cache_reads"), F.sum("cache_write").alias("cache_writes"), F.sum("output").alias("output"))


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """rows(model, tier, speed, geo, input, cache_write, cache_write_1h, cache_read, output) with picodollars, exact, or why there are none.

    prices(model, standard, fast, long, above, us_per_mille): rates are structs of picodollars a token. A fast response has rates of
    its own; a standard one whose whole prompt is over `above` tokens has the long prompt's. A dated model's id is looked up
    without its date where it has no price itself. The table of prices is joined as Spark sees fit for its size.
    """
    p = prices.select(F.col("model").alias("priced_as"), F.struct(*[c for c in prices.columns if c != "model"]).alias("p"))
    known = prices.select(F.col("model"), F.lit(True).alias("own"))
    bare = F.regexp_extract("model", r"^(.*)-[0-9]{8}$", 1)
    r = rows.join(known, "model", "left").withColumn("priced_as", F.when(F.col("own"), F.col("model")).otherwise(bare)).join(p, "priced_as", "left")
    hour = F.when(F.col("cache_write_1h") <= F.col("cache_write"), F.col("cache_write_1h")).when(F.col("cache_write_1h").isNull() & (F.col("cache_write") == 0), 0)
    per_mille = F.when(F.col("geo") == "global", 1000).when(F.col("geo") == "us", F.col("p.us_per_mille"))
    is_fast = F.coalesce(F.col("speed") == "fast", F.lit(False))
    speed_known = F.coalesce(F.col("speed").isin("standard", "fast"), F.lit(False)) & (~is_fast | F.col("p.fast").isNotNull())
    problems = (F.col("p").isNull(), ~F.col("tier").eqNullSafe("standard"), per_mille.isNull(), hour.isNull(), ~speed_known)
    why = F.coalesce(*[F.when(bad, name) for bad, name in zip(problems, UNPRICED, strict=True)])
    prompt = F.col("input") + F.col("cache_write") + F.col("cache_read")
    is_long = ~is_fast & F.coalesce(prompt > F.col("p.above"), F.lit(False))

    def rate(name: str) -> Column:
        return F.when(is_fast, F.col("p.fast")[name]).when(is_long, F.col("p.long")[name]).otherwise(F.col("p.standard")[name]).cast("decimal(12,0)")

    tokens = {"input": F.col("input"), "write_5m": F.col("cache_write") - hour, "write_1h": hour, "read": F.col("cache_read"), "output": F.col("output")}
    total = sum((tokens[k].cast("decimal(20,0)") * rate(k) for k in RATES[1:]), tokens["input"].cast("decimal(20,0)") * rate("input"))
    cost = F.floor(total * per_mille / 1000).cast("decimal(38,0)")
    return r.withColumn("unpriced", why).withColumn("picodollars", F.when(F.col("unpriced").isNull(), cost)).drop("own", "priced_as", "p")


def cache_breaks(usage: DataFrame, compactions: DataFrame, texts: DataFrame) -> DataFrame:
    """(session, turn, cause) of responses that rebuilt their cache: another model, a compaction between, a gap longer than the cache lives, a text given between, or unknown.

    usage(session, turn, ts, model, cache_write, cache_write_1h, cache_read); compactions and texts(session, at). The cache lives
    an hour if all that the session wrote to it so far was written for an hour, else five minutes.
    """
    w = Window.partitionBy("session").orderBy("turn", "ts")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.col("cache_write") > 0
    short = wrote & ~F.col("cache_write_1h").eqNullSafe(F.col("cache_write"))
    u = usage.select("*", F.lag("cache_read").over(w).alias("read0"), F.lag("ts").over(w).alias("ts0"), F.lag("model").over(w).alias("model0"), F.max(wrote).over(before).alias("wrote0"), F.max(short).over(before).alias("short0"))
    broken = u.where((F.col("cache_write") * 2 > F.col("cache_write") + F.col("cache_read")) & (F.col("cache_read") * 2 < F.col("read0")))

    def between(times: DataFrame, name: str) -> DataFrame:
        hit = broken.select("session", "turn", "ts0", "ts").join(times, "session").where("at >= ts0 and at <= ts").select("session", "turn").distinct()
        return hit.withColumn(name, F.lit(True))

    lives = F.when(F.col("wrote0") & ~F.col("short0"), ONE_HOUR).otherwise(FIVE_MINUTES)
    j = broken.join(between(compactions, "compacted"), ["session", "turn"], "left").join(between(texts, "told"), ["session", "turn"], "left")
    cause = F.when(F.col("model") != F.col("model0"), "model_switch").when(F.col("compacted"), "compaction").when(F.col("ts") - F.col("ts0") > lives, "idle_gap").when(F.col("told"), "hook_text")
    return j.select("session", "turn", cause.alias("cause"))


def replicates(rows: DataFrame, ident: str, n: int) -> DataFrame:
    """rows once for each replicate `r` of n, with how often each counts in it: a Poisson count by a hash of id and replicate."""
    each = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(ident).cast("string"), F.col("r").cast("string"))), 1, 8), 16, 10).cast("long") % 1_000_000
    times = F.when(u < 367_879, 0).when(u < 735_759, 1).when(u < 919_699, 2).when(u < 981_012, 3).when(u < 996_340, 4).otherwise(5)
    return each.withColumn("times", times)


def mean_interval(rows: DataFrame, ident: str, value: str, n: int = 200) -> DataFrame:
    """The middle 95 % of a mean's bootstrap replicates; each replicate is a sum in one pass."""
    means = replicates(rows.select(ident, value), ident, n).groupBy("r").agg(F.try_divide(F.sum(F.col("times") * F.col(value)), F.sum("times")).alias("m"))
    return means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def ratio_interval(rows: DataFrame, ident: str, value: str, arm: str, n: int = 200) -> DataFrame:
    """The middle 95 % of the ratio of two arms' means, of rows where `arm` is true over the others."""
    by = replicates(rows.select(ident, value, arm), ident, n).groupBy("r").agg(
        F.try_divide(F.sum(F.when(F.col(arm), F.col("times") * F.col(value))), F.sum(F.when(F.col(arm), F.col("times")))).alias("a"),
        F.try_divide(F.sum(F.when(~F.col(arm), F.col("times") * F.col(value))), F.sum(F.when(~F.col(arm), F.col("times")))).alias("b"),
    )
    ratios = by.select(F.try_divide("a", "b").alias("m"))
    return ratios.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def compared(tasks: DataFrame, arm: str, done: str, value: str) -> DataFrame:
    """One row for each arm: tasks, how many were done, the median of a value; and whether both arms have tasks enough to say anything."""
    by = tasks.groupBy(F.col(arm).alias("arm")).agg(F.count("*").alias("tasks"), F.count_if(done).alias("done"), F.median(value).alias("median"))
    least = by.agg(F.min("tasks").alias("least"), F.count("*").alias("arms"))
    return by.crossJoin(F.broadcast(least)).select("arm", "tasks", "done", F.round("median", 4).alias("median"), ((F.col("arms") == 2) & (F.col("least") >= ARM_TASKS)).alias("enough"))
