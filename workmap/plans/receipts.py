"""Receipts, prices and comparisons over the store's relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from workmap.functions.scalar import held_out
from workmap.operators import receipts as C
from workmap.plans.adapters import table
from workmap.plans.registry import query
from workmap.plans.relations import statement

_USE = "us as (select o_custkey session, o_orderkey turn, o_orderkey * 104729 % 100003 * 1000 ts, o_orderkey % 700 input, o_orderkey % 300 cache_write, o_orderkey % 911 cache_read, o_orderkey % 97 output from orders)"


def _usage(r):
    k = F.col("o_orderkey")
    return r.table("orders").select(F.col("o_custkey").alias("session"), k.alias("turn"), (k * 104_729 % 100_003 * 1000).alias("ts"), (k % 700).alias("input"), (k % 300).alias("cache_write"), (k % 911).alias("cache_read"), (k % 97).alias("output"))


_HELD = f"{_USE}, hd as (select us.*, arg_max(tasks.task_id, (started_at, tasks.task_id)) t0 from us left join tasks on tasks.session_id = session and started_at <= ts group by all), he as (select hd.*, case when ended_at is null or ended_at >= ts then t0 end task from hd left join tasks on task_id = t0)"


def _held(r):
    t = r.tasks.select(F.col("session_id").alias("session"), F.col("task_id").alias("task"), "started_at", "ended_at")
    return C.held_by_task(_usage(r), t)


@statement(f"with {_HELD} select task, count(*) turns, sum(input + cache_write + cache_read)::bigint cumulative_input, sum(input)::bigint uncached_input, sum(cache_read)::bigint cache_reads, sum(cache_write)::bigint cache_writes, sum(output)::bigint output from he group by 1")
def receipt_asof(r):
    """Tokens of each task by kind; what no task holds is under null."""
    return C.tallied(_held(r), ["task"])


@statement(f"with {_HELD} select session, count(*) filter (where task is not null) held, count(*) filter (where task is null) outside from he group by 1")
def task_holding(r):
    return _held(r).groupBy("session").agg(F.count_if(F.col("task").isNotNull()).alias("held"), F.count_if(F.col("task").isNull()).alias("outside"))


_RATE = "struct<input:bigint,write_5m:bigint,write_1h:bigint,read:bigint,output:bigint>"
#: Invented prices in picodollars a token: standard, fast and long-prompt rates, the size of a long prompt, the factor of one region.
PRICES = [
    ("m-one", (3_000_000, 3_750_000, 6_000_000, 300_000, 15_000_000), (9_000_000, 11_250_000, 18_000_000, 900_000, 45_000_000), (6_000_000, 7_500_000, 12_000_000, 600_000, 22_500_000), 4_000, 1100),
    ("m-two", (800_000, 1_000_000, 1_600_000, 80_000, 4_000_000), None, None, None, None),
]
_PRICED = """select l_partkey, case l_partkey % 4 when 0 then 'm-one' when 1 then 'm-one-20250101' when 2 then 'm-two' else 'other' end model, case when l_partkey % 11 = 0 then 'batch' else 'standard' end tier,
case when l_partkey % 7 = 0 then 'fast' when l_partkey % 13 = 0 then null else 'standard' end speed, case when l_partkey % 5 = 0 then 'us' else 'global' end geo, l_orderkey % 5000 input, l_partkey % 300 cache_write,
case when l_partkey % 3 = 0 then l_partkey % 300 when l_partkey % 3 = 1 then 0 end cache_write_1h, l_suppkey * 10 cache_read, l_linenumber * 100 output from {lines}"""


@statement(f"""with b as ({_PRICED.format(lines='lineitem')}), j as (select *, case when model in ('m-one', 'm-two') then model else regexp_replace(model, '-[0-9]{{8}}$', '') end m from b),
k as (select *, case when cache_write_1h <= cache_write then cache_write_1h when cache_write_1h is null and cache_write = 0 then 0 end h, case geo when 'global' then 1000 when 'us' then case m when 'm-one' then 1100 end end pm, case when speed = 'fast' then 3 when m = 'm-one' and input + cache_write + cache_read > 4000 then 2 else 1 end f from j),
q as (select *, case when m not in ('m-one', 'm-two') then 'model' when tier <> 'standard' then 'tier' when pm is null then 'region' when h is null then 'cache_split' when speed is null or (speed = 'fast' and m = 'm-two') then 'speed' end why from k),
c as (select *, case m when 'm-one' then (input::hugeint * 3000000 + (cache_write - h)::hugeint * 3750000 + h::hugeint * 6000000 + cache_read::hugeint * 300000) * f + output::hugeint * case f when 2 then 22500000 when 3 then 45000000 else 15000000 end
  else input::hugeint * 800000 + (cache_write - h)::hugeint * 1000000 + h::hugeint * 1600000 + cache_read::hugeint * 80000 + output::hugeint * 4000000 end * pm // 1000 pd from q)
select model, coalesce(why, '') unpriced, count(*) turns, coalesce(sum(case when why is null then pd end), 0)::varchar picodollars from c group by 1, 2""")
def cost_long_prompt(r):
    """Exact costs with rates of their own for fast responses and for long prompts."""
    rows = r.table("lineitem")
    rows = r.spark.sql(_PRICED.replace("{lines}", "{rows}"), rows=rows)
    prices = r.spark.createDataFrame(PRICES, f"model string, standard {_RATE}, fast {_RATE}, long {_RATE}, above long, us_per_mille int")
    by = C.priced(rows, prices).groupBy("model", F.coalesce("unpriced", F.lit("")).alias("unpriced"))
    return by.agg(F.count("*").alias("turns"), F.coalesce(F.sum("picodollars"), F.lit(0)).cast("string").alias("picodollars"))


_CALLS = "ca as (select session_id session, seq turn, ts, case when seq % 5 = 0 then 'm2' else 'm1' end model, seq * 7 % 300 cache_write, case when seq % 3 = 0 then seq * 7 % 300 when seq % 2 = 0 then 0 end cache_write_1h, seq * 13 % 500 cache_read from acts where kind in ('read', 'edit', 'check'))"


@statement(f"""with {_CALLS}, l as (select *, lag(cache_read) over w r0, lag(ts) over w ts0, lag(model) over w m0, max((cache_write > 0)::int) over b w0, max((cache_write > 0 and cache_write_1h is distinct from cache_write)::int) over b s0 from ca window w as (partition by session order by turn, ts), b as (partition by session order by turn, ts rows between unbounded preceding and 1 preceding)),
k as (select * from l where cache_write * 2 > cache_write + cache_read and cache_read * 2 < r0)
select session, turn, case when model <> m0 then 'model_switch' when exists (select 1 from acts where kind = 'compact' and session_id = session and acts.ts between ts0 and k.ts) then 'compaction' when ts - ts0 > case when w0 = 1 and s0 = 0 then 3600000 else 300000 end then 'idle_gap' when exists (select 1 from injections where session_id = session and injections.ts between ts0 and k.ts) then 'hook_text' end cause from k""")
def cache_break_causes(r):
    k = F.col("seq")
    calls = r.acts.where("kind in ('read', 'edit', 'check')").select(F.col("session_id").alias("session"), k.alias("turn"), "ts", F.when(k % 5 == 0, "m2").otherwise("m1").alias("model"), (k * 7 % 300).alias("cache_write"), F.when(k % 3 == 0, k * 7 % 300).when(k % 2 == 0, 0).alias("cache_write_1h"), (k * 13 % 500).alias("cache_read"))
    compactions = r.acts.where("kind = 'compact'").select(F.col("session_id").alias("session"), F.col("ts").alias("at"))
    texts = r.injections.select(F.col("session_id").alias("session"), F.col("ts").alias("at"))
    return C.cache_breaks(calls, compactions, texts)


_TIMES = "(('0x' || substr(md5(id || '-' || r), 1, 8))::bigint % 1000000)"
_REPS = f"e as (select *, case when u < 367879 then 0 when u < 735759 then 1 when u < 919699 then 2 when u < 981012 then 3 when u < 996340 then 4 else 5 end t from (select *, {_TIMES} u from (select *, unnest(range(1, 201)) r from v)))"


@query(f"with v as (select doc_id id, quality::double x from labels), {_REPS}, m as (select r, sum(t * x) / nullif(sum(t), 0) m from e group by 1) select round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from m")
def mean_interval(spark, d):
    v = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("x"))
    return C.mean_interval(v, "id", "x").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"with v as (select doc_id id, 1 + quality::double x, doc_id % 3 = 0 arm from labels), {_REPS}, m as (select r, sum(t * x) filter (where arm) / nullif(sum(t) filter (where arm), 0) a, sum(t * x) filter (where not arm) / nullif(sum(t) filter (where not arm), 0) b from e group by 1) select round(quantile_cont(a / b, 0.025), 6) low, round(quantile_cont(a / b, 0.975), 6) high from m")
def ratio_interval(spark, d):
    v = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (1 + F.col("quality").cast("double")).alias("x"), (F.col("doc_id") % 3 == 0).alias("arm"))
    return C.ratio_interval(v, "id", "x", "arm").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("with a as (select *, ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 1000000 < 100000 as h from orders), b as (select h arm, count(*) tasks, count(*) filter (where o_orderstatus = 'F') done, round(median(o_totalprice), 4) median from a group by 1) select *, (select min(tasks) >= 30 and count(*) = 2 from b) enough from b")
def holdout_compared(spark, d):
    """Arms of a hold-out, and whether they have tasks enough."""
    o = table(spark, d, "orders").select(held_out(F.col("o_orderkey"), 0.1).alias("arm"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_totalprice").alias("value"))
    return C.compared(o, "arm", "done", "value")


@statement(f"with {_HELD}, t as (select session, count(*) turns, sum(output)::bigint output from he group by 1) select 'sessions' what, count(*) n, sum(turns)::bigint v from t union all select 'held_out', count(*) filter (where held_out), count(*) from sessions union all select 'used', count(*) filter (where label = 1), count(*) filter (where label is not null) from injections")
def receipts_report(r):
    """The parts of the report: sessions and their turns, arms, what was used of what was labelled."""
    t = _held(r).groupBy("session").agg(F.count("*").alias("turns"))
    one = t.agg(F.count("*").alias("n"), F.sum("turns").alias("v")).select(F.lit("sessions").alias("what"), "n", "v")
    two = r.sessions.agg(F.count_if("held_out").alias("n"), F.count("*").alias("v")).select(F.lit("held_out").alias("what"), "n", "v")
    three = r.injections.agg(F.count_if(F.col("label") == 1).alias("n"), F.count("label").alias("v")).select(F.lit("used").alias("what"), "n", "v")
    return one.unionByName(two).unionByName(three)
