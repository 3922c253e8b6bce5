"""The driver's tables as the engine's relations, in DataFrame operations and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workmap.functions.scalar import epoch_ms
from workmap.operators import activity, cochange
from workmap.operators.scratch import parts_for, written

#: Most files of a commit that says something about pairs.
MAX_FILES = 30


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def commits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"))
    return cochange.numbered(o, F.col("at").cast("date"), ["at", "commit"]).select("commit", "seq")


def commit_lists(spark: SparkSession, d: str, max_files: int = MAX_FILES) -> DataFrame:
    """(seq, files, anchor): what each commit touches, made once; anchor is the newest commit's number, one row joined to all."""
    lines = table(spark, d, "lineitem")
    changes = lines.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))
    lists = written(cochange.commit_lists(changes, commits(spark, d), max_files, parts_for(spark, lines.count())))
    newest = lists.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("anchor"))
    return lists.crossJoin(F.broadcast(newest))


def commit_files(spark: SparkSession, d: str, max_files: int = MAX_FILES) -> DataFrame:
    """(seq, file, anchor), a row for each file that a commit touches."""
    return commit_lists(spark, d, max_files).select("seq", F.explode("files").alias("file"), "anchor")


def anchor(files: DataFrame):
    """The newest commit's number, as commit_files gives it with each row."""
    return F.col("anchor")


COMMITS = f"""
commits as (select o_orderkey c, row_number() over (order by o_orderdate, o_orderkey) seq from orders),
ch as (select distinct l_orderkey c, l_partkey f from lineitem),
cf as (select seq, f from ch join commits using (c) where c in (select c from ch group by 1 having count(*) <= {MAX_FILES})),
a as (select max(seq) a from cf),
fc as (select f, count(*) n, sum(pow(0.5, (a - seq) / 500.0)) w from cf, a group by 1),
pc as (select x.f fa, y.f fb, count(*) n, sum(pow(0.5, (a - x.seq) / 500.0)) w, max(x.seq) s from cf x join cf y on x.seq = y.seq and x.f < y.f, a group by 1, 2)
"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """(seq, session, ts, kind, node, value)"""
    kind = F.when(F.col("event_type").isin("view", "click"), "read").when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "error", "check").otherwise("prompt")
    node = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), epoch_ms("ts").alias("ts"), kind.alias("kind"), node.alias("node"), "value")


EVENTS = """
e as (select event_id seq, user_id session, epoch_us(ts) // 1000 ts, case when event_type in ('view', 'click') then 'read' when event_type = 'purchase' then 'edit' when event_type = 'error' then 'check' else 'prompt' end kind,
  cast(json_extract_string(props, '$.k') as bigint) node, value from events),
et as (select *, sum((kind = 'prompt')::int) over (partition by session order by ts, seq)::bigint task from e)
"""


def tasked(spark: SparkSession, d: str) -> DataFrame:
    return activity.with_tasks(events(spark, d))


def task_numbers(t: DataFrame) -> DataFrame:
    """(session, task, task_seq): tasks numbered by their first event."""
    first = t.where("task > 0").groupBy("session", "task").agg(F.min("ts").alias("at"), F.min("seq").alias("first_seq"))
    return cochange.numbered(first, F.floor(F.col("at") / 86_400_000), ["at", "first_seq"], "task_seq").select("session", "task", "task_seq")


TASKS = EVENTS + """,
tn as (select session, task, row_number() over (order by min(ts), min(seq)) task_seq from et where task > 0 group by 1, 2),
last_task as (select coalesce(max(task_seq), 0) n from tn)
"""


def outcomes(t: DataFrame) -> DataFrame:
    """(session, task, outcome): a check after the last edit decides; a failed one is a failure, no check at all with an edit is unknown, an edit-free task is abandoned."""
    last = t.where("task > 0").groupBy("session", "task").agg(F.max(F.when(F.col("kind") == "edit", F.struct("ts", "seq"))).alias("e"), F.max(F.when(F.col("kind") == "check", F.struct("ts", "seq"))).alias("c"), F.max(F.when(F.col("kind") == "check", F.struct(F.struct("ts", "seq"), F.col("value")))).alias("v"))
    judged = F.when(F.col("e").isNull(), "abandoned").when(F.col("c").isNull() | (F.col("c") < F.col("e")), "unknown").when(F.col("v.value") >= 10, "success").otherwise("failure")
    return last.select("session", "task", judged.alias("outcome"))


OUTCOMES = TASKS + """,
oc as (select session, task, case when max(case when kind = 'edit' then (ts, seq) end) is null then 'abandoned'
  when max(case when kind = 'check' then (ts, seq) end) is null or max(case when kind = 'check' then (ts, seq) end) < max(case when kind = 'edit' then (ts, seq) end) then 'unknown'
  when arg_max(value, (ts, seq)) filter (where kind = 'check') >= 10 then 'success' else 'failure' end outcome from et where task > 0 group by 1, 2)
"""


def edges(spark: SparkSession, d: str, max_files: int = MAX_FILES) -> DataFrame:
    """(src, dst, type, w, last_seq): structural edges from suppliers to parts by the best flag, co-change ones from partners."""
    flag = F.col("l_returnflag")
    w = F.when(flag == "A", 1.0).when(flag == "N", 0.8).otherwise(0.6)
    lines = table(spark, d, "lineitem")
    flags = lines.select((F.col("l_suppkey") + 10_000_000).alias("src"), F.col("l_partkey").alias("dst"), w.alias("w")).where("src is not null")
    # nearly every line is an edge of its own: they are dealt by their number, not added up first
    s = flags.repartition(parts_for(spark, lines.count()), "src", "dst").groupBy("src", "dst").agg(F.max("w").alias("w"))
    f = commit_lists(spark, d, max_files)
    a = anchor(f)
    p = cochange.partners(cochange.pair_commits(f, a), cochange.file_commits(f.select("seq", F.explode("files").alias("file"), "anchor"), a))
    return s.select("src", "dst", F.lit("structural").alias("type"), "w", F.lit(0).cast("long").alias("last_seq")).unionByName(p.select("src", "dst", F.lit("cochange").alias("type"), F.round("confidence", 9).alias("w"), F.lit(0).cast("long").alias("last_seq")))


PARTNERS = COMMITS + """,
di as (select fa src, fb dst, n, w from pc where n >= 2 union all select fb, fa, n, w from pc where n >= 2),
pa as (select src, dst, least(di.w / fc.w, 1.0) conf, di.n n from di join fc on fc.f = src where fc.w > 0 and least(di.w / fc.w, 1.0) >= 0.1),
pk as (select *, row_number() over (partition by src order by round(conf * ln(1 + n), 9) desc, dst) place from pa qualify place <= 32)
"""
EDGES = PARTNERS + """,
ed as (select l_suppkey + 10000000 src, l_partkey dst, 'structural' type, max(case l_returnflag when 'A' then 1.0 when 'N' then 0.8 else 0.6 end)::double w from lineitem group by 1, 2
  union all select src, dst, 'cochange', round(conf, 9) from pk)
"""
