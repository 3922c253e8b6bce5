"""Sessions, tasks, interest, links and transitions from events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from workmap.operators import activity, learn
from workmap.plans.adapters import EVENTS, OUTCOMES, TASKS, events, outcomes, task_numbers, tasked
from workmap.plans.registry import query

NOW = 1_706_600_000_000


@query(f"with {EVENTS} select session, task, min(ts) started_at, max(ts) last_at, count(*) events, min(seq) first_seq from et where task > 0 group by 1, 2")
def tasks_from_prompts(spark, d):
    return activity.tasks_of(tasked(spark, d))


@query(f"with {EVENTS}, c as (select session, task, ts, kind, node, min(seq) seq from et where task > 0 and kind <> 'prompt' group by all) select session, task, count(*) calls, min(seq) first_seq from c group by 1, 2")
def tool_calls(spark, d):
    return activity.tool_calls(tasked(spark, d))


@query(f"with {EVENTS}, l as (select session, max(ts) seen from e group by 1), t as (select session, task, max(ts) m, min(ts) s from et where task > 0 group by 1, 2 qualify row_number() over (partition by session order by task desc) = 1) select session, task, greatest(m, s, seen) last_at from t join l using (session) where greatest(m, s, seen) < {NOW} - 86400000")
def quiet_tasks(spark, d):
    t = tasked(spark, d)
    return activity.quiet_tasks(activity.tasks_of(t), t, NOW, 86_400_000)


@query(f"with {EVENTS}, n as (select *, row_number() over (partition by session, task order by ts desc, seq desc) k from et where task > 0 qualify k <= 5) select distinct session, task, node from n where node is not null")
def task_touched(spark, d):
    """Nodes among the newest five events of each task."""
    return activity.newest(tasked(spark, d).where("task > 0"), ["session", "task"], 5).where("node is not null").select("session", "task", "node").distinct()


@query(f"with {EVENTS} select session, seq, ts, node from et where kind = 'edit' and task > 0 qualify row_number() over (partition by session order by ts desc, seq desc) <= 3")
def edits_of_session(spark, d):
    return activity.newest(tasked(spark, d).where("kind = 'edit' and task > 0"), ["session"], 3).select("session", "seq", "ts", "node")


@query(f"with {EVENTS}, c as (select session, node, count(*) reads, max(ts) last_at from e where kind = 'read' and node is not null group by 1, 2) select * from c qualify row_number() over (partition by session order by reads desc, last_at desc, node) <= 5")
def session_top_reads(spark, d):
    c = events(spark, d).where("kind = 'read' and node is not null").groupBy("session", "node").agg(F.count("*").alias("reads"), F.max("ts").alias("last_at"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("reads"), F.desc("last_at"), "node"))).where("k <= 5").drop("k")


@query(f"with {EVENTS} select node, count(*) filter (where kind = 'read') as reads, max(ts) last_at from e where node is not null group by 1")
def file_reads(spark, d):
    return activity.file_reads(events(spark, d))


@query(f"with {EVENTS}, m as (select session, max((ts, seq)) filter (where kind = 'check') m from e group by 1) select e.session, seq, node from e join m using (session) where kind = 'read' and (m is null or (ts, seq) > m)")
def in_context_reads(spark, d):
    """Reads since the session's last check, as those since its last compaction."""
    return activity.since_last(events(spark, d), "check").where("kind = 'read'").select("session", "seq", "node")


@query(f"with {EVENTS} select seq, session, kind from e where seq > 500 order by seq limit 100")
def events_after(spark, d):
    """A page of the change feed."""
    return events(spark, d).where("seq > 500").orderBy("seq").limit(100).select("seq", "session", "kind")


@query(f"with {OUTCOMES} select outcome, count(*) tasks from oc group by 1")
def task_outcomes(spark, d):
    return outcomes(tasked(spark, d)).groupBy("outcome").agg(F.count("*").alias("tasks"))


def _numbered(spark, d):
    t = tasked(spark, d)
    n = task_numbers(t)
    return t, n, F.lit(n.agg(F.max("task_seq")).first()[0] or 0)


INTEREST = TASKS + ", sc as (select node, sum(case kind when 'edit' then 1.0 when 'read' then 0.3 else 0 end * pow(0.98, n - task_seq)) score from et join tn using (session, task), last_task where node is not null group by 1)"


@query(f"with {INTEREST} select node, round(score, 6) score from sc")
def interest_decayed(spark, d):
    t, n, now = _numbered(spark, d)
    return learn.interest(t.join(n, ["session", "task"]), now).withColumn("score", F.round("score", 6))


@query(f"with {INTEREST}, r as (select node, round(score, 6) score from sc), t as (select node from r where score >= 3 order by score desc, node limit 5) select node, score, case when node in (select node from t) then 'landmark' when score > 0.2 then 'interesting' else 'dark' end tier from r")
def interest_landmarks(spark, d):
    s = interest_decayed(spark, d)
    return learn.landmarks(s, 400)


ROLES = OUTCOMES + ", ro as (select session, task, node, case when bool_or(kind = 'edit') then 'edited' else 'read_only' end as role from et where task > 0 and node is not null and kind in ('read', 'edit') group by 1, 2, 3)"


@query(f"with {ROLES} select * from ro")
def file_roles(spark, d):
    return learn.file_roles(tasked(spark, d).where("task > 0"))


ADDS = ROLES + """, rw as (select *, case role when 'edited' then 1.0 else 0.2 end::double w from ro qualify row_number() over (partition by session, task order by w desc, node) <= 40),
own as (select session, task, node, w, task_seq, case outcome when 'success' then 1.0 else 0.3 end::double gain from rw join oc using (session, task) join tn using (session, task) where outcome in ('success', 'unknown')),
ad as (select x.node a, y.node b, x.task_seq, 0.1::double * x.w * y.w * x.gain v from own x join own y on x.session = y.session and x.task = y.task and x.node < y.node)"""


def _adds(spark, d):
    t, n, now = _numbered(spark, d)
    roles = learn.file_roles(t.where("task > 0"))
    return learn.coaccess(roles, outcomes(t).join(n, ["session", "task"])), now


@query(f"with {ADDS} select a, b, round(sum(v * pow(0.995, n - task_seq)), 6) weight, count(*) n, max(task_seq) last_seq from ad, last_task group by 1, 2")
def coaccess_links(spark, d):
    adds, now = _adds(spark, d)
    return learn.link_sums(adds, now).withColumn("weight", F.round("weight", 6))


@query(f"""with {ADDS}, p as (select a, b, task_seq, sum(v) v from ad group by 1, 2, 3), l as (select a, b, list({{'w': least(greatest(v, 0.0), 5.0), 'at_': task_seq, 'v': v}} order by task_seq) s from p group by 1, 2),
f as (select a, b, len(s) n, list_reduce(s, lambda x, y: {{'w': least(greatest(x.w * pow(0.995::double, (y.at_ - x.at_)::double) + y.v, 0.0), 5.0), 'at_': y.at_, 'v': y.v}}) r from l) select a, b, round(r.w, 6) weight, n, r.at_ last_seq from f""")
def coaccess_fold_clamped(spark, d):
    adds, _ = _adds(spark, d)
    return learn.link_folds(adds).withColumn("weight", F.round("weight", 6))


WALK = OUTCOMES + """, ev as (select * from et where task > 0 and node is not null and kind in ('read', 'edit')),
fe as (select session, task, min((ts, seq)) at_, arg_min(node, (ts, seq)) node from ev where kind = 'edit' group by 1, 2),
rd as (select session, task, ev.node, min((ts, seq)) at_ from ev left join fe using (session, task) where kind = 'read' and (fe.at_ is null or (ts, seq) < fe.at_) group by 1, 2, 3),
rk as (select *, row_number() over (partition by session, task order by at_) k from rd),
cp as (select session, task, max(k) > 20 capped from rk group by 1, 2),
wk as (select session, task, node, k from rk where k <= 20 union all select session, task, node, 21 from fe left join cp using (session, task) where not coalesce(capped, false)),
stp as (select distinct session, task, node src, dst from (select *, lead(node) over (partition by session, task order by k) dst from wk) where dst is not null and dst <> node),
tr as (select src, dst, sum(case outcome when 'success' then 1.0 when 'unknown' then 0.3 else 0.1 end::double * pow(0.995, n - task_seq)) weight, count(*) n from stp join oc using (session, task) join tn using (session, task), last_task group by 1, 2)"""


def _ways(spark, d):
    t, n, now = _numbered(spark, d)
    gain = F.when(F.col("outcome") == "success", 1.0).when(F.col("outcome") == "unknown", 0.3).otherwise(0.1)
    steps = learn.walks(t).join(outcomes(t), ["session", "task"]).join(n, ["session", "task"]).withColumn("gain", gain)
    return learn.transitions(steps, now)


@query(f"with {WALK} select src, dst, round(weight, 6) weight, n from tr")
def transitions(spark, d):
    return _ways(spark, d).withColumn("weight", F.round("weight", 6))


@query(f"with {WALK}, r as (select src, dst, round(weight, 6) weight from tr), m as (select src, sum(weight) total, max((weight, -dst)) m from r group by 1) select src, -m[2] dst, m[1] weight from m where m[1] >= 0.2 and m[1] > 0.05 * total")
def next_file(spark, d):
    ways = _ways(spark, d).withColumn("weight", F.round("weight", 6))
    return learn.next_file(ways, least=0.2, majority=0.05)


@query()
def archetypes(spark, d):
    t, n, _ = _numbered(spark, d)
    e = t.where("kind = 'edit' and node is not null and task > 0").groupBy("session", "task").agg(F.array_sort(F.collect_set("node")).alias("files")).join(n, ["session", "task"]).select(F.col("task_seq").alias("seq"), "files")
    return learn.archetypes(e.orderBy(F.desc("seq")).limit(5_000))
