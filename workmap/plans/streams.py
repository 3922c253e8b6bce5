"""Stream queries, run over what is there and compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from workmap.functions.scalar import epoch_ms
from workmap.operators.scratch import scratch_dir
from workmap.plans.adapters import EVENTS, events, table
from workmap.plans.registry import query
from workmap.streaming import live


def _stream(spark, d):
    raw = live.event_stream(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)
    kind = F.when(F.col("event_type").isin("view", "click"), "read").when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "error", "check").otherwise("prompt")
    ts = F.timestamp_millis(epoch_ms("ts"))
    return raw.select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), ts.alias("ts"), kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("node"))


def _run(spark, stream, mode):
    at = f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"
    return live.to_table(stream, f"{at}/table", f"{at}/state", mode)


@query(
    f"with {EVENTS}, g as (select session, ts, (ts - lag(ts) over (partition by session order by ts, seq) >= 21600000 or lag(ts) over (partition by session order by ts, seq) is null)::int new from e), i as (select *, sum(new) over (partition by session order by ts rows between unbounded preceding and current row) k from g) select session, min(ts) started_at, max(ts) + 21600000 ended_at, count(*) events from i group by session, k"
)
def stream_sessions(spark, d):
    """Sessions by gaps of six hours, those that are still open too."""
    s = _run(spark, live.sessions(_stream(spark, d), "6 hours", late="60 days"), "complete")
    return s.select("session", F.unix_millis("started_at").alias("started_at"), F.unix_millis("ended_at").alias("ended_at"), "events")


@query(
    f"with {EVENTS}, p as (select session, node, kind, ts, seq, ts + case kind when 'read' then 600000 else 1800000 end hold from e where kind in ('read', 'edit') and node is not null) select session, node, arg_max(kind, (hold, ts, seq)) as mode, max(hold) as until from p group by 1, 2"
)
def stream_positions(spark, d):
    s = _run(spark, live.positions(_stream(spark, d)), "complete")
    return s.select("session", "node", "mode", F.unix_millis("until").alias("until"))


@query(f"with {EVENTS}, g as (select node, ts, (ts - lag(ts) over (partition by node order by ts, seq) >= 3600000 or lag(ts) over (partition by node order by ts, seq) is null)::int new from e where node is not null), i as (select *, sum(new) over (partition by node order by ts rows between unbounded preceding and current row) k from g) select node, max(ts) + 3600000 quiet_at, count(*) changes from i group by node, k")
def stream_quiet_paths(spark, d):
    """Changes of a path in a row count as one, an hour after the last, also where that hour isn't over."""
    s = _run(spark, live.quiet_paths(_stream(spark, d).where("node is not null"), "1 hour", late="60 days"), "complete")
    return s.select("node", F.unix_millis("quiet_at").alias("quiet_at"), "changes")


@query(f"with {EVENTS} select ts // 21600000 * 21600000 started_at, count(*) changes from e group by 1 having count(*) > 85 and ts // 21600000 * 21600000 + 21600000 <= (select max(ts) - 30000 from e)")
def stream_bursts(spark, d):
    """Windows of six hours with more changes than are worth following one by one."""
    s = _run(spark, live.bursts(_stream(spark, d), "6 hours", 85), "append")
    return s.select(F.unix_millis("started_at").alias("started_at"), "changes")


_STOPS = EVENTS + """, k as (select session, seq, ts, case when kind = 'check' and seq % 3 = 0 then 'stop' else kind end kind from e), b as (select *, lead(seq) over w closed, lead(kind) over w how from (select * from k where kind in ('prompt', 'stop')) window w as (partition by session order by ts, seq)),
o as (select session, seq opened, ts, closed, case how when 'prompt' then 'next_prompt' else how end how, lead(ts) over (partition by session order by ts, seq) nt from b where kind = 'prompt'),
c as (select o.session, opened, closed, how, (select count(*) from k where k.session = o.session and (k.ts, k.seq) >= (o.ts, opened) and kind <> 'stop' and (closed is null or (k.ts, k.seq) < (select (x.ts, x.seq) from k x where x.seq = closed))) events, (select max(ts) from k where k.session = o.session and kind <> 'stop') last from o)"""


@query(f"with {_STOPS} select session, opened, closed, how, events from c where closed is not null union all select session, opened, null, 'quiet', events from c where closed is null and last + 86400000 < (select max(ts) - 30000 from k)")
def stream_tasks(spark, d):
    """Tasks opened by prompts, closed by the next prompt, a stop, or a day of quiet."""
    e = _stream(spark, d)
    kind = F.when((F.col("kind") == "check") & (F.col("seq") % 3 == 0), "stop").otherwise(F.col("kind"))
    return _run(spark, live.tasks(e.withColumn("kind", kind), 86_400_000), "append")


@query(f"with {EVENTS}, p as (select session, node, case when kind = 'edit' and seq % 4 = 1 then 'claim' else kind end as mode, ts, seq from e where kind in ('read', 'edit') and node is not null), h as (select *, ts + case mode when 'read' then 600000 when 'edit' then 1800000 else 7200000 end hold from p), b as (select session, node, max((hold, ts, seq, mode)) m from h group by 1, 2) select session, node, m[4] as mode, m[1] as until from b where m[1] < (select max(ts) - 30000 from p)")
def stream_expired(spark, d):
    """Reads, edits and claims whose time is over, of each session and node the last, unless it holds again by now."""
    holds = {"read": 600_000, "edit": 1_800_000, "claim": 7_200_000}
    mode = F.when((F.col("kind") == "edit") & (F.col("seq") % 4 == 1), "claim").otherwise(F.col("kind"))
    over = _run(spark, live.expired(_stream(spark, d).withColumn("kind", mode), holds), "append")
    last = over.groupBy("session", "node").agg(F.max(F.struct("until", "mode")).alias("p")).select("session", "node", "p.mode", "p.until")
    now = events(spark, d).where("kind in ('read', 'edit') and node is not null").withColumn("kind", mode)
    passed = now.agg((F.max("ts") - 30_000).alias("passed"))
    until = F.col("ts") + F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in holds.items()])
    held = now.join(F.broadcast(passed), until >= F.col("passed")).select("session", "node").distinct()
    return last.join(held, ["session", "node"], "left_anti")


@query(f"with {EVENTS} select c.seq change, c.node changed, x.session, x.ts from e c join e x on x.node = c.node and x.kind = 'read' and x.ts between c.ts - 1800000 and c.ts + 120000 where c.kind = 'edit'")
def stream_attribution(spark, d):
    """Changes joined with the reads of their file around them, two streams with watermarks."""
    changes, reads = _stream(spark, d).where("kind = 'edit' and node is not null"), _stream(spark, d).where("kind = 'read' and node is not null")
    s = _run(spark, live.attributed(changes, reads, "30 minutes", "2 minutes"), "append")
    return s.where("session is not null").select("change", "changed", "session", F.unix_millis("ts").alias("ts"))


@query(f"with {EVENTS} select distinct session, node, kind from e where node is not null")
def stream_once(spark, d):
    """The first of the rows that repeat a session, node and kind."""
    s = _run(spark, live.once(_stream(spark, d).where("node is not null"), ["session", "node", "kind"], "60 days"), "append")
    return s.select("session", "node", "kind")


@query(f"with {EVENTS} select seq, session from e where kind = 'edit'")
def stream_delivered(spark, d):
    """Rows delivered once, though the stream is run twice: its checkpoint says what has been."""
    at = f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"
    for _ in range(2):
        s = live.to_table(_stream(spark, d).where("kind = 'edit'").select("seq", "session"), f"{at}/table", f"{at}/state", "append")
    return s
