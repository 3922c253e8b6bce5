"""The recorder's streams over events, run over what is there and compared with batch SQL. A repository is ten sessions' worth of users."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from workmap.operators.scratch import scratch_dir
from workmap.plans.adapters import EVENTS
from workmap.plans.registry import query
from workmap.plans.streams import _run, _stream
from workmap.sources import growing
from workmap.streaming import live, recorder

#: Bounds that these tables reach: sessions known, rows of a task, quiet; a change's claims and activity; windows and what they hold.
_SESSIONS, _ROWS, _QUIET, _HELD, _BEFORE, _WINDOW, _PATHS, _SLOT, _WAITING = 8, 4, 86_400_000, 1_800_000, 7_200_000, 21_600_000, 8, 86_400_000, 30
_R = EVENTS.strip() + ", w as (select max(ts) - 30000 w from e), k as (select session % 10 repo, session, seq, ts, kind, node from e)"


def _repos(spark, d):
    return _stream(spark, d).withColumn("repo", F.col("session") % 10)


@query(f"""with {_R},
p as (select *, row_number() over (partition by repo order by ts, seq) pos from k, w where ts <= w),
l as (select *, lag(pos) over s prev, lead(pos) over s nx, lead(ts) over s nts from p window s as (partition by session order by pos)),
f as (select j.repo, j.pos, i.pos ip, i.ts its, i.seq iseq, row_number() over (partition by j.repo, j.pos order by i.pos) r from l j join l i on i.repo = j.repo and i.session <> j.session and i.pos > j.pos and coalesce(i.prev, 0) <= j.pos),
g as (select l.*, iseq, case when nx is not null and nts - l.ts < {_QUIET} and (ip is null or nx < ip) then 'on' when ip is not null and its - l.ts < {_QUIET} then 'evicted' when l.ts + {_QUIET} <= w then 'quiet' else 'open' end fate
  from l left join f on f.repo = l.repo and f.pos = l.pos and f.r = {_SESSIONS}),
h as (select *, coalesce(sum((fate <> 'on')::int) over (partition by session order by pos rows between unbounded preceding and 1 preceding), 0) run from g),
t as (select *, sum((kind = 'prompt')::int) over (partition by session, run order by pos) task from h),
a as (select repo, session, run, task, arg_min(seq, pos) opened, count(*) n, arg_max(fate, pos) fate, arg_max(iseq, pos) iseq from t where task > 0 group by 1, 2, 3, 4),
b as (select *, lead(opened) over (partition by session, run order by task) nxt from a)
select repo, session, opened, case when nxt is not null then nxt when fate = 'evicted' then iseq end closed, case when nxt is not null then 'next_prompt' else fate end how, n events, least(n, {_ROWS}) kept from b where nxt is not null or fate in ('evicted', 'quiet')""")
def stream_recorder(spark, d):
    """Tasks of the eight sessions of a repository that were active last, ended by prompts, a day of quiet, or for room."""
    with recorder.state_store(spark):
        return _run(spark, recorder.record(_repos(spark, d), _QUIET, _SESSIONS, _ROWS), "append")


@query(f"""with {_R}, c as (select * from k, w where kind = 'check' and node is not null and ts + {_HELD} <= w), o as (select * from k where kind <> 'check'),
cl as (select c.seq, arg_min(o.session, (abs(o.ts - c.ts), o.ts, o.seq)) session from c join o on o.repo = c.repo and o.node = c.node and o.kind = 'edit' and abs(o.ts - c.ts) <= {_HELD} group by 1),
la as (select c.seq, arg_min(o.session, (-o.ts, o.session)) session from c join o on o.repo = c.repo and o.ts between c.ts - {_BEFORE} and c.ts + {_HELD} group by 1)
select c.repo, c.seq change, c.node, coalesce(cl.session, la.session) session, case when cl.seq is not null then 'claimed' when la.seq is not null then 'latest' else 'nobody' end how from c left join cl on cl.seq = c.seq left join la on la.seq = c.seq""")
def stream_owned_changes(spark, d):
    """Changes on disk, claimed by an edit of their file near in time, else given to the session that was active last."""
    e = _repos(spark, d)
    changes, events = e.where("kind = 'check' and node is not null"), e.where("kind <> 'check'")
    with recorder.state_store(spark):
        return _run(spark, recorder.owned(changes, events, _HELD, _BEFORE), "append")


@query(f"""with {_R}, s as (select repo, ts // {_WINDOW} * {_WINDOW} since, node from k where node is not null),
n as (select repo, since, count(distinct node) p, count(*) n from s, w where since + {_WINDOW} <= w group by 1, 2)
select repo, since, null::bigint node, n changes from n where p > {_PATHS} union all select repo, since, node, count(*) from s join n using (repo, since) where p <= {_PATHS} group by 1, 2, 3""")
def stream_collapsed(spark, d):
    """Changed paths by windows of six hours, or one row for all of them where they are many."""
    return _run(spark, recorder.collapsed(_repos(spark, d), _WINDOW, _PATHS), "append")


@query(f"""with {_R}, s as (select repo, ts // {_SLOT} * {_SLOT} since, kind, seq, kind = 'read' soft, ts from k, w where ts // {_SLOT} * {_SLOT} + {_SLOT} <= w),
o as (select *, row_number() over (partition by repo, since order by ts, seq) place, row_number() over (partition by repo, since, soft order by ts, seq) own from s),
h as (select repo, since, least(count(*) filter (where not soft), {_WAITING}) h from s group by 1, 2),
q as (select o.*, h, row_number() over (partition by repo, since, soft, place <= {_WAITING} order by ts desc, seq desc) back from o join h using (repo, since)),
kp as (select *, case when soft then place <= {_WAITING} and back <= {_WAITING} - h else own <= {_WAITING} end kept from q)
select repo, since, kind, seq, 1::bigint n from kp where kept union all select repo, since, kind, null, count(*) from kp where not kept group by 1, 2, 3""")
def stream_admitted(spark, d):
    """What is taken of a day's events, thirty at most; reads give way first, and what is dropped is counted."""
    return _run(spark, recorder.admitted(_repos(spark, d), _SLOT, _WAITING), "append")


def _grown(spark, d, folder: str, later: bool):
    """Events as lines of files, one for each partition: the first time two thirds of each file and a bit of a line, later the rest."""
    from workmap.sources.growing import _opened

    def write(frames):
        from pyspark import TaskContext

        system, path = _opened(folder)
        data = "".join(f"{s},{q},{k}\n" for frame in frames for s, q, k in zip(frame["session"], frame["seq"], frame["kind"], strict=True)).encode()
        cut = len(data) * 2 // 3
        name = f"{path}/events-{TaskContext.get().partitionId()}.log"
        if later:
            with system.open_append_stream(name) as out:
                out.write(data[cut:])
        else:
            system.create_dir(path)
            with system.open_output_stream(name) as out:
                out.write(data[:cut])
        yield pd.DataFrame({"bytes": [len(data)]})

    from workmap.plans.adapters import events

    rows = events(spark, d).select("session", "seq", "kind").repartition(8, "session").sortWithinPartitions("seq")
    rows.mapInPandas(write, "bytes long").agg(F.sum("bytes")).collect()


@query(f"with {EVENTS} select session, seq, kind from e")
def lines_tailed(spark, d):
    """Lines of files that grow, read as a stream that is stopped in the middle of lines and started again: each comes once."""
    growing.register(spark)
    at = f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"
    at = at if "://" in at else f"file://{at}"
    for later in (False, True):
        _grown(spark, d, f"{at}/in", later)
        s = live.to_table(spark.readStream.format("growing_lines").load(f"{at}/in"), f"{at}/table", f"{at}/state", "append")
    part = F.split("line", ",")
    return s.select(part[0].cast("long").alias("session"), part[1].cast("long").alias("seq"), part[2].alias("kind"))
