"""Statements of the store about warnings, retention, positions, notices, handoffs and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from workmap.operators import snapshot as S
from workmap.plans.relations import FOLDER_NODES, SYMBOL_NODES, ids, statement


# ---------------------------------------------------------------- warnings
@statement("select warning_id + 1000000 warning_id, kind, src_node, dst_node from warnings where task_id % 20 = 0")
def warning_insert(r):
    new = r.warnings.where("task_id % 20 = 0").withColumn("warning_id", F.col("warning_id") + 1_000_000)
    return S.inserted(r.warnings, new).where("is_new").select("warning_id", "kind", "src_node", "dst_node")


@statement("select kind, count(*) given, count(resolved) judged, coalesce(sum(resolved), 0)::bigint resolved from warnings where kind in ('cochange', 'test') group by 1")
def warning_counts(r):
    w = r.warnings.where(F.col("kind").isin("cochange", "test"))
    return w.groupBy("kind").agg(F.count("*").alias("given"), F.count("resolved").alias("judged"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved"))


@statement("select warning_id, kind, ts from warnings where task_id = 40 order by ts, warning_id")
def warnings_of_task(r):
    return S.point(r.warnings, task_id=40).select("warning_id", "kind", "ts").orderBy("ts", "warning_id")


@statement("select warning_id, ts, kind from warnings order by ts desc, warning_id desc limit 30")
def latest_warnings(r):
    return S.newest(r.warnings, ["ts", "warning_id"], 30).select("warning_id", "ts", "kind")


@statement(f"""with own as (select file_id node from files where path = (select min(path) from files where lang = 'go') union all select symbol_id + {SYMBOL_NODES} from symbols join files using (file_id) where path = (select min(path) from files where lang = 'go'))
  select warning_id, src_node, dst_node from warnings where resolved is null and (src_node in (select node from own) or dst_node in (select node from own))""")
def open_warnings_about(r):
    """Open warnings with either end among the nodes of one file: two semi joins and a distinct, no join on an OR."""
    file = S.keyed(r.files, r.files.where("lang = 'go'").agg(F.min("path").alias("path"))).select("file_id")
    own = file.select(F.col("file_id").alias("node")).unionByName(S.keyed(r.symbols, file).select((F.col("symbol_id") + SYMBOL_NODES).alias("node")))
    w = r.warnings.where("resolved is null")
    return S.keyed(w, own.withColumnRenamed("node", "src_node")).unionByName(S.keyed(w, own.withColumnRenamed("node", "dst_node"))).select("warning_id", "src_node", "dst_node").distinct()


@statement("select warning_id, kind, ts from warnings where dst_node % 100 = 55 and kind in ('call_site', 'origin') order by ts desc, warning_id desc limit 25")
def warnings_naming(r):
    return S.newest(r.warnings.where((F.col("dst_node") % 100 == 55) & F.col("kind").isin("call_site", "origin")), ["ts", "warning_id"], 25).select("warning_id", "kind", "ts")


# ---------------------------------------------------------------- retention
@statement("select count(*) n, count(distinct session_id) sessions from acts")
def optimize(r):
    """What the planner's statistics would hold of the event log: row and distinct counts."""
    return r.acts.agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


@statement("select count(*) filter (where ts < 30000000) free_rows from acts")
def free_pages(r):
    """Rows that a rewrite of the log would free."""
    return r.acts.agg(F.count_if(F.col("ts") < 30_000_000).alias("free_rows"))


@statement("select seq from acts where not (ts < 30000000 and seq in (select seq from acts order by seq limit 2000))")
def events_delete_before(r):
    """Expired rows go, at most those among the first 2,000 in one step."""
    first = r.acts.orderBy("seq").limit(2000).where("ts < 30000000").select("seq")
    return S.without(r.acts, first).select("seq")


@statement("select injection_id from injections where not (ts < 30000000 and injection_id in (select injection_id from injections order by injection_id limit 1000))")
def injections_delete_before(r):
    first = r.injections.orderBy("injection_id").limit(1000).where("ts < 30000000").select("injection_id")
    return S.without(r.injections, first).select("injection_id")


@statement("select session_id, node_id, ts from positions where ts >= 40000000")
def positions_delete_before(r):
    return S.kept(r.positions, F.col("ts") < 40_000_000).select("session_id", "node_id", "ts")


@statement("select notice_id from notices where ts >= 40000000")
def notices_delete_before(r):
    return S.kept(r.notices, F.col("ts") < 40_000_000).select("notice_id")


@statement("select fact_id from facts where status = 'retired' and changed_at < 50000000 order by fact_id limit 100")
def facts_retired_before(r):
    return r.facts.where("status = 'retired' and changed_at < 50000000").select("fact_id").orderBy("fact_id").limit(100)


_RETIRED = "status = 'retired' and changed_at < 50000000"


@statement(f"select fact_id, count(*) n from anchors where fact_id not in (select fact_id from facts where {_RETIRED}) group by 1")
def fact_anchors_delete(r):
    return S.without(r.anchors, ids(r.facts, _RETIRED, "fact_id")).groupBy("fact_id").agg(F.count("*").alias("n"))


@statement(f"select fact_id, count(*) n from given where fact_id not in (select fact_id from facts where {_RETIRED}) group by 1")
def facts_given_delete(r):
    return S.without(r.given, ids(r.facts, _RETIRED, "fact_id")).groupBy("fact_id").agg(F.count("*").alias("n"))


@statement(f"select fact_id, status from facts where not ({_RETIRED})")
def facts_delete(r):
    return S.without(r.facts, ids(r.facts, _RETIRED, "fact_id")).select("fact_id", "status")


# ---------------------------------------------------------------- positions
@statement("select session_id, count(*) n from positions where not (mode = 'claim' and session_id % 5 = 2) group by 1")
def claims_release(r):
    """Claims of some sessions are given up; positions by edits stay."""
    asked = ids(r.sessions, "session_id % 5 = 2", "session_id")
    return S.without(r.positions.where("mode = 'claim'"), asked).unionByName(r.positions.where("mode <> 'claim'")).groupBy("session_id").agg(F.count("*").alias("n"))


_RUNNING = """select p.session_id, p.node_id, p.ts, arg_max(t.task_id, (t.started_at, t.task_id)) task_id from positions p left join tasks t on t.session_id = p.session_id and t.started_at <= p.ts"""


def _running(r, positions):
    return S.as_of(positions, r.tasks, "session_id", "ts", "started_at", "task_id").select("session_id", "node_id", "ts", "task_id")


@statement(f"{_RUNNING} where p.session_id = 42 group by 1, 2, 3")
def position_of(r):
    """The positions of one session with the task that ran then."""
    return _running(r, S.point(r.positions, session_id=42)).where("session_id = 42")


@statement(f"{_RUNNING} where p.ts >= 80000000 group by 1, 2, 3")
def positions_since(r):
    return _running(r, r.positions.where("ts >= 80000000"))


@statement("select session_id, max(ts) seen from acts where session_id in (select session_id from sessions where session_id % 20 = 4) group by 1")
def sessions_seen(r):
    return S.keyed(r.acts, ids(r.sessions, "session_id % 20 = 4", "session_id")).groupBy("session_id").agg(F.max("ts").alias("seen"))


# ---------------------------------------------------------------- notices
@statement("select notice_id + 100000 notice_id, session_id, cast(null as bigint) delivered_at from notices where about = 3")
def notice_queue(r):
    return S.point(r.notices, about=3).select((F.col("notice_id") + 100_000).alias("notice_id"), "session_id", F.lit(None).cast("long").alias("delivered_at"))


@statement("select notice_id + 200000 notice_id, session_id, ts delivered_at from notices where about = 4")
def notice_told(r):
    return S.point(r.notices, about=4).select((F.col("notice_id") + 200_000).alias("notice_id"), "session_id", F.col("ts").alias("delivered_at"))


@statement("select notice_id, session_id, ts from notices where ts >= 70000000 order by ts, notice_id")
def notices_since(r):
    return r.notices.where("ts >= 70000000").select("notice_id", "session_id", "ts").orderBy("ts", "notice_id")


@statement("select notice_id, about from notices where session_id = 7 and delivered_at is null and ts >= 1000 order by ts, notice_id")
def notices_waiting(r):
    return S.point(r.notices, session_id=7).where("delivered_at is null and ts >= 1000").orderBy("ts", "notice_id").select("notice_id", "about")


@statement("select notice_id, coalesce(delivered_at, case when session_id = 7 then 200000000 end) delivered_at from notices")
def notice_deliver(r):
    """Delivered once: what was delivered keeps its time."""
    return S.changed(r.notices, (F.col("session_id") == 7) & F.col("delivered_at").isNull(), delivered_at=F.lit(200_000_000)).select("notice_id", "delivered_at")


# ---------------------------------------------------------------- handoffs
@statement("select handoff_id + 100000 handoff_id, session_id, ts from handoffs where handoff_id % 50 = 0")
def handoff_leave(r):
    new = r.handoffs.where("handoff_id % 50 = 0").withColumn("handoff_id", F.col("handoff_id") + 100_000)
    return S.inserted(r.handoffs, new).where("is_new").select("handoff_id", "session_id", "ts")


@statement("select handoff_id, case when session_id % 10 = 3 and closed_at is null then 300000000 else closed_at end closed_at from handoffs")
def handoffs_replace_of_session(r):
    return S.changed(r.handoffs, (F.col("session_id") % 10 == 3) & F.col("closed_at").isNull(), closed_at=F.lit(300_000_000)).select("handoff_id", "closed_at")


@statement("select handoff_id, case when handoff_id = 9 and closed_at is null then 300000000 else closed_at end closed_at from handoffs where handoff_id < 20")
def handoff_close(r):
    return S.changed(r.handoffs.where("handoff_id < 20"), (F.col("handoff_id") == 9) & F.col("closed_at").isNull(), closed_at=F.lit(300_000_000)).select("handoff_id", "closed_at")


@statement("select handoff_id, case when ts < 50000000 then null else failures end failures from handoffs")
def handoffs_forget_failures_before(r):
    return S.changed(r.handoffs, F.col("ts") < 50_000_000, failures=F.lit(None)).select("handoff_id", "failures")


@statement("select handoff_id from handoffs where ts >= 50000000")
def handoffs_delete_before(r):
    return S.kept(r.handoffs, F.col("ts") < 50_000_000).select("handoff_id")


@statement("select handoff_id, ts from handoffs where closed_at is null and ts >= 50000000 order by ts desc, handoff_id desc")
def handoffs_open_since(r):
    return r.handoffs.where("closed_at is null and ts >= 50000000").select("handoff_id", "ts").orderBy(F.desc("ts"), F.desc("handoff_id"))


@statement("select handoff_id, ts from handoffs where closed_at is null and session_id = 9 order by ts desc, handoff_id desc")
def handoffs_open_of_session(r):
    return S.point(r.handoffs, session_id=9).where("closed_at is null").select("handoff_id", "ts").orderBy(F.desc("ts"), F.desc("handoff_id"))


# ---------------------------------------------------------------- facts
@statement("select fact_id + 1000000 fact_id, claim, 'proposed' status from facts where status = 'retired'")
def fact_add(r):
    return S.point(r.facts, status="retired").select((F.col("fact_id") + 1_000_000).alias("fact_id"), "claim", F.lit("proposed").alias("status"))


@statement("select fact_id, file_id node_id, content_hash hash from facts join files on file_id = fact_id where status = 'proposed'")
def fact_anchor_add(r):
    f = S.point(r.facts, status="proposed").select("fact_id")
    return f.join(r.files.select(F.col("file_id").alias("fact_id"), F.col("file_id").alias("node_id"), F.col("content_hash").alias("hash")), "fact_id")


@statement("""select fact_id, case when fact_id % 3 = 0 and status in ('approved', 'proposed') then 'suspect' when fact_id % 3 = 1 and status = 'suspect' then coalesce(before_suspect, 'proposed') else status end status,
  case when fact_id % 3 = 0 and status in ('approved', 'proposed') then status when fact_id % 3 = 1 and status = 'suspect' then null else before_suspect end before_suspect from facts""")
def fact_set_status(r):
    """The state machine of a doubt: a fact that becomes suspect remembers what it was, and goes back to it when the doubt is lifted."""
    doubt = (F.col("fact_id") % 3 == 0) & F.col("status").isin("approved", "proposed")
    lifted = (F.col("fact_id") % 3 == 1) & (F.col("status") == "suspect")
    status = F.when(doubt, "suspect").when(lifted, F.coalesce("before_suspect", F.lit("proposed"))).otherwise(F.col("status"))
    return r.facts.select("fact_id", status.alias("status"), F.when(doubt, F.col("status")).when(~lifted, F.col("before_suspect")).alias("before_suspect"))


@statement("select fact_id, coalesce(task_id, 88) task_id from facts")
def fact_note_task(r):
    return S.changed(r.facts, F.col("task_id").isNull(), task_id=F.lit(88)).select("fact_id", "task_id")


@statement("select distinct a.fact_id, a.node_id, case when a.fact_id % 2 = 0 then coalesce(h.hash, a.hash) else a.hash end hash from anchors a left join hashes h using (node_id)")
def fact_anchor_restamp(r):
    """Anchors of reviewed facts take the hash that their node has now."""
    now = r.hashes.withColumnRenamed("hash", "now")
    return r.anchors.join(now, "node_id", "left").select("fact_id", "node_id", F.when(F.col("fact_id") % 2 == 0, F.coalesce("now", "hash")).otherwise(F.col("hash")).alias("hash")).distinct()


@statement("select fact_id, coalesce(superseded_by, case when fact_id % 4 = 0 then fact_id + 2 end) superseded_by from facts")
def fact_supersede(r):
    return S.changed(r.facts, F.col("superseded_by").isNull() & (F.col("fact_id") % 4 == 0), superseded_by=F.col("fact_id") + 2).select("fact_id", "superseded_by")


@statement("select task_id, count(*) n from (select task_id, fact_id from given union select distinct task_id, 3 from given) group by 1")
def facts_given_add(r):
    """Fact 3 is given to every task, once."""
    given = r.dealt("given", "task_id")
    return S.once(given, given.select("task_id").distinct().withColumn("fact_id", F.lit(3).cast("long")), ["task_id", "fact_id"]).groupBy("task_id").agg(F.count("*").alias("n"))


@statement("select fact_id from given where task_id = 100")
def facts_given_in_task(r):
    return S.point(r.given, task_id=100).select("fact_id")


@statement("select fact_id, uses + coalesce(n, 0) uses from facts left join (select fact_id, count(*) n from given group by 1) g using (fact_id)")
def fact_count_uses(r):
    more = r.given.groupBy("fact_id").agg(F.count("*").alias("uses"))
    return S.summed(r.facts.select("fact_id", F.col("uses").cast("long").alias("uses")), more, ["fact_id"], ["uses"])


@statement("select fact_id, claim, status from facts where fact_id = 31")
def fact_by_id(r):
    return S.point(r.facts, fact_id=31).select("fact_id", "claim", "status")


@statement("select fact_id, claim from facts where status = 'approved' and superseded_by is null")
def facts_current_with_status(r):
    return S.point(r.facts, status="approved").where("superseded_by is null").select("fact_id", "claim")


@statement("select fact_id, changed_at from facts where status = 'suspect' and changed_at >= 50000000 order by changed_at, fact_id")
def facts_with_status_since(r):
    return S.point(r.facts, status="suspect").where("changed_at >= 50000000").select("fact_id", "changed_at").orderBy("changed_at", "fact_id")


@statement("select exists (select 1 from facts where fact_id = 1999999) there")
def fact_id_of(r):
    return S.point(r.facts, fact_id=1_999_999).agg((F.count("*") > 0).alias("there"))


@statement("""select a.fact_id, a.node_id, coalesce(f.path, g.path) path, s.name, a.hash = h.hash same from (select distinct * from anchors where fact_id % 10 = 1) a
  left join files f on f.file_id = a.node_id left join symbols s on s.symbol_id + 1000000000000 = a.node_id left join files g on g.file_id = s.file_id left join hashes h on h.node_id = a.node_id""")
def anchor_states_of(r):
    """Where the anchors of some facts are and whether they still match."""
    a = r.anchors.where("fact_id % 10 = 1")
    f = r.files.select(F.col("file_id").alias("node_id"), F.col("path").alias("own_path"))
    s = r.symbols.select((F.col("symbol_id") + SYMBOL_NODES).alias("node_id"), "file_id", "name")
    g = r.files.select("file_id", F.col("path").alias("symbol_path"))
    joined = a.join(f, "node_id", "left").join(s, "node_id", "left").join(g, "file_id", "left").join(r.hashes.withColumnRenamed("hash", "now"), "node_id", "left")
    return joined.select("fact_id", "node_id", F.coalesce("own_path", "symbol_path").alias("path"), "name", (F.col("hash") == F.col("now")).alias("same"))


@statement("select node_id, hash from hashes where node_id in (select distinct node_id from anchors where fact_id = 12)")
def anchor_hashes_of(r):
    return S.keyed(r.hashes, ids(r.anchors, "fact_id = 12", "node_id"))


@statement("select distinct fact_id, status from anchors join facts using (fact_id) where node_id in (select file_id from files where file_id % 400 = 8)")
def facts_anchored_to(r):
    held = S.keyed(r.anchors, ids(r.files, "file_id % 400 = 8", "file_id", "node_id")).select("fact_id").distinct()
    return r.facts.join(held, "fact_id").select("fact_id", "status")


@statement("select distinct facts.fact_id, coalesce(s.file_id, a.node_id) file_id from anchors a join facts using (fact_id) left join symbols s on s.symbol_id + 1000000000000 = a.node_id where coalesce(s.file_id, a.node_id) % 250 = 3")
def facts_in_files(r):
    """Facts anchored in a file or in one of its symbols: the two kinds of anchor are joined apart and united."""
    by_file = r.anchors.where(f"node_id < {SYMBOL_NODES}").select("fact_id", F.col("node_id").alias("file_id"))
    s = r.symbols.select((F.col("symbol_id") + SYMBOL_NODES).alias("node_id"), "file_id")
    by_symbol = r.anchors.where(f"node_id >= {SYMBOL_NODES} and node_id < {FOLDER_NODES}").join(s, "node_id").select("fact_id", "file_id")
    both = by_file.unionByName(by_symbol).where("file_id % 250 = 3").distinct()
    return S.keyed(both, r.facts.select("fact_id"))


@statement("select node_id, hash from anchors where fact_id = 12")
def fact_anchors_of(r):
    return S.point(r.anchors, fact_id=12).select("node_id", "hash")
