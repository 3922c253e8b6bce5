"""Warnings after an edit, notes, hints and experience over the store's relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from workmap.operators import advice as A
from workmap.operators import records
from workmap.operators import resolution as N
from workmap.plans.relations import statement

#: Edits of tasks, what a task touched, and the facts about an edited file: history, common work, call sites, tests, lines.
_EDIT = """ed as (select seq edit, task_id task, node_id node from acts where kind = 'edit' and task_id is not null),
tc as (select distinct task_id task, node_id target from acts where kind in ('read', 'edit') and task_id is not null),
pt as (select src node, dst target, (n + last_seq % 4)::double / (n + last_seq % 4 + dst % 5) confidence, (n + last_seq % 4)::double / (n + last_seq % 4 + src % 5) reverse, n + last_seq % 4 together, n + last_seq % 4 + dst % 5 commits from links where type = 1
  union all select dst, src, (n + last_seq % 4)::double / (n + last_seq % 4 + src % 5), (n + last_seq % 4)::double / (n + last_seq % 4 + dst % 5), n + last_seq % 4, n + last_seq % 4 + src % 5 from links where type = 1),
lk as (select src node, dst target, (n + last_seq % 7)::double / 4 weight, n + last_seq % 5 tasks from links where type = 2 union all select dst, src, (n + last_seq % 7)::double / 4, n + last_seq % 5 from links where type = 2),
coc as (select edit, task, 'cochange' kind, target, arg_max(strength, (-by_, strength)) strength from (select edit, task, target, confidence strength, 0 by_ from ed join pt using (node) where confidence >= 0.5 and reverse >= 0.5 and together >= 3 and together <= commits and node <> target
  union all select edit, task, target, least(weight / 5, 1.0), 1 from ed join lk using (node) where weight >= 1.0 and tasks >= 3 and node <> target) x where not exists (select 1 from tc where tc.task = x.task and tc.target = x.target) group by edit, task, target),
dr as (select edit, task, node, symbol_id symbol from ed join symbols on file_id = node where symbol_id % 3 = 0),
st as (select dst_symbol_id symbol, src_file_id target, line, case resolution when 'import' then 0.8 else 0.3 end::double confidence from refs where dst_symbol_id is not null),
cal as (select edit, task, 'call_site' kind, target, max(confidence) strength from (select * from dr join st using (symbol) where confidence >= 0.8 and node <> target and not exists (select 1 from tc where tc.task = dr.task and tc.target = st.target) qualify row_number() over (partition by edit, symbol order by confidence desc, target, line) <= 5) group by 1, 2, 4),
ts as (select file_id node, (file_id * 7 + 3) % 2000 target, case when file_id % 2 = 0 then 0.8 else 0.6 end::double confidence from files where file_id % 3 <> 0 union all select file_id, (file_id * 11 + 5) % 2000, 0.3 from files),
tst as (select edit, task, 'test' kind, target, confidence strength from ed join ts using (node) where node <> target and not exists (select 1 from tc where tc.task = ed.task and tc.target = ts.target) and ed.task not in (select task_id from warnings where kind = 'cochange' and task_id % 12 = 0) qualify row_number() over (partition by edit order by confidence desc, target) <= 3),
rp as (select edit, task, node, edit % 50 + 10 lo, edit % 50 + 10 + edit % 13 hi from ed),
rn as (select file_id node, first, last, md5(cast(put_at as string)) oid from blame where content_hash = 'now'),
cd as (select oid, made_at at_, case when number % 10 = 0 then 'mass' else 'normal' end kind, number % 3 = 0 has_issue, number % 5 = 1 has_test from cards),
org as (select edit, task, 'origin' kind, node target, max((lines, at_, oid))[1]::double / (any_value(hi) - any_value(lo) + 1) strength, max((lines, at_, oid))[3] oid from (select edit, task, node, lo, hi, oid, sum(least(last, hi) - greatest(first, lo) + 1)::bigint lines from rp join rn using (node) where first <= hi and last >= lo group by all) join cd using (oid) where kind = 'normal' and (has_issue or has_test) group by edit, task, node)"""


def _edits(r):
    return r.acts.where("kind = 'edit' and task_id is not null").select(F.col("seq").alias("edit"), F.col("task_id").alias("task"), F.col("node_id").alias("node"))


def _touched(r):
    return r.acts.where("kind in ('read', 'edit') and task_id is not null").select(F.col("task_id").alias("task"), F.col("node_id").alias("target")).distinct()


def _partners(r):
    x = r.links.where("type = 1").withColumn("k", F.col("n") + F.col("last_seq") % 4)
    ahead, back = F.col("k") / (F.col("k") + F.col("dst") % 5), F.col("k") / (F.col("k") + F.col("src") % 5)
    one = x.select(F.col("src").alias("node"), F.col("dst").alias("target"), ahead.alias("confidence"), back.alias("reverse"), F.col("k").alias("together"), (F.col("k") + F.col("dst") % 5).alias("commits"))
    return one.unionByName(x.select(F.col("dst").alias("node"), F.col("src").alias("target"), back.alias("confidence"), ahead.alias("reverse"), F.col("k").alias("together"), (F.col("k") + F.col("src") % 5).alias("commits")))


def _linked(r):
    x = r.links.where("type = 2").select("src", "dst", ((F.col("n") + F.col("last_seq") % 7) / 4).alias("weight"), (F.col("n") + F.col("last_seq") % 5).alias("tasks"))
    return x.select(F.col("src").alias("node"), F.col("dst").alias("target"), "weight", "tasks").unionByName(x.select(F.col("dst").alias("node"), F.col("src").alias("target"), "weight", "tasks"))


def _cochange(r):
    return A.cochange_companions(_edits(r), _partners(r), _linked(r), _touched(r))


def _call_sites(r):
    drifts = _edits(r).join(r.symbols.where("symbol_id % 3 = 0").select(F.col("file_id").alias("node"), F.col("symbol_id").alias("symbol")), "node")
    sites = r.refs.where("dst_symbol_id is not null").select(F.col("dst_symbol_id").alias("symbol"), F.col("src_file_id").alias("target"), "line", F.when(F.col("resolution") == "import", 0.8).otherwise(0.3).alias("confidence"))
    return A.call_site_drifts(drifts, sites, _touched(r))


def _tests(r):
    f = r.files.select(F.col("file_id").alias("node"))
    sure = F.when(F.col("node") % 2 == 0, 0.8).otherwise(0.6)
    tests = f.where("node % 3 <> 0").select("node", ((F.col("node") * 7 + 3) % 2000).alias("target"), sure.alias("confidence")).unionByName(f.select("node", ((F.col("node") * 11 + 5) % 2000).alias("target"), F.lit(0.3).alias("confidence")))
    warned = r.warnings.where("kind = 'cochange' and task_id % 12 = 0").select(F.col("task_id").alias("task")).distinct()
    return A.test_companions(_edits(r), tests, _touched(r), warned)


def _origins(r):
    replaced = _edits(r).withColumn("lo", F.col("edit") % 50 + 10).withColumn("hi", F.col("lo") + F.col("edit") % 13)
    runs = r.blame.where("content_hash = 'now'").select(F.col("file_id").alias("node"), "first", "last", F.md5(F.col("put_at").cast("string")).alias("oid"))
    cards = r.cards.select("oid", F.col("made_at").alias("at"), F.when(F.col("number") % 10 == 0, "mass").otherwise("normal").alias("kind"), (F.col("number") % 3 == 0).alias("has_issue"), (F.col("number") % 5 == 1).alias("has_test"))
    return A.edit_origins(replaced, runs, cards)


@statement(f"with {_EDIT} select node, count(*) partners, count(*) filter (where confidence >= 0.5 and reverse >= 0.5) sure from pt where node in (select node from ed) group by 1")
def edit_facts(r):
    """What is known of an edited file's partners."""
    p = _partners(r).join(_edits(r).select("node"), "node", "left_semi")
    return p.groupBy("node").agg(F.count("*").alias("partners"), F.count_if((F.col("confidence") >= 0.5) & (F.col("reverse") >= 0.5)).alias("sure"))


@statement(f"with {_EDIT} select edit, target, round(strength, 6) strength from coc")
def warnings_cochange(r):
    return _cochange(r).select("edit", "target", F.round("strength", 6).alias("strength"))


@statement(f"with {_EDIT} select edit, target, strength from cal")
def warnings_call_site(r):
    return _call_sites(r).select("edit", "target", "strength")


@statement(f"with {_EDIT} select edit, target, strength from tst")
def warnings_tests(r):
    return _tests(r).select("edit", "target", "strength")


@statement(f"with {_EDIT} select edit, target, round(strength, 6) strength, oid from org")
def warnings_origin(r):
    return _origins(r).select("edit", "target", F.round("strength", 6).alias("strength"), "oid")


@statement(f"with {_EDIT}, al as (select edit, kind, target, strength from coc union all select edit, kind, target, strength from cal union all select edit, kind, target, strength from tst union all select edit, kind, target, strength from org) select edit, kind, target, place from (select edit, kind, target, row_number() over (partition by edit order by case kind when 'cochange' then 0 when 'call_site' then 1 when 'test' then 2 else 3 end, round(strength, 9) desc, target) place from al) where place <= 3")
def warnings_told(r):
    """All rules together: at most three for an edit."""
    every = _cochange(r).unionByName(_call_sites(r)).unionByName(_tests(r)).unionByName(_origins(r).drop("oid"))
    return A.told(every).select("edit", "kind", "target", F.col("place").cast("long").alias("place"))


_RUNS = "ru as (select session_id session, seq, ts, 'cmd' || cast(node_id % 3 as string) command from acts where kind in ('check', 'prompt')), ch as (select session_id session, seq, ts from acts where kind = 'edit')"


@statement(f"""with {_RUNS}, b as (select * from ru union all select session, seq, ts, null from ch), m as (select *, sum((command is null)::int) over (partition by session order by ts, seq rows between unbounded preceding and current row) c from b),
l as (select session, seq, command, c, lag(seq) over (partition by session, command order by ts, seq) last_seq, lag(c) over (partition by session, command order by ts, seq) lc from m where command is not null) select session, seq, command, last_seq from l where lc = c""")
def redundant_notes(r):
    """Runs of a command again with no edit since."""
    runs = r.acts.where("kind in ('check', 'prompt')").select(F.col("session_id").alias("session"), "seq", "ts", F.concat(F.lit("cmd"), (F.col("node_id") % 3).cast("string")).alias("command"))
    return A.redundant_runs(runs, r.acts.where("kind = 'edit'").select(F.col("session_id").alias("session"), "seq", "ts"))


_FRAMES = """fr as (select seq failure, 0 pos, '/work/repo/' || path path, seq % 90 line from acts join files on file_id = node_id where kind = 'check' union all select seq, 1, string_split(path, '/')[-1], seq % 70 from acts join files on file_id = (node_id + 1) % 2000 where kind = 'check'
  union all select seq, 2, 'nowhere/x.rs', 1 from acts where kind = 'check'),
gr as (select failure, pos, line, file_id file from fr join files on fr.path = '/work/repo/' || files.path or fr.path = string_split(files.path, '/')[-1] where flags & 2 = 0)"""


def _frames(r):
    f = r.files.select(F.col("file_id").alias("node_id"), "path")
    a = r.acts.where("kind = 'check'")
    one = a.join(f, "node_id").select(F.col("seq").alias("failure"), F.lit(0).alias("pos"), F.concat(F.lit("/work/repo/"), "path").alias("path"), (F.col("seq") % 90).alias("line"))
    two = a.withColumn("node_id", (F.col("node_id") + 1) % 2000).join(f, "node_id").select(F.col("seq").alias("failure"), F.lit(1).alias("pos"), F.element_at(F.split("path", "/"), -1).alias("path"), (F.col("seq") % 70).alias("line"))
    return one.unionByName(two).unionByName(a.select(F.col("seq").alias("failure"), F.lit(2).alias("pos"), F.lit("nowhere/x.rs").alias("path"), F.lit(1).cast("long").alias("line")))


def _grounded(r):
    return A.grounded(_frames(r), r.files.select(F.col("file_id").alias("file"), "path", (F.col("flags").bitwiseAND(2) == 0).alias("unchanged")))


@statement(f"with {_FRAMES} select failure, pos, line, file from gr")
def grounded_failures(r):
    return _grounded(r)


@statement(f"with {_FRAMES} select failure, pos, file, line, arg_min(symbol_id, (end_line - start_line, -start_line, -symbol_id)) symbol from gr join symbols on symbols.file_id = file and start_line <= line and line <= end_line group by 1, 2, 3, 4 qualify row_number() over (partition by failure order by pos) <= 3")
def failure_map(r):
    """The first three frames of a failure that lie in a definition of an indexed file."""
    g = _grounded(r)
    spans = r.symbols.select(F.col("file_id").alias("file"), F.col("symbol_id").alias("symbol"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    inner = N.innermost(g.select("file", "line").distinct(), spans)
    placed = g.join(inner, ["file", "line"])
    return placed.withColumn("k", F.row_number().over(Window.partitionBy("failure").orderBy("pos"))).where("k <= 3").select("failure", "pos", "file", "line", "symbol")


_NARROW = """ne as (select distinct task_id task, node_id node from acts where kind = 'edit' and task_id is not null), na as (select file_id node, (file_id * 7 + 3) % 2000 test from files where file_id % 3 = 0), im as (select src node, dst test from links where type = 0 and dst % 4 = 0), et as (select distinct task, node test from ne where node % 4 = 0)"""


@statement(f"with {_NARROW}, a as (select task, test, 0 r, 'named' why from ne join na using (node) union all select task, test, 1, 'importing' from ne join im using (node) union all select task, test, 2, 'edited' from et), b as (select task, test, min((r, why)) m from a group by 1, 2) select task, test, m[2] why, row_number() over (partition by task order by m, test)::int place from b qualify row_number() over (partition by task order by m, test) <= 3")
def narrow_tests(r):
    e = r.acts.where("kind = 'edit' and task_id is not null").select(F.col("task_id").alias("task"), F.col("node_id").alias("node")).distinct()
    named = r.files.where("file_id % 3 = 0").select(F.col("file_id").alias("node"), ((F.col("file_id") * 7 + 3) % 2000).alias("test"))
    importing = r.links.where("type = 0 and dst % 4 = 0").select(F.col("src").alias("node"), F.col("dst").alias("test"))
    return A.narrow_tests(e, named, importing, e.where("node % 4 = 0").select("task", F.col("node").alias("test")))


_READS = "rd as (select seq read, session_id session, node_id % 40 file, coalesce(range_start, 1) lo, coalesce(range_start, 1) + 20 hi, node_id lines from acts where kind = 'read')"


@statement(f"""with {_READS}, pa as (select node_id % 40 file, node_id % 97 part from items group by 1, 2), tp as (select file, string_agg(cast(part as string), ',' order by part) parts from (select * from pa qualify row_number() over (partition by file order by part) <= 3) group by 1),
h as (select rd.read, case when exists (select 1 from rd e where e.session = rd.session and e.file = rd.file and e.read < rd.read and e.lo <= rd.lo and rd.hi <= e.hi) then 'already_read' when lines > 600 and parts is not null then 'parts' end hint, parts from rd left join tp using (file)) select read, hint, case when hint = 'parts' then parts end parts from h where hint is not null""")
def read_hints(r):
    lo = F.coalesce("range_start", F.lit(1))
    rd = r.acts.where("kind = 'read'").select(F.col("seq").alias("read"), F.col("session_id").alias("session"), (F.col("node_id") % 40).alias("file"), lo.alias("lo"), (lo + 20).alias("hi"), F.col("node_id").alias("lines"))
    earlier = rd.select("session", "file", F.col("lo").alias("first"), F.col("hi").alias("last"), "read")
    parts = r.items.select((F.col("node_id") % 40).alias("file"), (F.col("node_id") % 97).alias("part")).distinct()
    return A.read_hints(rd, earlier, parts)


@statement("select distinct w.task_id task, w.dst_node target from warnings w where kind = 'call_site' and not exists (select 1 from acts a where a.task_id = w.task_id and a.node_id = w.dst_node and a.kind in ('read', 'edit') and a.ts > w.ts)")
def stop_reasons(r):
    """Call-site warnings that nobody followed when the task stops."""
    w = r.warnings.select(F.col("task_id").alias("task"), "kind", F.col("dst_node").alias("target"), "ts")
    t = r.acts.where("kind in ('read', 'edit')").select(F.col("task_id").alias("task"), F.col("node_id").alias("target"), "ts")
    return A.unfollowed(w, t)


@statement("""with rc as (select injection_id task, injection_id * 31 % 10007 at_, node_id % 60 file from items), nw as (select distinct task, at_ from rc order by at_ desc, task desc limit 200), fs as (select item_id query, unnest([item_id % 60, item_id * 7 % 60, item_id * 11 % 60]) file from benchmark),
n as (select query, count(distinct file) n from fs group by 1), c as (select query, task, at_, count(distinct file) common from fs join rc using (file) join nw using (task, at_) group by 1, 2, 3) select query, arg_max(task, (common, at_, task)) task, max(common) common from c join n using (query) where 2 * common >= n group by 1""")
def experience_hints(r):
    """Earlier work that half of the files looked at were part of."""
    rc = r.items.select(F.col("injection_id").alias("task"), (F.col("injection_id") * 31 % 10_007).alias("at"), (F.col("node_id") % 60).alias("file"))
    fs = r.table("benchmark").select(F.col("item_id").alias("query"), F.explode(F.array(F.col("item_id") % 60, F.col("item_id") * 7 % 60, F.col("item_id") * 11 % 60)).alias("file"))
    return A.experience(rc, fs)


@statement("with f as (select fact_id, status, claim from facts where status = 'approved'), a as (select distinct fact_id, node_id from anchors where node_id < 1000000000000), q as (select item_id query, item_id * 31 % 2000 file from benchmark), h as (select query, fact_id, min(abs(node_id - file)) away from q, a where abs(node_id - file) <= 40 group by 1, 2) select query, fact_id, away, place from (select query, h.fact_id, away, row_number() over (partition by query order by away, h.fact_id) place from h join f using (fact_id)) where place <= 5")
def order_facts(r):
    """The facts whose anchors are closest to a listed file, five for a question: candidates meet by buckets of nodes, never by every pair."""
    q = r.table("benchmark").select(F.col("item_id").alias("query"), (F.col("item_id") * 31 % 2000).alias("file"))
    a = r.anchors.where("node_id < 1000000000000").select("fact_id", "node_id").distinct().withColumn("b", F.floor(F.col("node_id") / 41))
    near = q.withColumn("b", F.explode(F.array(*[F.floor(F.col("file") / 41) + k for k in (-1, 0, 1)]))).join(a, "b").withColumn("away", F.abs(F.col("node_id") - F.col("file"))).where("away <= 40")
    best = near.groupBy("query", "fact_id").agg(F.min("away").alias("away")).join(r.facts.where("status = 'approved'").select("fact_id"), "fact_id")
    order = Window.partitionBy("query").orderBy("away", "fact_id")
    return best.withColumn("place", F.row_number().over(order)).where("place <= 5").select("query", "fact_id", "away", F.col("place").cast("long").alias("place"))


@statement("with s as (select session_id, count(*) edits from acts where kind = 'edit' and node_id % 50 = 10 group by 1 order by edits desc, session_id limit 5) select 'session' what, session_id id, edits n from s union all select 'fact', fact_id, count(*) from anchors where node_id % 50 = 10 and node_id < 1000000000000 group by 2 having count(*) > 1 union all select 'warning', dst_node, count(*) from warnings where dst_node % 50 = 10 group by 2")
def why_of_target(r):
    """What is known of some files: the sessions that changed them most, facts, warnings."""
    s = r.acts.where("kind = 'edit' and node_id % 50 = 10").groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").limit(5).select(F.lit("session").alias("what"), F.col("session_id").alias("id"), "n")
    f = r.anchors.where("node_id % 50 = 10 and node_id < 1000000000000").groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("fact").alias("what"), F.col("fact_id").alias("id"), "n")
    w = r.warnings.where("dst_node % 50 = 10").groupBy("dst_node").agg(F.count("*").alias("n")).select(F.lit("warning").alias("what"), F.col("dst_node").alias("id"), "n")
    return s.unionByName(f).unionByName(w)


@statement("with ln as (select file_id, start_line, end_line, symbol_id from symbols where symbol_id % 11 = 0) select symbol_id symbol, number card, sum(least(last, end_line) - greatest(first, start_line) + 1)::bigint lines from ln join blame using (file_id) join cards on oid = md5(cast(put_at as string)) where content_hash = 'now' and first <= end_line and last >= start_line group by 1, 2")
def why_lines(r):
    """The changes that own the lines of a definition."""
    asked = r.symbols.where("symbol_id % 11 = 0").select(F.col("file_id").alias("file"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), F.col("symbol_id").alias("symbol"))
    runs = r.blame.where("content_hash = 'now'").select(F.col("file_id").alias("file"), "first", "last", F.md5(F.col("put_at").cast("string")).alias("oid"))
    hit = records.overlapping(runs, asked, "file", 32).withColumn("lines", F.least("last", "hi") - F.greatest("first", "lo") + 1)
    return hit.join(r.cards.select("oid", F.col("number").alias("card")), "oid").groupBy("symbol", "card").agg(F.sum("lines").alias("lines"))

