"""Learning from tasks over the store's relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from workmap.operators import learn
from workmap.operators import learning as L
from workmap.plans.adapters import table
from workmap.plans.registry import query
from workmap.plans.relations import FOLDER_NODES, statement

_EV = "ev as (select task_id task, seq, kind, node_id node, range_start rng, seq % 4 <> 3 passed from acts where task_id is not null)"


def _events(r):
    return r.acts.where("task_id is not null").select(F.col("task_id").alias("task"), "seq", "kind", F.col("node_id").alias("node"), F.col("range_start").alias("range"), (F.col("seq") % 4 != 3).alias("passed"))


_GIVEN = "gv as (select distinct task_id task, items.node_id node from injections join items using (injection_id) where injections.injection_id % 3 = 0)"


def _given(r):
    return r.injections.where("injection_id % 3 = 0").select("injection_id", F.col("task_id").alias("task")).join(r.items, "injection_id").select("task", F.col("node_id").alias("node")).distinct()


_EARNED = f"""{_EV}, {_GIVEN}, tch as (select * from ev where kind in ('read', 'edit')),
ea as (select task, node, rng is not null symbol, case when kind = 'edit' then 1.0 when rng is not null then 0.4 else 0.3 end::double score from tch
  union all select task, node, false, 0.5 from (select task, node, min(seq) f from tch where kind = 'edit' group by 1, 2) join (select task, max(seq) l from ev where kind = 'check' and passed group by 1) using (task) where f < l
  union all select task, node, true, 0.3 from gv where exists (select 1 from tch where tch.task = gv.task and tch.node = gv.node)
  union all select task, node, false, case when exists (select 1 from tch where tch.task = h.task and tch.node = h.node and tch.seq > h.seq) then 0.2 else 0.05 end from (select task, seq, node from ev where kind = 'prompt') h),
fd as (select file_id node, cast(substr(split_part(path, '/', 1), 7) as bigint) + {FOLDER_NODES} folder from files),
so as (select task, 'symbol' kind, node id, score s from ea join fd using (node) where symbol union all select task, 'file', node, case when symbol then score * 0.5 else score end from ea join fd using (node) union all select task, 'dir', folder, score * 0.25 from ea join fd using (node))"""


def _earned(r):
    e = _events(r)
    folders = r.files.select(F.col("file_id").alias("node"), (F.substring(F.split("path", "/")[0], 7, 9).cast("long") + FOLDER_NODES).alias("folder"))
    hits = e.where("kind = 'prompt'").select("task", "seq", "node")
    return L.shared_out(L.interest_earned(e, _given(r), hits), folders)


@statement(f"with {_EARNED} select task, kind, id, round(sum(s), 6) score from so group by 1, 2, 3")
def interest_rules(r):
    """What each task earns for definitions, files and folders by all rules."""
    return _earned(r).withColumn("score", F.round("score", 6))


@statement("select node_id node, case when score <= 0.2 then 'dark' when node_id % 7 = 0 then 'landmark' else 'interesting' end tier from interest")
def tiers_sticky(r):
    """Tiers of files of which every seventh was a landmark before."""
    return r.interest.select(F.col("node_id").alias("node"), L.sticky_tier(F.col("score"), F.col("node_id") % 7 == 0).alias("tier"))


@statement("select node_id node, score, row_number() over (order by score desc, node_id) place from interest where score >= 3 qualify place <= (select least(greatest(ceil(count(*) / 100), 5), 50) from files)")
def landmarks_counted(r):
    """A hundredth of the files, but 5 to 50."""
    return L.landmarks(r.interest.withColumnRenamed("node_id", "node").select("node", "score"), r.files).withColumn("place", F.col("place").cast("long"))


_ROLES = f"""{_EV}, {_GIVEN}, edt as (select distinct task, node from ev where kind = 'edit'), nr as (select distinct task, dst node from edt join links on src = node where type = 0),
rr as (select task, node, r, nr.node is not null used from (select task, node, 3 r from edt union all select distinct task, node, 2 from ev where kind = 'read' union all select task, node, 1 from gv) left join nr using (task, node)),
ro as (select task, node, case max(case when r = 3 then 3 when r = 2 and used then 2 when r = 1 and used then 1 when r = 2 then 0 end) when 3 then 'edited' when 2 then 'read_and_used' when 1 then 'given_and_used' when 0 then 'read_only' end as role from rr group by 1, 2)"""


def _roles(r):
    return L.roles(_events(r), _given(r), r.links.where("type = 0").select("src", "dst"))


@statement(f"with {_ROLES} select task, node, role from ro where role is not null")
def roles_four(r):
    return _roles(r)


_OUT = "oc as (select task_id task, seq, case when task_id % 7 = 0 then 'reverted' when task_id % 7 < 3 then 'success' when task_id % 7 < 5 then 'unknown' else 'failure' end outcome from tasks)"


def _outcomes(r):
    m = F.col("task_id") % 7
    return r.tasks.select(F.col("task_id").alias("task"), "seq", F.when(m == 0, "reverted").when(m < 3, "success").when(m < 5, "unknown").otherwise("failure").alias("outcome"))


@statement(f"""with {_ROLES}, {_OUT}, w as (select *, case role when 'edited' then 1.0 when 'read_and_used' then 0.6 when 'given_and_used' then 0.4 else 0.2 end::double w from ro where role is not null qualify row_number() over (partition by task order by w desc, node) <= 40),
own as (select task, seq, outcome, node, w, case outcome when 'success' then 1.0 when 'unknown' then 0.3 when 'reverted' then 1.0 end::double gain from w join oc using (task) where outcome <> 'failure')
select x.node a, y.node b, round(sum(case when x.outcome = 'reverted' then -0.05 else 0.1 * x.w * y.w * x.gain end), 6) add, count(*) n from own x join own y using (task) where x.node < y.node group by 1, 2""")
def coaccess_four_roles(r):
    """Links of tasks by four roles; reverted tasks take from theirs."""
    return L.links(_roles(r), _outcomes(r)).groupBy("a", "b").agg(F.round(F.sum("add"), 6).alias("add"), F.count("*").alias("n"))


_REV = "rv as (select task_id task, bool_and(before is not distinct from aft) reverted from (select task_id, node_id, node_id % 11 before, case when task_id % 20 < 10 then node_id % 11 when node_id % 2 = 0 then node_id % 11 else node_id % 13 end aft from acts where kind = 'edit' and task_id is not null) group by 1)"


def _reverted(r):
    before, node = F.col("node_id") % 11, F.col("node_id")
    after = F.when(F.col("task_id") % 20 < 10, before).when(node % 2 == 0, before).otherwise(node % 13)
    return L.reverted_after(r.acts.where("kind = 'edit' and task_id is not null").select(F.col("task_id").alias("task"), before.alias("before"), after.alias("after_next")))


@statement(f"with {_REV} select task, reverted from rv")
def reverted_tasks(r):
    """Tasks of which all files were back as before when the next one ended."""
    return _reverted(r)


@statement(f"""with {_EV}, {_REV}, s as (select task, max(case when kind = 'edit' then seq end) e, max(case when kind = 'check' then seq end) c, arg_max(passed, seq) filter (where kind = 'check') p from ev group by 1)
select case when coalesce(reverted, false) then 'reverted' when e is null then 'abandoned' when coalesce(c, -1) < e then 'unknown' when p then 'success' else 'failure' end outcome, count(*) tasks from s left join rv using (task) group by 1""")
def outcomes_judged(r):
    e = _events(r).groupBy("task").agg(F.max(F.when(F.col("kind") == "edit", F.col("seq"))).alias("e"), F.max(F.when(F.col("kind") == "check", F.col("seq"))).alias("c"), F.max_by("passed", F.when(F.col("kind") == "check", F.col("seq"))).alias("p"))
    j = e.join(_reverted(r), "task", "left")
    verdict = L.outcome(F.col("e").isNotNull(), F.coalesce("reverted", F.lit(False)), F.coalesce("c", F.lit(-1)) >= F.col("e"), F.col("p"))
    return j.groupBy(verdict.alias("outcome")).agg(F.count("*").alias("tasks"))


@statement("select src, dst, round(sum(case when last_seq % 3 = 0 then 0.0 else weight end * pow(0.995::double, greatest(400 - last_seq % 400, 0))), 6) weight from ways group by 1, 2 having count(*) filter (where last_seq % 3 <> 0) > 0")
def transitions_taken_back(r):
    s = r.ways.select("src", "dst", (F.col("last_seq") % 400).alias("seq"), F.col("weight").alias("gain"), (F.col("last_seq") % 3 == 0).alias("reverted"))
    return L.taken_back(s, F.lit(400)).select("src", "dst", F.round("weight", 6).alias("weight"))


@statement(f"""with {_EV}, l as (select task, coalesce(list(node order by seq) filter (where kind = 'read'), []) r, coalesce(list(node order by seq) filter (where kind = 'edit'), []) e, coalesce(list(node order by seq) filter (where kind = 'check' and passed), []) v, coalesce(list(node order by seq) filter (where kind = 'check' and not passed), []) p from ev group by 1)
select task, '{{"localize":[' || array_to_string(r[1:8], ',') || '],"change":[' || array_to_string(e[1:8], ',') || '],"verify":[' || array_to_string(v[1:8], ',') || '],"pitfalls":[' || array_to_string(p[1:8], ',') || ']}}' episode from l""")
def episodes_written(r):
    return L.episodes(_events(r))


@statement("with c as (select 'b' || cast(node_id % 13 as string) term, episodes.task_id % 5 cluster from episodes join acts on acts.task_id = episodes.task_id where kind = 'edit'), a as (select term, count(*) n from c group by 1) select cluster, c.term, round(count(*) * count(*)::double / any_value(n), 6) score from c join a using (term) group by 1, 2")
def telling_terms(r):
    """How telling a term is of a cluster of tasks."""
    c = r.episodes.select("task_id").join(r.acts.where("kind = 'edit'").select("task_id", "node_id"), "task_id").select((F.col("task_id") % 5).alias("cluster"), F.concat(F.lit("b"), (F.col("node_id") % 13).cast("string")).alias("term"))
    n = c.groupBy("term").agg(F.count("*").alias("n"))
    own = c.groupBy("cluster", "term").agg(F.count("*").alias("m"))
    return own.join(n, "term").select("cluster", "term", F.round(L.telling(F.col("m"), F.col("n")), 6).alias("score"))


@statement("select injection_id query, round(used_count / 4, 6) + 0 a0, (task_id % 5)::double / 6 a2, case when label is null then 1.0 else 0.0 end::double a6 from injections where injection_id % 10 = 0")
def model_input_rows(r):
    f = r.injections.where("injection_id % 10 = 0").select(
        F.col("injection_id").alias("query"), (F.col("used_count") / 4).alias("top_lexical"), F.lit(0.5).alias("top_mass"), (F.col("task_id") % 5).alias("agreeing_kinds"), F.lit(3).alias("supporting_kinds"),
        F.lit(None).cast("double").alias("similar_task"), F.col("label").cast("double").alias("recent_precision"), F.lit(True).alias("is_continuing"),
    )
    x = L.model_inputs(f)
    return x.select("query", F.round(F.col("inputs")[0], 6).alias("a0"), F.col("inputs")[2].alias("a2"), F.col("inputs")[6].alias("a6"))


@query()
def calibration_fit(spark, d):
    """A model of labelled rows and whether it is kept: the sums of each step are aggregates, the fit itself is iterative."""
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", (F.log1p("n_chars") / 10).alias("x1"), (F.col("lang") == "en").cast("double").alias("x2"), F.col("quality").alias("y"))
    m = L.calibrated(s, ["x1", "x2"], "y", "doc_id")
    return spark.createDataFrame([(m["rows"], round(m["auc"], 6) if m["auc"] is not None else None, m["kept"])], "n long, auc double, kept boolean")


_CLAIMS = "fa as (select fact_id id, fact_id % 50 anchor, string_split(claim || ' ' || status || ' x y z w', ' ') words from facts), gi as (select fact_id id, fact_id % 50 anchor, string_split(claim || ' ' || case when fact_id % 2 = 0 then status else 'other new' end || ' x y z w', ' ') words from facts)"


@statement(f"with {_CLAIMS}, p as (select gi.id given, fa.id fact, len(list_intersect(gi.words, fa.words))::double / len(list_distinct(list_concat(gi.words, fa.words))) j from gi join fa using (anchor)), b as (select given, arg_max(fact, (j, -fact)) fact from p where j >= 0.8 group by 1) select gi.id given, fact from gi left join b on b.given = gi.id")
def facts_asserted(r):
    """Claims that say again what a fact of the same place says."""
    tail = F.lit(" x y z w")
    stored = r.facts.select(F.col("fact_id").alias("id"), F.array(F.col("fact_id") % 50).alias("anchors"), F.split(F.concat("claim", F.lit(" "), "status", tail), " ").alias("words"))
    said = F.when(F.col("fact_id") % 2 == 0, F.col("status")).otherwise("other new")
    given = r.facts.select(F.col("fact_id").alias("id"), F.array(F.col("fact_id") % 50).alias("anchors"), F.split(F.concat("claim", F.lit(" "), said, tail), " ").alias("words"))
    return L.asserted(stored, given)


@statement("with dr as (select distinct fact_id from anchors left join hashes using (node_id) where anchors.hash is distinct from hashes.hash) select facts.fact_id fact, case when status = 'suspect' and changed_at < 1300000000 - 14 * 86400000 then 'retired' when dr.fact_id is not null and status in ('approved', 'proposed') then 'suspect' else status end status from facts left join dr using (fact_id)")
def facts_reviewed(r):
    f = r.facts.select(F.col("fact_id").alias("fact"), "status", "changed_at")
    a = r.anchors.select(F.col("fact_id").alias("fact"), F.col("node_id").alias("node"), "hash")
    return L.reviewed(f, a, r.hashes.withColumnRenamed("node_id", "node"), 1_300_000_000)


@statement("select fact_id fact, case when fact_id % 30 = 1 then 'approved' when fact_id % 30 = 2 then 'retired' else status end status, case when fact_id % 30 = 3 then claim || ' (edited)' else claim end claim from facts")
def facts_worded(r):
    """The user's word: confirm, retire or edit."""
    m = F.col("fact_id") % 30
    return r.facts.select(F.col("fact_id").alias("fact"), F.when(m == 1, "approved").when(m == 2, "retired").otherwise(F.col("status")).alias("status"), F.when(m == 3, F.concat("claim", F.lit(" (edited)"))).otherwise(F.col("claim")).alias("claim"))


@statement("with e as (select session_id task, node_id % 3 file, seq, seq % 3 before, (seq * 7 + 1) % 3 aft from acts where kind in ('edit', 'read')), g as (select task, file, arg_min(before, seq) f, arg_max(aft, seq) l, count(*) n from e group by 1, 2) select task, file from g where n > 1 and f = l")
def approaches_changed_back(r):
    e = r.acts.where("kind in ('edit', 'read')").select(F.col("session_id").alias("task"), (F.col("node_id") % 3).alias("file"), "seq", (F.col("seq") % 3).alias("before"), ((F.col("seq") * 7 + 1) % 3).alias("after"))
    return L.changed_back(e)


_FAIL = "ru as (select session_id task, seq, 'sig' || cast(node_id % 2 as string) signature from acts where kind in ('check', 'read')), ed as (select session_id task, seq from acts where kind in ('edit', 'prompt'))"


@statement(f"""with {_FAIL}, b as (select * from ru union all select task, seq, null from ed), c as (select *, count(*) filter (where signature is null) over (partition by task order by seq rows between unbounded preceding and current row) ch from b),
l as (select *, lag(signature) over w ls, lag(ch) over w lc from c where signature is not null window w as (partition by task order by seq)) select task, signature, count(*) + 1 runs from l where ls = signature and lc < ch group by 1, 2""")
def approaches_failures(r):
    """Failures that stayed the same over edits."""
    runs = r.acts.where("kind in ('check', 'read')").select(F.col("session_id").alias("task"), "seq", F.concat(F.lit("sig"), (F.col("node_id") % 2).cast("string")).alias("signature"))
    return L.persisted_failures(runs, r.acts.where("kind in ('edit', 'prompt')").select(F.col("session_id").alias("task"), "seq"))


@statement(f"""with {_EV}, op as (select task_id task from tasks where outcome is null or outcome = 'unknown'), en as (select task, node, max(seq) s from ev where kind = 'edit' and task in (select task from op) group by 1, 2), rn as (select task, node, max(seq) s from ev where kind = 'read' and task in (select task from op) group by 1, 2),
e as (select task, string_agg(cast(node as string), ',' order by node) edited from (select * from en qualify row_number() over (partition by task order by s desc) <= 12) group by 1), o as (select task, string_agg(cast(node as string), ',' order by node) open from (select * from rn where not exists (select 1 from en where en.task = rn.task and en.node = rn.node) qualify row_number() over (partition by task order by s desc) <= 12) group by 1)
select task, edited, open from op left join e using (task) left join o using (task) where edited is not null or open is not null""")
def handoffs_left(r):
    return L.handoffs(r.tasks.select(F.col("task_id").alias("task"), "outcome"), _events(r))


@statement("with s as (select session_id, seq, kind, lead(seq) over w nseq, lead(kind) over w nkind from (select * from acts where kind in ('prompt', 'compact')) window w as (partition by session_id order by ts, seq)) select session_id, seq opened, nseq closed, case nkind when 'prompt' then 'next_prompt' when 'compact' then 'stop' end how from s where kind = 'prompt'")
def recorded_tasks(r):
    """A prompt opens a task; the next prompt or a stop closes it."""
    w = Window.partitionBy("session_id").orderBy("ts", "seq")
    s = r.acts.where("kind in ('prompt', 'compact')").withColumn("closed", F.lead("seq").over(w)).withColumn("n", F.lead("kind").over(w))
    return s.where("kind = 'prompt'").select("session_id", F.col("seq").alias("opened"), "closed", F.when(F.col("n") == "prompt", "next_prompt").when(F.col("n") == "compact", "stop").alias("how"))


_WATCH = "wa as (select seq edit, ts, node_id % 20 node from acts where kind = 'edit' and seq % 12 = 1), ho as (select seq, session_id, ts, node_id % 20 node, kind from acts where seq % 12 <> 1)"


@statement(f"""with {_WATCH}, cl as (select edit, arg_min(session_id, (abs(ho.ts - wa.ts), ho.seq)) session_id from wa join ho on ho.node = wa.node and ho.kind = 'edit' and ho.ts between wa.ts - 2000 and wa.ts + 2000 group by 1),
la as (select edit, arg_max(session_id, (ho.ts, ho.seq)) session_id from wa join ho on ho.ts between wa.ts - 30000 and wa.ts + 2000 where edit not in (select edit from cl) group by 1) select edit, session_id, 'claimed' how from cl union all select edit, session_id, 'latest' from la""")
def watcher_edits(r):
    """A change seen on disk is claimed by a hook's edit of the file within two seconds, else goes to the session with the latest event from 30 seconds before to 2 after.

    The latest event is the last before a change's end in the order of each slot of time, so no change meets all events around
    it; edits of a file at one time are one before changes are joined to them.
    """
    span, near = 32_000, 4_000
    w = r.acts.where("kind = 'edit' and seq % 12 = 1").select(F.col("seq").alias("edit"), F.col("ts").alias("at"), (F.col("node_id") % 20).alias("node"))
    h = r.acts.where("seq % 12 <> 1").select("seq", "session_id", "ts", (F.col("node_id") % 20).alias("node"), "kind")

    def slots(before: int, after: int, width: int):
        return F.explode(F.array_distinct(F.array(F.floor((F.col("at") - before) / width), F.floor((F.col("at") + after) / width)))).alias("b")

    ends = w.select("edit", "at", slots(30_000, 2_000, span), (F.col("at") + 2_000).alias("t"), F.lit(1).alias("last"), F.lit(None).cast("struct<ts:bigint,seq:bigint,session_id:bigint>").alias("event"))
    seen = h.select(F.lit(None).cast("long").alias("edit"), F.lit(None).cast("long").alias("at"), F.floor(F.col("ts") / span).alias("b"), F.col("ts").alias("t"), F.lit(0).alias("last"), F.struct(F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"), F.col("session_id").cast("long").alias("session_id")).alias("event"))
    order = Window.partitionBy("b").orderBy("t", "last", "event.seq").rowsBetween(Window.unboundedPreceding, 0)
    passed = seen.unionByName(ends).withColumn("event", F.last("event", ignorenulls=True).over(order)).where("last = 1 and event.ts >= at - 30000")
    latest = passed.groupBy("edit").agg(F.max_by("event.session_id", F.struct("event.ts", "event.seq")).alias("latest"))
    edits = h.where("kind = 'edit'").groupBy("node", "ts").agg(F.min_by("session_id", "seq").alias("session_id"), F.min("seq").alias("seq")).withColumn("b", F.floor(F.col("ts") / near))
    claims = w.select("edit", "at", "node", slots(2_000, 2_000, near)).join(edits, ["node", "b"]).where(F.col("ts").between(F.col("at") - 2_000, F.col("at") + 2_000))
    claimed = claims.groupBy("edit").agg(F.min_by("session_id", F.struct(F.abs(F.col("ts") - F.col("at")), "seq")).alias("claimed")).withColumn("n", F.lit(1))
    by = latest.join(claimed, "edit", "full")
    return by.select("edit", F.when(F.col("n") == 1, F.col("claimed")).otherwise(F.col("latest")).alias("session_id"), F.when(F.col("n") == 1, "claimed").otherwise("latest").alias("how"))


@statement("select mark, case when mark is null then 'full' when head = mark then 'unchanged' when mark in (select number from cards) and age < 7 then 'incremental' else 'full' end plan, mark is null or age >= 7 or head <> mark due from (select case when value = 0 then null else value end mark, 200 head, value / 50 age from git_state)")
def mining_plans(r):
    """Whether history is to be mined anew, onward from a mark, or not at all; it is due without a mark, after a week or when the head has moved."""
    g = r.git_state.select(F.when(F.col("value") != 0, F.col("value")).cast("long").alias("mark"), F.lit(200).alias("head"), (F.col("value") / 50).alias("age"))
    known = r.cards.select(F.col("number").alias("mark")).withColumn("known", F.lit(True))
    j = g.join(known, "mark", "left")
    plan = F.when(F.col("mark").isNull(), "full").when(F.col("head") == F.col("mark"), "unchanged").when(F.col("known") & (F.col("age") < 7), "incremental").otherwise("full")
    return j.select("mark", plan.alias("plan"), (F.col("mark").isNull() | (F.col("age") >= 7) | (F.col("head") != F.col("mark"))).alias("due"))


@statement("with o as (select src, dst, n from links where type = 1 and last_seq % 2 = 0), nw as (select src, dst, n from links where type = 1), m as (select src, dst, sum(n)::bigint n from (select * from o union all select * from nw) group by 1, 2) select src, dst, n, row_number() over (partition by src order by n desc, dst) place from m where n >= 2 qualify place <= 32")
def mining_written(r):
    """A mining's counts added to what is stored, and the edges made from them anew: those of two co-changes or more, 32 a file."""
    own = r.links.where("type = 1").select("src", "dst", "n", "last_seq")
    m = own.where("last_seq % 2 = 0").select("src", "dst", "n").unionByName(own.select("src", "dst", "n")).groupBy("src", "dst").agg(F.sum("n").alias("n")).where("n >= 2")
    return m.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("place <= 32").withColumn("place", F.col("place").cast("long"))


@statement("with w as (select l_partkey src, case when l_linenumber <= 4 then 1 else l_linenumber end dst, count(*)::double / 4 weight from lineitem group by 1, 2), m as (select src, sum(weight) total, max((weight, -dst)) m from w group by 1) select src, -m[2] dst, m[1] weight from m where m[1] >= 2.0 and m[1] > 0.5 * total")
def next_files(r):
    """The one way on from a file: of weight 2 or more, and more than half of all that leads on."""
    lines = r.table("lineitem")
    ways = lines.groupBy(F.col("l_partkey").alias("src"), F.when(F.col("l_linenumber") <= 4, 1).otherwise(F.col("l_linenumber")).alias("dst")).agg((F.count("*") / 4).alias("weight"))
    return learn.next_file(ways)


@statement(f"with {_EARNED}, {_ROLES[_ROLES.index("edt as"):]}, op as (select task_id task from tasks where ended_at is not null) select task, (select count(*) from (select distinct kind, id from so where so.task = op.task)) interest, (select count(*) from ro where ro.task = op.task and role is not null) roles, (select count(*) from ev where ev.task = op.task) steps from op where task % 50 = 0")
def task_ends(r):
    """What the end of a task gives to learning: how many places earn interest, how many roles, of how many steps."""
    ended = r.tasks.where("ended_at is not null and task_id % 50 = 0").select(F.col("task_id").alias("task"))
    parts = {"interest": _earned(r).select("task", "kind", "id").distinct(), "roles": _roles(r), "steps": _events(r)}
    out = ended
    for name, rows in parts.items():
        out = out.join(rows.groupBy("task").agg(F.count("*").alias(name)), "task", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
