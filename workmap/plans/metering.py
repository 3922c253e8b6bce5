"""Usage, cost, records and coordination."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from workmap.operators import activity, records
from workmap.plans.adapters import EVENTS, events, table, tasked
from workmap.plans.registry import query


def usage(spark, d):
    """Token rows of purchases and errors: (session, ts, turn, response, tokens)."""
    e = events(spark, d).where("kind in ('edit', 'check')")
    turn = F.row_number().over(Window.partitionBy("session").orderBy("ts", "seq"))
    response = F.when(F.col("node") % 10 != 0, F.col("node"))
    return e.select("session", "ts", "seq", turn.alias("turn"), response.alias("response"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("tokens"))


USAGE = EVENTS + ", us as (select session, ts, seq, row_number() over (partition by session order by ts, seq) turn, case when node % 10 <> 0 then node end response, round(coalesce(value, 0) * 100)::bigint tokens from e where kind in ('edit', 'check')), ss as (select session, min(ts) started_at from e group by 1)"


@query(f"with {USAGE}, m as (select session, ts, seq, node from e where kind = 'read' and node is not null), w as (select u.tokens, (select node from m where m.session = u.session and m.ts <= u.ts order by m.ts desc, m.seq desc limit 1) node from us u) select node, sum(tokens)::bigint tokens from w where node is not null group by 1 having sum(tokens) > 0")
def file_tokens_asof(spark, d):
    """Tokens of each response go to the file that its session read last."""
    marks = events(spark, d).where("kind = 'read' and node is not null").select("session", "ts", "seq", "node")
    facts = usage(spark, d).select("session", "ts", "tokens")
    return activity.as_of(facts, marks, "session", "node").where("node is not null").groupBy("node").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


@query(f"with {USAGE} select u.session, u.turn, u.response, u.tokens from us u join ss s on s.session = u.session where not exists (select 1 from us c join ss cs on cs.session = c.session where c.response = u.response and c.session <> u.session and (cs.started_at < s.started_at or (cs.started_at = s.started_at and c.session < u.session)))")
def usage_fork_dedup(spark, d):
    sessions = events(spark, d).groupBy("session").agg(F.min("ts").alias("started_at"))
    return records.fork_dedup(usage(spark, d), sessions).select("session", F.col("turn").cast("long").alias("turn"), "response", "tokens")


@query(f"with {USAGE}, t as (select session, seq, task from et) select u.session, t.task, sum(tokens)::bigint tokens, count(*) turns, count(*) filter (where response is null) unnamed from us u join t using (session, seq) group by 1, 2")
def receipt_tallies(spark, d):
    t = tasked(spark, d).select("session", "seq", "task")
    return usage(spark, d).join(t, ["session", "seq"]).groupBy("session", "task").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns"), F.count_if(F.col("response").isNull()).alias("unnamed"))


PRICES = [("m-one", 3_000_000, 3_750_000, 6_000_000, 300_000, 15_000_000, 1100, 2000), ("m-two", 800_000, 1_000_000, 1_600_000, 80_000, 4_000_000, None, None)]


def price_table(spark):
    return spark.createDataFrame(PRICES, "model string, input long, write_5m long, write_1h long, read long, output long, us_per_mille int, fast_per_mille int")


_BILLED = """select l_orderkey, l_linenumber, case l_partkey % 4 when 0 then 'm-one' when 1 then 'm-one-20250101' when 2 then 'm-two' else 'other' end model, case when l_partkey % 11 = 0 then 'batch' else 'standard' end tier,
case when l_partkey % 7 = 0 then 'fast' when l_partkey % 13 = 0 then null else 'standard' end speed, case when l_partkey % 5 = 0 then 'us' else 'global' end geo, l_orderkey % 5000 input, l_partkey % 300 cache_write,
case when l_partkey % 3 = 0 then l_partkey % 300 when l_partkey % 3 = 1 then 0 end cache_write_1h, l_suppkey * 10 cache_read, l_linenumber * 100 output from lineitem"""


@query(f"""with b as ({_BILLED}), p(m, i, w5, w1, r, o, us, fast) as (values ('m-one', 3000000, 3750000, 6000000, 300000, 15000000, 1100, 2000), ('m-two', 800000, 1000000, 1600000, 80000, 4000000, null, null)),
j as (select b.*, coalesce(p1.i, p2.i) i, coalesce(p1.w5, p2.w5) w5, coalesce(p1.w1, p2.w1) w1, coalesce(p1.r, p2.r) r, coalesce(p1.o, p2.o) o, coalesce(p1.us, p2.us) us, coalesce(p1.fast, p2.fast) fast from b left join p p1 on p1.m = model left join p p2 on p2.m = regexp_replace(model, '-[0-9]{{8}}$', '')),
k as (select *, case when cache_write_1h <= cache_write then cache_write_1h when cache_write_1h is null and cache_write = 0 then 0 end h, case geo when 'global' then 1000 when 'us' then us end pm from j),
q as (select *, case when i is null then 'model' when tier <> 'standard' then 'tier' when pm is null then 'region' when h is null then 'cache_split' when speed is null then 'speed' when speed = 'fast' and fast is null then 'speed' end why from k)
select model, coalesce(why, '') as unpriced, count(*) turns, coalesce(sum(case when why is null then ((cache_write - h)::hugeint * w5 + h::hugeint * w1 + input::hugeint * i + cache_read::hugeint * r + output::hugeint * o) * (case when speed = 'fast' then fast else 1000 end) * pm // 1000000 end), 0)::varchar picodollars from q group by 1, 2""")
def cost_picodollars(spark, d):
    rows = spark.sql(_BILLED.replace("from lineitem", "from {lines}"), lines=table(spark, d, "lineitem"))
    priced = records.picodollars(rows, price_table(spark)).groupBy("model", F.coalesce("unpriced", F.lit("")).alias("unpriced"))
    return priced.agg(F.count("*").alias("turns"), F.coalesce(F.sum("picodollars"), F.lit(0)).cast("string").alias("picodollars"))


@query("with u as (select conv_id session, turn, length(text) % 1000 cache_write, (length(text) % 97) * 10 cache_read from conversations), l as (select *, lag(cache_read) over (partition by session order by turn, cache_write, cache_read) b from u) select session, turn, cache_read from l where cache_write * 2 > cache_write + cache_read and cache_read * 2 < b")
def cache_breaks(spark, d):
    n = F.length("text").cast("long")
    u = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", F.struct((n % 1000).alias("w"), (n % 97 * 10).alias("r")).alias("ts"), (n % 1000).alias("cache_write"), (n % 97 * 10).alias("cache_read"))
    return records.cache_breaks(u).select("session", "turn", "cache_read")




@query("""with nm as (select p_partkey symbol, p_size file, p_brand family, p_type as name from part), rf as (select p_partkey + 1000000 ref, p_partkey % 50 file, p_brand family, p_type as name from part),
h as (select file, name, count(*) n, min(symbol) s from nm group by 1, 2), w as (select family, name, count(*) n, min(symbol) s from nm group by 1, 2)
select ref, case when h.n = 1 then h.s when h.n is null and w.n = 1 then w.s end symbol, case when h.n = 1 then 'same_file' when h.n is null and w.n = 1 then 'name_only' end resolution from rf left join h using (file, name) left join w using (family, name)""")
def resolve_names(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.col("p_partkey").alias("symbol"), F.col("p_size").cast("long").alias("file"), F.col("p_brand").alias("family"), F.col("p_type").alias("name"))
    refs = p.select((F.col("p_partkey") + 1_000_000).alias("ref"), (F.col("p_partkey") % 50).alias("file"), F.col("p_brand").alias("family"), F.col("p_type").alias("name"))
    return records.resolve(refs, names)


@query("""with o as (select p_brand, p_type, p_partkey id, row_number() over (partition by p_brand, p_type order by p_partkey) k from part where p_partkey % 3 <> 0), n as (select p_brand, p_type, p_partkey id, row_number() over (partition by p_brand, p_type order by p_partkey) k from part where p_partkey % 3 <> 1)
select coalesce(o.p_brand, n.p_brand) p_brand, coalesce(o.p_type, n.p_type) p_type, coalesce(o.k, n.k)::int k, o.id as old, n.id as new from o full join n on o.p_brand = n.p_brand and o.p_type = n.p_type and o.k = n.k""")
def symbol_diff(spark, d):
    p = table(spark, d, "part")
    return records.matched(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 <> 1"), ["p_brand", "p_type"], "p_partkey", "p_partkey")


SPANS = "sp as (select l_orderkey f, (l_partkey % 500)::bigint lo_, (l_partkey % 500 + l_quantity)::bigint hi_, l_linenumber id from lineitem)"


@query(f"with {SPANS} select a.f file, a.id, b.id asked from sp a join sp b on a.f = b.f where a.id <> b.id and a.lo_ <= b.hi_ and a.hi_ >= b.lo_")
def interval_overlap(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 500).cast("long").alias("first"), (F.col("l_partkey") % 500 + F.col("l_quantity")).cast("long").alias("last"), F.col("l_linenumber").alias("id"))
    asked = s.select("file", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("id").alias("asked"))
    return records.overlapping(s, asked, "file", 64).where("id <> asked").select("file", "id", "asked")


@query(f"with {SPANS}, o as (select *, max(hi_) over (partition by f order by lo_, hi_ rows between unbounded preceding and 1 preceding) r from sp), i as (select *, sum((coalesce(r, lo_ - 2) < lo_)::int) over (partition by f order by lo_, hi_ rows between unbounded preceding and current row) g from o), n as (select f, g, max(hi_) - min(lo_) + 1 n from i group by 1, 2) select f file, sum(n)::bigint covered, count(*) islands from n group by 1")
def lines_covered(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 500).cast("long").alias("first"), (F.col("l_partkey") % 500 + F.col("l_quantity")).cast("long").alias("last"))
    return records.covered_length(s, ["file"])


@query("with h as (select p_partkey, case when p_size > 5 then p_brand end now, case when p_partkey % 4 <> 0 then p_brand end stamped from part) select distinct p_partkey fact from h where now is distinct from stamped")
def facts_changed_anchors(spark, d):
    h = table(spark, d, "part").select(F.col("p_partkey").alias("fact"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("now"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("stamped"))
    return h.where(~F.col("now").eqNullSafe(F.col("stamped"))).select("fact").distinct()


@query("select case when l_linenumber = 1 then l_suppkey else l_partkey end file, l_linestatus as status, count(distinct l_orderkey) facts from lineitem group by 1, 2")
def fact_counts_by_file(spark, d):
    file = F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).otherwise(F.col("l_partkey"))
    return table(spark, d, "lineitem").groupBy(file.alias("file"), F.col("l_linestatus").alias("status")).agg(F.count_distinct("l_orderkey").alias("facts"))


@query("select count(*) filter (where x) dangling, count(*) filter (where not x) anchored from (select c_custkey, not exists (select 1 from orders where o_custkey = c_custkey) x from customer)")
def fact_health(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("there", F.lit(1))
    return c.join(o, "c_custkey", "left").agg(F.count_if(F.col("there").isNull()).alias("dangling"), F.count_if(F.col("there").isNotNull()).alias("anchored"))


@query("with c as (select l_orderkey card, list_distinct(list(l_partkey % 50)) issues, max(l_suppkey) pr from lineitem group by 1) select card from c where pr = 7 or list_contains(issues, 7)")
def cards_numbered(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("card")).agg(F.collect_set(F.col("l_partkey") % 50).alias("issues"), F.max("l_suppkey").alias("pr"))
    return c.where((F.col("pr") == 7) | F.array_contains("issues", F.lit(7).cast("long"))).select("card")


@query("with c as (select l_orderkey card, l_partkey file, count(*) over (partition by l_orderkey) n from (select distinct l_orderkey, l_partkey from lineitem)) select file, round(max(0.8::double / n), 6) seed from c group by 1")
def history_seed_share(spark, d):
    """A change's weight spread evenly over its files, the most of each file."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("file")).distinct()
    n = c.groupBy("card").agg(F.count("*").alias("n"))
    return c.join(n, "card").groupBy("file").agg(F.round(F.max(0.8 / F.col("n")), 6).alias("seed"))


@query(f"with {EVENTS}, w as (select session, task, ts, seq, node + 1 named from et where kind = 'check' and task > 0 and node is not null) select w.session, w.seq, exists (select 1 from et x where x.session = w.session and x.task = w.task and x.node = w.named and x.ts > w.ts and x.kind in ('read', 'edit')) resolved from w")
def warnings_resolution(spark, d):
    """Was the file that a warning names touched after it?"""
    t = tasked(spark, d)
    w = t.where("kind = 'check' and task > 0 and node is not null").select("session", "task", "ts", "seq", (F.col("node") + 1).alias("named"))
    last = t.where("kind in ('read', 'edit')").groupBy("session", "task", F.col("node").alias("named")).agg(F.max("ts").alias("touched"))
    return w.join(last, ["session", "task", "named"], "left").select("session", "seq", F.coalesce(F.col("touched") > F.col("ts"), F.lit(False)).alias("resolved"))


POSITIONS = EVENTS + """, pp as (select session, node, kind, ts, seq, ts + case kind when 'read' then 600000 else 1800000 end hold from et where kind in ('read', 'edit') and node is not null),
po as (select session, node, arg_max(kind, (hold, ts, seq)) as mode, max(hold) hold, arg_max(ts, (hold, ts, seq)) last from pp group by 1, 2)"""


def _positions(spark, d):
    e = events(spark, d).where("kind in ('read', 'edit') and node is not null")
    held = e.withColumn("until", records.until(F.col("kind"), F.col("ts"), F.lit(None).cast("long")))
    return held.groupBy("session", "node").agg(F.max(F.struct("until", "ts", "seq", "kind")).alias("p")).select("session", "node", F.col("p.kind").alias("mode"), F.col("p.until").alias("until"), F.col("p.ts").alias("last"))


@query(f"with {POSITIONS} select session, node, mode, hold as until, last from po")
def position_holds(spark, d):
    """Of a session's positions on a node the one that holds longest."""
    return _positions(spark, d)


@query(f"""with {POSITIONS}, ed as (select seq edit, session, ts at_, node from e where kind = 'edit' and node is not null), seen as (select distinct session other, ts from e),
cp as (select distinct p_partkey::bigint src, (p_partkey + 1)::bigint dst from part where p_partkey < 100),
f as (select edit, ed.session, at_, node held, 2 r from ed union all select edit, ed.session, at_, dst, 1 from ed join cp on src = node),
l as (select distinct edit, po.session other, held, r from f join po on po.node = held where po.session <> f.session and last <= at_ and at_ < hold and exists (select 1 from seen where seen.other = po.session and ts > at_ - 900000 and ts <= at_))
select edit, other, held, case r when 2 then 'same' else 'coupled' end via from l qualify row_number() over (partition by edit, other order by r desc, held) = 1""")
def concerned_sessions(spark, d):
    e = events(spark, d)
    edits = e.where("kind = 'edit' and node is not null").select(F.col("seq").alias("edit"), "session", F.col("ts").alias("at"), "node")
    couplings = table(spark, d, "part").where("p_partkey < 100").select(F.col("p_partkey").cast("long").alias("src"), (F.col("p_partkey") + 1).cast("long").alias("dst")).distinct()
    positions = _positions(spark, d).select("session", "node", "mode", "last", F.lit(None).cast("long").alias("task_ended"))
    return records.concerned(edits, positions, e.select("session", "ts"), couplings)


@query(f"with {EVENTS}, w as (select seq id, ts, node from e where kind = 'edit' and node is not null), c as (select w.id, x.session, x.ts xt, x.seq xs from w join e x on x.node = w.node and x.kind = 'read' and x.ts between w.ts - 3600000 and w.ts + 120000) select id, arg_max(session, (xt, xs)) session from c group by 1")
def watcher_attribution(spark, d):
    """A change seen on disk goes to the session whose latest event on the file lies in its window: equal buckets of time, then the exact range."""
    e = events(spark, d)
    span = 3_720_000
    w = e.where("kind = 'edit' and node is not null").select(F.col("seq").alias("id"), F.col("ts").alias("at"), "node").withColumn("b", F.explode(F.array(F.floor((F.col("at") - 3_600_000) / span), F.floor((F.col("at") + 120_000) / span))))
    x = e.where("kind = 'read' and node is not null").select("session", "ts", "seq", "node", F.floor(F.col("ts") / span).alias("b"))
    near = w.distinct().join(x, ["node", "b"]).where(F.col("ts").between(F.col("at") - 3_600_000, F.col("at") + 120_000))
    return near.groupBy("id").agg(F.max_by("session", F.struct("ts", "seq")).alias("session"))


@query(f"with {EVENTS} select session, seq from e qualify row_number() over (partition by session order by (kind <> 'check')::int desc, ts desc, seq desc) <= 20")
def retention_cap(spark, d):
    """Past the cap failed checks go first, then the oldest."""
    e = events(spark, d)
    return records.within_cap(e, ["session"], [F.desc((F.col("kind") != "check").cast("int")), F.desc("ts"), F.desc("seq")], 20).select("session", "seq")


@query(f"with {EVENTS} select session, node, kind, seq from e where node is not null qualify row_number() over (partition by session, node order by ts desc, seq desc) = 1")
def upsert_latest(spark, d):
    e = events(spark, d).where("node is not null").select("session", "node", "kind", "seq", "ts")
    return records.latest(e, ["session", "node"], [F.desc("ts"), F.desc("seq")]).drop("ts")


@query(f"with {EVENTS} select session, max(seq) seq, arg_max(value, seq) filter (where value is not null) as value, arg_max(node, seq) filter (where node is not null) node from e group by 1")
def upsert_coalesce(spark, d):
    """Given fields replace, missing ones keep what is stored."""
    return records.latest_known(events(spark, d), ["session"], "seq", ["value", "node"])


@query("with c as (select conv_id, list(role order by turn) roles, count(*) n from conversations group by 1) select count(*) given, count(*) filter (where n > 2) used from c where list_contains(roles, 'assistant')")
def next_file_use(spark, d):
    """Records whose list names a reason, and those of them that were used."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"), F.count("*").alias("n"))
    return c.where(F.exists("roles", lambda r: r == "assistant")).agg(F.count("*").alias("given"), F.count_if(F.col("n") > 2).alias("used"))


@query("with p as (select conv_id, length(text) x from conversations where role = 'assistant'), t as (select split_part(split_part(url, '://', 2), '/', 1) folder, sum(ceil(length(html) / 4))::bigint tokens from pages group by 1) select folder, tokens from t order by tokens desc, folder limit 1")
def summary_busiest_folder(spark, d):
    folder = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    t = table(spark, d, "pages").groupBy(folder.alias("folder")).agg(F.sum(F.ceil(F.length("html") / 4)).cast("long").alias("tokens"))
    return t.orderBy(F.desc("tokens"), "folder").limit(1)
