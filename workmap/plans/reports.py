"""Notices, texts, exports and the map's answers over the store's relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from workmap.functions.scalar import scale_mode
from workmap.operators import reports as T
from workmap.operators import retrieval as R
from workmap.plans.relations import statement

_HOLD = "pm as (select session_id session, node_id % 500 node, ts, case when kind = 'read' then 'read' when kind = 'edit' and seq % 4 = 1 then 'claim' else 'edit' end as mode from acts where kind in ('read', 'edit')), hl as (select session, node, max((ts + case mode when 'read' then 600000 when 'edit' then 1800000 else 7200000 end, ts, mode)) b from pm group by 1, 2)"


def _held(r):
    mode = F.when(F.col("kind") == "read", "read").when(F.col("seq") % 4 == 1, "claim").otherwise("edit")
    return T.held_longest(r.acts.where("kind in ('read', 'edit')").select(F.col("session_id").alias("session"), (F.col("node_id") % 500).alias("node"), "ts", mode.alias("mode")))


@statement(f"with {_HOLD} select session, node, b[3] as mode, b[1] as until from hl")
def position_claims(r):
    """Reads, edits and claims of a node: the one that holds longest."""
    return _held(r)


@statement(f"with {_HOLD}, n as (select node, count(*) n from hl group by 1) select node, 'Note: ' || case when n = 1 then 'another session is' else n || ' other sessions are' end || ' working on ' || path || '.' text from n join files on file_id = node")
def notices_to_editors(r):
    n = _held(r).groupBy("node").agg(F.count("*").alias("n")).join(r.files.select(F.col("file_id").alias("node"), "path"), "node")
    return n.select("node", T.editor_notice(F.col("path"), F.col("n")).alias("text"))


@statement("select seq edit, 'Another session changed ' || path || case when range_start is null then '' else ' (line ' || range_start || ')' end || ', ' || case when seq % 2 = 0 then 'which you have open' else 'which what you have open depends on' end || '.' text from acts join files on file_id = node_id where kind in ('edit', 'read') and session_id % 20 = 3")
def notices_to_holders(r):
    a = r.acts.where("kind in ('edit', 'read') and session_id % 20 = 3").join(r.files.select(F.col("file_id").alias("node_id"), "path"), "node_id")
    via = F.when(F.col("seq") % 2 == 0, "same").otherwise("coupled")
    return a.select(F.col("seq").alias("edit"), T.holder_notice(F.col("path"), via, F.col("range_start")).alias("text"))


@statement("with s as (select dst_symbol_id, list_sort(list(distinct cast(src_file_id as string) || ':' || cast(line as string)))[1:5] sites from refs where dst_symbol_id is not null group by 1) select symbol_id symbol, 'The signature of ' || name || ' changed from ' || substr(sig_hash, 1, 6) || ' to ' || substr(md5(qual_name), 1, 6) || '; called at ' || array_to_string(sites, ', ') || '.' text from symbols join s on dst_symbol_id = symbol_id")
def notices_of_contracts(r):
    s = r.refs.where("dst_symbol_id is not null").groupBy(F.col("dst_symbol_id").alias("symbol_id")).agg(F.array_sort(F.collect_set(F.concat_ws(":", F.col("src_file_id").cast("string"), F.col("line").cast("string")))).alias("sites"))
    j = r.symbols.join(s, "symbol_id")
    return j.select(F.col("symbol_id").alias("symbol"), T.contract_notice(F.col("name"), F.substring("sig_hash", 1, 6), F.substring(F.md5("qual_name"), 1, 6), F.col("sites")).alias("text"))


@statement("with w as (select task_id task, string_agg(distinct cast(node_id as string), ',' order by cast(node_id as string)) filter (where kind = 'edit') edited, string_agg(distinct cast(node_id as string), ',' order by cast(node_id as string)) filter (where kind = 'read') open from acts where task_id is not null group by 1) select task, 'Unfinished work: edited ' || coalesce(edited, 'nothing') || '; still to look at ' || coalesce(open, 'nothing') || '.' text from w")
def handoff_texts(r):
    def named(kind: str):
        return F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("node_id").cast("string")))), ","), F.lit(""))

    w = r.acts.where("task_id is not null").groupBy(F.col("task_id").alias("task")).agg(named("edit").alias("edited"), named("read").alias("open"))
    return w.select("task", T.handoff_text(F.col("edited"), F.col("open")).alias("text"))


# ---------------------------------------------------------------- sinks and texts
@statement("with o as (select file_id, name, symbol_id, row_number() over (partition by file_id, name order by symbol_id) k from symbols where symbol_id % 5 <> 0), n as (select file_id, name, symbol_id * 3 pos, row_number() over (partition by file_id, name order by symbol_id * 3) k from symbols where symbol_id % 7 <> 0) select n.file_id, n.name, n.pos, o.symbol_id from n left join o on o.file_id = n.file_id and o.name = n.name and o.k = n.k")
def file_rows_replaced(r):
    """Files parsed anew: definitions that are still there keep their ids."""
    stored = r.symbols.where("symbol_id % 5 <> 0").select("file_id", "name", F.col("symbol_id").alias("pos"), "symbol_id")
    parsed = r.symbols.where("symbol_id % 7 <> 0").select("file_id", "name", (F.col("symbol_id") * 3).alias("pos"))
    return T.replaced_rows(stored, parsed, ["file_id", "name"], "symbol_id")


@statement("select '{\"fact_id\":' || fact_id || ',\"claim\":\"' || claim || '\",\"status\":\"' || status || '\"}' json from facts where status = 'approved'")
def facts_exported(r):
    return T.facts_json(r.facts.where("status = 'approved'"))


@statement("select fact_id, claim, status from facts where status = 'approved' and fact_id % 50 <> 4")
def facts_imported(r):
    """The export read again by a strict schema: objects with an unknown field are refused."""
    lines = T.facts_json(r.facts.where("status = 'approved'")).withColumn("json", F.when(F.get_json_object("json", "$.fact_id").cast("long") % 50 == 4, F.regexp_replace("json", r"\}$", ',"more":1}')).otherwise(F.col("json")))
    known = F.array_except(F.json_object_keys("json"), F.array(*map(F.lit, ("fact_id", "claim", "status"))))
    parsed = lines.where(F.size(known) == 0).select(F.from_json("json", "fact_id long, claim string, status string").alias("f"))
    return parsed.select("f.fact_id", "f.claim", "f.status")


_ORDER = "select task_id task, row_number() over (partition by task_id order by seq) k, '- ' || path || ' (' || kind || ')' line from (select task_id, min(seq) seq, kind, node_id from acts where task_id is not null and kind in ('read', 'edit') group by 1, 3, 4) join files on file_id = node_id"


@statement(f"with l as ({_ORDER}), s as (select *, sum(length(line) + 1) over (partition by task order by k rows between unbounded preceding and current row) n from l) select task, string_agg(line, chr(10) order by k) text from s where n <= 120 group by 1")
def work_orders_rendered(r):
    """A task's files as lines of text, as many as fit."""
    a = r.acts.where("task_id is not null and kind in ('read', 'edit')").groupBy("task_id", "kind", "node_id").agg(F.min("seq").alias("seq"))
    rows = a.join(r.files.select(F.col("file_id").alias("node_id"), "path"), "node_id").select(F.col("task_id").alias("task"), "seq", F.concat(F.lit("- "), "path", F.lit(" ("), "kind", F.lit(")")).alias("line"))
    return T.lines_within(rows, ["task"], ["seq"], "line", 120)


@statement("""with c as (select count(*) n, sum(loc)::bigint l from files), lm as (select string_agg(path, ', ' order by path) names from (select path from interest join files on file_id = node_id where score >= 3 order by score desc, file_id limit 8))
select case when n > 60000 or l > 5000000 then 'huge' when n < 30 or l < 2000 then 'tiny' when n <= 500 then 'small' else 'medium' end as mode, (round(n / pow(10, greatest(length(cast(n as string)) - 2, 0))) * pow(10, greatest(length(cast(n as string)) - 2, 0)))::bigint files, names landmarks, (select string_agg(claim, '; ' order by fact_id) from (select fact_id, claim from facts where status = 'approved' and superseded_by is null order by fact_id limit 6)) rules from c, lm""")
def primer(r):
    """What a session is told at its start: the mode, the size to two digits, the landmarks by path, the first rules."""
    c = r.files.agg(F.count("*").alias("n"), F.sum("loc").alias("l"))
    top = r.interest.where("score >= 3").join(r.files.select(F.col("file_id").alias("node_id"), "path"), "node_id").orderBy(F.desc("score"), "node_id").limit(T.MOST_LANDMARKS)
    marks = top.agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("landmarks"))
    first = r.facts.where("status = 'approved' and superseded_by is null").orderBy("fact_id").limit(T.MOST_RULES)
    rules = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "claim"))), lambda x: x["claim"]), "; ").alias("rules"))
    return c.crossJoin(F.broadcast(marks)).crossJoin(F.broadcast(rules)).select(scale_mode(F.col("n"), F.col("l")).alias("mode"), T.rounded_two(F.col("n")).alias("files"), "landmarks", "rules")


_SET = "ws as (select task_id task, kind, node_id, max(seq) seq from acts where kind in ('read', 'edit') and task_id in (select task_id from tasks where ended_at is null) group by 1, 2, 3), wl as (select task, seq, (case kind when 'edit' then 'changed ' else 'read ' end) || path line from ws join files on file_id = node_id)"


def _working_set(r):
    open_ = r.tasks.where("ended_at is null").select("task_id")
    a = r.acts.where("kind in ('read', 'edit')").join(open_, "task_id", "left_semi").groupBy("task_id", "kind", "node_id").agg(F.max("seq").alias("seq"))
    word = F.when(F.col("kind") == "edit", "changed ").otherwise("read ")
    return a.join(r.files.select(F.col("file_id").alias("node_id"), "path"), "node_id").select(F.col("task_id").alias("task"), "seq", F.concat(word, "path").alias("line"))


@statement(f"with {_SET}, s as (select *, sum(length(line) + 1) over (partition by task order by seq desc rows between unbounded preceding and current row) n from wl) select task, string_agg(line, chr(10) order by seq desc) text from s where n <= 2000 group by 1")
def recaps(r):
    """After a compaction: what the open task was working on, the newest first."""
    return T.lines_within(_working_set(r), ["task"], [F.desc("seq")], "line", 2000)


@statement(f"with {_SET}, s as (select *, sum(length(line) + 1) over (partition by task order by seq desc rows between unbounded preceding and current row) n from wl) select task, string_agg(line, chr(10) order by seq desc) text from s where n <= 90 group by 1")
def keep_lists(r):
    """Before a compaction: the same within a shorter text."""
    return T.lines_within(_working_set(r), ["task"], [F.desc("seq")], "line", 90)


# ---------------------------------------------------------------- the map's answers
@statement("""with ex as (select count(*) n from interest where score > 0.2), bz as (select split_part(path, '/', 1) folder, sum(loc)::bigint t from files join acts on node_id = file_id where ts >= 50000000 group by 1 order by t desc, folder limit 1),
sp as (select src, dst from links where type = 1 order by w desc, n desc, src, dst limit 1) select (select count(*) from files) files_, (select count(distinct split_part(path, '/', 1)) + count(distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2)) from files) folders_, ex.n explored, sp.src pair_a, sp.dst pair_b, bz.folder busiest from ex, bz, sp""")
def map_summary(r):
    """Files, folders, files explored, the strongest pair, the busiest folder of late."""
    p = F.split("path", "/")
    files = r.files.agg(F.count("*").alias("files_"), (F.count_distinct(p[0]) + F.count_distinct(F.concat_ws("/", p[0], p[1]))).alias("folders_"))
    explored = r.interest.where("score > 0.2").agg(F.count("*").alias("explored"))
    pair = r.links.where("type = 1").orderBy(F.desc("w"), F.desc("n"), "src", "dst").limit(1).select(F.col("src").alias("pair_a"), F.col("dst").alias("pair_b"))
    busy = r.acts.where("ts >= 50000000").select(F.col("node_id").alias("file_id")).join(r.files, "file_id").groupBy(p[0].alias("busiest")).agg(F.sum("loc").alias("t")).orderBy(F.desc("t"), "busiest").limit(1).select("busiest")
    return files.crossJoin(F.broadcast(explored)).crossJoin(F.broadcast(pair)).crossJoin(F.broadcast(busy))


_FOUND = "f as (select 'file' kind, file_id id, path name, case when lower(path) = 'ring_1' then 0 when starts_with(lower(path), 'ring_1') then 1 else 2 end r from files where contains(lower(path), 'ring_1') union all select 'symbol', symbol_id, name, case when lower(name) = 'sym_10' then 0 when starts_with(lower(name), 'sym_10') then 1 else 2 end from symbols where contains(lower(name), 'sym_10'))"


@statement(f"with {_FOUND} select kind, id, name from (select *, row_number() over (order by r, length(name), name, kind, id) k from f) where k <= 40")
def map_search(r):
    """Paths and names that contain a text, equal ones first, then those that begin with it, then the shorter."""

    def rank(name: str, text: str):
        n = F.lower(name)
        return F.when(n == text, 0).when(n.startswith(text), 1).otherwise(2)

    files = r.files.where(F.lower("path").contains("ring_1")).select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("path").alias("name"), rank("path", "ring_1").alias("r"))
    symbols = r.symbols.where(F.lower("name").contains("sym_10")).select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id"), "name", rank("name", "sym_10").alias("r"))
    return files.unionByName(symbols).orderBy("r", F.length("name"), "name", "kind", "id").limit(40).select("kind", "id", "name")


@statement("""with a as (select * from acts order by seq limit 3000), p as (select * from positions order by node_id limit 3000), n as (select * from notices order by notice_id limit 3000)
select 'events' step, count(*) looked_at, count(*) filter (where ts < 30000000) gone, max(seq) resume from a union all select 'positions', count(*), count(*) filter (where ts < 40000000), max(node_id) from p union all select 'notices', count(*), count(*) filter (where ts < 40000000), max(notice_id) from n""")
def upkeep_steps(r):
    return T.upkeep({"events": (r.acts, "seq", F.col("ts") < 30_000_000), "positions": (r.positions, "node_id", F.col("ts") < 40_000_000), "notices": (r.notices, "notice_id", F.col("ts") < 40_000_000)}, 3000)


@statement("with p as (select injection_id, a.node_id x, b.node_id y from items a join items b using (injection_id) where a.node_id < b.node_id), c as (select x, y, count(*) n from p group by 1, 2) select x, y, n, round(n::double / (select max(n) from c), 6) share from c")
def work_order_pairs(r):
    """Files named together in work orders, over the most often named pair; pairs are made inside an order's list of files."""
    orders = r.items.groupBy("injection_id").agg(F.array_sort(F.collect_set("node_id")).alias("n"))
    pair = F.flatten(F.transform("n", lambda x, i: F.transform(F.slice("n", i + 2, F.size("n")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    c = orders.select(F.explode(pair).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("n"))
    most = c.agg(F.max("n").alias("most"))
    return c.crossJoin(F.broadcast(most)).select("x", "y", "n", F.round(F.col("n") / F.col("most"), 6).alias("share"))


@statement("select kind, count(*) n from nodes group by 1 union all select 'edges', count(*) from links")
def graph_read(r):
    """What reading the graph gives: nodes by kind and edges."""
    return r.nodes.groupBy("kind").agg(F.count("*").alias("n")).unionByName(r.links.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n"))



_OUTLINE = "ol as (select injection_id % 7 query, file_id file, symbol_id symbol, start_line first, end_line last, (symbol_id * 37 % 101)::double / 101 strength from symbols join (select distinct injection_id, node_id from items where injection_id % 40 = 3) i on file_id = node_id)"
_CUT = """bd as (select distinct query, file, symbol, strength, case when last - first + 1 > 20 then greatest(least(first + (last - first) // 2 - 10, last - 19), first) else first end f, last, first f0 from ol where strength > 0),
cu as (select query, file, symbol, strength, f, case when last - f0 + 1 > 20 then f + 19 else last end l from bd),
bs as (select * from cu qualify row_number() over (partition by query, file order by round(strength, 9) desc, f, symbol) <= 16),
ls as (select query, file, list([{'first': f, 'last': l}] order by round(strength, 9) desc, f, symbol) b from bs group by 1, 2),
fo as (select query, file, list_reduce(b, lambda h, y: case when len(list_filter(h, lambda z: y[1].first <= z.last + 1 and z.first <= y[1].last + 1)) > 0
  then list_transform(h, lambda z, i: case when i = list_position(list_transform(h, lambda g: y[1].first <= g.last + 1 and g.first <= y[1].last + 1), true) and greatest(z.last, y[1].last) - least(z.first, y[1].first) + 1 <= 20 then {'first': least(z.first, y[1].first), 'last': greatest(z.last, y[1].last)} else z end)
  when len(h) < 2 then list_concat(h, y) else h end) s from ls)"""


@statement(f"with {_OUTLINE}, {_CUT} select query, file, x.first, x.last from (select query, file, unnest(s) x from fo)")
def spans_selected(r):
    """At most two spans of a file: the strongest definitions, cut to twenty lines, joined where they touch."""
    files = r.items.where("injection_id % 40 = 3").select((F.col("injection_id") % 7).alias("query"), F.col("node_id").alias("file_id")).distinct()
    o = r.symbols.join(files, "file_id").select("query", F.col("file_id").alias("file"), F.col("symbol_id").alias("symbol"), F.col("start_line").alias("body_first"), F.col("end_line").alias("body_last"), (F.col("start_line") + F.floor((F.col("end_line") - F.col("start_line")) / 2)).alias("centre"), ((F.col("symbol_id") * 37 % 101).cast("double") / 101).alias("strength"))
    return R.spans(o, cap=20)


@statement(f"with {_OUTLINE} select distinct query, file, symbol from ol join acts on node_id = file and acts.session_id % 7 = query and kind = 'read' where range_start is null or (range_start * 8 <= first and last <= range_start * 8 + 60)")
def spans_in_context(r):
    """Definitions that a session has in context: a read of the file without a range, or of one that covers them."""
    files = r.items.where("injection_id % 40 = 3").select((F.col("injection_id") % 7).alias("query"), F.col("node_id").alias("file_id")).distinct()
    shown = r.symbols.join(files, "file_id").select("query", F.col("file_id").alias("file"), F.col("symbol_id").alias("symbol"), F.lit("h").alias("content"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    reads = r.acts.where("kind = 'read'").select((F.col("session_id") % 7).alias("query"), F.col("node_id").alias("file"), F.lit("h").alias("content"), (F.col("range_start") * 8).alias("lo"), (F.col("range_start") * 8 + 60).alias("hi"))
    return R.in_context(shown, reads).select("query", "file", "symbol")
