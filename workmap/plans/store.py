"""Statements of the store about sessions, tasks, the event log, the index of files and symbols, and search rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from workmap.operators import snapshot as S
from workmap.plans.relations import FOLDER_NODES, ids, statement

_ENDED = "case when session_id % 10 = 1 then 99000000 else ended_at end ended_at, case when session_id % 10 = 1 then 'ended' else status end status"


# ---------------------------------------------------------------- sessions and tasks
@statement(f"select session_id, {_ENDED} from sessions")
def session_end(r):
    return S.changed(r.sessions, F.col("session_id") % 10 == 1, ended_at=F.lit(99_000_000), status=F.lit("ended")).select("session_id", "ended_at", "status")


@statement("select session_id, agent, started_at, status from sessions where session_id = 42")
def session_by_id(r):
    return S.point(r.sessions, session_id=42).select("session_id", "agent", "started_at", "status")


@statement("select seq + 1000 as task_id, (select max(seq) from tasks) + row_number() over (order by started_at, seq) as seq from tasks where outcome is null")
def task_insert(r):
    """Tasks without an outcome begun anew: numbered on from the greatest number, in the order of their start."""
    new = r.tasks.where("outcome is null").selectExpr("seq + 1000 as task_id", "started_at", "seq as old")
    return S.appended(r.tasks, new.withColumn("seq", F.lit(0)).drop("seq"), "seq", F.floor(F.col("started_at") / 1_000_000), ["started_at", "old"]).select("task_id", "seq")


@statement("select task_id, case when ended_at is null and task_id % 2 = 0 then 101000000 else ended_at end ended_at from tasks")
def task_end(r):
    """Ends asked for even tasks; those that have ended keep their end."""
    asked = ids(r.tasks, "task_id % 2 = 0", "task_id").withColumn("ended_at", F.lit(101_000_000).cast("long"))
    return S.updated(r.tasks, asked, ["task_id"], F.col("ended_at").isNull()).select("task_id", "ended_at")


@statement("select task_id, case when ended_at is not null and task_id % 3 = 0 then 'failure' else outcome end outcome from tasks")
def task_outcome(r):
    asked = ids(r.tasks, "task_id % 3 = 0", "task_id").withColumn("outcome", F.lit("failure"))
    return S.updated(r.tasks, asked, ["task_id"], F.col("ended_at").isNotNull()).select("task_id", "outcome")


@statement("select * from tasks where task_id = 77")
def task_by_id(r):
    return S.point(r.tasks, task_id=77)


@statement("select session_id, max(seq) seq from tasks where ended_at is null group by 1")
def task_open_of_session(r):
    """The latest open task of every session."""
    return r.tasks.where("ended_at is null").groupBy("session_id").agg(F.max("seq").alias("seq"))


@statement("select task_id, exists (select 1 from tasks o where o.session_id = t.session_id and o.task_id <> t.task_id) has_other from tasks t")
def session_has_other_task(r):
    """Whether a task's session has another one: its session's greatest or least task differs; one aggregate, no theta join."""
    ends = r.tasks.groupBy("session_id").agg(F.min("task_id").alias("lo"), F.max("task_id").alias("hi"))
    return r.tasks.join(ends, "session_id").select("task_id", (F.col("lo") != F.col("hi")).alias("has_other"))


@statement("select session_id, started_at from sessions where started_at >= 50000000 order by started_at, session_id")
def sessions_started_since(r):
    return r.sessions.where("started_at >= 50000000").select("session_id", "started_at").orderBy("started_at", "session_id")


@statement("select session_id, parent from sessions where parent = 5 order by session_id")
def sessions_started_by(r):
    return S.point(r.sessions, parent=5).select("session_id", "parent").orderBy("session_id")


@statement("select task_id, seq, started_at from tasks where session_id = 42 order by started_at, task_id")
def tasks_of_session(r):
    return S.point(r.tasks, session_id=42).select("task_id", "seq", "started_at").orderBy("started_at", "task_id")


@statement("select count(*) arms, count(*) filter (where held_out) held_out, count(*) filter (where not held_out) given from sessions")
def holdout_arms(r):
    return r.sessions.agg(F.count("*").alias("arms"), F.count_if("held_out").alias("held_out"), F.count_if(~F.col("held_out")).alias("given"))


# ---------------------------------------------------------------- the event log
@statement("select (select max(seq) from acts) + row_number() over (order by ts, seq) seq, ts, kind from acts")
def event_insert(r):
    """All rows appended once more, numbered on in the order of their times."""
    again = r.acts.selectExpr("seq as old", "ts", "kind")
    return S.appended(r.acts, again, "seq", F.floor(F.col("ts") / 1_000_000), ["ts", "old"]).select("seq", "ts", "kind")


@statement("select seq, kind, node_id from acts where task_id = 100 order by seq limit 3")
def events_of_task(r):
    return S.point(r.acts, task_id=100).orderBy("seq").limit(3).select("seq", "kind", "node_id")


@statement("select seq, ts, kind from acts where session_id = 42 order by ts, seq")
def events_of_session(r):
    return S.point(r.acts, session_id=42).orderBy("ts", "seq").select("seq", "ts", "kind")


@statement("select seq, ts, kind from acts where (kind = 'read' and node_id = 62 or kind = 'compact') order by ts desc, seq desc limit 20")
def reads_in_session(r):
    """Reads of one node and any compaction, newest first."""
    return S.newest(r.acts.where("(kind = 'read' and node_id = 62) or kind = 'compact'"), ["ts", "seq"], 20).select("seq", "ts", "kind")


@statement("select seq, task_id, kind from acts where task_id is not null qualify row_number() over (partition by task_id order by seq desc) <= 2")
def latest_events_of_task(r):
    """The newest two events of every task."""
    by = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    return r.acts.where("task_id is not null").withColumn("k", F.row_number().over(by)).where("k <= 2").select("seq", "task_id", "kind")


@statement("select count(*) calls from (select distinct session_id, ts, kind, node_id, case when range_start is null then seq end s from acts where task_id is null and source = 'hook')")
def tool_calls_outside_tasks(r):
    """Distinct calls outside of tasks: rows with a range are one call for each time and node, rows without each one of their own."""
    own = F.when(F.col("range_start").isNull(), F.col("seq")).alias("own")
    return r.acts.where("task_id is null and source = 'hook'").select("session_id", "ts", "kind", "node_id", own).distinct().agg(F.count("*").alias("calls"))


@statement("select session_id, ts, seq from acts where kind = 'compact' order by session_id, ts, seq")
def compactions_of_session(r):
    return S.point(r.acts, kind="compact").select("session_id", "ts", "seq").orderBy("session_id", "ts", "seq")


@statement("select seq, ts, session_id from acts order by seq desc limit 50")
def latest_events(r):
    return S.newest(r.acts, ["seq"], 50).select("seq", "ts", "session_id")


# ---------------------------------------------------------------- key-value rows and the catalogue
@statement("select count(*) columns_, count(distinct t) tables_ from (select unnest(['meta', 'meta', 'git_state', 'git_state', 'archetypes', 'archetypes', 'archetypes']) t)")
def count_objects(r):
    """Columns and tables of a small catalogue, from the relations' own schemas."""
    named = [(n, c) for n in ("meta", "git_state", "archetypes") for c in getattr(r, n).columns]
    return r.spark.createDataFrame(named, "t string, c string").agg(F.count("*").alias("columns_"), F.count_distinct("t").alias("tables_"))


@statement("select count(*) n from (select 'meta' t) where t = 'meta'")
def count_meta_tables(r):
    return r.spark.createDataFrame([("meta",)] if r.meta.columns else [], "t string").where("t = 'meta'").agg(F.count("*").alias("n"))


@statement("select value from meta where key = 'NATION_7'")
def meta_get(r):
    return S.point(r.meta, key="NATION_7").select("value")


@statement("select key, case when key in ('NATION_1', 'NATION_2') then 'set' else value end as value from meta union all select 'new', 'set'")
def meta_set(r):
    return S.replaced(r.meta, r.spark.createDataFrame([("NATION_1", "set"), ("NATION_2", "set"), ("new", "set")], "key string, value string"), ["key"])


@statement("select key, value from meta where key <> 'NATION_3'")
def meta_delete(r):
    return S.kept(r.meta, F.col("key") == "NATION_3")


@statement("select key, value from meta union all select 'new', 'once'")
def meta_set_once(r):
    """What is there stays, what isn't is added."""
    return S.once(r.meta, r.spark.createDataFrame([("NATION_1", "lost"), ("new", "once")], "key string, value string"), ["key"])


@statement("select value from git_state where key = 'asia'")
def git_state_get(r):
    return S.point(r.git_state, key="asia").select("value")


@statement("select key, case when key = 'asia' then 777 else value end as value from git_state")
def git_state_set(r):
    return S.replaced(r.git_state, r.spark.createDataFrame([("asia", 777)], "key string, value int"), ["key"])


@statement("select key, value from git_state where key <> 'europe'")
def git_state_delete(r):
    return S.kept(r.git_state, F.col("key") == "europe")


# ---------------------------------------------------------------- files
@statement("select file_id from files where path like 'brand_2/%' and path like '%.rs' and file_id < 200")
def file_id(r):
    """Ids of paths that are asked for."""
    asked = r.files.where("path like 'brand_2/%' and path like '%.rs' and file_id < 200").select("path")
    return S.keyed(r.files, asked).select("file_id")


@statement("select file_id + 1000000 file_id, 'copy/' || path path from files where flags = 0")
def file_insert(r):
    return S.once(r.files, r.files.where("flags = 0").withColumns({"file_id": F.col("file_id") + 1_000_000, "path": F.concat(F.lit("copy/"), F.col("path"))}), ["path"]).where("path like 'copy/%'").select("file_id", "path")


@statement("select file_id, path, case when lang = 'go' then loc + 1 else loc end loc, case when lang = 'go' then md5(path) else content_hash end content_hash from files")
def file_update(r):
    given = r.files.where("lang = 'go'").select("path", (F.col("loc") + 1).alias("loc"), F.md5("path").alias("content_hash"))
    return S.updated(r.files, given, ["path"]).select("file_id", "path", "loc", "content_hash")


@statement("select file_id, path from files where flags & 4 = 0")
def file_delete(r):
    return S.without(r.files, ids(r.files, "flags & 4 <> 0", "file_id")).select("file_id", "path")


@statement("select file_id, lang, loc from files where path = (select min(path) from files where lang = 'rust')")
def file_by_path(r):
    return S.keyed(r.files, r.files.where("lang = 'rust'").agg(F.min("path").alias("path"))).select("file_id", "lang", "loc")


@statement("select * from files order by path")
def file_rows(r):
    return r.files.orderBy("path")


@statement("select file_id, case when file_id % 8 = 1 then mtime + 5 else mtime end mtime from files")
def file_touch(r):
    return S.changed(r.files, F.col("file_id") % 8 == 1, mtime=F.col("mtime") + 5).select("file_id", "mtime")


@statement("select path from files order by path")
def file_paths(r):
    return r.files.select("path").orderBy("path")


@statement("select file_id, path from files where file_id = 12")
def file_path_of(r):
    return S.point(r.files, file_id=12).select("file_id", "path")


# ---------------------------------------------------------------- symbols
@statement("select symbol_id, kind, qual_name, parent_id, sig_hash from symbols where file_id = 11")
def symbols_to_match(r):
    return S.point(r.symbols, file_id=11).select("symbol_id", "kind", "qual_name", "parent_id", "sig_hash")


@statement("select symbol_id + 10000000 symbol_id, file_id, name from symbols where kind = 'test'")
def symbol_insert(r):
    return r.symbols.where("kind = 'test'").select((F.col("symbol_id") + 10_000_000).alias("symbol_id"), "file_id", "name")


@statement("select symbol_id, case when file_id % 7 = 0 then start_line + 3 else start_line end start_line, case when file_id % 7 = 0 then end_line + 3 else end_line end end_line from symbols")
def symbol_update(r):
    """Matched symbols move; their ids stay."""
    moved = r.symbols.where("file_id % 7 = 0").select("symbol_id", (F.col("start_line") + 3).alias("start_line"), (F.col("end_line") + 3).alias("end_line"))
    return S.updated(r.symbols, moved, ["symbol_id"]).select("symbol_id", "start_line", "end_line")


@statement("select symbol_id from symbols where not (kind = 'test' and file_id % 2 = 0)")
def symbol_delete(r):
    return S.without(r.symbols, ids(r.symbols, "kind = 'test' and file_id % 2 = 0", "symbol_id")).select("symbol_id")


@statement("select symbol_id, name, start_byte from symbols where file_id = 11 order by start_byte, symbol_id")
def symbols_in_file(r):
    return S.point(r.symbols, file_id=11).select("symbol_id", "name", "start_byte").orderBy("start_byte", "symbol_id")


@statement("select node_id, name, start_line, end_line from symbols join nodes on nodes.kind = 'symbol' and ref_id = symbol_id where file_id = 11")
def symbol_spans_in_file(r):
    n = r.nodes.where("kind = 'symbol'").select("node_id", F.col("ref_id").alias("symbol_id"))
    return S.point(r.symbols, file_id=11).join(n, "symbol_id").select("node_id", "name", "start_line", "end_line")


@statement("select node_id, files.path from nodes join files on ref_id = file_id where nodes.kind = 'file' and node_id % 97 = 5")
def files_of_nodes(r):
    asked = r.nodes.where("node_id % 97 = 5").select("node_id").distinct()
    return S.keyed(r.nodes.where("kind = 'file'"), asked).select("node_id", F.col("ref_id").alias("file_id")).join(r.files, "file_id").select("node_id", "path")


@statement("select symbol_id, file_id, kind from symbols where name = 'sym_5'")
def symbols_named(r):
    return S.point(r.symbols, name="sym_5").select("symbol_id", "file_id", "kind")


@statement("select symbol_id, name, qual_name from symbols where qual_name = 'mod_3::sym_5' or name = 'sym_6'")
def symbols_called(r):
    return r.symbols.where((F.col("qual_name") == "mod_3::sym_5") | (F.col("name") == "sym_6")).select("symbol_id", "name", "qual_name")


_NAMES = "select symbol_id, name, lang, parent_id is null is_top_level from symbols join files using (file_id)"


def _names(r, symbols):
    return symbols.join(r.files, "file_id").select("symbol_id", "name", "lang", F.col("parent_id").isNull().alias("is_top_level"))


@statement(_NAMES)
def symbol_names(r):
    return _names(r, r.symbols)


@statement(f"{_NAMES} where file_id % 40 = 1")
def symbol_names_in_files(r):
    return _names(r, S.keyed(r.symbols, ids(r.files, "file_id % 40 = 1", "file_id")))


@statement(f"{_NAMES} where name = 'sym_7' and lang in ('rust', 'go') order by symbol_id limit 5")
def symbol_names_named_in_languages(r):
    return _names(r, S.point(r.symbols, name="sym_7")).where(F.col("lang").isin("rust", "go")).orderBy("symbol_id").limit(5)


@statement("select name, count(*) n from symbols group by 1")
def symbol_nodes(r):
    """Nodes of symbols, counted by name."""
    n = r.nodes.where("kind = 'symbol'").select(F.col("ref_id").alias("symbol_id"))
    return n.join(r.symbols, "symbol_id").groupBy("name").agg(F.count("*").alias("n"))


@statement("select node_id, name from symbols join nodes on nodes.kind = 'symbol' and ref_id = symbol_id where name = 'sym_9' order by node_id limit 8")
def symbol_nodes_named(r):
    n = r.nodes.where("kind = 'symbol'").select("node_id", F.col("ref_id").alias("symbol_id"))
    return S.point(r.symbols, name="sym_9").join(n, "symbol_id").select("node_id", "name").orderBy("node_id").limit(8)


# ---------------------------------------------------------------- references
@statement("select src_file_id, dst_name, kind, line, cast(null as bigint) dst_symbol_id from refs where src_file_id % 10 = 0")
def ref_insert(r):
    """References as they come from the parser: without a target."""
    return r.refs.where("src_file_id % 10 = 0").select("src_file_id", "dst_name", "kind", "line", F.lit(None).cast("long").alias("dst_symbol_id"))


@statement("select src_file_id, count(*) n from refs where src_file_id % 2 = 1 group by 1")
def refs_delete_in_file(r):
    return S.without(r.refs, ids(r.files, "file_id % 2 = 0", "file_id", "src_file_id")).groupBy("src_file_id").agg(F.count("*").alias("n"))


@statement("""select dst_symbol_id, resolution, count(*) n from (select case when dst_symbol_id % 100 = 50 then null else dst_symbol_id end dst_symbol_id,
  case when dst_symbol_id % 100 = 50 then case resolution when 'import' then resolution end else resolution end resolution from refs) group by 1, 2""")
def refs_unresolve_to(r):
    """References to symbols that go lose their target; only those that came through an import keep how they were resolved."""
    hit = F.col("dst_symbol_id") % 100 == 50
    lost = S.changed(r.refs, hit, resolution=F.when(F.col("resolution") == "import", F.col("resolution")))
    return S.changed(lost, hit, dst_symbol_id=F.lit(None)).groupBy("dst_symbol_id", "resolution").agg(F.count("*").alias("n"))


@statement("""select resolution, confidence, count(*) n from (select case when dst_symbol_id is null and t.target is not null then 'name' else resolution end resolution,
  case when dst_symbol_id is null and t.target is not null then 0.6 when resolution = 'import' then 0.9 when resolution = 'name' then 0.6 end::double confidence
  from refs left join (select name, min(symbol_id) target from symbols group by 1 having count(*) = (select min(n) from (select count(*) n from symbols group by name))) t on t.name = dst_name) group by 1, 2""")
def ref_resolve(r):
    """Unresolved references take the target of a name that few symbols have."""
    names = r.symbols.groupBy("name").agg(F.min("symbol_id").alias("target"), F.count("*").alias("n"))
    few = names.join(F.broadcast(names.agg(F.min("n").alias("n"))), "n").select(F.col("name").alias("dst_name"), "target")
    hit = F.col("dst_symbol_id").isNull() & F.col("target").isNotNull()
    confidence = F.when(hit, 0.6).when(F.col("resolution") == "import", 0.9).when(F.col("resolution") == "name", 0.6)
    resolved = r.refs.join(few, "dst_name", "left").select(F.when(hit, "name").otherwise(F.col("resolution")).alias("resolution"), confidence.alias("confidence"))
    return resolved.groupBy("resolution", "confidence").agg(F.count("*").alias("n"))


@statement("select src_symbol_id, dst_name, line from refs where src_file_id = 21 order by line, src_symbol_id, dst_name")
def refs_in_file(r):
    return S.point(r.refs, src_file_id=21).select("src_symbol_id", "dst_name", "line").orderBy("line", "src_symbol_id", "dst_name")


@statement("select src_file_id, src_symbol_id, line from refs where dst_symbol_id = 120")
def refs_tied_to(r):
    return S.point(r.refs, dst_symbol_id=120).select("src_file_id", "src_symbol_id", "line")


@statement("select dst_name, lang, count(*) n from refs join files on src_file_id = file_id group by 1, 2")
def ref_names(r):
    f = r.files.select(F.col("file_id").alias("src_file_id"), "lang")
    return r.refs.join(f, "src_file_id").groupBy("dst_name", "lang").agg(F.count("*").alias("n"))


@statement("select distinct src_file_id from refs where resolution = 'import' and kind = 'import'")
def files_with_refs_through_imports(r):
    return S.point(r.refs, resolution="import", kind="import").select("src_file_id").distinct()


@statement("select src_file_id, line, lang from refs join files on src_file_id = file_id where dst_name = 'sym_35' and (resolution is null or resolution <> 'import')")
def ref_names_by_name(r):
    f = r.files.select(F.col("file_id").alias("src_file_id"), "lang")
    return S.point(r.refs, dst_name="sym_35").where("resolution is null or resolution <> 'import'").join(f, "src_file_id").select("src_file_id", "line", "lang")


@statement("select distinct src_file_id from refs join symbols on dst_symbol_id = symbol_id where file_id = 11 or file_id % 100 = 7")
def files_tied_into(r):
    s = r.symbols.where("file_id = 11 or file_id % 100 = 7").select(F.col("symbol_id").alias("dst_symbol_id"))
    return S.keyed(r.refs, s).select("src_file_id").distinct()


@statement("select src_file_id, dst_name, dst_symbol_id from refs where resolution = 'name' and src_file_id < 100")
def refs_tied_as(r):
    return S.point(r.refs, resolution="name").where("src_file_id < 100").select("src_file_id", "dst_name", "dst_symbol_id")


@statement("select dst_name, kind, lang from refs join files on src_file_id = file_id where file_id = 33")
def ref_names_in_file(r):
    f = S.point(r.files, file_id=33).select(F.col("file_id").alias("src_file_id"), "lang")
    return r.refs.join(f, "src_file_id").select("dst_name", "kind", "lang")


# ---------------------------------------------------------------- nodes
@statement("select kind, count(*) n, max(node_id) newest from (select node_id, kind from nodes union select file_id + 5000000, 'file' from files where flags = 0) group by 1")
def node_upsert(r):
    """An identity is given once; files that have none get one."""
    new = r.files.where("flags = 0").select((F.col("file_id") + 5_000_000).alias("node_id"), F.lit("file").alias("kind"))
    return S.once(r.nodes.select("node_id", "kind"), new, ["node_id"]).groupBy("kind").agg(F.count("*").alias("n"), F.max("node_id").alias("newest"))


@statement("select node_id from nodes where kind = 'symbol' and ref_id = 40")
def node_of(r):
    return S.point(r.nodes, kind="symbol", ref_id=40).select("node_id")


@statement("""select 'nodes' relation, count(*) n from nodes where not (kind = 'file' and ref_id % 5 = 0)
  union all select 'links', count(*) from links where src % 5 <> 0 and dst % 5 <> 0 union all select 'interest', count(*) from interest where node_id % 5 <> 0 union all select 'ways', count(*) from ways where src % 5 <> 0 and dst % 5 <> 0""")
def node_delete(r):
    """A delete of nodes that takes their edges, interest and transitions along, one anti join for each end."""
    gone = r.nodes.where("kind = 'file' and ref_id % 5 = 0").select("node_id")
    ends = [gone.withColumnRenamed("node_id", c) for c in ("src", "dst")]
    left = {"nodes": S.without(r.nodes, gone), "links": S.without(S.without(r.links, ends[0]), ends[1]), "interest": S.without(r.interest, gone), "ways": S.without(S.without(r.ways, ends[0]), ends[1])}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("relation"), "n") for k, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@statement("select node_id from nodes where kind = 'dir' and path = 'brand_7'")
def folder_node(r):
    return S.point(r.nodes, kind="dir", path="brand_7").select("node_id")


@statement(f"select node_id, path from nodes where kind = 'dir' union all select {FOLDER_NODES} + 999, 'docs'")
def folder_node_insert(r):
    return S.once(r.nodes.where("kind = 'dir'").select("node_id", "path"), r.spark.createDataFrame([(FOLDER_NODES + 999, "docs"), (FOLDER_NODES + 998, "brand_1")], "node_id long, path string"), ["path"])


@statement("select node_id, path from nodes where kind = 'dir' order by path")
def folder_nodes(r):
    return S.point(r.nodes, kind="dir").select("node_id", "path").orderBy("path")


@statement("select node_id from nodes join files on nodes.kind = 'file' and ref_id = file_id where files.path in (select max(path) from files)")
def file_node_at(r):
    at = S.keyed(r.files, r.files.agg(F.max("path").alias("path"))).select(F.col("file_id").alias("ref_id"))
    return S.keyed(r.nodes.where("kind = 'file'"), at).select("node_id")


@statement("select file_id, files.path, lang from nodes join files on ref_id = file_id where nodes.kind = 'file' and node_id = 15")
def node_file(r):
    return S.point(r.nodes, kind="file", node_id=15).select(F.col("ref_id").alias("file_id")).join(r.files, "file_id").select("file_id", "path", "lang")


@statement("select node_id, files.path from nodes join files on ref_id = file_id where nodes.kind = 'file' order by files.path")
def file_nodes(r):
    return r.nodes.where("kind = 'file'").select("node_id", F.col("ref_id").alias("file_id")).join(r.files, "file_id").select("node_id", "path").orderBy("path")


@statement("select node_id, files.path from nodes join files on ref_id = file_id where nodes.kind = 'file' and flags & 5 = 0")
def cochange_files(r):
    """Files that co-change is mined for: with neither of two flag bits."""
    f = r.files.where(F.col("flags").bitwiseAND(5) == 0).select(F.col("file_id").alias("ref_id"), F.col("path").alias("at"))
    return r.nodes.where("kind = 'file'").join(f, "ref_id").select("node_id", F.col("at").alias("path"))


@statement("select (select count(*) from nodes) nodes_, (select count(*) from links) edges_")
def graph_counts(r):
    return r.nodes.agg(F.count("*").alias("nodes_")).crossJoin(F.broadcast(r.links.agg(F.count("*").alias("edges_"))))


@statement("select (select count(*) from files) files_, (select count(*) from symbols) symbols_, (select count(*) from refs) refs_, (select count(*) from refs where dst_symbol_id is not null) tied, (select count(*) from nodes) nodes_, (select count(*) from links) edges_")
def counts(r):
    """Six counts as one row; each is an aggregate of its own, joined as rows of one."""
    one = [r.files.agg(F.count("*").alias("files_")), r.symbols.agg(F.count("*").alias("symbols_")), r.refs.agg(F.count("*").alias("refs_"), F.count("dst_symbol_id").alias("tied")), r.nodes.agg(F.count("*").alias("nodes_")), r.links.agg(F.count("*").alias("edges_"))]
    out = one[0]
    for row in one[1:]:
        out = out.crossJoin(F.broadcast(row))
    return out


# ---------------------------------------------------------------- re-exports
@statement("select file_id + 500 file_id, position, name, taken, path from passes_on union all select file_id, position, name, taken, path from passes_on")
def passes_on_insert(r):
    return r.passes_on.unionByName(r.passes_on.withColumn("file_id", F.col("file_id") + 500))


@statement("select file_id, name from passes_on where file_id % 4 <> 0")
def passes_on_delete(r):
    return S.kept(r.passes_on, F.col("file_id") % 4 == 0).select("file_id", "name")


@statement("select name, count(distinct taken) taken from passes_on where name <> taken group by 1")
def passes_on_aliases(r):
    return r.passes_on.where("name <> taken").groupBy("name").agg(F.count_distinct("taken").alias("taken"))


@statement("select position, name, taken, path from passes_on where file_id = 9 order by position")
def passes_on_of_file(r):
    return S.point(r.passes_on, file_id=9).select("position", "name", "taken", "path").orderBy("position")


@statement("select * from passes_on order by file_id, position")
def passes_on_every(r):
    return r.passes_on.orderBy("file_id", "position")


# ---------------------------------------------------------------- search rows
@statement("select node_id from search where node_id % 3 <> 0")
def search_delete(r):
    return S.without(r.search, ids(r.search, "node_id % 3 = 0", "node_id")).select("node_id")


@statement("select node_id, md5(tokens) digest from search union all select node_id + 1000, md5(tokens) from search where node_id % 2 = 0")
def search_insert(r):
    more = r.search.where("node_id % 2 = 0").withColumn("node_id", F.col("node_id") + 1000)
    return S.once(r.search, more, ["node_id"]).select("node_id", F.md5("tokens").alias("digest"))


@statement("select tokens from search where node_id = 4")
def search_tokens(r):
    return S.point(r.search, node_id=4).select("tokens")


@statement("select node_id, tokens from search where node_id in (1, 3, 8)")
def search_tokens_of(r):
    return S.keyed(r.search, r.spark.createDataFrame([(1,), (3,), (8,), (3,)], "node_id long")).select("node_id", "tokens")
