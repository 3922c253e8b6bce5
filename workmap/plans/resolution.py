"""Resolution of names, structural edges, spans and targets over the store's relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from workmap.operators import records
from workmap.operators import resolution as N
from workmap.plans.relations import FOLDER_NODES, statement

_FAMILY = "case lang when 'typescript' then 'script' else lang end"
_NAMES = f"nm as (select symbol_id symbol, file_id file, {_FAMILY} family, name from symbols join files using (file_id))"
_REFS = f"rf as (select distinct src_symbol_id * 1000 + line ref, src_file_id file, {_FAMILY} family, dst_name name from refs join files on file_id = src_file_id where kind = 'call' and src_file_id % 5 = 0 qualify row_number() over (partition by src_symbol_id * 1000 + line order by src_file_id, dst_name) = 1)"


def _names(r):
    return r.symbols.join(r.files.select("file_id", "lang"), "file_id").select(F.col("symbol_id").alias("symbol"), F.col("file_id").alias("file"), N.family(F.col("lang")).alias("family"), "name")


def _refs(r):
    ref = F.col("src_symbol_id") * 1000 + F.col("line")
    calls = r.refs.where("kind = 'call' and src_file_id % 5 = 0").join(r.files.select(F.col("file_id").alias("src_file_id"), "lang"), "src_file_id")
    rows = calls.select(ref.alias("ref"), F.col("src_file_id").alias("file"), N.family(F.col("lang")).alias("family"), F.col("dst_name").alias("name")).distinct()
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("ref").orderBy("file", "name"))).where("k = 1").drop("k")


def _imports(r):
    return r.files.select(F.col("file_id").alias("file"), (F.col("file_id") * 3 % 1500).alias("imported"))


@statement(f"""with {_NAMES}, {_REFS},
t0 as (select ref, min(symbol_id) t0 from rf join symbols on symbol_id = ref % 15000 where ref % 7 = 0 group by 1),
t1 as (select im.file_id file, name, case when count(distinct symbol) = 1 then min(symbol) end t1 from files im join nm on nm.file = im.file_id * 3 % 1500 group by 1, 2),
hr as (select file, name, count(distinct symbol) n, case when count(distinct symbol) = 1 then min(symbol) end t2 from nm group by 1, 2), wd as (select family, name, case when count(distinct symbol) = 1 then min(symbol) end t3 from nm group by 1, 2)
select ref, coalesce(t0, t1, t2, case when n is null then t3 end) symbol, case when t0 is not null then 'scip' when t1 is not null then 'import_path' when t2 is not null then 'same_file' when n is null and t3 is not null then 'name_only' end resolution
from rf left join t0 using (ref) left join t1 using (file, name) left join hr using (file, name) left join wd using (family, name)""")
def reference_tiers(r):
    """References by four tiers; every seventh has a precise tie."""
    refs = _refs(r)
    precise = refs.where("ref % 7 = 0").select("ref", (F.col("ref") % 15_000).alias("symbol")).join(r.symbols.select(F.col("symbol_id").alias("symbol")), "symbol", "left_semi")
    return N.resolved(refs, _names(r), precise, _imports(r))


@statement(f"with {_NAMES}, alt as (select src_symbol_id ref, src_file_id + k file, dst_name name from refs, (select unnest([0, 300, 600]) k)), a as (select ref, s from (select alt.ref, alt.file, alt.name, min(symbol) s from alt left join nm on nm.name = alt.name and nm.file % 300 = alt.file % 300 group by 1, 2, 3)) select ref, min(s) symbol from a group by 1 having count(distinct s) = 1 and count(*) filter (where s is null) = 0")
def names_agreed(r):
    """Three alternatives for each reference must find one definition."""
    alt = r.refs.select(F.col("src_symbol_id").alias("ref"), F.explode(F.array(*[F.col("src_file_id") + k for k in (0, 300, 600)])).alias("file"), F.col("dst_name").alias("name"))
    n = _names(r).select((F.col("file") % 300).alias("m"), "name", "symbol")
    found = alt.withColumn("m", F.col("file") % 300).join(n, ["m", "name"], "left").groupBy("ref", "file", "name").agg(F.min("symbol").alias("symbol"))
    return N.agreed(found)


_PASSES = "ps as (select file_id file, (file_id * 3 + 1) % 97 next from passes_on union select file_id, (file_id * 5 + 2) % 97 from passes_on where file_id % 2 = 0)"


def _passes(r):
    one = r.passes_on.select(F.col("file_id").alias("file"), ((F.col("file_id") * 3 + 1) % 97).alias("next"))
    return one.unionByName(r.passes_on.where("file_id % 2 = 0").select(F.col("file_id").alias("file"), ((F.col("file_id") * 5 + 2) % 97).alias("next"))).distinct()


@statement(f"with recursive {_PASSES}, w as (select distinct file root, file, 0 depth from ps union select root, next, depth + 1 from w join ps using (file) where depth < 4) select root, file, min(depth) depth from w group by 1, 2")
def re_export_closure(r):
    p = _passes(r)
    return N.reachable(p.select("file").distinct(), p)


@statement("""with recursive pn as (select distinct file_id file, 'sym_' || cast(position * 3 % 40 as string) name, (file_id * 3 + 1) % 97 next, 'sym_' || cast(position * 3 % 40 + 1 as string) taken from passes_on),
fr as (select distinct file, name, file at_, name called, 0 depth from pn union select fr.file, fr.name, pn.next, pn.taken, depth + 1 from fr join pn on pn.file = fr.at_ and pn.name = fr.called where depth < 4),
hit as (select fr.file, fr.name, depth, count(distinct symbol_id) n, min(symbol_id) symbol from fr join symbols on symbols.file_id % 97 = at_ and symbols.name = called group by 1, 2, 3)
select file, name, symbol, depth from hit where n = 1 qualify depth = min(depth) over (partition by file, name) and n = 1 and not exists (select 1 from hit h where h.file = hit.file and h.name = hit.name and h.depth < hit.depth)""")
def re_export_search(r):
    called = F.concat(F.lit("sym_"), (F.col("position") * 3 % 40).cast("string"))
    taken = F.concat(F.lit("sym_"), (F.col("position") * 3 % 40 + 1).cast("string"))
    passes = r.passes_on.select(F.col("file_id").alias("file"), called.alias("name"), ((F.col("file_id") * 3 + 1) % 97).alias("next"), taken.alias("taken")).distinct()
    names = r.symbols.select((F.col("file_id") % 97).alias("file"), "name", F.col("symbol_id").alias("symbol"))
    return N.searched(passes.select("file", "name"), passes, names)


_SURE = "case resolution when 'import' then 0.8 when 'name' then 0.3 end::double"


def _ties(r):
    sure = F.when(F.col("resolution") == "import", 0.8).when(F.col("resolution") == "name", 0.3)
    s = r.symbols.select(F.col("symbol_id").alias("dst_symbol_id"), F.col("file_id").alias("dst_file"))
    return r.refs.where("dst_symbol_id is not null").join(s, "dst_symbol_id").withColumn("confidence", sure)


@statement(f"select src_file_id src, file_id dst, max({_SURE}) w, count(*) n from refs join symbols on dst_symbol_id = symbol_id where src_file_id <> file_id group by 1, 2")
def file_import_edges(r):
    return N.edges_of(_ties(r), "src_file_id", "dst_file")


@statement(f"select src_symbol_id src, dst_symbol_id dst, max({_SURE}) w, count(*) n from refs where dst_symbol_id is not null and src_symbol_id <> dst_symbol_id group by 1, 2")
def symbol_edges(r):
    return N.edges_of(_ties(r), "src_symbol_id", "dst_symbol_id")


@statement(f"select cast(substr(split_part(path, '/', 1), 7) as bigint) + {FOLDER_NODES} src, file_id dst, 1.0::double w from files")
def containment_edges(r):
    """From the node of the top folder that holds a file to the file."""
    top = r.nodes.where("kind = 'dir'").select(F.col("node_id").alias("src"), F.col("path").alias("folder"))
    f = r.files.select(F.col("file_id").alias("dst"), F.split("path", "/")[0].alias("folder"))
    return f.join(top, "folder").select("src", "dst", F.lit(1.0).alias("w"))


_BASES = "fb as (select file_id file, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) folder, regexp_replace(split_part(path, '/', 3), '_[0-9]+\\.[a-z]+$', '') base from files)"


def _bases(r):
    p = F.split("path", "/")
    return r.files.select(F.col("file_id").alias("file"), F.concat_ws("/", p[0], p[1]).alias("folder"), F.regexp_replace(p[2], r"_[0-9]+\.[a-z]+$", "").alias("base"))


@statement(f"with {_BASES}, t as (select file + 100000 test, folder, base from fb where file % 3 = 0), nr as (select folder, base, count(*) n, min(file) f from fb group by 1, 2), wd as (select base, count(*) n, min(file) f from fb group by 1) select test, case when nr.n is not null then case when nr.n = 1 then nr.f end when wd.n = 1 then wd.f end file from t left join nr using (folder, base) left join wd using (base) where case when nr.n is not null then case when nr.n = 1 then nr.f end when wd.n = 1 then wd.f end is not null")
def test_targets(r):
    """Tests named for a file: by the base name behind their marks."""
    f = _bases(r)
    marked = F.when(F.col("file") % 2 == 0, F.concat(F.lit("tests/test_"), "base", F.lit(".py"))).otherwise(F.concat(F.lit("tests/"), "base", F.lit("_test.go")))
    tests = f.where("file % 3 = 0").select((F.col("file") + 100_000).alias("test"), "folder", N.test_base(marked).alias("base"))
    return N.test_targets(tests, f)


@statement(f"with {_BASES} select file, file % 4 <> 3 and base <> '' own from fb")
def own_tests(r):
    """Whether a test's path is that of a file's own test, in four ways of naming it; every fourth is another file's."""
    b = F.col("base")
    test = F.when(F.col("file") % 4 == 0, F.concat(F.lit("t/test_"), b, F.lit(".py"))).when(F.col("file") % 4 == 1, F.concat(F.lit("t/"), F.upper(b), F.lit(".test.ts"))).when(F.col("file") % 4 == 2, F.concat(b, F.lit("Spec.java"))).otherwise(F.concat(F.lit("test_x"), b, F.lit(".py")))
    return _bases(r).select("file", N.is_own_test(test, F.concat(F.lit("src/"), b, F.lit(".rs"))).alias("own"))


@statement("""with o as (select file_id, name, symbol_id, sig_hash, row_number() over (partition by file_id, name order by symbol_id) k from symbols where symbol_id % 2 = 0), n as (select file_id, name, symbol_id, sig_hash, row_number() over (partition by file_id, name order by symbol_id) k from (select file_id, name, symbol_id + 997 symbol_id, md5(qual_name) sig_hash from symbols where symbol_id % 4 = 0 union all select file_id, name, symbol_id + 997, sig_hash from symbols where symbol_id % 4 = 2))
select o.symbol_id as old, n.symbol_id as new from o join n using (file_id, name, k) where o.sig_hash is distinct from n.sig_hash""")
def signature_changes(r):
    """Definitions matched k-th to k-th whose signatures differ."""
    old = r.symbols.where("symbol_id % 2 = 0").select("file_id", "name", F.col("symbol_id").alias("old"), F.col("sig_hash").alias("old_sig"))
    new = r.symbols.where("symbol_id % 2 = 0").select("file_id", "name", (F.col("symbol_id") + 997).alias("new"), F.when(F.col("symbol_id") % 4 == 0, F.md5("qual_name")).otherwise(F.col("sig_hash")).alias("new_sig"))
    keys = ["file_id", "name"]
    pairs = old.withColumn("k", N.kth(keys, "old")).join(new.withColumn("k", N.kth(keys, "new")), [*keys, "k"], "full_outer")
    return N.signature_changes(pairs).select("old", "new")


_LINES = "ln as (select distinct src_file_id file, src_symbol_id % 400 + 1 line from refs where src_file_id % 3 = 0)"


def _lines(r):
    return r.refs.where("src_file_id % 3 = 0").select(F.col("src_file_id").alias("file"), (F.col("src_symbol_id") % 400 + 1).alias("line")).distinct()


def _spans(r):
    return r.symbols.select(F.col("file_id").alias("file"), F.col("symbol_id").alias("symbol"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))


@statement(f"with {_LINES} select file, line, arg_min(symbol_id, (end_line - start_line, -start_line, -symbol_id)) symbol from ln join symbols on file_id = file and start_line <= line and line <= end_line group by 1, 2")
def innermost_definitions(r):
    return N.innermost(_lines(r), _spans(r))


@statement("select distinct blame.file_id file, symbol_id symbol from blame join symbols on symbols.file_id = blame.file_id and start_line <= last and end_line >= first where blame.file_id % 4 = 1")
def covering_symbols(r):
    """Definitions whose lines overlap a range of lines."""
    asked = r.blame.where("file_id % 4 = 1").select(F.col("file_id").alias("file"), F.col("first").alias("lo"), F.col("last").alias("hi"))
    return records.overlapping(_spans(r), asked, "file", 64).select("file", "symbol").distinct()


_TARGETS = """tg as (select path target from files where file_id % 20 = 0 union select path || ':' || cast(start_line as string) from files join symbols using (file_id) where symbol_id % 90 = 0 union select path || ':' || name from files join symbols using (file_id) where symbol_id % 70 = 0
  union select name from symbols where symbol_id % 200 = 0 union select 'nothing/here.rs:12')"""


@statement(f"""with {_TARGETS}, ln as (select distinct file_id file, start_line line from symbols where symbol_id % 90 = 0), inn as (select file, line, arg_min(symbol_id, (end_line - start_line, -start_line, -symbol_id)) symbol from ln join symbols on file_id = file and start_line <= line and line <= end_line group by 1, 2),
f as (select target, file_id node, 'file' kind from tg join files on path = target union all select target, symbol, 'symbol' from tg join files on starts_with(target, path || ':') join inn on file = file_id and cast(line as string) = substr(target, length(path) + 2)
  union all select target, symbol_id, 'symbol' from tg join files on starts_with(target, path || ':') join symbols on symbols.file_id = files.file_id and name = substr(target, length(path) + 2) union all select target, symbol_id, 'symbol' from tg join symbols on name = target)
select target, min(node) node, min(kind) kind from f group by 1 having count(distinct (node, kind)) = 1""")
def why_targets(r):
    """A path, a path with a line or a name, or a name: the one thing it names."""
    f = r.files.select(F.col("file_id").alias("file"), "path")
    s = r.symbols.select(F.col("file_id").alias("file"), F.col("symbol_id").alias("symbol"), "name", F.col("start_line").alias("line"))
    sf = s.join(f, "file")
    t = f.where("file % 20 = 0").select(F.col("path").alias("target"))
    for more in (
        sf.where("symbol % 90 = 0").select(F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("target")),
        sf.where("symbol % 70 = 0").select(F.concat("path", F.lit(":"), "name").alias("target")),
        s.where("symbol % 200 = 0").select(F.col("name").alias("target")),
        r.spark.createDataFrame([("nothing/here.rs:12",)], "target string"),
    ):
        t = t.unionByName(more)
    lines = N.innermost(s.where("symbol % 90 = 0").select("file", "line").distinct(), _spans(r))
    return N.one_target(t.distinct(), f, s.select("file", "symbol", "name"), lines)
