"""Co-change, folders, sizes and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from workmap.functions.scalar import prefixes, scale_mode
from workmap.operators import cochange
from workmap.operators.scratch import written
from workmap.plans.adapters import COMMITS, MAX_FILES, PARTNERS, anchor, commit_files, commit_lists, commits, table
from workmap.plans.registry import query


@query(f"with {COMMITS} select f file, n commits, round(w, 6) weighted from fc")
def cochange_file_commits(spark, d):
    f = commit_files(spark, d)
    return cochange.file_commits(f, anchor(f)).withColumn("weighted", F.round("weighted", 6))


@query(f"with {COMMITS} select fa file_a, fb file_b, n commits, round(w, 6) weighted, s last_seq from pc")
def cochange_pairs(spark, d):
    f = commit_lists(spark, d)
    return cochange.pair_commits(f, anchor(f)).withColumn("weighted", F.round("weighted", 6))


@query(f"with {PARTNERS} select src, dst, round(conf, 6) confidence, n commits, place::int place from pk")
def cochange_edges(spark, d):
    f = commit_lists(spark, d)
    a = anchor(f)
    return cochange.partners(cochange.pair_commits(f, a), cochange.file_commits(f.select("seq", F.explode("files").alias("file"), "anchor"), a)).withColumn("confidence", F.round("confidence", 6))


@query(f"with {COMMITS}, w as (select p_partkey f from part where p_size = 7) select fa file_a, fb file_b, n commits from pc where fa in (select f from w) union select fa, fb, n from pc where fb in (select f from w)")
def cochange_partners_of(spark, d):
    f = commit_lists(spark, d)
    wanted = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("file"))
    return cochange.partners_of(cochange.pair_commits(f, anchor(f)).select("file_a", "file_b", "commits"), wanted)


@query(f"with {COMMITS} select fa file_a, fb file_b, n commits, round(w, 6) weighted, s last_seq from pc")
def cochange_merge(spark, d):
    """Two minings, of even and of odd commits, add up to the whole."""
    f = commit_lists(spark, d)
    a = anchor(f)
    halves = [cochange.pair_commits(f.where(F.col("seq") % 2 == k), a) for k in (0, 1)]
    return cochange.merged(halves[0].unionByName(halves[1]), ["file_a", "file_b"], cochange.pair_parts(f)).withColumn("weighted", F.round("weighted", 6))


#: A history of renames: a returned part takes the place of the one after it, whose path may be used again, and is, by later orders.
_MOVES = f"""with recursive {COMMITS.strip()},
mv as (select seq, l_partkey path, case when bool_or(l_returnflag = 'R') then l_partkey + 1 end renamed_from from lineitem join commits on c = l_orderkey where seq in (select seq from cf) group by 1, 2),
ev as (select renamed_from path, seq until, max(path) as name from mv where renamed_from is not null group by 1, 2),
sv as materialized (select *, coalesce(lag(until) over (partition by path order by until), -1) since from ev),
rw as (select path, since, until, name, until at_ from sv union all select rw.path, rw.since, rw.until, sv.name, sv.until from rw join sv on sv.path = rw.name and sv.since <= rw.at_ and rw.at_ < sv.until),
nw as (select path, since, until, arg_max(name, at_) as name from rw group by 1, 2, 3),
rf as (select distinct seq, coalesce(name, mv.path) f from mv left join nw on nw.path = mv.path and since <= seq and seq < until where coalesce(name, mv.path) in (select p_partkey from part))"""


def _moves(spark, d):
    """(seq, path, renamed_from) of the commits that count."""
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("moved"))
    sizes = o.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= MAX_FILES).select("commit")
    counted = o.join(sizes, "commit").join(commits(spark, d), "commit")
    return counted.select("seq", "path", F.when(F.col("moved"), F.col("path") + 1).alias("renamed_from"))


def _todays(spark, d):
    return cochange.under_todays_names(written(_moves(spark, d)), table(spark, d, "part").select(F.col("p_partkey").alias("file")))


@query(f"{_MOVES} select path, since, until, name from nw")
def renames_followed(spark, d):
    """What each path that was ever renamed is called now, by the commits for which it is."""
    return cochange.renames_followed(written(_moves(spark, d))).select("path", "since", "until", "name")


@query(f"{_MOVES} select x.f file_a, y.f file_b, count(*) commits, round(sum(pow(0.5, (a - x.seq) / 500.0)), 6) weighted, max(x.seq) last_seq from rf x join rf y on x.seq = y.seq and x.f < y.f, a group by 1, 2")
def cochange_renamed_pairs(spark, d):
    """Pairs of files over their whole history, renames followed."""
    files = _todays(spark, d)
    newest = commit_lists(spark, d).agg(F.max("anchor").alias("anchor"))
    return cochange.pair_commits(files.crossJoin(newest), F.col("anchor")).withColumn("weighted", F.round("weighted", 6))


@query(f"{_MOVES} select f file, count(*) commits, round(sum(pow(0.5, (a - seq) / 500.0)), 6) weighted from rf, a group by 1")
def cochange_renamed_file_commits(spark, d):
    files = _todays(spark, d)
    newest = commit_lists(spark, d).agg(F.max("anchor").alias("anchor"))
    return cochange.file_commits(files.crossJoin(newest), F.col("anchor")).withColumn("weighted", F.round("weighted", 6))


def part_paths(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.concat_ws("/", F.lower("p_brand"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))).alias("path"), F.col("p_size").alias("loc"))


PATHS = "f as (select p_partkey file, concat_ws('/', lower(p_brand), replace(lower(p_type), ' ', '/'), replace(lower(p_name), ' ', '_')) path, p_size loc from part), fp as (select file, path, string_split(path, '/') p from f), pre as (select distinct array_to_string(p[1:i], '/') folder, i, file from (select *, unnest(range(1, len(p))) i from fp))"


@query(f"with {PATHS} select folder, count(*) files from pre group by 1")
def folder_containment(spark, d):
    """Files that each folder holds, at any depth."""
    return part_paths(spark, d).select("file", F.explode(prefixes(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count_distinct("file").alias("files"))


@query(f"with {PATHS} select count(distinct folder) folders from pre")
def folder_count(spark, d):
    return part_paths(spark, d).select(F.explode(prefixes(F.col("path"))).alias("folder")).agg(F.count_distinct("folder").alias("folders"))


@query("select count(*) files, coalesce(sum(p_size), 0)::bigint lines from part where (p_partkey & 5) = 0")
def source_size_flags(spark, d):
    """Files with neither of two flag bits, and their lines."""
    return table(spark, d, "part").where(F.col("p_partkey").bitwiseAND(5) == 0).agg(F.count("*").alias("files"), F.coalesce(F.sum("p_size"), F.lit(0)).alias("lines"))


@query("select b brand, case when n > 60000 or l > 5000000 then 'huge' when n < 30 or l < 2000 then 'tiny' when n <= 500 then 'small' else 'medium' end mode from (select p_brand b, count(*) n, sum(p_size) l from part group by 1)")
def scale_modes(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.sum("p_size").alias("l"))
    return s.select("brand", scale_mode(F.col("n"), F.col("l")).alias("mode"))


@query("select page_id, url from pages where url > 'https://www.' and url < 'https://www/'")
def path_prefix_range(spark, d):
    """A prefix as an open range, which the scan prunes by statistics."""
    return table(spark, d, "pages").where((F.col("url") > "https://www.") & (F.col("url") < "https://www/")).select("page_id", "url")


@query("select p_partkey file, p_name path from part where lower(p_name) = 'ring' or ends_with(lower(p_name), ' ring')")
def files_named(spark, d):
    t = F.lower("p_name")
    return table(spark, d, "part").where((t == "ring") | t.endswith(" ring")).select(F.col("p_partkey").alias("file"), F.col("p_name").alias("path"))


@query("select p_name name, p_partkey symbol, case when lower(p_name) = 'red ring' then 0 when starts_with(lower(p_name), 'red r') then 1 else 2 end rank from part where contains(lower(p_name), 'd r') order by rank, p_type, p_size, p_name, p_partkey limit 40")
def symbols_containing(spark, d):
    """Names that contain a text: equal, beginning with it, then the rest."""
    n = F.lower("p_name")
    rank = F.when(n == "red ring", 0).when(n.startswith("red r"), 1).otherwise(2)
    return table(spark, d, "part").where(F.instr(n, "d r") > 0).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("symbol"), rank.alias("rank"), "p_type", "p_size").orderBy("rank", "p_type", "p_size", "name", "symbol").limit(40).select("name", "symbol", "rank")
