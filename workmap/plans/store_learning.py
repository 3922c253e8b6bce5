"""Statements of the store about the graph's edges, interest, transitions, usage, episodes, injections, blame and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from workmap.operators import snapshot as S
from workmap.plans.relations import ids, statement


# ---------------------------------------------------------------- co-change rows
@statement("select count(*) n from commits_of where false")
def file_commits_delete_all(r):
    """The empty table that a full mining begins with."""
    return r.commits_of.where("false").agg(F.count("*").alias("n"))


@statement("select count(*) n from links where type <> 1")
def cochange_stats_delete_all(r):
    return S.kept(r.links, F.col("type") == 1).agg(F.count("*").alias("n"))


@statement("select file_id, case when file_id % 2 = 0 then 2 * n else n end n, last_seq from commits_of")
def file_commits_add(r):
    """A second mining of half of the files adds to the first."""
    return S.summed(r.commits_of, r.commits_of.where("file_id % 2 = 0"), ["file_id"], ["n"], ("last_seq",))


@statement("select src, dst, n + (case when src % 2 = 0 then 1 else 0 end) n, case when src % 2 = 0 then greatest(last_seq, 9000) else last_seq end last_seq from links where type = 1")
def cochange_stats_add(r):
    own = r.links.where("type = 1").select("src", "dst", "n", "last_seq")
    more = own.where("src % 2 = 0").select("src", "dst", F.lit(1).cast("long").alias("n"), F.lit(9000).cast("long").alias("last_seq"))
    return S.summed(own, more, ["src", "dst"], ["n"], ("last_seq",))


@statement("select file_id, n from commits_of where file_id % 50 = 7")
def file_commits_of(r):
    return S.keyed(r.commits_of, ids(r.files, "file_id % 50 = 7", "file_id")).select("file_id", "n")


# ---------------------------------------------------------------- edges
@statement("""select nodes.kind, coalesce(files.flags, f2.flags) flags, count(*) n, round(sum(coalesce(score, 0)), 4) score from nodes
  left join symbols on nodes.kind = 'symbol' and symbols.symbol_id = nodes.ref_id left join files on nodes.kind = 'file' and files.file_id = nodes.ref_id
  left join files f2 on f2.file_id = symbols.file_id left join interest on interest.node_id = nodes.node_id group by 1, 2""")
def graph_nodes(r):
    """Every node with its file's flags (a symbol has its file's) and its interest, summed up by kind and flags."""
    of_file = r.nodes.select("node_id", "kind", F.when(F.col("kind") == "file", F.col("ref_id")).alias("own"), F.when(F.col("kind") == "symbol", F.col("ref_id")).alias("symbol_id"))
    held = of_file.join(r.symbols.select("symbol_id", "file_id"), "symbol_id", "left").withColumn("file_id", F.coalesce("own", "file_id"))
    full = held.join(r.files.select("file_id", "flags"), "file_id", "left").join(r.interest.select("node_id", "score"), "node_id", "left")
    return full.groupBy("kind", "flags").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("score", F.lit(0.0))), 4).alias("score"))


@statement("select src, dst, type, w, n from links order by src, dst, type")
def all_edges(r):
    return r.links.select("src", "dst", "type", "w", "n").orderBy("src", "dst", "type")


@statement("select coalesce(max(seq), 0) seq from tasks")
def latest_task_seq(r):
    return r.tasks.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))


@statement("select src, type, count(*) n from links where not (src % 10 = 3 and type = 0) group by 1, 2")
def edges_delete_from(r):
    return S.kept(r.links, (F.col("src") % 10 == 3) & (F.col("type") == 0)).groupBy("src", "type").agg(F.count("*").alias("n"))


@statement("select type, count(*) n from links where type <> 2 group by 1")
def edges_delete_of_type(r):
    return S.kept(r.links, F.col("type") == 2).groupBy("type").agg(F.count("*").alias("n"))


@statement("select src, dst, 4 as type, w from links where type = 0 and src = 8")
def edge_insert(r):
    new = S.point(r.links, type=0, src=8).withColumn("type", F.lit(4))
    return S.once(r.links, new, ["src", "dst", "type"]).where("type = 4").select("src", "dst", "type", "w")


@statement("select dst, type, w from links where src = 12 order by dst, type")
def edges_from(r):
    return S.point(r.links, src=12).select("dst", "type", "w").orderBy("dst", "type")


@statement("select distinct src from links where dst = 40")
def sources_into(r):
    return S.point(r.links, dst=40).select("src").distinct()


@statement("select distinct dst from links l where src = 12 and type = 0 and exists (select 1 from symbols s where s.file_id = l.dst and s.kind = 'test')")
def test_files_into(r):
    """Neighbours whose file has a test: one semi join."""
    tests = r.symbols.where("kind = 'test'").select(F.col("file_id").alias("dst"))
    return S.keyed(S.point(r.links, src=12, type=0), tests).select("dst").distinct()


@statement("select distinct src from links where type = 2 and w >= 0.1")
def edge_sources(r):
    return S.point(r.links, type=2).where("w >= 0.1").select("src").distinct()


@statement("select src, dst, w from links where type = 1 and w > 0.09")
def edges_of_type(r):
    return S.point(r.links, type=1).where("w > 0.09").select("src", "dst", "w")


# ---------------------------------------------------------------- interest, transitions, co-access
@statement("select node_id, score, last_seq from interest where node_id % 71 = 2")
def interest_of(r):
    return S.keyed(r.interest, ids(r.files, "file_id % 71 = 2", "file_id", "node_id"))


@statement("select interest.node_id, score from interest join nodes using (node_id) where kind = 'file' and score >= 4.5")
def file_interest_from(r):
    return S.keyed(r.interest.where("score >= 4.5"), r.nodes.where("kind = 'file'").select("node_id")).select("node_id", "score")


@statement("select node_id, case when node_id % 9 = 0 then 7.5 else score end::double score from interest")
def interest_replace(r):
    """Interest given for nodes that exist; what is given for others is dropped."""
    given = r.interest.where("node_id % 9 = 0").unionByName(r.interest.where("node_id % 9 = 0").withColumn("node_id", F.col("node_id") + 700_000_000)).withColumn("score", F.lit(7.5))
    return S.replaced(r.interest, S.guarded(given, r.nodes, "node_id").select(*r.interest.columns), ["node_id"]).select("node_id", "score")


@statement("select src, dst, weight from ways where src in (3, 4)")
def transitions_from(r):
    return S.keyed(r.ways, r.spark.createDataFrame([(3,), (4,)], "src long")).select("src", "dst", "weight")


@statement("select src, dst, weight from ways where (src, dst) > (20, 150) order by src, dst limit 100")
def transitions_after(r):
    return S.page(r.ways, ["src", "dst"], (20, 150), 100).select("src", "dst", "weight")


@statement("select src, dst, case when src % 2 = 0 then 9.25 else weight end::double weight from ways")
def transition_set(r):
    given = S.guarded(r.ways.where("src % 2 = 0").withColumn("weight", F.lit(9.25)), r.nodes, "src", "dst").select(*r.ways.columns)
    return S.replaced(r.ways, given, ["src", "dst"]).select("src", "dst", "weight")


@statement("select src, count(*) n from ways where not (src = 5 and dst % 2 = 0) group by 1")
def transitions_remove(r):
    return S.without(r.ways, r.ways.where("src = 5 and dst % 2 = 0").select("src", "dst")).groupBy("src").agg(F.count("*").alias("n"))


@statement("select src, dst, w from links where type = 2 and (src, dst) > (7, 500) order by src, dst limit 60")
def coaccess_after(r):
    return S.page(S.point(r.links, type=2), ["src", "dst"], (7, 500), 60).select("src", "dst", "w")


@statement("select type, count(*) n from links where not (type = 2 and w < 0.03) group by 1")
def coaccess_remove(r):
    """Faded links go, by their pairs."""
    return S.without(r.links, r.links.where("type = 2 and w < 0.03").select("src", "dst", "type")).groupBy("type").agg(F.count("*").alias("n"))


@statement("select node_id, score from interest where node_id > 300 order by node_id limit 40")
def interest_after(r):
    return S.page(r.interest, ["node_id"], (300,), 40).select("node_id", "score")


@statement("select node_id from interest where score >= 0.3")
def interest_remove(r):
    return S.without(r.interest, ids(r.interest, "score < 0.3", "node_id")).select("node_id")


# ---------------------------------------------------------------- usage
@statement("select session_id, count(*) turns, sum(tokens)::bigint tokens from usage where not (session_id % 3 = 0 and turn > 5000) group by 1")
def usage_forget_after(r):
    """Turns past a mark are forgotten in the sessions that went back."""
    return S.kept(r.usage, (F.col("session_id") % 3 == 0) & (F.col("turn") > 5000)).groupBy("session_id").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))


# ---------------------------------------------------------------- episodes, archetypes, calibration
@statement("select task_id, case when task_id % 6 = 0 then 'reverted' else outcome end outcome from episodes")
def episode_replace(r):
    return S.replaced(r.episodes, r.episodes.where("task_id % 6 = 0").withColumn("outcome", F.lit("reverted")), ["task_id"]).select("task_id", "outcome")


@statement("select task_id, outcome, changes from episodes where task_id = 9")
def episode_of_task(r):
    return S.point(r.episodes, task_id=9).select("task_id", "outcome", "changes")


@statement("select count(*) n from archetypes where false")
def archetypes_delete_all(r):
    return r.archetypes.where("false").agg(F.count("*").alias("n"))


@statement("select archetype_id, name, tasks from archetypes union all select 100, 'new', 3")
def archetype_insert(r):
    return r.archetypes.unionByName(r.spark.createDataFrame([(100, "new", 3)], "archetype_id int, name string, tasks int"))


@statement("select archetype_id, name, tasks from archetypes order by tasks desc, archetype_id")
def archetypes_ordered(r):
    return r.archetypes.orderBy(F.desc("tasks"), "archetype_id")


@statement("select * from (select task_id, ended_at, outcome from episodes order by ended_at desc, task_id desc limit 200) order by ended_at, task_id")
def episodes(r):
    """The newest, given oldest first."""
    return S.newest(r.episodes, ["ended_at", "task_id"], 200).select("task_id", "ended_at", "outcome").orderBy("ended_at", "task_id")


@statement("select task_id, changes, ended_at from episodes where ended_at < 50000000 and changes > 0 order by ended_at desc, task_id desc limit 100")
def episode_changes_ended_before(r):
    return S.newest(r.episodes.where("ended_at < 50000000 and changes > 0"), ["ended_at", "task_id"], 100).select("task_id", "changes", "ended_at")


@statement("select version, rows_, intercept from calibration order by version desc limit 1")
def calibration_latest(r):
    return S.newest(r.calibration, ["version"], 1)


@statement("select coalesce(max(version), 0) + 1 as version, 500 rows_, 0.125::double intercept from calibration")
def calibration_add(r):
    return r.calibration.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version")).select("version", F.lit(500).alias("rows_"), F.lit(0.125).alias("intercept"))


@statement("select version from calibration order by version desc limit 10")
def calibration_prune(r):
    return S.over_cap(r.calibration, "version", [F.desc("version")], 10).select("version")


# ---------------------------------------------------------------- injections and labels
@statement("select injection_id + 1000000 injection_id, task_id, channel, delivered from injections where task_id % 9 = 0")
def injection_insert(r):
    new = r.injections.where("task_id % 9 = 0").withColumn("injection_id", F.col("injection_id") + 1_000_000)
    return S.inserted(r.injections, new).where("is_new").select("injection_id", "task_id", "channel", "delivered")


_DELIVERED = "delivered and label is not null and used_count is not null"


@statement(f"select injection_id, label from injections where {_DELIVERED} order by ts desc, injection_id desc limit 150")
def delivered_labels(r):
    return S.newest(r.injections.where(_DELIVERED), ["ts", "injection_id"], 150).select("injection_id", "label")


@statement(f"select count(*) filter (where {_DELIVERED}) labelled, count(*) all_ from injections")
def count_delivered_labelled(r):
    return r.injections.agg(F.count_if(F.expr(_DELIVERED)).alias("labelled"), F.count("*").alias("all_"))


@statement("select injection_id, label, ts from (select * from injections where label is not null order by ts desc, injection_id desc limit 300) order by ts, injection_id")
def labelled_injections(r):
    return S.newest(r.injections.where("label is not null"), ["ts", "injection_id"], 300).select("injection_id", "label", "ts").orderBy("ts", "injection_id")


@statement("select count(*) filter (where label is not null) labelled from injections")
def count_labelled_injections(r):
    return r.injections.agg(F.count_if(F.col("label").isNotNull()).alias("labelled"))


@statement("select injection_id, coalesce(u.n, used_count) used_count from injections left join (select injection_id, count(*) n from items where node_id % 2 = 0 group by 1) u using (injection_id)")
def injection_use(r):
    """How many of an injection's items were used."""
    used = r.items.where("node_id % 2 = 0").groupBy("injection_id").agg(F.count("*").alias("used_count"))
    return S.updated(r.injections, used, ["injection_id"]).select("injection_id", "used_count")


@statement("select distinct task_id from injections join items using (injection_id) where node_id = 5")
def task_named(r):
    """Tasks that an injection with a node went to."""
    return S.keyed(r.injections, S.point(r.items, node_id=5).select("injection_id")).select("task_id").distinct()


@statement("select injection_id, channel, ts from injections where task_id = 30 order by ts, injection_id")
def injections_of_task(r):
    return S.point(r.injections, task_id=30).select("injection_id", "channel", "ts").orderBy("ts", "injection_id")


@statement("select injection_id, task_id, ts from injections where session_id = 42 order by ts, injection_id")
def injections_of_session(r):
    return S.point(r.injections, session_id=42).select("injection_id", "task_id", "ts").orderBy("ts", "injection_id")


@statement("select injection_id, ts from injections where ts >= 60000000 and delivered and channel = 'prompt' order by ts desc, injection_id desc limit 80")
def work_orders_since(r):
    return S.newest(r.injections.where("ts >= 60000000 and delivered and channel = 'prompt'"), ["ts", "injection_id"], 80).select("injection_id", "ts")


@statement("select injection_id, task_id, label from injections where delivered and channel = 'prompt'")
def work_orders_all(r):
    return r.injections.where("delivered and channel = 'prompt'").select("injection_id", "task_id", "label")


@statement("select injection_id, ts from injections i where delivered and channel = 'prompt' and exists (select 1 from items t where t.injection_id = i.injection_id and node_id % 200 = 5) order by ts desc, injection_id desc limit 80")
def work_orders_naming(r):
    named = S.keyed(r.injections.where("delivered and channel = 'prompt'"), ids(r.items, "node_id % 200 = 5", "injection_id"))
    return S.newest(named, ["ts", "injection_id"], 80).select("injection_id", "ts")


# ---------------------------------------------------------------- blame cache
@statement("select file_id, content_hash, max(put_at) put_at, count(*) n from blame group by 1, 2")
def blame_put(r):
    """One entry for each content, the last one put."""
    return r.blame.groupBy("file_id", "content_hash").agg(F.max("put_at").alias("put_at"), F.count("*").alias("n"))


@statement("select count(*) n from blame")
def blame_rows(r):
    return r.blame.agg(F.count("*").alias("n"))


@statement("select content_hash, count(*) n from blame b where exists (select 1 from files f where f.file_id = b.file_id and b.content_hash = 'now' and f.flags & 1 = 0) group by 1")
def blame_delete_missing(r):
    """Entries whose file or content is gone are deleted."""
    there = r.files.where(F.col("flags").bitwiseAND(1) == 0).select("file_id", F.lit("now").alias("content_hash"))
    return S.keyed(r.blame, there).groupBy("content_hash").agg(F.count("*").alias("n"))


@statement("select file_id, first, last, put_at from blame order by put_at desc, file_id, first, last, content_hash limit 500")
def blame_over_cap(r):
    """The newest entries up to a cap of 500 stay."""
    return r.blame.orderBy(F.desc("put_at"), "file_id", "first", "last", "content_hash").limit(500).select("file_id", "first", "last", "put_at")


# ---------------------------------------------------------------- change cards and their terms
@statement("select exists (select 1 from cards where number = 31) there")
def card_exists(r):
    return S.point(r.cards, number=31).agg((F.count("*") > 0).alias("there"))


@statement("select oid, case when number % 8 = 0 then 'rewritten' else title end title from cards")
def card_put(r):
    return S.replaced(r.cards, r.cards.where("number % 8 = 0").withColumn("title", F.lit("rewritten")), ["oid"]).select("oid", "title")


_TERMS = "select number, unnest(string_split(title, '-')) term from cards"


def _terms(r):
    return r.cards.select("number", F.explode(F.split("title", "-")).alias("term"))


@statement(f"select term, count(*) n from ({_TERMS}) where number % 4 <> 1 group by 1")
def terms_delete(r):
    return S.without(_terms(r), ids(r.cards, "number % 4 = 1", "number")).groupBy("term").agg(F.count("*").alias("n"))


@statement(f"select number, term from ({_TERMS}) union all select number + 5000000, 'extra' from cards where number % 100 = 0")
def terms_insert(r):
    return _terms(r).unionByName(r.cards.where("number % 100 = 0").select((F.col("number") + 5_000_000).alias("number"), F.lit("extra").alias("term")))


@statement("select number from cards where number % 4 <> 1")
def cards_delete(r):
    return S.without(r.cards, ids(r.cards, "number % 4 = 1", "oid")).select("number")


@statement("select number, title from cards where oid in (select md5(cast(n as string)) from (select unnest([3, 14, 159, 99999999]) n))")
def cards_by_oid(r):
    return S.keyed(r.cards, r.spark.createDataFrame([(3,), (14,), (159,), (99_999_999,)], "n long").select(F.md5(F.col("n").cast("string")).alias("oid"))).select("number", "title")


@statement("""with t as (select item_id card, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) term from benchmark),
  n as (select card, count(*) n from t group by 1), st as (select count(*) c, avg(n) a from n), tf as (select card, term, count(*) tf from t group by 1, 2), df as (select term, count(*) df from tf group by 1)
  select card, round(sum(greatest(ln((c - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a))), 6) score from tf join df using (term) join n using (card), st where term in ('the', 'that', 'est', 'heren') group by 1 order by 2 desc, 1 limit 10""")
def cards_matching(r):
    """Texts that match any of some words, the best ten."""
    from workmap.operators import search
    
    cards = r.table("benchmark")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    post = search.term_counts(cards, "item_id", words)
    stats = cards.select(F.size(words).alias("n")).agg(F.count("*").alias("rows"), F.avg("n").alias("mean_length"))
    asked = r.spark.createDataFrame([(0, w) for w in ("the", "that", "est", "heren")], "query int, term string")
    return search.bm25(post, asked, stats, 10).select(F.col("doc").alias("card"), "score")


@statement("select count(*) n from cards")
def card_rows(r):
    return r.cards.agg(F.count("*").alias("n"))


@statement("select oid, number from cards where oid >= 'ab' and oid < 'ac' order by oid limit 20")
def cards_starting(r):
    """Ids that begin with two hexadecimal digits, as a range that statistics prune."""
    return r.cards.where("oid >= 'ab' and oid < 'ac'").orderBy("oid").limit(20).select("oid", "number")


@statement(f"select count(*) n from ({_TERMS})")
def term_rows(r):
    return _terms(r).agg(F.count("*").alias("n"))


@statement(f"select term, count(distinct number) df from ({_TERMS}) where term in ('urgent', '1') group by 1")
def term_cards(r):
    return S.keyed(_terms(r), r.spark.createDataFrame([("urgent",), ("1",)], "term string")).groupBy("term").agg(F.count_distinct("number").alias("df"))

