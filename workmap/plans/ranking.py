"""The graph, its ranking, the gate and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from workmap.operators import graph, learn, records, spreading
from workmap.operators.scratch import parts_for, written
from workmap.plans.adapters import EDGES, edges, table
from workmap.plans.registry import query

WEIGHED = EDGES + """,
on_ as (select src, dst, type, case type when 'structural' then 1.0 else 0.6 end::double * least(greatest(w, 0), 1) w from ed),
wg as (select src, dst, type, sum(w) w, max(w) peak from (select * from on_ union all select dst, src, type, w from on_ where type <> 'cochange') group by 1, 2, 3),
g as (select src, dst, sum(w) w from wg group by 1, 2)
"""


def _weighed(spark, d):
    # a line is an edge at most, an edge is a link of either end
    return graph.weighed(edges(spark, d), F.lit(0), parts=parts_for(spark, 2 * table(spark, d, "lineitem").count()))


@query(f"with {WEIGHED} select src, dst, type, round(w, 6) w, round(peak, 6) peak from wg")
def graph_weighed(spark, d):
    return _weighed(spark, d).withColumns({"w": F.round("w", 6), "peak": F.round("peak", 6)})


@query(f"with {WEIGHED}, f as (select x.src % 97 src, x.dst % 97 dst, w from wg x) select src, dst, round(sum(w), 4) w from f where src <> dst group by 1, 2")
def graph_by_files(spark, d):
    """Nodes lifted to 97 files."""
    w = _weighed(spark, d)
    of = w.select(F.col("src").alias("node")).unionByName(w.select(F.col("dst").alias("node"))).distinct().withColumn("file", F.col("node") % 97)
    return graph.by_files(w, of).withColumn("w", F.round("w", 4))


@query(f"""with {WEIGHED}, sh as materialized (select src, dst, w / sum(w) over (partition by src) p from g where w > 0), m as (select 0 query, p_partkey node, 1.0::double / count(*) over () w from part where p_size = 1),
{spreading.power_sql("m", "sh")}
select node, round(kept, 6) score from z""")
def ppr_scores(spark, d):
    """Page rank from the small parts, ten rounds from all nodes."""
    g = written(_weighed(spark, d).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    seeds = table(spark, d, "part").where("p_size = 1").select(F.lit(0).cast("long").alias("query"), F.col("p_partkey").alias("node"))
    total = seeds.agg(F.count("*").alias("n"))
    found = spreading.power(g, seeds.crossJoin(F.broadcast(total)).select("query", "node", (1 / F.col("n")).alias("w")))
    return found.select("node", F.round("kept", 6).alias("score"))


LINKS = EDGES + ", ln_ as (select least(src, dst) a, greatest(src, dst) b, max(w) weight from ed where type = 'cochange' group by 1, 2)"


def _links(spark, d):
    e = edges(spark, d).where("type = 'cochange'")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("weight"))


@query(f"with {LINKS}, en as (select a, b, weight, unnest([a, b]) e from ln_) select distinct a, b, round(weight, 6) weight from (select *, row_number() over (partition by e order by weight desc, a, b) k from en) where k <= 8")
def map_links_top8(spark, d):
    """Links among the eight strongest of either end."""
    return graph.strongest(_links(spark, d), 8).withColumn("weight", F.round("weight", 6))


@query(f"with {LINKS} select a, b, round(weight, 6) weight from ln_ order by round(weight, 9) desc, a, b limit 1")
def summary_strongest_pair(spark, d):
    return _links(spark, d).orderBy(F.desc(F.round("weight", 9)), "a", "b").limit(1).withColumn("weight", F.round("weight", 6))


@query(f"with {WEIGHED}, s as (select p_partkey src from part where p_size = 1 order by p_retailprice desc, src limit 10), n as (select dst node, max(w) w from g where src in (select src from s) group by 1) select node, round(w, 6) w from n where node not in (select p_partkey from part where p_size = 2) order by round(w, 9) desc, node limit 20")
def exploration_nodes(spark, d):
    g = _weighed(spark, d).groupBy("src", "dst").agg(F.round(F.sum("w"), 9).alias("w"))
    seeds = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("weight"))
    known = table(spark, d, "part").where("p_size = 2").select(F.col("p_partkey").alias("node"))
    return graph.exploration(g, seeds, known).withColumn("w", F.round("w", 6))


@query(f"with {EDGES}, n as (select p_partkey node from part where p_size <= 10) select src, dst, type, round(w, 6) w from ed where src in (select node from n) and dst in (select node from n)")
def edges_among(spark, d):
    nodes = table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("node"))
    return graph.among(edges(spark, d), nodes).select("src", "dst", "type", F.round("w", 6).alias("w"))


@query(f"with {EDGES}, t as (select min(src) t from ed where type = 'cochange'), o as (select dst other, type, w from ed, t where src = t union all select src, type, w from ed, t where dst = t) select other, type, round(max(w), 6) w from o, t where other <> t group by 1, 2")
def links_of_file(spark, d):
    e = edges(spark, d)
    first = e.where("type = 'cochange'").agg(F.min("src")).first()[0]
    return graph.both_ways(e, first).withColumn("w", F.round("w", 6))


@query(f"""with {EDGES}, h as (select p_partkey node from part where p_size = 3), x as (select src held, dst node, type, w from ed union all select dst, src, type, w from ed where type = 'structural')
select held, type, round(max(w), 6) w, count(*) n from x where held in (select node from h) group by 1, 2""")
def couplings(spark, d):
    """The strongest link of each held file and type: structural ones both ways, co-change one way."""
    e = edges(spark, d)
    held = table(spark, d, "part").where("p_size = 3").select(F.col("p_partkey").alias("held"))
    x = e.select(F.col("src").alias("held"), F.col("dst").alias("node"), "type", "w").unionByName(e.where("type = 'structural'").select(F.col("dst").alias("held"), F.col("src").alias("node"), "type", "w"))
    return x.join(held, "held", "left_semi").groupBy("held", "type").agg(F.round(F.max("w"), 6).alias("w"), F.count("*").alias("n"))


@query(f"with {EDGES}, n as (select p_partkey node from part where p_size % 2 = 0) select src, dst, type from ed where type = 'cochange' and src in (select node from n) and dst in (select node from n)")
def guarded_upsert(spark, d):
    nodes = table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("node"))
    return records.guarded(edges(spark, d).where("type = 'cochange'"), nodes).select("src", "dst", "type")


@query("""with r as (select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) k, sum(n_chars) over (partition by source) total from documents),
f as (select source, max(n_chars)::double / any_value(total) top, sum(n_chars) filter (where k <= 5)::double / any_value(total) top_mass, count(distinct doc_id % 6) filter (where k <= 3) kinds from r group by 1)
select source, round(top_mass, 6) top_mass, kinds, case when (kinds >= 2 and top >= 0.03) or (kinds >= 3 and top >= 0.02) then 'agreement' when top >= 0.05 then 'continuity' when kinds >= 2 then 'weak_match' else 'too_few_kinds' end verdict from f""")
def gate_decision(spark, d):
    """Features of a ranking and the gate's rules, with documents of a source as its files."""
    from pyspark.sql import Window

    by = Window.partitionBy("source")
    r = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.row_number().over(by.orderBy(F.desc("n_chars"), "doc_id")).alias("k"), F.sum("n_chars").over(by).alias("total"))
    f = r.groupBy("source").agg((F.max("n_chars") / F.first("total")).alias("top"), (F.sum(F.when(F.col("k") <= 5, F.col("n_chars"))) / F.first("total")).alias("top_mass"), F.count_distinct(F.when(F.col("k") <= 3, F.col("doc_id") % 6)).alias("kinds"))
    verdict = F.when(((F.col("kinds") >= 2) & (F.col("top") >= 0.03)) | ((F.col("kinds") >= 3) & (F.col("top") >= 0.02)), "agreement").when(F.col("top") >= 0.05, "continuity").when(F.col("kinds") >= 2, "weak_match").otherwise("too_few_kinds")
    return f.select("source", F.round("top_mass", 6).alias("top_mass"), "kinds", verdict.alias("verdict"))


@query("with i as (select l_orderkey injection, l_linenumber - 1 pos, l_returnflag = 'R' used from lineitem) select injection, count(*) filter (where used) used_count, coalesce(bool_or(used and pos < 3), false) as label from i group by 1")
def injection_labels(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("injection"), (F.col("l_linenumber") - 1).alias("pos"), (F.col("l_returnflag") == "R").alias("used"))
    return learn.labelled(i)


@query('with r as (select quality = 1 as "label" from labels order by doc_id desc limit 100) select count(*) labelled, count(*) filter (where "label") used, round(avg("label"::int::double), 6) as "precision" from r')
def self_check(spark, d):
    return learn.recent_precision(table(spark, d, "labels").select(F.col("doc_id").alias("at"), F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("label")))


@query("select source, count(*) given, sum(quality)::bigint used, round(avg(quality), 6) as share from labels join documents using (doc_id) group by 1")
def delivered_precision(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("given"), F.sum("quality").alias("used"), F.round(F.avg("quality"), 6).alias("share"))


@query("""with s as (select n_chars score, quality = 1 as y from labels join documents using (doc_id)), b as (select score, count(*) filter (where y) p, count(*) filter (where not y) n from s group by 1),
c as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) below from b)
select round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) auc, sum(p)::bigint positives, sum(n)::bigint negatives from c""")
def auc(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return learn.auc(s.select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("label")))


@query()
def logistic_fit(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select((F.log1p("n_chars") / 10).alias("x1"), (F.col("lang") == "en").cast("double").alias("x2"), F.col("quality").alias("y")).persist()
    w = learn.logistic_fit(s, ["x1", "x2"], "y")
    s.unpersist()
    return spark.createDataFrame([(k, round(v, 4)) for k, v in enumerate(w)], "k int, coefficient double")


@query("with a as (select *, ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 1000000 < 100000 as h from orders) select h as held_out, count(*) tasks, count(*) filter (where o_orderstatus = 'F') done, round(median(o_totalprice), 2) cost from a group by 1")
def holdout_compare(spark, d):
    from workmap.functions.scalar import held_out

    o = table(spark, d, "orders").withColumn("held_out", held_out(F.col("o_orderkey"), 0.1))
    return o.groupBy("held_out").agg(F.count("*").alias("tasks"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.round(F.median("o_totalprice"), 2).alias("cost"))


@query()
def bootstrap_interval(spark, d):
    v = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("value"))
    return learn.bootstrap_mean(v)
