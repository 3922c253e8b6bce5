"""Search over texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from workmap.functions.scalar import collapsed_hash, count_lines, estimate_tokens, identifier_tokens, jaccard
from workmap.operators import search
from workmap.operators.scratch import scratch_dir, written
from workmap.operators.search_index import SearchIndex
from workmap.plans.adapters import table
from workmap.plans.registry import query

_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
POSTINGS = f"""
tk as (select doc_id doc, {_TOKENS.format("text")} t from documents),
po as (select doc, term, count(*) tf, any_value(n) length from (select doc, len(t) n, unnest(t) term from tk) group by 1, 2),
st as (select count(*) n_rows, avg(len(t)) mean_length from tk),
qt as (select distinct item_id query, term from (select item_id, unnest({_TOKENS.format("text")}) term from benchmark)),
df as (select term, count(*) df from po group by 1)
"""


def _documents(spark, d):
    return search.spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(identifier_tokens(F.col("text"))).alias("term")).distinct()


def document_index(spark, d):
    index = SearchIndex(spark, f"{scratch_dir(spark)}/index/{uuid.uuid4().hex}", identifier_tokens)
    index.insert(_documents(spark, d), "doc_id", "text")
    return index


def looked_up(index, queries):
    """The rarest words of each question, 24 at most, in at most 5 % of the documents, or 20."""
    bar = index.stats().select(F.greatest(F.ceil(F.col("rows") * 0.05), F.lit(20)).alias("bar"))
    queries = written(queries)  # read by both sides, and small
    rare = queries.join(index.holding(queries), "term").crossJoin(F.broadcast(bar)).where("df <= bar")
    return rare.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("df", "term"))).where("k <= 24").select("query", "term", "df", "k")


@query(f"with {POSTINGS} select term, df from df")
def token_df(spark, d):
    """Each document's distinct words, counted: one partial aggregate and one shuffle."""
    terms = _documents(spark, d).select(F.explode(F.array_distinct(identifier_tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


@query(f"""with {POSTINGS}, rare as (select query, term, df, row_number() over (partition by query order by df, term) k from qt join df using (term) where df <= (select greatest(ceil(n_rows * 0.05), 20) from st) qualify k <= 24),
s as (select query, doc, round(sum(greatest(ln((n_rows - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) score from rare join po using (term), st group by 1, 2)
select query, doc, score, row_number() over (partition by query order by score desc, doc)::int place from s qualify place <= 50""")
def bm25_top(spark, d):
    """The best documents of each item by its rarest words; words in over 5 % of the documents (and over 20) are not looked up."""
    index = document_index(spark, d)
    return index.top(looked_up(index, _queries(spark, d)), 50)


@query(f"""with {POSTINGS}, i as (select query, term, ln(1 + (n_rows - df + 0.5) / (df + 0.5)) idf from qt join df using (term), st),
w as (select query, greatest(sum(idf), 2 * (select ln(1 + (n_rows - ceil(n_rows * 0.01) + 0.5) / (ceil(n_rows * 0.01) + 0.5)) from st)) whole from i group by 1),
m as (select query, doc, sum(idf) matched from po join i using (term) group by 1, 2)
select query, doc, round(least(matched / whole, 1.0), 6) coverage from m join w using (query) where round(least(matched / whole, 1.0), 6) >= 0.4""")
def lexical_coverage(spark, d):
    return document_index(spark, d).coverage(_queries(spark, d), 0.4)


_UPKEEP = f"""{POSTINGS.strip().replace("from documents)", "from (select doc_id + case when doc_id % 7 = 0 then 10000000 else 0 end doc_id, case when doc_id % 5 = 0 then text || ' renewed ' || source else text end text from documents where doc_id % 3 <> 0 or doc_id % 5 = 0))", 1)},
rare as (select query, term, df, row_number() over (partition by query order by df, term) k from qt join df using (term) where df <= (select greatest(ceil(n_rows * 0.05), 20) from st) qualify k <= 24),
s as (select query, doc, round(sum(greatest(ln((n_rows - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) score from rare join po using (term), st group by 1, 2)"""


def _kept_up(spark, d):
    """The index after upkeep: a third of the documents deleted, a seventh under new ids, a fifth with new texts, also of those deleted."""
    index = document_index(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    moved = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id"))
    index.delete(docs.where("doc_id % 3 = 0"), "doc_id")
    index.insert(docs.where("doc_id % 7 = 0 and doc_id % 3 <> 0").withColumn("doc_id", F.col("doc_id") + 10_000_000), "doc_id", "text")
    index.delete(docs.where("doc_id % 7 = 0"), "doc_id")
    index.insert(docs.where("doc_id % 5 = 0").select(moved.alias("doc_id"), F.concat("text", F.lit(" renewed "), "source").alias("text")), "doc_id", "text")
    return index


@query(f"with {_UPKEEP} select query, doc, score, row_number() over (partition by query order by score desc, doc)::int place from s qualify place <= 50")
def search_after_upkeep(spark, d):
    """Questions to an index that documents were put in and taken out of: each sees all generations."""
    index = _kept_up(spark, d)
    return index.top(looked_up(index, _queries(spark, d)), 50)


@query(f"with {_UPKEEP} select query, doc, score, row_number() over (partition by query order by score desc, doc)::int place from s qualify place <= 50")
def search_after_compaction(spark, d):
    """The same from one generation that holds what is live."""
    index = _kept_up(spark, d).compacted(f"{scratch_dir(spark)}/index/{uuid.uuid4().hex}")
    return index.top(looked_up(index, _queries(spark, d)), 50)


@query("""with w as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) w from conversations),
p as (select a.conv_id, a.turn, a.w x, b.w y from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) share from p where len(x) + len(y) > 0""")
def jaccard_similar(spark, d):
    """Shared words of consecutive turns."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    t = table(spark, d, "conversations").select("conv_id", "turn", words.alias("w"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(nxt, ["conv_id", "turn"]).where(F.size("w") + F.size("v") > 0).select("conv_id", "turn", F.round(jaccard(F.col("w"), F.col("v")), 6).alias("share"))


@query(f"select page_id, array_to_string({_TOKENS.format('url')}, ' ') tokens from pages")
def identifier_words(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(identifier_tokens(F.col("url")), " ").alias("tokens"))


@query("""select conv_id, turn, ceil(strlen(text) / 4)::bigint tokens, (len(string_split(text, chr(10))) - ends_with(text, chr(10))::int)::int n_lines,
substr(sha256(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), 1, 32) hash from conversations where text <> ''""")
def text_measures(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").where(t != "").select("conv_id", "turn", estimate_tokens(t).alias("tokens"), count_lines(t).alias("n_lines"), collapsed_hash(t).alias("hash"))


@query("""with w as (select item_id, unnest(x) word, unnest(range(1, len(x) + 1)) pos from (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') x from benchmark)),
c as (select item_id, word, count(*) n, min(pos) pos from w group by 1, 2),
k as (select *, row_number() over (partition by item_id order by n desc, pos) k from c qualify k <= 12)
select item_id, string_agg(word, ' ' order by pos) words from k group by 1""")
def frequent_words(spark, d):
    """The most frequent words of a prompt, in the order in which they first stand."""
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("pos", "word"))
    c = w.groupBy("item_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    k = c.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "pos"))).where("k <= 12")
    return k.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("words"))
