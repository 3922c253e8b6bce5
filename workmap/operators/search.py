"""Full-text search: postings, document frequencies, BM25 and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.functions.scalar import idf_coverage, idf_ranking, identifier_tokens

K1, B = 1.2, 0.75


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all cores by a key, if the files they come from have fewer pieces than there are cores (a file of one row group is one task); else as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def term_counts(docs: DataFrame, ident: str, tokens: Column, gathered: bool = False) -> DataFrame:
    """(doc, term, tf, length) of rows whose `ident` is unique: terms are counted inside their row, so nothing is shuffled. gathered: a row a document, with `runs` of (term, tf)."""
    rows = docs.select(F.col(ident).alias("doc"), F.sort_array(tokens).alias("t")).withColumn("length", F.size("t"))
    # in a sorted list a term's run begins where it differs from the one before; its length is the distance to the next beginning
    begins = F.filter(F.sequence(F.lit(0), F.greatest(F.col("length"), F.lit(1)) - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.withColumn("b", begins)
    ends = F.concat(F.slice("b", 2, F.size("b")), F.array(F.col("length")))
    runs = F.filter(F.zip_with("b", ends, lambda b, e: F.struct(F.get("t", b).alias("term"), (e - b).cast("long").alias("tf"))), lambda r: r["tf"] > 0)
    if gathered:
        return rows.select("doc", "length", runs.alias("runs"))
    return rows.select("doc", "length", F.explode(runs).alias("r")).select("doc", "r.term", "r.tf", "length")


def postings(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc, term, tf, length) of the identifier words of a text."""
    return term_counts(docs, ident, identifier_tokens(F.col(text)))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def text_stats(post: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: rows and their mean length; documents without terms count as rows of no length."""
    lengths = post.select("doc", "length").distinct().agg(F.sum("length").alias("all"))
    return docs.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(lengths)).select("rows", (F.coalesce("all", F.lit(0)) / F.col("rows")).alias("mean_length"))


def rare_terms(post: DataFrame, queries: DataFrame, stats: DataFrame, share: float = 0.05, least: int = 20, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """(query, term, k): of each query(query, term) the rarest terms that at most a share of the rows have, or `least`; and stats."""
    bar = stats.select(F.greatest(F.ceil(F.col("rows") * share), F.lit(least)).alias("bar"))
    held = post.join(queries.select("term").distinct(), "term", "left_semi")
    rare = queries.select("query", "term").join(document_frequency(held), "term").crossJoin(F.broadcast(bar)).where("df <= bar")
    return rare.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("df", "term"))).where(F.col("k") <= most).select("query", "term", "k"), stats


def scores(post: DataFrame, queries: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, doc, score) by BM25 of a disjunction; and (query, term, idf) of the terms that any document has."""
    terms = queries.select("query", "term").distinct()
    held = post.join(terms.select("term").distinct(), "term", "left_semi")
    df = document_frequency(held)
    known = terms.join(df, "term").crossJoin(F.broadcast(stats)).select("query", "term", idf_ranking(F.col("rows"), F.col("df")).alias("idf"))
    weight = held.join(df, "term").crossJoin(F.broadcast(stats))
    score = idf_ranking(F.col("rows"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return weight.select("doc", "term", score.alias("s")).join(terms, "term").groupBy("query", "doc").agg(F.sum("s").alias("score")), known


def bm25(post: DataFrame, queries: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query(query, term), a disjunction; stats has one row: rows, mean_length."""
    scored = scores(post, queries, stats)[0].withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def over_most(post: DataFrame, queries: DataFrame, stats: DataFrame, k: int, floor_share: float = 0.01) -> DataFrame:
    """The k best documents of each query with their score over the whole weight of the query's known words, or of two rare ones, at most 1."""
    scored, known = scores(post, queries, stats)
    rare = stats.select((2.0 * idf_ranking(F.col("rows"), F.ceil(F.col("rows") * floor_share))).alias("floor"))
    whole = known.groupBy("query").agg(F.sum("idf").alias("all")).crossJoin(F.broadcast(rare)).select("query", F.greatest("all", "floor").alias("whole"))
    share = scored.join(whole, "query").withColumn("share", F.col("score") / F.col("whole"))
    best = Window.partitionBy("query").orderBy(F.desc(F.round("share", 9)), "doc")
    return share.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query", "doc", F.round(F.least("share", F.lit(1.0)), 6).alias("score"))


def coverage(post: DataFrame, queries: DataFrame, stats: DataFrame, floor_share: float = 0.01) -> DataFrame:
    """How much of a query's weight in words a document holds, over the whole or a floor of two rare words; stats has one row."""
    terms = queries.select("query", "term").distinct()
    df = document_frequency(post.join(terms.select("term").distinct(), "term", "left_semi"))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", idf_coverage(F.col("rows"), F.col("df")))
    floor = 2.0 * idf_coverage(F.col("rows"), F.greatest(F.ceil(F.col("rows") * floor_share), F.lit(1)))
    whole = weighed.groupBy("query").agg(F.greatest(F.sum("idf"), F.max(floor)).alias("whole"))
    matched = post.join(weighed.select("query", "term", "idf"), "term").groupBy("query", "doc").agg(F.sum("idf").alias("matched"))
    return matched.join(whole, "query").select("query", "doc", F.round(F.least(F.col("matched") / F.col("whole"), F.lit(1.0)), 6).alias("coverage"))
