"""A kept inverted index: postings in blocks by term, a forward table by document, and generations that are merged on read.

A folder holds generations. Each insert is one: its documents replace those of the same ids in older generations; each delete is a
generation of ids alone. Nothing written is changed, so a question reads what was there when it was asked. `compact` writes
one generation of what is live. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from workmap.functions.scalar import idf_coverage, idf_ranking
from workmap.operators.scratch import parts_for, written
from workmap.operators.search import K1, B, term_counts

#: Postings of a block; levels of a posting's part of the score, so that a block's postings score alike; postings of a term that meet in one row.
BLOCK, LEVELS, GATHERED = 256, 8, 1 << 16
#: Postings that a task holds at once.
PART_POSTINGS = 2_000_000


def _part(tf: Column, length: Column, mean: Column) -> Column:
    """What of a term's weight a document with it scores."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class SearchIndex:
    """The index in a folder; `tokens` gives the words of a text, repeats and all."""

    def __init__(self, spark: SparkSession, path: str, tokens):
        self.spark, self.path, self.tokens = spark, path.rstrip("/"), tokens

    # ------------------------------------------------------------ upkeep
    def _has(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str) -> DataFrame:
        """Rows of all generations."""
        return self.spark.read.parquet(f"{self.path}/{name}/*")

    def _write(self, df: DataFrame, name: str, generation: int) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}/g{generation}")

    def _generation(self) -> int:
        return 1 + (self._read("counts").agg(F.max("generation")).first()[0] if self._has("counts") else 0)

    def _forward(self) -> DataFrame:
        return self._read("forward")

    def _gone(self) -> DataFrame | None:
        """(doc, gone): the last generation that replaced or deleted a document; none if no generation did."""
        if not self._has("gone"):
            return None
        return self._read("gone").groupBy("doc").agg(F.max("generation").alias("gone"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows(generation, doc, ...) that no later generation replaced or deleted."""
        gone = self._gone()
        return rows if gone is None else rows.join(gone, "doc", "left").where("gone is null or gone <= generation").drop("gone")

    def _bury(self, ids: DataFrame, generation: int) -> None:
        """Notes ids(doc) as replaced or deleted, where they are live, and takes them off the counts."""
        if not self._has("forward"):
            return
        old = self._live(self._forward().select("generation", "doc", "length")).join(ids.select("doc").distinct(), "doc", "left_semi")
        old = old.select("doc", "length").withColumn("generation", F.lit(generation).cast("long"))
        self._write(old, "gone", generation)
        buried = self.spark.read.parquet(f"{self.path}/gone/g{generation}")
        self._write(buried.agg(F.lit(generation).cast("long").alias("generation"), (-F.count("*")).alias("rows"), (-F.coalesce(F.sum("length"), F.lit(0))).cast("long").alias("words")), "counts", generation)

    def insert(self, docs: DataFrame, ident: str, text: str) -> None:
        """Documents that are new or take the place of those with their ids. Ids are unique; null texts have no words."""
        g = self._generation()
        rows = docs.select(F.col(ident).cast("long").alias("doc"), F.col(text).alias("text"))
        counts = term_counts(rows.withColumn("text", F.coalesce("text", F.lit(""))), "doc", self.tokens(F.col("text")), gathered=True)
        self._bury(rows.select("doc"), g)
        self._write(counts.select(F.lit(g).cast("long").alias("generation"), "doc", "length", F.transform("runs", lambda r: r["term"]).alias("terms"), F.transform("runs", lambda r: r["tf"].cast("int")).alias("tfs")), "forward", g)
        new = self.spark.read.parquet(f"{self.path}/forward/g{g}")
        totals = new.agg(F.lit(g).cast("long").alias("generation"), F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("words"))
        self._write(totals, "counts", g)
        self._write(self._blocks(new), "blocks", g)

    def _blocks(self, forward: DataFrame) -> DataFrame:
        """Postings in blocks of one term and level, some BLOCK of them: what a block's best and least score, at any mean length, follows from its ends.

        Postings are dealt once. Terms of more than GATHERED are dealt by document, too, so no term meets in one task; there
        are so few of them that each task knows them.
        """
        mean = forward.agg(F.greatest(F.avg("length"), F.lit(1.0)).alias("mean"))
        post = forward.select("generation", "doc", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("generation", "doc", "length", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).crossJoin(F.broadcast(mean))
        parts = parts_for(self.spark, int(forward.agg(F.sum(F.size("terms"))).first()[0] or 0), PART_POSTINGS)
        level = F.floor(_part(F.col("tf"), F.col("length"), F.col("mean")) / (K1 + 1) * LEVELS).cast("int")
        often = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > GATHERED)
        salt = F.coalesce(F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / GATHERED)), F.lit(0)).cast("int")
        dealt = post.join(F.broadcast(often), "term", "left").select("generation", "term", salt.alias("salt"), level.alias("level"), "doc", "tf", "length").repartition(parts, "term", "salt")
        met = dealt.groupBy("generation", "term", "salt", "level").agg(F.collect_list(F.struct("doc", "tf", "length")).alias("p"))
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / BLOCK).cast("int")), lambda i: F.slice("p", i * BLOCK + 1, F.lit(BLOCK)))
        ends = [of(F.col(f"postings.{c}")).alias(name) for name, of, c in (("most", F.array_max, "tf"), ("shortest", F.array_min, "length"), ("fewest", F.array_min, "tf"), ("longest", F.array_max, "length"))]
        return met.select("generation", "term", F.explode(cuts).alias("postings")).select("generation", "term", "postings", F.size("postings").alias("n"), *ends).sortWithinPartitions("term")

    def delete(self, ids: DataFrame, ident: str) -> None:
        """Documents go; ids that aren't there change nothing."""
        self._bury(ids.select(F.col(ident).cast("long").alias("doc")), self._generation())

    def compacted(self, path: str) -> SearchIndex:
        """An index of one generation in another folder, of what is live here."""
        new = SearchIndex(self.spark, path, self.tokens)
        live = self._live(self._forward()).withColumn("generation", F.lit(1).cast("long"))
        new._write(live, "forward", 1)
        forward = new.spark.read.parquet(f"{new.path}/forward/g1")
        new._write(forward.agg(F.lit(1).cast("long").alias("generation"), F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("words")), "counts", 1)
        new._write(new._blocks(forward), "blocks", 1)
        return new

    # ------------------------------------------------------------ questions
    def stats(self) -> DataFrame:
        """One row: rows, and their mean length; from the counts of each generation."""
        n = self._read("counts").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))
        return n.select("rows", (F.col("words") / F.greatest(F.col("rows"), F.lit(1))).alias("mean_length"))

    def blocks(self, terms: DataFrame) -> DataFrame:
        """Blocks of the terms(term); the index stays where it is if Spark finds the terms small."""
        return self._read("blocks").join(terms.select("term").distinct(), "term", "left_semi")

    def opened(self, blocks: DataFrame) -> DataFrame:
        """Live postings (doc, term, tf, length) of blocks, with their other columns."""
        others = [c for c in blocks.columns if c not in ("postings", "n", "most", "shortest", "fewest", "longest", "term", "generation")]
        rows = blocks.select("generation", "term", *others, F.explode("postings").alias("p")).select("generation", "term", *others, "p.doc", "p.tf", "p.length")
        return self._live(rows).drop("generation")

    def holding(self, terms: DataFrame) -> DataFrame:
        """(term, df): how many live documents hold each term; from the blocks' sizes alone where nothing has gone."""
        found = self.blocks(terms)
        if self._gone() is None:
            return found.groupBy("term").agg(F.sum("n").cast("long").alias("df"))
        return self.opened(found).groupBy("term").agg(F.count("*").alias("df"))

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, doc, score, place): the k best documents of each query(query, term) by BM25, a disjunction; with `df`, how many hold a term is known already.

        A query's k-th best is at least what the least of k postings of one term score (more, if some may have gone): its bar. Terms
        that can't reach the bar together find no document alone: their postings count for documents that the others found only.
        Of the others, a block is opened only if its best, with the most that all other terms can add, reaches the bar.
        The terms and their bars are written, so that Spark knows how few they are and leaves the blocks where they are.
        """
        known = "df" in queries.columns
        asked = written(queries.select("query", "term", *(["df"] if known else [])).distinct())
        held = asked.select("term", "df").distinct() if known else self.holding(asked)
        asked = asked.select("query", "term")
        mean, rows = F.greatest(F.col("mean_length"), F.lit(1e-9)), F.col("rows")
        idf = written(held.crossJoin(F.broadcast(self.stats())).select("term", "mean_length", idf_ranking(rows, F.col("df")).alias("idf")))
        found = self._read("blocks").join(idf, "term")
        found = found.withColumn("best", F.col("idf") * _part(F.col("most"), F.col("shortest"), mean)).withColumn("least", F.col("idf") * _part(F.col("fewest"), F.col("longest"), mean))
        gone = self._gone()
        spare = 0 if gone is None else gone.count()
        order = Window.partitionBy("term").orderBy(F.desc("least"))
        sure = found.select("term", "best", "least", F.sum("n").over(order).alias("n"))
        ends = sure.groupBy("term").agg(F.max("best").alias("most_"), F.coalesce(F.max(F.when(F.col("n") >= k + spare, F.col("least"))), F.lit(0.0)).alias("sure"))
        bars = asked.join(ends, "term").withColumn("bar", F.max("sure").over(Window.partitionBy("query")) - 2e-6)  # scores are compared to six places
        up = F.sum("most_").over(Window.partitionBy("query").orderBy("most_", "term"))
        bars = bars.withColumn("finds", up >= F.col("bar")).withColumn("needed", F.col("bar") - F.sum("most_").over(Window.partitionBy("query")) + F.col("most_"))
        bars = written(bars.select("query", "term", "finds", "needed"))
        open_ = found.join(bars, "term").where(~F.col("finds") | (F.col("best") >= F.col("needed")))
        part = (F.col("idf") * _part(F.col("tf"), F.col("length"), mean)).alias("s")
        kept = ["query", "generation", "term", "postings", "idf", "mean_length"]
        first = self.opened(open_.where("finds").select(*kept)).select("query", "doc", part, F.lit(True).alias("finds"))
        more = self.opened(open_.where("not finds").select(*kept)).select("query", "doc", part, F.lit(False).alias("finds"))
        each = first.unionByName(more).groupBy("query", "doc").agg(F.round(F.sum("s"), 6).alias("score"), F.bool_or("finds").alias("finds"))
        scored = each.where("finds").drop("finds")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)

    def weights(self, queries: DataFrame, floor_share: float = 0.01) -> DataFrame:
        """(query, term, df, idf, whole): the words that any document holds, and the weight that covers a query."""
        asked = queries.select("query", "term").distinct()
        rows = F.col("rows")
        known = asked.join(self.holding(asked), "term").crossJoin(F.broadcast(self.stats())).withColumn("idf", idf_coverage(rows, F.col("df")))
        floor = 2.0 * idf_coverage(rows, F.greatest(F.ceil(rows * floor_share), F.lit(1)))
        whole = known.groupBy("query").agg(F.greatest(F.sum("idf"), F.max(floor)).alias("whole"))
        return known.join(whole, "query").select("query", "term", "df", "idf", "whole")

    def coverage(self, queries: DataFrame, least: float, floor_share: float = 0.01) -> DataFrame:
        """(query, doc, coverage): documents that hold at least the part `least` of a query's weight in words.

        A query's commonest words, of a quarter of what is needed at most, are left out at first: documents whose other words don't
        come to the bar with all of them drop out before the few that are left are looked up in the forward table.
        """
        known = self.weights(queries, floor_share)
        bar = (least - 1e-6) * F.col("whole")
        running = F.sum("idf").over(Window.partitionBy("query").orderBy(F.desc("df"), "term"))  # from the commonest on
        ranked = known.withColumn("common", running < bar / 4)
        ranked = ranked.withColumn("missing", bar - F.coalesce(F.sum(F.when(F.col("common"), F.col("idf"))).over(Window.partitionBy("query")), F.lit(0.0)))
        first = ranked.where("not common").select("query", "term", "idf", "missing")
        held = self.opened(self.blocks(first)).join(first, "term").groupBy("query", "doc").agg(F.sum("idf").alias("has"), F.first("missing").alias("missing"))
        return self.covered(held.where("has >= missing").select("query", "doc"), known).where(F.col("coverage") >= least)

    def covered(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """(query, doc, coverage) of pairs(query, doc), from the forward table; known as `weights` gives it."""
        words = known.groupBy("query").agg(F.collect_list(F.struct("term", "idf")).alias("words"), F.first("whole").alias("whole"))
        met = pairs.join(self._live(self._forward().select("generation", "doc", "terms")), "doc").join(words, "query")
        matched = F.aggregate(F.filter("words", lambda w: F.array_contains("terms", w["term"])), F.lit(0.0), lambda a, w: a + w["idf"])
        return met.select("query", "doc", F.round(F.least(matched / F.col("whole"), F.lit(1.0)), 6).alias("coverage"))
