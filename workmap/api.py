"""What a user asks, as functions that give DataFrames, and views for ad-hoc SQL.

    m = Workmap(spark, "/tables")
    m.where("how are orders priced").show()
    m.views(); spark.sql("select * from files where lang = 'rust'")

Answers come from the same plans that the registered queries run, over one folder of tables.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import workmap
from workmap.functions.scalar import identifier_tokens
from workmap.operators import advice, learn, search
from workmap.operators import receipts as C
from workmap.operators import retrieval as R
from workmap.plans import advice as advice_plans
from workmap.plans import learning, receipts, reports
from workmap.plans.adapters import table
from workmap.plans.relations import _DERIVED, _RELATIONS, Relations
from workmap.plans.retrieval import Stages
from workmap.sources import payloads


class Workmap:
    """Questions to one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.relations = Relations(spark, folder)

    def install(self) -> None:
        """Sends the package to executors that don't have it."""
        root = os.path.dirname(os.path.dirname(os.path.abspath(workmap.__file__)))
        self.spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "workmap"), "zip", root, "workmap"))

    def views(self) -> list[str]:
        """Temporary views of all relations, by their names with `map_` before; returns the names."""
        names = [*_RELATIONS, *_DERIVED]
        for n in names:
            getattr(self.relations, n).createOrReplaceTempView(f"map_{n}")
        return [f"map_{n}" for n in names]

    def _asked(self, question: str) -> Stages:
        s = Stages(self.relations)
        s.questions = self.spark.createDataFrame([(0, question)], "query long, text string")
        return s

    def where(self, question: str, gated: bool = True) -> DataFrame:
        """(file, reason, place): the files that a question is about; none where the gate is shut and `gated`."""
        s = self._asked(question)
        listed = s.listed
        if gated:
            listed = listed.join(R.decided(s.features).where("verdict in ('agreement', 'continuity', 'calibrated')").select("query"), "query", "left_semi")
        return listed.select("file", "reason", "place").orderBy("place")

    def why(self, target: str) -> DataFrame:
        """(what, id, n) of a file by its path: sessions that changed it, facts, warnings."""
        file = self.relations.files.where(F.col("path") == target).select(F.col("file_id").alias("node_id"))
        s = self.relations.acts.where("kind = 'edit'").join(file, "node_id", "left_semi").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n")).select(F.lit("session").alias("what"), "id", "n")
        f = self.relations.anchors.join(file, "node_id", "left_semi").groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("n")).select(F.lit("fact").alias("what"), "id", "n")
        w = self.relations.warnings.join(file.withColumnRenamed("node_id", "dst_node"), "dst_node", "left_semi").groupBy(F.col("kind").alias("k")).agg(F.count("*").alias("n")).select(F.concat(F.lit("warning "), "k").alias("what"), F.lit(None).cast("long").alias("id"), "n")
        return s.unionByName(f).unionByName(w).orderBy("what", F.desc("n"), "id")

    def next_file(self, node: int, least: float = 2.0, majority: float = 0.5) -> DataFrame:
        """(src, dst, weight): where work went on from a file, if it mostly went to one."""
        return learn.next_file(self.relations.ways.where(F.col("src") == node).select("src", "dst", "weight"), least, majority)

    def receipts(self, since_ms: int = 0) -> DataFrame:
        """Tokens of each task by kind, of responses since a time."""
        return C.tallied(receipts._held(self.relations).where(F.col("ts") >= since_ms), ["task"])

    def summary(self) -> DataFrame:
        return reports.map_summary(self.relations)

    def search(self, text: str, most: int = 40) -> DataFrame:
        """(doc, score) of documents that have any of a text's words, best first."""
        docs = table(self.spark, self.folder, "documents")
        post = search.postings(docs, "doc_id", "text")
        asked = self.spark.createDataFrame([(text,)], "text string").select(F.lit(0).alias("query"), F.explode(identifier_tokens(F.col("text"))).alias("term")).distinct()
        return search.bm25(post, asked, search.text_stats(post, docs), most).select("doc", "score", "place").orderBy("place")

    def warnings(self, edit: int) -> DataFrame:
        """(kind, target, place): what is told after an edit, by its number in the log."""
        r = self.relations
        every = advice_plans._cochange(r).unionByName(advice_plans._call_sites(r)).unionByName(advice_plans._tests(r)).unionByName(advice_plans._origins(r).drop("oid"))
        return advice.told(every.where(F.col("edit") == edit)).select("kind", "target", "place")

    def facts(self, status: str = "approved") -> DataFrame:
        return self.relations.facts.where((F.col("status") == status) & F.col("superseded_by").isNull()).select("fact_id", "claim")

    def handoffs(self) -> DataFrame:
        return learning.handoffs_left(self.relations)

    @staticmethod
    def events(lines: DataFrame, value: str = "value") -> DataFrame:
        """Hook payloads as events."""
        return payloads.events(lines, value)
