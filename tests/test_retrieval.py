"""The gate case by case, spans in order, names by suffix, walks through re-exports, causes and intervals."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from workmap.operators import advice, learning, receipts
from workmap.operators import resolution as N
from workmap.operators import retrieval as R
from workmap.plans import QUERIES


def features(**given):
    return {"query": 1, "top_lexical": 0.0, "top_mass": 0.0, "agreeing_kinds": 0, "supporting_kinds": 0, "is_continuing": False, "history_alone": False} | given


@pytest.mark.parametrize(
    ("given", "raised", "verdict"),
    [
        ({"agreeing_kinds": 2, "top_lexical": 0.5}, 0.0, "agreement"),
        ({"agreeing_kinds": 2, "top_lexical": 0.499}, 0.0, "weak_match"),
        ({"agreeing_kinds": 2, "top_lexical": 0.55}, 0.1, "weak_match"),
        ({"agreeing_kinds": 3, "top_lexical": 0.1}, 0.0, "agreement"),
        ({"agreeing_kinds": 3, "top_lexical": 0.0}, -0.5, "weak_match"),
        ({"agreeing_kinds": 1, "top_lexical": 1.0}, 0.0, "too_few_kinds"),
        ({"is_continuing": True}, 0.0, "continuity"),
        ({"is_continuing": True}, 0.1, "too_few_kinds"),
        ({"history_alone": True, "agreeing_kinds": 3, "top_lexical": 0.9}, 0.0, "too_few_kinds"),
    ],
)
def test_gate(spark, given, raised, verdict):
    df = spark.createDataFrame([features(**given)])
    assert R.decided(df, raised).first().verdict == verdict


def test_a_model_decides_alone(spark):
    df = spark.createDataFrame([features(agreeing_kinds=2, top_lexical=0.9) | {"probability": p, "bar": b} for p, b in ((0.1, 0.7), (0.7, 0.7))])
    assert sorted(r.verdict for r in R.decided(df).collect()) == ["calibrated", "unlikely"]
    bars = spark.createDataFrame([(0.7, "small", 0.0), (0.7, "medium", 0.5), (0.95, "medium", 0.2), (0.7, "huge", -1.0)], "least double, mode string, raised double")
    assert [r[0] for r in bars.select(F.round(R.confidence_bar(F.col("least"), F.col("mode"), F.col("raised")), 3)).collect()] == [0.85, 0.9, 0.95, 0.7]


def test_spans_join_and_keep_the_cap(spark):
    rows = [(1, 1, 10, 1, 20, 10, 0.9), (1, 1, 11, 21, 30, 25, 0.8), (1, 1, 12, 200, 400, 300, 0.7), (1, 1, 13, 500, 510, 505, 0.6), (1, 2, 14, 1, 5, 3, 0.0)]
    df = spark.createDataFrame(rows, "query int, file int, symbol int, body_first int, body_last int, centre int, strength double")
    assert sorted((r.file, r.first, r.last) for r in R.spans(df).collect()) == [(1, 1, 30), (1, 270, 329)]
    reads = spark.createDataFrame([(1, 1, "h", 1, 30), (1, 1, "old", None, None)], "query int, file int, content string, lo int, hi int")
    shown = R.spans(df).withColumn("content", F.lit("h"))
    assert [(r.first, r.last) for r in R.in_context(shown, reads).collect()] == [(1, 30)]


def test_names_by_suffix(spark):
    files = spark.createDataFrame([(1, "a/b.rs"), (2, "c/b.rs"), (3, "c/d.rs")], "file int, path string")
    m = spark.createDataFrame([(1, "a/b.rs"), (2, "b.rs"), (3, "d.rs"), (4, "repo/c/d.rs"), (5, "e.rs")], "query int, mention string")
    assert sorted((r.query, r.file) for r in R.named_file(m, files).collect()) == [(1, 1), (3, 3), (4, 3)]


def test_tiers_of_resolution(spark):
    refs = spark.createDataFrame([(1, 1, "f", "x"), (2, 1, "f", "y"), (3, 1, "f", "z"), (4, 2, "f", "x"), (5, 1, "f", "w")], "ref int, file int, family string, name string")
    names = spark.createDataFrame([(10, 1, "f", "x"), (11, 3, "f", "y"), (12, 1, "f", "z"), (13, 1, "f", "z"), (14, 9, "g", "w"), (15, 5, "f", "y")], "symbol int, file int, family string, name string")
    precise = spark.createDataFrame([(4, 99)], "ref int, symbol int")
    imports = spark.createDataFrame([(1, 3)], "file int, imported int")
    got = {r.ref: (r.symbol, r.resolution) for r in N.resolved(refs, names, precise, imports).collect()}
    assert got == {1: (10, "same_file"), 2: (11, "import_path"), 3: (None, None), 4: (99, "scip"), 5: (None, None)}


def test_re_exports_to_depth_four(spark):
    passes = spark.createDataFrame([(k, "n", k + 1, "n") for k in range(8)], "file int, name string, next int, taken string")
    names = spark.createDataFrame([(4, "n", 40)], "file int, name string, symbol int")
    got = {r.file: r.depth for r in N.searched(passes.select("file", "name"), passes, names).collect()}
    assert got == {0: 4, 1: 3, 2: 2, 3: 1, 4: 0}
    assert N.reachable(spark.createDataFrame([(0,)], "file int"), passes.select("file", "next")).agg(F.max("depth")).first()[0] == 4


def test_own_tests(spark):
    pairs = [("tests/test_orders.py", "src/orders.py"), ("pkg/orders_test.go", "pkg/orders.go"), ("src/orders.spec.ts", "src/orders.ts"), ("t/OrdersTest.java", "m/Orders.java"), ("spec/orders_spec.rb", "lib/orders.rb")]
    others = [("tests/test_other.py", "src/orders.py"), ("test_.py", "src/orders.py")]
    df = spark.createDataFrame([(*p, True) for p in pairs] + [(*p, False) for p in others], "test string, edited string, own boolean")
    assert df.where(N.is_own_test(F.col("test"), F.col("edited")) != F.col("own")).count() == 0


def test_redundant_runs_and_warnings_told(spark):
    runs = spark.createDataFrame([(1, 1, 10, "t"), (1, 2, 20, "t"), (1, 4, 40, "t")], "session int, seq int, ts int, command string")
    edits = spark.createDataFrame([(1, 3, 30)], "session int, seq int, ts int")
    assert [(r.seq, r.last_seq) for r in advice.redundant_runs(runs, edits).collect()] == [(2, 1)]
    w = spark.createDataFrame([(1, 1, k, t, s) for k, t, s in (("origin", 1, 1.0), ("test", 2, 0.5), ("cochange", 3, 0.5), ("cochange", 4, 0.9))], "edit int, task int, kind string, target int, strength double")
    assert [(r.kind, r.target) for r in advice.told(w).orderBy("place").collect()] == [("cochange", 4), ("cochange", 3), ("test", 2)]


def test_cache_breaks_and_held_tasks(spark):
    calls = spark.createDataFrame([(1, 1, 0, "m", 10, 10, 100), (1, 2, 1_000_000, "m", 90, 90, 1), (1, 3, 1_000_100, "k", 90, 90, 0), (2, 1, 0, "m", 5, 0, 50), (2, 2, 400_000, "m", 90, None, 1)], "session int, turn int, ts long, model string, cache_write int, cache_write_1h int, cache_read int")
    none = spark.createDataFrame([], "session int, at long")
    texts = spark.createDataFrame([(1, 500_000)], "session int, at long")
    assert sorted((r.session, r.turn, r.cause) for r in receipts.cache_breaks(calls, none, texts).collect()) == [(1, 2, "hook_text"), (1, 3, "model_switch"), (2, 2, "idle_gap")]
    tasks = spark.createDataFrame([(1, 7, 100, 200), (1, 8, 300, None)], "session int, task int, started_at long, ended_at long")
    usage = spark.createDataFrame([(1, 50), (1, 200), (1, 250), (1, 999)], "session int, ts long")
    assert {r.ts: r.task for r in receipts.held_by_task(usage, tasks).collect()} == {50: None, 200: 7, 250: None, 999: 8}


def test_facts_and_approaches(spark):
    stored = spark.createDataFrame([(1, [5], ["a", "b", "c", "d", "e"]), (2, [6], ["a", "b", "c", "d", "e"])], "id int, anchors array<int>, words array<string>")
    given = spark.createDataFrame([(9, [5], ["a", "b", "c", "d", "e"]), (10, [5], ["a", "x"])], "id int, anchors array<int>, words array<string>")
    assert {r.given: r.fact for r in learning.asserted(stored, given).collect()} == {9: 1, 10: None}
    runs = spark.createDataFrame([(1, 1, "s"), (1, 3, "s"), (1, 4, "s"), (1, 6, "t")], "task int, seq int, signature string")
    edits = spark.createDataFrame([(1, 2), (1, 5)], "task int, seq int")
    assert [(r.signature, r.runs) for r in learning.persisted_failures(runs, edits).collect()] == [("s", 2)]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables aren't here")
def test_a_question_sees_tables_as_they_are(spark, tmp_path):
    """Nothing is kept between calls: other questions and other documents give other answers."""
    for name in ("documents", "benchmark"):
        shutil.copytree(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet") if os.path.isdir(f"{SMALL}/{name}.parquet") else shutil.copy(f"{SMALL}/{name}.parquet", tmp_path)
    first = {r["query"] for r in QUERIES["lexical_seeds"](spark, str(tmp_path)).collect()}
    few = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(3).toPandas()
    few.to_parquet(tmp_path / "benchmark.parquet")
    again = QUERIES["lexical_seeds"](spark, str(tmp_path)).collect()
    assert len(first) > 3 and {r["query"] for r in again} <= set(few["item_id"]) and again
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    docs.assign(doc_id=docs["doc_id"] + 5000).to_parquet(tmp_path / "documents.parquet")
    assert {r["node"] for r in QUERIES["lexical_seeds"](spark, str(tmp_path)).collect()} == {r["node"] + 5000 for r in again}
