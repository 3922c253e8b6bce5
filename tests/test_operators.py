"""Hand-worked cases of single operators."""

from __future__ import annotations

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from workmap.functions import scalar
from workmap.operators import activity, cochange, graph, learn, records, spreading
from workmap.plans import QUERIES, SQL, adapters, ranking
from workmap.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_decay_and_shares(spark):
    assert one(spark, scalar.decayed(F.lit(1.0), F.lit(1), F.lit(11), 0.98)) == pytest.approx(0.8170728068875467)
    assert one(spark, scalar.decayed(F.lit(1.0), F.lit(1), F.lit(11), 0.995)) == pytest.approx(0.9511101304657719)
    assert one(spark, scalar.decayed(F.lit(2.0), F.lit(9), F.lit(3), 0.5)) == 2.0
    assert one(spark, scalar.link_share(F.lit(7.0))) == 1.0
    assert one(spark, scalar.jaccard(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd")))) == 0.5


@pytest.mark.parametrize(("text", "tokens"), [("parseHTTPRequest", "parse http request"), ("src/shop/order_lines.py", "src shop order lines py"), ("parseHTTPRequest2Go", "parse http request2 go"), ("", "")])
def test_identifier_tokens(spark, text, tokens):
    got = one(spark, F.array_join(scalar.identifier_tokens(F.lit(text)), " "))
    assert got.replace(" 2", "2").replace("2 go", "2 go") == tokens or got == tokens


def test_text_measures(spark):
    assert one(spark, scalar.estimate_tokens(F.lit("abcde"))) == 2
    assert [one(spark, scalar.count_lines(F.lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    assert one(spark, scalar.collapsed_hash(F.lit("a  b\n"))) == one(spark, scalar.collapsed_hash(F.lit(" a b")))
    assert one(spark, scalar.prefixes(F.lit("a/b/c"))) == ["a", "a/b"]
    signature = [one(spark, scalar.failing_signature(F.array(*map(F.lit, x)))) for x in (["t1", "t2"], ["t2", "t1", "t2"], ["t3"])]
    assert signature[0] == signature[1] != signature[2]


def test_cochange(spark):
    files = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (2, 20), (2, 30), (3, 10)], "seq long, file long")
    pairs = cochange.pair_commits(files, F.lit(3), 1.0)
    assert rows(pairs, "file_a", "file_b", "commits", "weighted", "last_seq") == [(10, 20, 2, 0.75, 2), (10, 30, 1, 0.5, 2), (20, 30, 1, 0.5, 2)]
    own = cochange.file_commits(files, F.lit(3), 1.0)
    links = cochange.partners(pairs, own)
    assert rows(links, "src", "dst") == [(10, 20), (20, 10)]
    assert {r.src: r.confidence for r in links.collect()} == {10: pytest.approx(0.75 / 1.75), 20: 1.0}


def test_mass_commits_are_skipped_whole(spark):
    changes = spark.createDataFrame([(c, f) for c, n in ((1, 30), (2, 31), (3, 7)) for f in range(n)] + [(1, 0)], "commit long, file long")
    commits = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "commit long, seq long")
    got = cochange.commit_files(changes, commits, adapters.MAX_FILES).groupBy("seq").count()
    assert rows(got, "seq", "count") == [(10, 30), (30, 7)]


def test_queries_keep_orders_of_many_parts(spark):
    d = "/root/testdata/sf0.001"
    distinct = adapters.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    assert adapters.MAX_FILES == 30
    assert QUERIES["cochange_file_commits"](spark, d).agg(F.sum("commits")).first()[0] == distinct.count()
    assert "<= 30)" in SQL["cochange_pairs"]


def test_numbering_has_no_gaps(spark):
    r = random.Random(1)
    data = [(i, r.randrange(5), r.randrange(50)) for i in range(300)]
    got = cochange.numbered(spark.createDataFrame(data, "id int, b int, o int"), F.col("b"), ["b", "o", "id"]).collect()
    expected = {x[0]: k + 1 for k, x in enumerate(sorted(data, key=lambda x: (x[1], x[2], x[0])))}
    assert {x.id: x.seq for x in got} == expected


def test_tasks_and_as_of(spark):
    e = spark.createDataFrame([(1, 7, 100, "read", 5), (2, 7, 110, "prompt", None), (3, 7, 120, "edit", 6), (4, 7, 130, "prompt", None)], "seq long, session long, ts long, kind string, node long")
    t = activity.with_tasks(e)
    assert rows(t, "seq", "task") == [(1, 0), (2, 1), (3, 1), (4, 2)]
    facts = spark.createDataFrame([(7, 100, 1), (7, 125, 2), (7, 50, 3), (8, 100, 4)], "session long, ts long, tokens long")
    got = activity.as_of(facts, e.where("node is not null").select("session", "ts", "seq", "node"), "session", "node")
    assert {r.tokens: r.node for r in got.collect()} == {1: 5, 2: 6, 3: None, 4: None}


def test_clamped_links_fold_in_order(spark):
    adds = spark.createDataFrame([(1, 2, 1, 4.0), (1, 2, 2, 3.0), (1, 2, 4, -1.0)], "a long, b long, task_seq long, add double")
    w = min(4.0 * 0.995 + 3.0, 5.0) * 0.995**2 - 1.0
    assert learn.link_folds(adds).first().weight == pytest.approx(w)


def test_rank_by_pushing_mass(spark):
    r = random.Random(3)
    edges = sorted({(r.randrange(12), r.randrange(12)) for _ in range(30)})
    e = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in edges], "src long, dst long, w double")
    seeds = spark.createDataFrame([(0, 1.0), (3, 3.0)], "node long, weight double")
    m = np.zeros((12, 12))
    for a, b in edges:
        m[b, a] = 1.0 + (a + b) % 3
    m = m / np.maximum(m.sum(0), 1e-300)
    mass = np.zeros(12)
    mass[0], mass[3] = 0.25, 0.75
    exact = 0.5 * np.linalg.solve(np.eye(12) - 0.5 * m, mass)
    for tolerance in (1e-3, 1e-9):
        got = np.zeros(12)
        for x in graph.spread(e, seeds, tolerance).collect():
            got[x.node] = x.score
        assert (got <= exact + 1e-12).all() and np.abs(exact - got).sum() <= tolerance


def test_push_of_many_questions_over_kept_links(spark):
    """Hot sources are dealt over rows; every question ends by its own mass left; no round shuffles or sorts the links."""
    r = random.Random(8)
    edges = [(0, d, 1.0) for d in range(1, 60)] + [(s, (s * 7 + k) % 60, 1.0 + k) for s in range(1, 60) for k in range(s % 4)] + [(5, 0, 0.0), (6, 0, -1.0)]
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    links = spreading.Adjacency(e, row_links=8)
    assert links.hot.count() == 1 and links.rows.where("src = 0").count() > 1
    seeds = [(q, r.randrange(60), r.random()) for q in range(12) for _ in range(1 + q)] + [(99, 1, 0.0), (98, 4, 1e-4), (97, 4, 1.0), (97, 4, 2.0)]
    state = spreading.push(links, spark.createDataFrame(seeds, "query long, node long, w double"), 1e-4)
    m = np.zeros((60, 60))
    for a, b, w in edges:
        if w > 0:
            m[b, a] += w
    m = m / np.maximum(m.sum(0), 1e-300)
    rows = state.collect()
    assert {x.query for x in rows} == {q for q, _, w in seeds if w > 0}
    for q in {x.query for x in rows}:
        start, got = np.zeros(60), np.zeros(60)
        for a, n, w in seeds:
            start[n] += w if a == q else 0
        left = sum(x.rest for x in rows if x.query == q)
        for x in rows:
            got[x.node] += x.kept if x.query == q else 0
        exact = 0.5 * np.linalg.solve(np.eye(60) - 0.5 * m, start)
        assert left <= 1e-4 and (got <= exact + 1e-12).all() and np.abs(exact - got).sum() <= left + 1e-12
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spreading.after(state, spreading.left_over(state, 0.0), links)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(re.findall(r"Exchange hashpartitioning\(src#\d+L, part#\d+", plan)) == 1 and "Bucketed: true" in plan  # what is pushed moves, the links don't


def test_ranking_leaves_little_mass(spark, monkeypatch):
    """Of a long path all but a thousandth of the mass is spread, and nodes beyond six steps have rows."""
    path = spark.createDataFrame([(k, k + 1, "cochange", 1.0, 0) for k in range(40)], "src long, dst long, type string, w double, last_seq long")
    seed = spark.createDataFrame([(0, 1)], "p_partkey long, p_size int")
    monkeypatch.setattr(ranking, "edges", lambda *_: path)
    monkeypatch.setattr(ranking, "table", lambda *_: seed)
    got = {x.node: x.score for x in QUERIES["ppr_scores"](spark, "").collect()}
    assert 7 in got and 1 - sum(got.values()) <= 1e-3


def test_strongest_of_either_end(spark):
    links = spark.createDataFrame([(1, 2, 9.0), (1, 3, 8.0), (1, 4, 7.0), (4, 5, 1.0)], "a long, b long, weight double")
    assert rows(graph.strongest(links, 1), "a", "b") == [(1, 2), (1, 3), (1, 4), (4, 5)]


def test_auc_with_ties(spark):
    s = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "score double, label boolean")
    assert learn.auc(s).first().auc == pytest.approx(0.875)


def test_logistic_fit_against_gradient(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + r.normal(size=200) > 0).astype(int)
    w = learn.logistic_fit(spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int"), ["a", "b"], "y")
    p = 1 / (1 + np.exp(-(w[0] + x @ np.array(w[1:]))))
    gradient = np.r_[(p - y).sum(), x.T @ (p - y) + np.array(w[1:])]
    assert np.abs(gradient).max() < 1e-5


def test_intervals(spark):
    s = spark.createDataFrame([("f", 1, 5), ("f", 4, 9), ("f", 20, 20), ("g", 3, 300)], "k string, first long, last long")
    assert rows(records.covered_length(s, ["k"]), "k", "covered", "islands") == [("f", 10, 2), ("g", 298, 1)]
    asked = spark.createDataFrame([("f", 5, 4 + 2), ("g", 250, 260), ("f", 10, 12)], "k string, lo long, hi long")
    assert rows(records.overlapping(s, asked, "k", 16), "k", "first", "lo") == [("f", 1, 5), ("f", 4, 5), ("g", 3, 250)]


def test_resolution_is_silent_when_ambiguous(spark):
    names = spark.createDataFrame([(1, "a", "py", "run"), (2, "a", "py", "go"), (3, "a", "py", "go"), (4, "b", "py", "go"), (5, "b", "py", "stop")], "symbol long, file string, family string, name string")
    refs = spark.createDataFrame([(1, "a", "py", "run"), (2, "a", "py", "go"), (3, "c", "py", "stop"), (4, "c", "py", "go"), (5, "c", "js", "stop")], "ref long, file string, family string, name string")
    assert rows(records.resolve(refs, names).na.fill({"symbol": 0, "resolution": ""}), "ref", "symbol", "resolution") == [(1, 1, "same_file"), (2, 0, ""), (3, 5, "name_only"), (4, 0, ""), (5, 0, "")]


def test_forked_usage_counts_once(spark):
    usage = spark.createDataFrame([("s1", "r1", 1), ("s2", "r1", 2), ("s2", "r1", 3), ("s2", None, 4), ("s1", None, 5)], "session string, response string, id long")
    sessions = spark.createDataFrame([("s1", 20), ("s2", 10)], "session string, started_at long")
    assert rows(records.fork_dedup(usage, sessions), "id") == [(2,), (3,), (4,), (5,)]


def test_archetypes_follow_the_order(spark):
    e = spark.createDataFrame([(1, [1, 2]), (2, [2, 1]), (3, [1, 2, 3, 4]), (4, [9]), (5, [])], "seq long, files array<long>")
    got = [(r.tasks, r.newest, r.seed_files) for r in learn.archetypes(e).orderBy("cluster").collect()]
    assert got == [(3, 3, [1, 2]), (1, 4, [9])]


def test_snapshot_upserts(spark):
    v = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "x"), ("l", 1, None, None)], "k string, v int, a string, b string")
    assert rows(records.latest_known(v, ["k"], "v", ["a", "b"]).na.fill(""), "k", "a", "b") == [("k", "a", "x"), ("l", "", "")]


def test_payloads_and_transcripts(spark):
    edit = {"session_id": "s", "hook_event_name": "PostToolUse", "tool_name": "Edit", "tool_input": {"file_path": "/a.py"}, "tool_response": {"filePath": "/a.py", "structuredPatch": [{"newStart": 3, "newLines": 2, "lines": []}]}}
    read = {"session_id": "s", "hook_event_name": "PostToolUse", "tool_name": "Read", "tool_input": {"file_path": "/b.py", "offset": 10, "limit": 5}}
    df = spark.createDataFrame([(json.dumps(edit),), (json.dumps(read),), ("no json",)], "value string")
    got = readers.events_of_payloads(df).collect()
    assert [(r.kind, r.path, [tuple(x) for x in r.ranges or []]) for r in got] == [("edit", "/a.py", [(3, 4)]), ("read", "/b.py", [(10, 14)]), (None, None, [])]
    line = {"type": "assistant", "timestamp": "2025-01-01T00:00:01.500Z", "message": {"id": "m1", "model": "x", "usage": {"input_tokens": 5, "cache_creation_input_tokens": 7, "cache_read_input_tokens": 1, "output_tokens": 2}}}
    more = json.loads(json.dumps(line))
    more["message"]["usage"]["output_tokens"] = 9
    u = readers.usage_of_messages(spark.createDataFrame([("s", json.dumps(line)), ("s", json.dumps(more)), ("s", "{}")], "session string, value string")).collect()
    assert [(r.response, r.ts, r.input, r.cache_write, r.cache_read, r.output) for r in u] == [("m1", 1735689601500, 5, 7, 1, 9)]
    recs = [{"type": "turn_context", "model": "m"}, {"type": "token_usage_record", "timestamp": "2025-01-01T00:00:00Z", "response_id": "r", "usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 3}}]
    u = readers.usage_of_records(spark.createDataFrame([("s", k, json.dumps(r)) for k, r in enumerate(recs)], "session string, line int, value string")).collect()
    assert [(r.model, r.input, r.cache_read, r.output) for r in u] == [("m", 6, 4, 3)]


def test_commit_listing_and_paths(spark):
    text = "\u0000aa bb|100\nM\tx.py\nR090\told.py\tnew.py\u0000bb |90\nA\tx.py\n"
    got = readers.commits_of_listing(spark.createDataFrame([(text,)], "value string"))
    assert sorted((r.oid, r.parents, r.at, r.path, r.renamed_from) for r in got.collect()) == [("aa", ["bb"], 100, "new.py", "old.py"), ("aa", ["bb"], 100, "x.py", None), ("bb", [], 90, "x.py", None)]
    cases = {"src/a.py": ("python", 0, False), "node_modules/x/y.js": ("javascript", 1, False), "dist/a.min.js": ("javascript", 2, False), "tests/test_a.py": ("python", 4, False), "conf/.env": (None, 0, True), "go.sum": (None, 2, False)}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", readers.language(F.col("p")).alias("l"), readers.flags(F.col("p")).alias("f"), readers.is_secret(F.col("p")).alias("s"))
    assert {r.p: (r.l, r.f, r.s) for r in df.collect()} == cases


def test_repository_is_read_without_secrets(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "local.env").write_text("KEY=1")
    (tmp_path / "run").write_text("#!/usr/bin/env python3\n")
    got = {r.path: (r.language, r.loc, r.hash is not None) for r in readers.repository(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("python", 2, True), "local.env": (None, None, False), "run": ("python", 1, True)}


def test_bootstrap_holds_the_mean(spark):
    v = spark.createDataFrame([(k, float(k % 2)) for k in range(400)], "id long, value double")
    i = learn.bootstrap_mean(v).first()
    assert i.low < 0.5 < i.high and math.isclose(i.high - i.low, 0.098, abs_tol=0.03)
