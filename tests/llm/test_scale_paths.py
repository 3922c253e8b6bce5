"""Rooms, blocks, dense cells, caps and clashes: the paths that small tables don't reach by themselves, against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from workmap.llm import common, decontaminate, lattice_dedup, mixing, ngram_jaccard, suffix_dedup, toxicity, url_rules


def components_of(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in ids}


def test_jaccard_groups_and_rooms_of_few_rows(spark):
    """Groups of two, rooms of one query, homes of three rows: near copies and a passage that all texts share."""
    r = random.Random(21)
    word = [f"w{k}" for k in range(4000)]
    passage = [r.choice(word) for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [r.choice(word) for _ in range(60)] + passage
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = r.choice(word)
            texts.append(" ".join(w))
    texts += [" ".join(passage + [r.choice(word) for _ in range(r.randrange(0, 60))]) for _ in range(20)]
    rows = list(enumerate(texts))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components_of(range(len(rows)), links)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for few in ({}, {"home_rows": 3, "group_rows": 2, "query_rows": 1, "block_bytes": 2000, "part_bytes": 4000}):
        assert {x.doc_id: x.component_id for x in ngram_jaccard.join(df, **few).collect()} == expected


def test_rows_with_one_id_keep_their_own_items(spark):
    """Equal ids and word counts, a benchmark of several blocks: each row has what occurs in it."""
    item = {k: " ".join(f"i{k}x{j}" for j in range(6)) for k in (1, 2, 3, 4)}
    docs = spark.createDataFrame([(1, item[1] + " " + item[3]), (1, item[2] + " a b c d e f"), (1, item[4] + " a b c d e f"), (None, item[1])], "doc_id long, text string")
    bench = spark.createDataFrame(list(item.items()), "item_id long, text string")
    for block in (6, 1 << 20):
        got = decontaminate.find_contamination(docs, bench, block_bytes=block).collect()
        assert sorted(str(x["items"]) for x in got) == ["['1', '3']", "['1']", "['2']", "['4']"]
        assert sorted(sum(s["words"] for s in x.spans) for x in got) == [6, 6, 6, 12]


def test_dense_cells_count_each_link_once(spark):
    """A large group of near copies, compared in its cell, by blocks of a dense cell, and streamed past a task's bound: the same links."""
    r = np.random.default_rng(2)
    centre, other = r.normal(size=(2, 32))
    v = np.concatenate([centre + 0.12 * r.normal(size=(80, 32)), other + 0.25 * r.normal(size=(40, 32)), r.normal(size=(60, 32)), np.tile(centre, (5, 1))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = unit @ unit.T >= 0.9
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>").repartition(3)
    plain = {x.vec_id: (x.n_links, x.component_id) for x in lattice_dedup.near_duplicates(df, dense=10**9).collect()}
    for how in ({"dense": 0, "block": 16}, {"dense": 2, "block": 7}, {"cell_rows": 8, "block": 16}):
        assert {x.vec_id: (x.n_links, x.component_id) for x in lattice_dedup.near_duplicates(df, **how).collect()} == plain
    found, all_ = sum(n for n, _ in plain.values()), int(true.sum()) - len(v)
    assert 0.97 * all_ <= found <= all_


@pytest.mark.parametrize("cos", [0.9005, 0.91, 0.92])
def test_recall_of_lattice_cells(spark, cos):
    r = np.random.default_rng(7)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in r.normal(size=(2, 2000, 64)))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = cos * a + np.sqrt(1 - cos**2) * b
    df = spark.createDataFrame(list(enumerate(np.concatenate([a, b]).tolist())), "vec_id long, embedding array<double>")
    found = lattice_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0] / 2
    assert found >= 0.97 * 2000


def test_mined_rules_are_those_of_brute_force(spark):
    r = random.Random(3)
    tokens = [f"t{k}" for k in range(9)]
    rows = [(k, sorted(r.sample(tokens, r.randrange(1, 6))), None) for k in range(400)]
    rows = [(k, t, ("t1" in t and "t2" in t) or (r.random() < 0.15)) for k, t, _ in rows]
    support, confidence, lift = 0.02, 0.3, 1.2
    n, bad = len(rows), sum(b for _, _, b in rows)
    rules = {}
    for size in (1, 2, 3):
        for c in itertools.combinations(tokens, size):
            own = [b for _, t, b in rows if set(c) <= set(t)]
            hit = sum(own)
            if own and hit / n >= support and hit / len(own) >= confidence and hit / len(own) / (bad / n) >= lift:
                rules[c] = hit / len(own)
    expected = {c: v for c, v in rules.items() if not any(set(o) < set(c) and w >= v for o, w in rules.items())}
    df = spark.createDataFrame(rows, "id long, tokens array<string>, bad boolean")
    got = {tuple(x.tokens): x.confidence for x in url_rules.mine(df, support=support, confidence=confidence, lift=lift).collect()}
    assert got == pytest.approx(expected)
    # the index finds the surest of the rules whose tokens a page has
    pages = spark.createDataFrame([(k, t) for k, t, _ in rows], "key long, tokens array<string>")
    mined = url_rules.mine(df, support=support, confidence=confidence, lift=lift)
    best = {x.key: x.confidence for x in url_rules.matched(pages, mined).collect()}
    want = {k: max(v for c, v in expected.items() if set(c) <= set(t)) for k, t, _ in rows if any(set(c) <= set(t) for c in expected)}
    assert best == pytest.approx(want)


def test_mining_looks_at_all_tokens_of_long_paths(spark):
    """Forty folders that always stand together, behind others: each is a rule of its own, and its rows aren't combinations."""
    deep = [f"p{k}" for k in range(40)]
    rows = [(k, [f"a{k}"] * 2 + [f"x{k % 7}"] + deep, True) for k in range(60)] + [(100 + k, [f"x{k % 7}", "y"], k % 10 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, bad boolean")
    got = url_rules.mine(df, support=0.05, confidence=0.9, lift=1.2).collect()
    assert {tuple(x.tokens) for x in got} == {(t,) for t in deep}
    pages = spark.createDataFrame([(1, ["p39"]), (2, ["y"]), (3, None), (4, [])], "key long, tokens array<string>")
    assert [x.key for x in url_rules.matched(pages, url_rules.mine(df, support=0.05, confidence=0.9, lift=1.2)).collect()] == [1]


def test_tokens_that_most_rows_have_are_mined(spark):
    rows = [(k, ["all", "b"] if k % 4 == 0 else ["all", "c"], k % 4 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, bad boolean")
    assert {tuple(x.tokens) for x in url_rules.mine(df, support=0.05, confidence=0.2, lift=0.5).collect()} == {("all",), ("b",)}


def test_urls_with_clashing_columns_nulls_and_repeats(spark):
    pages = spark.createDataFrame(
        [(1, "http://x.org/a", "h", "v", 1), (1, "http://x.org/a", "h", "v", 1), (None, "http://x.org/" + "a/" * 3000, None, None, None), (2, None, "", "", 0)],
        "page_id long, url string, host string, verdict string, mined int",
    )
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (3, None)], "page_id long, bad boolean")
    got = url_rules.judge(pages, labels).collect()
    assert sorted((str(x.page_id), x.host, x.verdict) for x in got) == [("1", "x.org", "allow"), ("1", "x.org", "allow"), ("2", "", "allow"), ("None", "x.org", "allow")]
    a, b = url_rules.Rule("org", "/a", "allow"), url_rules.Rule("x.org", "/", "block")
    assert {x.rule for x in url_rules.judge(pages.where("page_id = 1"), labels, rules=(a, b)).collect()} == {"x.org/"}


def test_factors_are_those_of_iterative_fitting(spark):
    r = random.Random(5)
    cells = [(s, g, t, r.randrange(0, 50)) for s in "abc" for g in ("en", "de") for t in ("prose", "web") if r.random() < 0.9]
    targets = {"source": {"a": 0.5, "b": 0.2, "c": 0.3}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"prose": 0.6, "web": 0.4}}
    df = spark.createDataFrame(cells, "source string, lang string, topic string, weight long")
    got = {(x.source, x.lang, x.topic): x.factor for x in mixing.rake(df, targets).collect()}
    w = {c[:3]: float(c[3]) for c in cells}
    all_, now = sum(w.values()), dict(w)
    for _ in range(200):
        for k, m in enumerate(("source", "lang", "topic")):
            sums = {}
            for c, x in now.items():
                sums[c[k]] = sums.get(c[k], 0.0) + x
            now = {c: x * (targets[m][c[k]] * all_ / sums[c[k]] if sums[c[k]] > 0 else 1.0) for c, x in now.items()}
    assert got == pytest.approx({c: now[c] / w[c] if w[c] else 1.0 for c in w}, rel=1e-6)


def test_cells_of_null_and_of_empty_strings_are_apart(spark):
    rows = [(1, "x" * 400, None, "a"), (2, "x" * 400, "", "a"), (3, "x" * 400, "", None), (4, "x" * 40, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in mixing.mix(df, {"lang": {"": 0.5}}).collect()}
    assert {k: (x.lang, x.source) for k, x in got.items()} == {k: (g, s) for k, _, g, s in rows}
    assert all(x.residual >= 0 for x in got.values())
    assert {(x.doc_id, x.lang, x.source) for x in mixing.mix_rows(df, ["doc_id", "text", "lang", "source"]).collect()} == {(k, g, s) for k, _, g, s in rows}


def test_targets_that_contradict_each_other_leave_a_residual(spark):
    cells = [("a", "en", "prose", 10), ("b", "de", "prose", 10)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, weight long")
    held = mixing.rake(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}, rounds=7).first()
    assert held.residual > 0.1
    assert mixing.rake(df, {"source": {"a": 0.9, "b": 0.1}}, flatten=1.0, rounds=7).select("residual").first()[0] > 0.1
    assert mixing.rake(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.9, "de": 0.1}}).first().residual <= 1e-9


def test_isotonic_levels_are_least_squares(spark):
    r = random.Random(1)
    for _ in range(20):
        n = r.randrange(1, 12)
        x, y = np.array([r.randrange(6) for _ in range(n)], float), np.array([r.randrange(2) for _ in range(n)], float)
        knots, levels = toxicity.isotonic(x, y)
        # the level at a knot is the greatest over starts of the least mean up to any end
        for k, knot in enumerate(knots):
            want = max(min(y[(x >= lo) & (x <= hi)].mean() for hi in knots[k:]) for lo in knots[: k + 1])
            assert levels[k] == pytest.approx(want), (knot, x, y)


def test_a_tree_splits_where_the_loss_falls_most(spark):
    r = np.random.default_rng(4)
    x = np.round(r.random((80, 3)), 1)
    y = (x[:, 1] > 0.5).astype(float)
    y[:5] = 1 - y[:5]
    forest = toxicity.boost(x, y, rounds=1, depth=1, rate=1.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = max(
        (g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1), j)
        for j in range(3)
        for cut in np.unique(x[:, j])
        if (left := x[:, j] <= cut).any() and h[left].sum() >= 1 and h[~left].sum() >= 1
    )
    left = x[:, forest.feature[0, 0]] <= forest.threshold[0, 0]
    got = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    assert forest.feature[0, 0] == best[1] == 1 and got >= 0.9 * best[0]
    assert forest.value[0, 0] == pytest.approx(-g[left].sum() / (h[left].sum() + 1)) and forest.value[0, 1] == pytest.approx(-g[~left].sum() / (h[~left].sum() + 1))


def test_features_of_small_texts(spark):
    f = toxicity.Featurer({"bad": 5.0})
    x = f.features(["bad word", None, "", "you are b@d now", "fine"])
    assert x.shape == (5, toxicity.FEATURES) and not x[1].any() and not x[2].any()
    assert x[0, 0] == 0.5 and x[3, 0] == 0.25 and x[4, 0] == 0.0  # density of words of the lexicon, plain or hidden


def test_the_fitting_sample_stays_bounded(spark):
    docs = spark.createDataFrame([(3, f"text {k}") for k in range(50)] + [(4, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, 2).groupBy("doc_id").count().where("count > 1").count() == 0


def test_cut_rows_leaves_what_no_earlier_row_has(spark):
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh") for _ in range(80))
    texts = [(1, "q" * 30 + passage), (2, passage + "r" * 30), (3, "é" * 10 + passage[:60]), (4, None), (5, "short"), (None, passage)]
    cut = {x.doc_id: (x.text, x.lang) for x in suffix_dedup.cut_rows(spark.createDataFrame([(*x, "l") for x in texts], "doc_id long, text string, lang string"), ["doc_id", "text", "lang"]).collect()}
    assert cut == {1: ("q" * 30 + passage, "l"), 2: ("r" * 30, "l"), 3: ("é" * 10, "l"), 4: (None, "l"), 5: ("short", "l"), None: (passage, "l")}


@pytest.mark.parametrize("k", range(5))
def test_stages_stand_odd_rows(spark, k):
    """Empty tables, nulls in every column, repeated ids and columns of clashing names."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    name, stage = corpus_pipeline.STAGES[k]
    odd = [(1, "a b c d e f " * 9, "en", "s", 3), (1, "a b c d e f " * 9, "en", "s", 3), (2, None, None, None, None), (3, "", "", "", 0), (None, "words of a row without an id", "de", "t", 1), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*x, 1, "c") for x in odd], schema + ", score int, component_id string")
    got = stage(spark, df, d).collect()
    assert all(x.doc_id in (1, 2, 3, None) for x in got)
    if name != "mixing":
        assert len(got) == {"near duplicates": 6}.get(name, 6) and set(got[0].asDict()) == set(corpus_pipeline.COLUMNS)
    assert stage(spark, df.limit(0), d).count() == 0


def test_stars_reach_the_least_node_of_a_partition(spark):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(250)]
    df = spark.createDataFrame(links, "a long, b long").coalesce(1)
    got = {x.a: x.b for x in df.mapInArrow(common.stars, "a long, b long").collect()}
    want = components_of({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k != v}


def test_stretches_with_one_hash_are_told_apart(spark):
    """Hashes that all collide: classes are those of equal bytes."""
    r = random.Random(13)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 4))) for _ in range(60)]
    anchors = np.array([r.randrange(3) for _ in texts], np.uint64)
    at = np.cumsum([0, *map(len, texts)])
    for hashes in (np.zeros(60, np.uint64), np.arange(60, dtype=np.uint64) % 4 * 0):
        got = suffix_dedup.told_apart(anchors, hashes, np.frombuffer(b"".join(texts), np.uint8), at, chunk=7)
        for i in range(60):
            for j in range(60):
                if anchors[i] == anchors[j]:
                    assert (got[i] == got[j]) == (texts[i] == texts[j])
