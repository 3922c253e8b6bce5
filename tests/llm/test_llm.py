"""Corpus operators against brute force on small tables, with nulls, empty and very long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from workmap.llm import common, decontaminate, lattice_dedup, lm_score, mixing, ngram_jaccard, substring_dedup, suffix_dedup, token_count, toxicity, url_rules
from workmap.llm.suffix_sort import sorted_windows

DOC = "doc_id long, text string, part int, class long, n_words int"


def corpus(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(120)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts: list[str | None] = [None, "", " \n\t", "one two", "ONE two", "one two", "x" * 3000, "aaaa " * 60, "aaaa " * 40]
    base = [r.choice(vocabulary) for _ in range(150)]
    texts.append(" ".join(base))
    for _ in range(12):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary) + "x"
        texts.append(" ".join(w))
    texts += [f"{' '.join(r.choice(vocabulary) for _ in range(r.randrange(1, 60)))} {passage} {' '.join(r.choice(vocabulary) for _ in range(r.randrange(1, 60)))}" for _ in range(6)]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 200))) for _ in range(20)]
    r.shuffle(texts)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    rows += [rows[5], (rows[7][0], "other text of the same id"), (None, texts[3]), (None, None)]
    return [(*x, 1, 2, 3) for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).cache()


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def multiset(rows):
    return sorted(map(repr, rows))


def test_decontamination(spark, docs):
    r = random.Random(2)
    passage = next(t for _, t, *_ in corpus() if t and len(t.split()) > 120)
    w = lower(passage).split()
    items = [(1, " ".join(w[10:40])), (2, " ".join(w[5:12])), (12, "One, two!"), (3, None), (4, ""), (5, " ".join(w[20:34])), (None, " ".join(w[50:80])), (6, " ".join(r.sample(w, 30)))]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows: dict[tuple, set] = {}
    for i, t in items:
        v = words(lower(t), pattern) if t is not None else []
        for k in range(max(1, len(v) - 12) if v else 0):
            windows.setdefault(tuple(v[k : k + 13]), set()).add("null" if i is None else str(i))
    expected = []
    for d, t, *_ in corpus():
        v = words(lower(t), pattern)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(v) - n + 1):
                own = windows.get(tuple(v[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        expected.append((d, len(v), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(v)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 100):  # one block, and the benchmark in several
        got = decontaminate.judged(decontaminate.find_contamination(docs, bench, block_bytes=block)).collect()
        assert multiset(tuple(x) for x in got) == multiset(expected)
    kept = decontaminate.judge_rows(docs, bench, ["doc_id", "text"], block_bytes=100).collect()
    assert multiset((x.doc_id, x.contaminated) for x in kept) == multiset((x[0], x[-1]) for x in expected)
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == len(expected)


def test_fm_index_finds_all(spark):
    r = np.random.default_rng(0)
    for _ in range(20):
        text = np.concatenate([np.r_[r.integers(1, 4, r.integers(1, 30)), 0] for _ in range(5)])
        index = decontaminate.FMIndex(text, 3, sample=4)
        for n in (1, 2, 5):
            phrases = r.integers(1, 4, (10, n))
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi, strict=True):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]


def test_ngram_jaccard(spark, docs):
    rows = corpus()
    sets = []
    for _, t, *_ in rows:
        w = words(lower(t))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent: dict = {d: d for d, *_ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, *_) in enumerate(rows):
        for j, (b, *_) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    expected = [(d, len(s), top(d) if d is not None else None) for (d, *_), s in zip(rows, sets, strict=True)]
    assert multiset(tuple(x) for x in ngram_jaccard.join(docs).collect()) == multiset(expected)
    assert ngram_jaccard.join(docs.limit(0)).count() == 0


def test_many_near_copies_join_through_the_matrix(spark):
    """A chain whose neighbours alone are linked, and groups larger than a room."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    chain = [base]
    for k in range(40):
        w = list(chain[-1])
        w[(7 * k) % 120] = f"v{k}"
        chain.append(w)
    rows = [(k, " ".join(w)) for k, w in enumerate(chain)]
    got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0}


def test_lm_scores(spark, docs):
    rows = corpus()
    texts = [words(lower(t)) for _, t, *_ in rows]
    counts: dict[tuple, int] = {}
    own = []
    for t in texts:
        c: dict[tuple, int] = {}
        for n in (1, 2, 3):
            for k in range(len(t) - n + 1):
                c[tuple(t[k : k + n])] = c.get(tuple(t[k : k + n]), 0) + 1
        own.append(c)
        for g, x in c.items():
            counts[g] = counts.get(g, 0) + x
    total = sum(map(len, texts))
    for order in (2, 3):
        expected = []
        for (d, *_), t, c in zip(rows, texts, own, strict=True):
            score = 0.0
            for k in range(len(t)):
                penalty = 0.0
                for n in range(min(order, k + 1), 0, -1):
                    g = tuple(t[k - n + 1 : k + 1])
                    if counts[g] - c[g] > 0:
                        below = counts[g[:-1]] - c[g[:-1]] if n > 1 else total - len(t)
                        score += penalty + np.log(counts[g] - c[g]) - np.log(below)
                        break
                    penalty += np.log(0.4) if n > 1 else 0.0
                else:
                    score += penalty + np.log(0.4) - np.log(total - len(t) + 1)
            expected.append((d, len(t), round(score, 4)))
        got = lm_score.score_documents(docs, order=order, part_bytes=2000).collect()
        assert multiset((x.doc_id, x.n_words, round(x.log_score, 4) + 0.0) for x in got) == multiset((d, n, float(v) + 0.0) for d, n, v in expected)


def test_lm_scores_are_of_trigrams_unless_told(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, "x b c"), (4, "x b d")]
    got = {x.doc_id: x.log_score for x in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # of the other rows' 9 words one is a; b is after the one a there; c after the one a b, not after two of the three b
    assert got[1] == pytest.approx(np.log(1 / 9) + np.log(1 / 1) + np.log(1 / 1))


def test_url_rules(spark):
    urls = ["http://Blog.Example.ORG/es/1", "https://example.org/en/12?x=1", "https://example.org/en/2", "https://a.example.com/fr/", "x://com/de/1#t", "https://examplecom/de/", "no url", None, "http://a://b/c", "http://example.org", "http://example.org?es/", "http://bad.net/en/spam/1"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(100 + k, "http://bad.net/en/spam/x") for k in range(30)] + [(200 + k, "http://good.net/en/fine/x") for k in range(30)], "page_id long, url string")
    labels = pages.select("page_id", F.col("url").contains("bad.net").alias("bad")).where("page_id >= 100")
    got = {r.page_id: r for r in url_rules.judge(pages, labels, confidence=0.9).collect()}
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(urls))] == [
        ("blog.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"),
        ("a.example.com", "/fr/", "com/fr/", "allow"),
        ("com", "/de/1", "com/de/", "block"),
        ("examplecom", "/de/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a:", "//b/c", None, "allow"),
        ("example.org", "", None, "allow"),
        ("example.org", "", None, "allow"),
        ("bad.net", "/en/spam/1", None, "block"),
    ]
    assert {got[200 + k].verdict for k in range(30)} == {"allow"} and {got[100 + k].verdict for k in range(30)} == {"block"}
    assert url_rules.judge(pages.limit(0), labels.limit(0)).count() == 0


def test_lattice(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 8)) * 2
    points = lattice_dedup.decode(x)
    assert len(lattice_dedup.ROOTS) == 240
    near = ((x - points) ** 2).sum(1)
    for root in lattice_dedup.ROOTS:
        assert (near <= ((x - points - root) ** 2).sum(1) + 1e-9).all()
    centres = r.normal(size=(30, 64))
    v = [(centres[k % 30] + r.normal(size=64) * (0.02 if k < 120 else 0.35)).tolist() for k in range(200)]
    rows = [(k, e) for k, e in enumerate(v)]
    rows += [(300, v[0]), (301, v[0]), (302, None), (303, [0.0] * 64), (304, [float("nan")] * 64), (305, [1.0, None] * 32), (306, [2.0 * a for a in v[1]]), (None, v[0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, cell int").repartition(3)
    got = {x.vec_id: x for x in lattice_dedup.near_duplicates(df).collect()}
    ok = {a: np.array(b) / np.linalg.norm(b) for a, b in rows if a is not None and b is not None and a not in (303, 304, 305)}
    ids = sorted(ok)
    m = np.stack([ok[k] for k in ids])
    cos = m @ m.T
    true = {ids[k]: int((cos[k] >= 0.9).sum()) - 1 for k in range(len(ids))}
    assert sum(got[k].n_links for k in ids) >= 0.9 * sum(true.values())
    assert all(got[k].n_links <= true[k] for k in ids)
    assert got[300].component_id == got[301].component_id == got[0].component_id == 0
    for k in (302, 303, 304, 305):
        assert (got[k].n_links, got[k].component_id) == (0, k)
    assert (got[None].n_links, got[None].component_id) == (0, None)
    assert lattice_dedup.near_duplicates(df.limit(0)).count() == 0


def test_links_near_the_threshold_are_found(spark):
    """Planted pairs of cosine 0.90 to 0.91, and vectors of a rarer length."""
    r = np.random.default_rng(11)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in r.normal(size=(2, 600, 64)))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = r.uniform(0.9001, 0.91, (600, 1))
    v = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * b])
    true = int((v @ v.T >= 0.9).sum()) - len(v)
    rare = r.normal(size=8)
    rows = [(k, x) for k, x in enumerate(v.tolist())] + [(5000, rare.tolist()), (5001, (rare + 0.01).tolist()), (5002, (-rare).tolist()), (5003, [1.0] * 5)]
    got = {x.vec_id: x for x in lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert true >= 1200
    assert 0.99 * true <= sum(got[k].n_links for k in range(len(v))) <= true
    assert [(got[k].n_links, got[k].component_id) for k in range(5000, 5004)] == [(1, 5000), (1, 5000), (0, 5002), (0, 5003)]


def brute_segmentation(text, pieces, unknown):
    """Best score and the pieces of the segmentation that the tie rule keeps, by the definition."""
    best = {0: (0.0, 0)}
    for i in range(len(text)):
        if i not in best:
            continue
        score, n = best[i]
        options = [(len(p), s) for p, s in sorted(pieces.items(), key=lambda x: len(x[0])) if text.startswith(p, i)]
        for size, s in options:
            if i + size not in best or score + s > best[i + size][0]:
                best[i + size] = (score + s, n + 1)
        if not any(size == 1 for size, _ in options) and (i + 1 not in best or score + unknown > best[i + 1][0]):
            best[i + 1] = (score + unknown, n + len(text[i].encode()))
    return best[len(text)]


def test_token_counts(spark, docs):
    r = random.Random(8)
    mark = token_count.MARK
    pieces = {p: -float(r.randrange(1, 9)) for p in {mark, *[mark * (r.random() < 0.4) + "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 4))) for _ in range(60)]}}
    vocabulary = token_count.Vocabulary(tuple(pieces.items()), True)
    counter = token_count.Counter(vocabulary)
    for _, t, *_ in corpus():
        whole = mark + t.replace(" ", mark) if t else ""
        assert counter.text(t or "") == pytest.approx(brute_segmentation(whole, pieces, counter.unknown) if t else (0.0, 0))
    got = token_count.count_tokens(docs, vocabulary).collect()
    assert multiset((x.doc_id, x.n_tokens) for x in got) == multiset((d, counter.text(t or "")[1]) for d, t, *_ in corpus())


def test_token_counts_equal_a_tokenizer(spark):
    import os

    if not os.path.exists(token_count.DEFAULT_VOCABULARY):
        pytest.skip("no vocabulary file here")
    from tokenizers import Tokenizer, models

    v = token_count.Vocabulary.of_model(token_count.DEFAULT_VOCABULARY)
    low = min(s for _, s in v.pieces)
    t = Tokenizer(models.Unigram([("<unk>", low), *v.pieces, *((f"<0x{i:02X}>", low) for i in range(256))], unk_id=0, byte_fallback=True))
    c = token_count.Counter(v)
    for text in ["", " ", "  a  b", "Hello, world! The quick brown fox", "x 你好 \n\t ¡", "▁▁a ▁", "ééé 🙂🙂 naïve", *[x[1] for x in corpus() if x[1]]]:
        assert c.text(text)[1] == (len(t.encode("▁" + text.replace(" ", "▁")).ids) if text else 0)


def test_suffix_order(spark):
    for seed in range(60):
        r = random.Random(seed)
        width, letters = r.choice([1, 3, 8, 20]), r.choice(["ab", "a", "abcdefgh"])
        texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))).encode() for _ in range(r.randrange(1, 12))]
        texts += texts[:3] + [t + b"ab" for t in texts[:2]]
        text, at, same = sorted_windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), width)
        expected = sorted(t[i:] for t in texts for i in range(len(t) - width + 1))
        got = [texts[t][a:] for t, a in zip(text, at, strict=True)]
        assert [g[:width] for g in got] == [e[:width] for e in expected]
        assert same.tolist() == [k > 0 and got[k][:width] == got[k - 1][:width] for k in range(len(got))]


def test_suffix_dedup(spark, docs):
    rows = corpus()
    texts = [(t or "").encode() for _, t, *_ in rows]
    least: dict[bytes, int] = {}
    for (d, *_), t in zip(rows, texts, strict=True):
        for k in range(len(t) - 49 if d is not None else 0):
            least[t[k : k + 50]] = min(d, least.get(t[k : k + 50], d))
    expected = []
    for (d, *_), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if d is not None and least[t[k : k + 50]] < d:
                gone[k : k + 50] = [True] * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        expected.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeated_bytes(docs, part_bytes=3000, block_bytes=2000, sort_rows=5).collect()
    assert multiset((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == multiset(expected)
    cut = suffix_dedup.cut_rows(docs, ["doc_id", "text", "class"]).collect()
    assert all(x.text is None or len(x.text.encode()) >= 0 for x in cut) and len(cut) == len(rows)
    assert suffix_dedup.remove_repeated_bytes(docs.limit(0)).count() == 0


def test_a_short_text_at_the_head_of_a_block_hides_no_windows(spark):
    r = random.Random(12)
    for heads in ([10], [30], [48], [49], [0, 7, 3, 0], [20, 45]):
        passage = "".join(r.choice("abcdefgh") for _ in range(90))
        rows = [(k, "z" * n) for k, n in enumerate(heads)] + [(100, passage), (101, passage[:60] + "y" * 40)]
        data = "".join(t for _, t in rows).encode()
        offsets = np.cumsum([0, *(len(t) for _, t in rows)])
        found = suffix_dedup.Anchors(np.frombuffer(data, np.uint8), offsets, 50, 20)
        starts = [x for a, n in zip(found.first.tolist(), found.size.tolist(), strict=True) for x in range(a, a + n)]
        assert starts == [a + k for a, (_, t) in zip(offsets.tolist(), rows, strict=False) for k in range(len(t) - 49)]
    # the copy's first bytes go though a short text is before it in the block
    df = spark.createDataFrame([(1, "z" * 10), (3, passage), (2, passage[:60])], "doc_id long, text string").coalesce(1)
    got = {x.doc_id: (x.n_removed, x.n_spans, x.kept.decode()) for x in suffix_dedup.remove_repeated_bytes(df).collect()}
    assert got == {1: (0, 0, "z" * 10), 2: (0, 0, passage[:60]), 3: (60, 1, passage[60:])}


def test_substring_dedup(spark, docs):
    rows = corpus()
    texts = [words(t) for _, t, *_ in rows]
    least: dict[tuple, int] = {}
    for (d, *_), w in zip(rows, texts, strict=True):
        for k in range(len(w) - 12 if d is not None else 0):
            least[tuple(w[k : k + 13])] = min(d, least.get(tuple(w[k : k + 13]), d))
    expected = []
    for (d, *_), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if d is not None and least[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substring_dedup.remove_repeated_windows(docs, block_bytes=2000, part_bytes=3000).collect()
    assert multiset((x.doc_id, x.n_words, x.n_removed, x.kept_sha256, x.kept) for x in got) == multiset(expected)


def test_the_largest_id_loses_what_smaller_ones_have(spark):
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(5, text), ((1 << 63) - 1, text), (-(1 << 63), "a " + text)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_windows(df).collect()}
    assert got == {5: 20, (1 << 63) - 1: 20, -(1 << 63): 0}


def test_mixing_meets_its_targets(spark):
    r = random.Random(4)
    rows = [(k, "x" * r.randrange(40, 400), r.choice(["en", "de", None]), r.choice("abc")) for k in range(600)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, text string, lang string, source string, topic string")
    got = mixing.mix(df, {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6}}, share=0.4, rounds=20).collect()
    assert len(got) == len(rows)
    weight = sum(x.n_tokens * x.factor for x in got)
    assert sum(x.n_tokens * x.factor for x in got if x.source == "a") / weight == pytest.approx(0.5, abs=0.01)
    assert sum(x.n_tokens * x.factor for x in got if x.lang == "en") / weight == pytest.approx(0.6, abs=0.01)
    assert mixing.mix(df.limit(0)).count() == 0
    again = mixing.mix_rows(df.withColumn("n_chars", F.lit(1)), ["doc_id", "text", "lang", "source"]).collect()
    assert {x.doc_id: x.lang for x in again} == {x[0]: x[2] for x in rows}


def test_toxicity(spark):
    r = random.Random(6)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(900):
        w = [r.choice(plain) for _ in range(60)]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(["zorgle", "zorglish", "Vexnut!"])
        rows.append((k, " ".join(w), "x"))
        labels.append((k, int(toxic)))
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "zorgle zorgle you zorgle zorgle", "x"), (5002, "z0rgle " * 4 + "a " * 40, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    y = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, y)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _ in labels)
    held = [(got[k].predicted, t) for k, t in labels if got[k].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert got[5000].predicted == got[5001].predicted == 0 and 0 <= got[5000].score <= 1
    nothing = toxicity.fit(docs, y.limit(0))
    assert {x.predicted for x in toxicity.score(docs, nothing).collect()} == {0}


def test_components(spark):
    r = random.Random(9)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(500, 560)] + [(900, 900)]
    parent: dict[int, int] = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {x.id: x.component for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in links for x in (a, b) if a != b}


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, d))
        assert docs.columns == corpus_pipeline.COLUMNS or set(docs.columns) == set(corpus_pipeline.COLUMNS)
    assert 0 < corpus_pipeline.mix_sources(spark, docs, d).count() <= docs.count()
