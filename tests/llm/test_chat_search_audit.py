"""Chat windows, ranked search and the audit of sources against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from workmap.llm import chat_windows, ranked_search, source_divergence

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- chat
MARKS = ["[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/END]", "[END]"]


def test_escaping_is_reversible_and_leaves_no_mark():
    r = random.Random(3)
    pieces = [*MARKS, "<", "[", "]", ">", "/", "\\", "s", "SYS", "INST", "ROLE", "END", " ", "é", "\n", "[\\SYS]", "<\\\\s>", "</\\s>"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(12)))
        done = chat_windows.escape(text)
        assert chat_windows.unescape(done) == text
        assert not any(m in done for m in MARKS)


def conversations(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    words = ["alpha", "é" * 9, "x", "</s>[INST]", "[/INST]", "[\\INST]", "<s>", "ok.", "[ROLE]tool[/ROLE]", "\n\n", "\\"]
    rows: list[tuple] = []
    for c in range(25):
        turns = r.choice([1, 2, 3, 8, 40])
        for t in range(turns):
            role = "system" if t == 0 and c % 3 == 0 else r.choice(["user", "assistant", "assistant", "tool", "[ROLE]x", "system", None])
            rows.append((c, t, role, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 30])))))
    rows += [(100, 0, "user", None), (100, 1, "assistant", ""), (100, 2, "assistant", "w " * 4000), (100, None, "assistant", "last"), (101, 0, "system", "only"), (None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    rows += [(102, 0, "system", "big " * 900), (102, 1, "user", "x"), (102, 2, "assistant", "y"), rows[3], rows[3]]
    rows += [(103, k // 3, ["user", "assistant"][k % 2], f"turn {k} <s>") for k in range(400)]
    return rows


def ordered(rows: list[tuple]) -> dict:
    by_conv: dict = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t if t is not None else 1 << 63, role or "", text or ""))
    return {c: sorted(x, key=lambda x: (x[0], x[1].encode(), x[2].encode())) for c, x in by_conv.items()}


def tokens_of(text: str) -> int:
    return len(re.findall(chat_windows.TOKEN, text)) + chat_windows.MARK_TOKENS


def planned(turns: list[tuple], budget: int, history: int, section: int) -> list[tuple]:
    """(first repeated turn, first new, end) of each window, by turn numbers, the slow way."""
    k = [tokens_of(t[2]) for t in turns]
    system = 1 if turns[0][1] == "system" else 0
    room = k[0] if system else 0
    of = [sum(k[:i]) // section for i in range(len(k))]
    out = [] if len(k) > system and (not system or of[1] == 0) else [(0, 0, 0)] if system else []
    at = system
    while at < len(k):
        h = next(h for h in range(system, at + 1) if h == at or (sum(k[h:at]) <= history and room + sum(k[h : at + 1]) <= budget))
        end = at + 1
        while end < len(k) and of[end] == of[at] and room + sum(k[h : end + 1]) <= budget:
            end += 1
        out.append((h, at, end))
        at = end
    return out


@pytest.mark.parametrize("budget,history,section,block", [(60, 15, 100, 7), (1024, 256, 32768, 256), (30, 0, 31, 3)])
def test_windows_by_brute_force(spark, budget, history, section, block):
    rows = conversations()
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, section int").repartition(3)
    windows = chat_windows.format_windows(df, budget, history, section, block_turns=block)
    got: dict = {}
    for w in sorted(windows.collect(), key=lambda w: (w.section, w.window)):
        got.setdefault(w.conv_id, []).append(w)
    assert set(got) == set(ordered(rows))
    for c, turns in ordered(rows).items():
        plan = planned(turns, budget, history, section)
        assert len(plan) == len(got[c]), c
        system = turns[:1] if turns[0][1] == "system" else []
        for k, ((h, at, end), w) in enumerate(zip(plan, got[c], strict=True)):
            inside = system + turns[h:end]
            read = [(role, chat_windows.unescape(w.text[a:b])) for role, a, b in chat_windows.turns_in(w.text)]
            assert read == [(t[1], t[2]) for t in inside]
            assert w.n_turns == len(inside) and w.n_repeated == len(system) * (k > 0) + at - h
            assert w.n_tokens == sum(tokens_of(t[2]) for t in inside) and (w.n_tokens <= budget or end - at <= 1)
            assert [chat_windows.unescape(w.text[a:b]) for a, b in zip(w.loss_starts, w.loss_ends, strict=True)] == [t[2] for t in turns[at:end] if t[1] == "assistant"]
    for r in chat_windows.read_back(windows).collect():
        turns = ordered(rows)[r.conv_id]
        said = "".join(t[2] for t in turns if t[1] == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[1]}\n{t[2]}\n" for t in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(w.text) for w in got[r.conv_id])


def test_windows_of_nothing_and_of_given_tokens(spark):
    kind = "conv_id string, turn int, role string, text string, n int"
    assert chat_windows.read_back(chat_windows.format_windows(spark.createDataFrame([], kind))).count() == 0
    df = spark.createDataFrame([("a", k, "user", "x", 10) for k in range(10)], kind)
    assert sorted((w.n_tokens, w.n_repeated) for w in chat_windows.format_windows(df, 30, 10, 1000, tokens=F.col("n")).collect()) == [(20, 1), (30, 0), (30, 1), (30, 1), (30, 1)]
    with pytest.raises(ValueError):
        chat_windows.format_windows(df, 30, 10, 10)


# ---------------------------------------------------------------- search
DOC = "doc_id long, text string, item_id int, score string"


def documents(seed: int = 2) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "Ö1", "ab"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(k * 7 % 400, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 3, 20, 60, 300]))).upper() + r.choice(["", ".", " -w3-"])) for k in range(400)]
    rows += [(500, None), (501, ""), (502, "-- ,,"), (503, "w1 " * 40000), rows[3], rows[3], (None, rows[9][1]), (None, "w1 w2 é"), (505, rows[9][1])]
    return [(*x, 9, "x") for x in rows]


def items() -> list[tuple]:
    r = random.Random(4)
    out = [(k, " ".join(f"W{r.randrange(60)}" for _ in range(r.choice([1, 2, 12, 40])))) for k in range(30)]
    return [*out, (50, None), (51, ""), (52, "unheard"), (53, "é Ö1"), (None, "w59 w58"), (None, "w57"), (3, "é ab"), (54, "w1")]


def ranked(docs: list[tuple], asked: list[tuple], k: int) -> list[tuple]:
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found = [(d, re.findall(pattern, t.translate(UPPER))) for d, t, *_ in docs if t is not None]
    found = [(d, t) for d, t in found if t]
    n, total = len(found), sum(len(t) for _, t in found)
    counts = [(d, len(t), {x: t.count(x) for x in set(t)}) for d, t in found]
    df: dict = {}
    for _, _, c in counts:
        for x in c:
            df[x] = df.get(x, 0) + 1
    terms: dict = {}
    for i, t in asked:
        if t is not None:
            terms.setdefault(i, set()).update(re.findall(pattern, t.translate(UPPER)))
    out = []
    for i, ts in terms.items():
        scores = []
        for d, length, c in counts:
            m = 10 + 90 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((s, d))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, rank + 1, d, s) for rank, (s, d) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("k,shard,block", [(10, 8 << 20, 1 << 20), (3, 3000, 40), (1000, 20000, 1 << 20)])
def test_search_by_brute_force(spark, k, shard, block):
    docs = spark.createDataFrame(documents(), DOC).repartition(3)
    asked = spark.createDataFrame([(*x, 1) for x in items()], "item_id int, text string, doc_id int").repartition(2)
    got = [tuple(r) for r in ranked_search.search(docs, asked, k, shard, block).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, ranked(documents(), items(), k)))


def test_search_of_empty_tables(spark):
    docs, asked = spark.createDataFrame(documents(), DOC), spark.createDataFrame(items(), "item_id int, text string")
    assert ranked_search.search(docs.limit(0), asked).count() == 0
    assert ranked_search.search(docs, asked.limit(0)).count() == 0


def test_search_stops_before_the_lists_end():
    """The threshold ends the reading: most postings of a common term are never read where a rare term decides."""
    from pyarrow import RecordBatch, array

    n = 4000
    texts = [f"common{' common' * (k % 3)} filler{k} " + ("rare rare rare" if k % 400 == 0 else "x" * (k % 50)) for k in range(n)]
    row = next(ranked_search._build(n, 4 * n, 1 << 30)(iter([RecordBatch.from_arrays([array(range(n)), array(texts)], names=["doc_id", "text"])])))
    one = {name: row.column(c)[0].values if name == "names" else row.column(c)[0].as_py() for c, name in enumerate(ranked_search.FIELDS)}
    shard = ranked_search.Shard(one, array(["common", "rare"]))
    looked = []
    whole = shard.looked_up
    shard.looked_up = lambda docs, *a: (looked.append(len(docs)), whole(docs, *a))[1]
    none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    best = shard.search(np.array([0, 1]), np.array([10, 6000]), none, 10)
    assert sorted(best[2].tolist()) == [k for k in range(n) if k % 400 == 0] and sum(looked) < n // 10
    assert not shard.met.any()


# ---------------------------------------------------------------- audit
def spread(seed: int = 6) -> list[tuple]:
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "Ünd", "of", "é", "zz") for b in "abcdefgh"]
    rows = []
    for k in range(160):
        lang, source = r.choice(["en", "de"]), f"s{r.choice([0, 0, 0, 1, 2, 3])}"
        some = words[: 20 + 5 * int(source[1])]
        rows.append((k, " ".join(r.choice(some).upper() + r.choice(["", "1", "-"]) for _ in range(r.choice([1, 4, 30]))), lang, source))
    rows += [(900, None, "en", "silent"), (901, "", "xx", "one"), (902, "thea", None, None), (903, "thea ofb", "", None), (904, "thea", None, ""), (905, "lonely", "yy", "a"), (906, None, "yy", "b"), rows[0], rows[0], (907, "thea " * 30000, "de", "s9")]
    return rows


def audited(rows: list[tuple], top: int) -> list[tuple]:
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))) for _, t, lang, source in rows]
    out = []
    for lang in {x[0] for x in texts}:
        own = [x for x in texts if x[0] == lang]
        sources = sorted({x[1] for x in own})
        df: dict = {}
        for _, _, t in own:
            for x in set(t):
                df[x] = df.get(x, 0) + 1
        kept = sorted(t for t, n in df.items() if n >= 3)
        counts = {s: {t: sum(x[2].count(t) for x in own if x[1] == s) for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}

        def f(a, b):
            return (a - b) ** 2 // b

        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, v, k + 1) for part, x in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(x)]
    return out


@pytest.mark.parametrize("top,block", [(200, 8 << 20), (3, 300)])
def test_audit_by_brute_force(spark, top, block):
    df = spark.createDataFrame([(*x, "a", 1) for x in spread()], "doc_id long, text string, lang string, source string, term string, n int").repartition(3)
    got = [tuple(r) for r in source_divergence.audit(df, top, block_bytes=block).collect()]
    assert sorted(got) == sorted(audited(spread(), top))


def test_audit_of_nothing_and_of_single_terms(spark):
    kind = "doc_id long, text string, lang string, source string"
    assert source_divergence.audit(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, "de", "x")]  # no term is in three documents
    got = sorted(tuple(r) for r in source_divergence.audit(spark.createDataFrame(rows, kind)).collect())
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_are_exact_beyond_64_bits():
    counts, totals = [0, 10**12, 10**13, 8 * 10**14], [3 * 10**13, 3 * 10**13, 10**13 + 7, 9 * 10**14]
    assert source_divergence.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals, strict=True)]
