"""Co-change over renamed history: hand-made cases, and a walk from the newest commit back as a plain reference."""

from __future__ import annotations

import random

from workmap.operators import cochange

KIND = "seq long, path string, renamed_from string"


def followed(rows):
    """{(seq, path): name now}, walking from the newest commit back."""
    now: dict[str, str] = {}
    out = {}
    for seq in sorted({r[0] for r in rows}, reverse=True):
        own = [r for r in rows if r[0] == seq]
        for _, path, _ in own:
            out[seq, path] = now.get(path, path)
        noted = {old: now.get(path, path) for _, path, old in sorted(own, key=lambda r: r[1]) if old is not None}
        now |= noted
    return out


def check(spark, rows):
    got = {(r.seq, r.file) for r in cochange.under_todays_names(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {(seq, name) for (seq, _), name in followed(rows).items()}
    return got


def test_a_renamed_file_is_one_file(spark):
    assert check(spark, [(1, "old", None), (1, "x", None), (2, "old", None), (3, "new", "old"), (4, "new", None)]) == {(1, "new"), (1, "x"), (2, "new"), (3, "new"), (4, "new")}


def test_a_path_used_again_is_another_file(spark):
    rows = [(1, "a", None), (2, "b", "a"), (3, "a", None), (4, "a", None), (5, "c", "a"), (6, "a", None)]
    assert check(spark, rows) == {(1, "b"), (2, "b"), (3, "c"), (4, "c"), (5, "c"), (6, "a")}


def test_renames_of_one_commit_keep_apart(spark):
    # a becomes b while b becomes c; then two files swap
    check(spark, [(1, "a", None), (1, "b", None), (2, "b", "a"), (2, "c", "b"), (3, "b", None)])
    check(spark, [(1, "p", None), (2, "q", None), (3, "p", "q"), (3, "q", "p"), (4, "p", None)])
    check(spark, [(1, "p", None), (2, "q", "p"), (2, "p", None), (3, "p", "q"), (4, "p", None)])


def test_long_chains_and_random_histories(spark):
    chain = [(k, f"n{k}", f"n{k - 1}" if k else None) for k in range(70)]
    assert check(spark, chain) == {(k, "n69") for k in range(70)}
    r = random.Random(9)
    for _ in range(3):
        rows = {}
        for seq in range(60):
            for path in r.sample("abcdefgh", r.randrange(1, 4)):
                rows[seq, path] = r.choice([None, None, *"abcdefgh"])
            taken = set()
            for key in [k for k in rows if k[0] == seq]:  # a path is renamed once in a commit, and not to itself
                if rows[key] in taken or rows[key] == key[1]:
                    rows[key] = None
                taken.add(rows[key])
        check(spark, [(*k, v) for k, v in rows.items()])


def test_history_without_renames_and_without_rows(spark):
    assert check(spark, [(1, "a", None), (2, "b", None)]) == {(1, "a"), (2, "b")}
    assert cochange.under_todays_names(spark.createDataFrame([], KIND)).count() == 0


def test_files_that_are_gone_do_not_count(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "c", "a")], KIND)
    current = spark.createDataFrame([("c",)], "file string")
    assert sorted((r.seq, r.file) for r in cochange.under_todays_names(rows, current).collect()) == [(1, "c"), (2, "c")]
