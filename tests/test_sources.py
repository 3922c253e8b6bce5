"""Readers: strict files, symbol indexes, growing transcripts, payloads that are none."""

from __future__ import annotations

import json

import pytest

from workmap.sources import files, history, payloads

RATES = "{input = 1, cache_write_5m = 1, cache_write_1h = 1, cache_read = 1, output = 2}"


@pytest.mark.parametrize(
    "text",
    [
        "nothing",
        'updated = "2025-02-30"\n[models]',
        f'updated = "2025-01-01"\nmore = 1\n[models.a]\nstandard = {RATES}',
        f'updated = "2025-01-01"\n[models.a]\nlong_prompt = {RATES}\nstandard = {RATES}',
        'updated = "2025-01-01"\n[models.a]\nstandard = {input = -1, cache_write_5m = 1, cache_write_1h = 1, cache_read = 1, output = 2}',
        'updated = "2025-01-01"\n[models.a]\nfast = {input = 1}',
    ],
)
def test_bad_prices_are_refused(text):
    with pytest.raises(files.BadFile):
        files.parse_prices(text)


def test_facts_go_round():
    rows = [(2, "b", "approved"), (1, "ä", "proposed")]
    assert files.parse_facts(files.facts_text(rows)) == sorted(rows)
    assert files.facts_text(rows) == files.facts_text(rows[::-1])
    for bad in ("[]", '{"version": 2, "facts": []}', json.dumps({"version": 1, "facts": [{"fact_id": 1}]})):
        with pytest.raises(files.BadFile):
            files.parse_facts(bad)


def message(*fields):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in fields)


def test_symbol_index(spark):
    occurrence = lambda line, symbol, roles: message((1, bytes([line, 0, 5])), (2, symbol.encode()), (3, roles))
    doc = message((1, b"src/a.rs"), (2, occurrence(3, "pkg a()", 1)), (2, occurrence(9, "pkg b()", 8)), (2, occurrence(1, "local 1", 0)))
    data = message((1, b"metadata"), (2, doc), (2, message((1, b"empty.rs"))))
    assert files.parse_scip(data) == [("src/a.rs", "pkg a()", 4, True), ("src/a.rs", "pkg b()", 10, False)]
    assert files.scip_occurrences(spark.createDataFrame([(data,), (b"",)], "content binary")).count() == 2
    with pytest.raises(files.BadFile):
        files.parse_scip(data, most=1)


def test_tail_waits_for_ends_and_starts_over(spark):
    texts = spark.createDataFrame([("a", b"one\ntwo\nthr"), ("b", b"new\n"), ("c", "é\n".encode())], "file string, content binary")
    offsets = spark.createDataFrame([("a", 4), ("b", 99)], "file string, at long")
    lines, after = files.tailed(texts, offsets)
    assert sorted((r.file, r.line) for r in lines.collect()) == [("a", "two"), ("b", "new"), ("c", "é")]
    assert {r.file: r["at"] for r in after.collect()} == {"a": 8, "b": 4, "c": 3}


def test_payloads_that_say_nothing(spark):
    df = spark.createDataFrame([("no json",), (None,), ("{}",), ('{"hook_event_name":"PostToolUseFailure","tool_name":"Bash","tool_input":{"command":"x"}}',)], "value string")
    got = payloads.events(df).collect()
    assert [r.kind for r in got] == [None, None, None, "command"] and got[3].failed and got[3].command == "x"


def test_blame_runs_and_cards(spark):
    oid = "a" * 40
    text = "\n".join([f"{oid} 5 1 2", "author X", "\tcode", f"{oid} 6 2", "\tcode", f"{'b' * 40} 1 3 1", "\tx", f"{oid} 9 4 1", "\ty"])
    got = sorted((r.oid[0], r.first, r.last, r.source) for r in history.blame_runs(spark.createDataFrame([(1, text)], "file int, text string")).collect())
    assert got == [("a", 1, 2, 5), ("a", 4, 4, 9), ("b", 3, 3, 1)]
    commits = [("1", "dep[bot]", "Bump x", "", 1), ("2", "A", "Fix typo", None, 1), ("3", "A", "Add y (#12)", "Why so.\nFixes #4\nFixes #5\nCloses #6\nRefs #7", 2), ("4", "A", "Sweep", "", 99)]
    cards = {r.oid: r for r in history.cards(spark.createDataFrame(commits, "oid string, author string, subject string, body string, n_files int")).collect()}
    assert [cards[k].kind for k in "1234"] == ["bot", "trivial", "normal", "mass"]
    assert (cards["3"].pull_request, cards["3"].issues, cards["3"].reason) == (12, ["#4", "#5", "#6"], "Why so.")
