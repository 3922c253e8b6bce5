"""Command lines, check output and prompts. Lines are made from the tables' keys, so that SQL knows what they say."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from workmap.functions import commands as C
from workmap.functions.scalar import failing_signature
from workmap.plans.relations import statement

_LINE = "case seq % 6 when 0 then 'cd app && pytest -q' when 1 then 'RUST_LOG=x cargo test --workspace' when 2 then 'npx jest src/a.test.ts | tee out' when 3 then 'go build ./... && go test ./...' when 4 then 'echo \"pytest\"; ls' else 'cargo clippy --all && tsc -p .' end"


def _lines(r):
    return r.acts.where("kind in ('check', 'prompt', 'read', 'edit')").select("seq", F.expr(_LINE).alias("line"))


_WHERE = "from acts where kind in ('check', 'prompt', 'read', 'edit')"


@statement(f"select seq, case seq % 6 when 0 then 'pytest/test' when 1 then 'cargo test/test' when 2 then 'jest/test' when 3 then 'go build/build,go test/test' when 4 then '' else 'clippy/lint,tsc/type_check' end checks {_WHERE}")
def command_runners(r):
    """Which checks a command line runs."""
    return _lines(r).select("seq", F.array_join(C.runners("line"), ",").alias("checks"))


@statement(f"select seq, case seq % 6 when 0 then 'pytest -q@app' when 1 then 'cargo test --workspace@' when 2 then 'npx jest src/a.test.ts@;tee out@' when 3 then 'go build ./...@;go test ./...@' when 4 then 'echo pytest@;ls@' else 'cargo clippy --all@;tsc -p .@' end parts {_WHERE}")
def shell_commands(r):
    """The commands of a line with the folder each runs in."""
    part = F.transform(C.commands("line"), lambda c: F.concat(F.array_join(c["words"], " "), F.lit("@"), c["folder"]))
    return _lines(r).select("seq", F.array_join(part, ";").alias("parts"))


@statement(f"select seq, seq % 6 in (0, 1, 3) whole {_WHERE}")
def whole_suites(r):
    return _lines(r).select("seq", C.runs_whole_suite("line").alias("whole"))


@statement(f"select seq, case seq % 6 when 0 then 'cd app && pytest -q t/test_' || seq || '.py' when 3 then 'go test ./app/t' end line {_WHERE}")
def narrow_commands(r):
    """The line that runs one test file only."""
    file = F.concat(F.lit("app/t/test_"), F.col("seq").cast("string"), F.lit(".py"))
    return _lines(r).select("seq", C.narrowed("line", F.array(file)).alias("line"))


@statement("select seq, case seq % 4 when 0 then 'curl -H \"Authorization: Bearer <redacted>\" http://h/' || seq when 1 then 'API_KEY=<redacted> run ' || seq when 2 then 'git clone https://me:<redacted>@h/r' || seq else 'deploy --password <redacted> -v ' || seq end line from acts where kind = 'check'")
def clean_commands(r):
    """Credentials out of command lines."""
    s = F.col("seq").cast("string")
    secret = F.concat(F.lit("ghp_"), F.md5(s))
    m = F.col("seq") % 4
    line = F.when(m == 0, F.concat(F.lit('curl -H "Authorization: Bearer '), F.md5(s), F.lit('" http://h/'), s)).when(m == 1, F.concat(F.lit("API_KEY="), secret, F.lit(" run "), s)).when(m == 2, F.concat(F.lit("git clone https://me:"), F.md5(s), F.lit("@h/r"), s)).otherwise(F.concat(F.lit("deploy --password "), F.md5(s), F.lit(" -v "), s))
    return r.acts.where("kind = 'check'").select("seq", C.cleaned(line).alias("line"))


_OUTPUT = """case seq % 4 when 0 then 'FAILED t/test_a.py::test_' || seq || ' - assert\nt/test_a.py:' || seq || ': AssertionError\n=== 1 failed, ' || (seq % 7) || ' passed in 0.1s ==='
 when 1 then 'test m::t' || seq || ' ... FAILED\nthread panicked at src/lib.rs:' || seq || ':5\ntest result: FAILED. ' || (seq % 7) || ' passed; 1 failed; 0 ignored'
 when 2 then '--- FAIL: Test' || seq || ' (0.00s)\n    a_test.go:' || seq || ': got 1\n--- PASS: TestB (0.00s)' else 'src/a.ts(' || seq || ',5): error TS2322: no' end"""


@statement("select seq, case seq % 4 when 0 then seq % 7 when 1 then seq % 7 when 2 then 1 else 0 end::int passed, 1 failed, case seq % 4 when 0 then 't/test_a.py::test_' || seq when 1 then 'm::t' || seq when 2 then 'Test' || seq else '' end tests, case seq % 4 when 0 then 't/test_a.py' when 1 then 'src/lib.rs' when 2 then 'a_test.go' else 'src/a.ts' end || ':' || seq frames from acts where kind in ('check', 'read', 'edit')")
def failures_parsed(r):
    """Counts, failing tests and places from four runners' output."""
    runner = F.element_at(F.array(*map(F.lit, ("pytest", "cargo test", "go test", "tsc"))), (F.col("seq") % 4 + 1).cast("int"))
    f = r.acts.where("kind in ('check', 'read', 'edit')").select("seq", C.failures(runner, F.expr(_OUTPUT)).alias("f"))
    frames = F.array_join(F.transform("f.frames", lambda x: F.concat_ws(":", x["path"], x["line"].cast("string"))), ",")
    return f.select("seq", "f.passed", "f.failed", F.array_join("f.tests", ",").alias("tests"), frames.alias("frames"))


@statement("select task_id task, md5(string_agg(t, chr(10) order by t)) signature from (select distinct task_id, 'test_' || cast(node_id % 9 as string) t from acts where kind = 'check' and task_id is not null) group by 1")
def failing_signatures(r):
    """The same for the same failing tests in any order."""
    t = r.acts.where("kind = 'check' and task_id is not null").groupBy(F.col("task_id").alias("task")).agg(F.collect_list(F.concat(F.lit("test_"), (F.col("node_id") % 9).cast("string"))).alias("t"))
    return t.select("task", failing_signature(F.col("t")).alias("signature"))


#: Words that say nothing about a question.
STOP_WORDS = ("the", "a", "an", "to", "in", "of", "and", "is", "it", "for", "on", "with", "this", "that", "please", "fix")
_PROMPT = "'Please fix ' || name || ' in ' || path || ':' || cast(start_line as string) || ' and the ' || kind || ' ' || name"
_PROMPTS = f"pr as (select symbol_id query, {_PROMPT} prompt from symbols join files using (file_id))"


def _prompts(r):
    return r.symbols.join(r.files.select("file_id", "path"), "file_id").select(F.col("symbol_id").alias("query"), F.expr(_PROMPT).alias("prompt"))


@statement(f"with {_PROMPTS}, w as (select query, unnest(list_filter(regexp_split_to_array(lower(prompt), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) word from pr) select query, word, count(*) n from w where word not in {STOP_WORDS} group by 1, 2")
def prompt_words(r):
    """The words of a prompt that say something, counted."""
    w = _prompts(r).select("query", F.explode(F.filter(F.split(F.lower("prompt"), r"[^\p{L}\p{N}_]+"), lambda x: x != "")).alias("word"))
    return w.where(~F.col("word").isin(*STOP_WORDS)).groupBy("query", "word").agg(F.count("*").alias("n"))


_MENTIONS = "mn as (select query, unnest(regexp_extract_all(prompt, '[A-Za-z0-9_./-]+/[A-Za-z0-9_./-]+\\.[a-z]{1,10}(?::[0-9]+)?|[a-z]+_[0-9]+')) m from pr)"


def _mentions(r):
    return _prompts(r).select("query", F.explode(F.regexp_extract_all("prompt", F.lit(r"([A-Za-z0-9_./-]+/[A-Za-z0-9_./-]+\.[a-z]{1,10}(?::[0-9]+)?|[a-z]+_[0-9]+)"))).alias("m"))


@statement(f"with {_PROMPTS}, {_MENTIONS} select query, m mention, count(*) n from mn group by 1, 2")
def prompt_mentions(r):
    """Paths, with their lines, and names that a prompt mentions."""
    return _mentions(r).groupBy("query", F.col("m").alias("mention")).agg(F.count("*").alias("n"))


@statement(f"with {_PROMPTS}, {_MENTIONS}, c as (select query, m, count(*) n from mn group by 1, 2) select query, m mention, n::double / max(n) over (partition by query) prominence from c qualify row_number() over (partition by query order by n desc, m) <= 3")
def prominent_mentions(r):
    c = _mentions(r).groupBy("query", "m").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query")
    k = F.row_number().over(w.orderBy(F.desc("n"), "m"))
    return c.withColumn("prominence", F.col("n") / F.max("n").over(w)).withColumn("k", k).where("k <= 3").select("query", F.col("m").alias("mention"), "prominence")


@statement("with p as (select number, 'see #' || number || ' and !' || (number + 7) || ' not the #1 thing, color #ffaa' || (number % 10) || '0, commit ' || substr(oid, 1, 8) || ' or 1st' prompt from cards), x as (select number, unnest(regexp_extract_all(prompt, '(?:^|[^A-Za-z0-9])([#!][0-9]+)(?:[^A-Za-z0-9]|$)', 1)) n from p) select number query, n named from x where substr(n, 2)::bigint >= 10 union all select number, c from (select number, unnest(regexp_extract_all(prompt, '(?:^|[^A-Za-z0-9#])([0-9a-f]{7,40})(?:[^A-Za-z0-9]|$)', 1)) c from p)")
def named_changes(r):
    """Change numbers and beginnings of commit ids in a prompt; small numbers, ordinals and colours aren't any."""
    c = r.cards.select("number", F.expr("concat('see #', number, ' and !', number + 7, ' not the #1 thing, color #ffaa', number % 10, '0, commit ', substr(oid, 1, 8), ' or 1st')").alias("prompt"))
    numbers = c.select(F.col("number").alias("query"), F.explode(F.regexp_extract_all("prompt", F.lit(r"(?:^|[^A-Za-z0-9])([#!][0-9]+)(?:[^A-Za-z0-9]|$)"))).alias("named")).where(F.expr("cast(substr(named, 2) as bigint)") >= 10)
    oids = c.select(F.col("number").alias("query"), F.explode(F.regexp_extract_all("prompt", F.lit(r"(?:^|[^A-Za-z0-9#])([0-9a-f]{7,40})(?:[^A-Za-z0-9]|$)"))).alias("named"))
    return numbers.unionByName(oids)
