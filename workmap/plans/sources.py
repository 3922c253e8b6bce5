"""Readers held against the tables that their texts were made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from workmap.functions.scalar import utc_text
from workmap.plans.adapters import table
from workmap.plans.registry import query
from workmap.plans.relations import statement
from workmap.sources import files, history, payloads, readers

_SHAPES = {
    0: """concat('{"session_id":"', s, '","cwd":"/r","hook_event_name":"PostToolUse","tool_name":"Read","tool_input":{"file_path":"', p, '","offset":', n, '}}')""",
    1: """concat('{"conversation_id":"', s, '","workspaceRoots":["/r"],"hook_event_name":"postToolUse","tool_name":"Shell","tool_input":{"cmd":"ls ', p, '"}}')""",
    2: """concat('{"taskId":"', s, '","workspaceRoots":["/r"],"hookName":"PostToolUse","postToolUse":{"toolName":"replace_in_file","parameters":{"path":"', p, '"}}}')""",
    3: """concat('{"sessionId":"', s, '","cwd":"/r","hook_event_name":"AfterTool","toolCall":{"name":"grep_search","args":{"Query":"q', n, '","SearchPath":"', p, '"}}}')""",
    4: """concat('{"session_id":"', s, '","working_dir":"/r","event_type":"pre_llm_call","extra":{"user_message":"do ', n, '"}}')""",
    5: """concat('{"session_id":"', s, '","cwd":"/r","hook_event_name":"PreCompress"}')""",
}


@statement("""select seq, cast(session_id as string) session, '/r' cwd, case seq % 6 when 0 then 'read' when 1 then 'command' when 2 then 'edit' when 3 then 'search' when 4 then 'prompt' else 'compact' end kind, case when seq % 6 in (0, 2, 3) then path end path, case when seq % 6 = 1 then 'ls ' || path end command,
case when seq % 6 = 3 then 'q' || seq end pattern, case when seq % 6 = 0 then seq end first, case when seq % 6 = 4 then 'do ' || seq end prompt from acts join files on file_id = node_id""")
def payload_events(r):
    """Payloads of six shapes, as agents send them, in one relation."""
    a = r.acts.join(r.files.select(F.col("file_id").alias("node_id"), "path"), "node_id").select("seq", F.col("session_id").cast("string").alias("s"), F.col("path").alias("p"), F.col("seq").cast("string").alias("n"))
    value = F.expr("case " + " ".join(f"when seq % 6 = {k} then {e}" for k, e in _SHAPES.items()) + " end")
    return payloads.events(a.select("seq", value.alias("value"))).select("seq", "session", "cwd", "kind", "path", "command", "pattern", "first", "prompt")


@statement("select distinct l_orderkey commit_, l_partkey file, case when l_returnflag = 'R' then l_partkey + 1 end renamed_from from lineitem")
def git_listing(r):
    """A log listing made of orders and their lines, parsed again."""
    ch = r.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("R100\tf"), (F.col("l_partkey") + 1).cast("string"), F.lit("\tf"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("M\tf"), F.col("l_partkey").cast("string")))
    record = ch.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    listing = record.select(F.concat(F.lit("\u0000"), F.lpad(F.col("l_orderkey").cast("string"), 40, "0"), F.lit(" p1 p2|"), F.col("l_orderkey").cast("string"), F.lit("\n"), "lines", F.lit("\n")).alias("value"))
    c = readers.commits_of_listing(listing)
    return c.select(F.col("at").alias("commit_"), F.substr("path", F.lit(2)).cast("long").alias("file"), F.substr("renamed_from", F.lit(2)).cast("long").alias("renamed_from")).distinct()


_BLAME = "bl as (select l_partkey file, l_linenumber l, md5(cast(l_suppkey % 3 as string)) || '00000000' oid, 100 + l_linenumber * (1 + l_suppkey % 3 // 2) s from (select l_partkey, l_linenumber, min(l_suppkey) l_suppkey from lineitem group by 1, 2))"


@query(f"with {_BLAME}, k as (select *, l - row_number() over (partition by file, oid, l - s order by l) i from bl) select file, oid, min(l) as first, max(l) as last, min(s) source from k group by file, oid, l - s, i")
def blame_parsed(spark, d):
    """Blame listings parsed to runs of lines."""
    b = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("l")).agg(F.min("l_suppkey").alias("u"))
    m = F.col("u") % 3
    s = F.lit(100) + F.col("l") * F.when(m == 2, 2).otherwise(1)
    head = F.concat_ws(" ", F.concat(F.md5(m.cast("string")), F.lit("00000000")), s.cast("string"), F.col("l").cast("string"))
    text = b.select("file", "l", F.concat(head, F.lit("\nauthor A\n\tcode of the line")).alias("t")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return history.blame_runs(text)


_MESSAGE = "case o_orderkey % 5 when 0 then 'Fix typo in docs' when 1 then 'Add a thing (#' || cast(o_orderkey as string) || ')' when 2 then 'Typos fixed' else 'Change ABC-' || cast(o_orderkey as string) || ' and more' end"


@query("select md5(cast(o_orderkey as string)) oid, case when o_orderkey % 40 = 7 then 'mass' when o_orderkey % 11 = 0 then 'bot' when o_orderkey % 5 in (0, 2) then 'trivial' else 'normal' end kind, case when o_orderkey % 5 = 1 then o_orderkey end pull_request, case when o_orderkey % 5 in (3, 4) then 'ABC-' || o_orderkey || ',' else '' end || '#' || (o_orderkey % 100) issues, 'Because of ' || o_orderkey reason from orders")
def cards_read(spark, d):
    """Commit messages as cards."""
    k = F.col("o_orderkey").cast("string")
    c = table(spark, d, "orders").select(
        F.md5(k).alias("oid"), F.when(F.col("o_orderkey") % 11 == 0, "renovate[bot]").otherwise("Ann").alias("author"), F.expr(_MESSAGE).alias("subject"),
        F.concat(F.lit("\nBecause of "), k, F.lit("\nFixes #"), (F.col("o_orderkey") % 100).cast("string"), F.lit("\nSigned-off-by: x")).alias("body"), F.when(F.col("o_orderkey") % 40 == 7, 31).otherwise(3).alias("n_files"),
    )
    return history.cards(c).select("oid", "kind", "pull_request", F.array_join("issues", ",").alias("issues"), "reason")


@statement("select path, case when file_id % 3 = 0 then 'M' when file_id % 3 = 1 then '??' else 'R' end state from files order by path limit 1000")
def uncommitted_files(r):
    """A work tree's short status, parsed."""
    m = F.col("file_id") % 3
    line = F.when(m == 0, F.concat(F.lit(" M "), "path")).when(m == 1, F.concat(F.lit("?? "), "path")).otherwise(F.concat(F.lit("R  old/x -> "), "path"))
    # a tree's status is as long as its files are many: a text for each folder, as its own work tree gives
    text = r.files.groupBy(F.substring_index("path", "/", 2).alias("folder")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return history.uncommitted(text.select("text"))


@query("select o_custkey session, 'm' || o_orderkey response, 'model-' || (o_orderkey % 3) model, o_orderkey * 1000 ts, o_orderkey % 700 input, o_orderkey % 97 + 5 output from orders")
def transcripts_by_message(spark, d):
    """Transcripts with a line for each block of a message: a message counts once, with its largest output."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("block", F.explode(F.array(F.lit(0), F.lit(5))))
    usage = F.struct((k % 700).alias("input_tokens"), F.lit(0).alias("cache_creation_input_tokens"), F.lit(0).alias("cache_read_input_tokens"), (k % 97 + F.col("block")).alias("output_tokens"))
    message = F.struct(F.concat(F.lit("m"), k.cast("string")).alias("id"), F.concat(F.lit("model-"), (k % 3).cast("string")).alias("model"), usage.alias("usage"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), utc_text(k * 1000 + F.col("block")).alias("timestamp"), message.alias("message")))
    return readers.usage_of_messages(o.select(F.col("o_custkey").alias("session"), line.alias("value"))).select("session", "response", "model", "ts", "input", "output")


@query("with o as (select o_custkey session, o_orderkey line, case when o_orderkey % 3 = 0 then 'model-' || (o_orderkey % 5) end m from orders), w as (select *, last_value(m ignore nulls) over (partition by session order by line) model from o) select session, 'r' || line response, model, greatest(line % 900 - line % 90, 0) input, line % 90 cache_read, line % 41 output from w where line % 3 <> 0")
def transcripts_by_record(spark, d):
    """Transcripts whose model stands in the last context line before a record."""
    k = F.col("o_orderkey")
    context = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.concat(F.lit("model-"), (k % 5).cast("string")).alias("model")))
    usage = F.struct((k % 900).alias("input_tokens"), (k % 90).alias("cached_input_tokens"), (k % 41).alias("output_tokens"))
    record = F.to_json(F.struct(F.lit("token_usage_record").alias("type"), utc_text(k * 1000).alias("timestamp"), F.concat(F.lit("r"), k.cast("string")).alias("response_id"), usage.alias("usage")))
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), k.alias("line"), F.when(k % 3 == 0, context).otherwise(record).alias("value"))
    return readers.usage_of_records(lines).select("session", "response", "model", "input", "cache_read", "output")


@statement("select session_id file, seq from acts where seq > 3000 and seq < 12000")
def transcripts_tailed(r):
    """Lines behind a mark in files that grow; the last line, which has no end yet, waits."""
    line = F.concat(F.lpad(F.col("seq").cast("string"), 8, "0"), F.lit("\n"))
    text = r.acts.groupBy(F.col("session_id").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("seq") < 12_000, line))), "").alias("t"), F.count_if(F.col("seq") <= 3000).alias("read"))
    texts = text.select("file", F.encode(F.concat("t", F.lit("half a li")), "UTF-8").alias("content"))
    lines, _ = files.tailed(texts, text.select("file", (F.col("read") * 9).cast("long").alias("at")))
    return lines.select("file", F.col("line").cast("long").alias("seq"))


@query("with t as (select o_orderkey k, make_timestamp(o_orderkey * 12345678) ts from orders) select k, o ms, strftime(make_timestamp(o * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as text from (select k, k * 123456789 % 4102444800000 o from t)")
def timestamps_read(spark, d):
    """Times to text and back."""
    ms = F.col("o_orderkey") * 123_456_789 % 4_102_444_800_000
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), utc_text(ms).alias("text"))
    return t.select("k", readers.utc_ms(F.col("text")).alias("ms"), "text")


@statement("""select file_id, case file_id % 4 when 0 then 'rust' when 1 then 'python' when 2 then 'typescript' else 'go' end || case when file_id % 10 = 0 then '/generated' when file_id % 10 = 1 then '/vendored' when file_id % 10 = 2 then '/test' else '' end as what, file_id % 10 = 3 secret from files""")
def paths_judged(r):
    """Language, flags and secrets by path."""
    m = F.col("file_id") % 10
    path = F.when(m == 0, F.concat(F.lit("dist/"), "path")).when(m == 1, F.concat(F.lit("vendor/"), "path")).when(m == 2, F.concat(F.lit("tests/"), "path")).otherwise(F.col("path"))
    flag = readers.flags(path)
    named = F.when(flag == readers.GENERATED, "/generated").when(flag == readers.VENDORED, "/vendored").when(flag == readers.TEST, "/test").otherwise("")
    return r.files.select("file_id", F.concat(readers.language(path), named).alias("what"), readers.is_secret(F.when(m == 3, F.concat(F.lit("a/"), F.col("file_id").cast("string"), F.lit(".pem"))).otherwise(F.col("path"))).alias("secret"))


@query("select * from (values ('m-one', 3000000, 15000000, 4000, 1100), ('m-two', 800000, 4000000, null, null)) t(model, input, output, above, us_per_mille)")
def prices_read(spark, d):
    """A price file in dollars a million tokens as picodollars a token."""
    text = """updated = "2025-01-31"
[models.m-one]
long_prompt_above_tokens = 4000
us_only = 1.1
standard = {input = 3, cache_write_5m = 3.75, cache_write_1h = 6, cache_read = 0.3, output = 15}
long_prompt = {input = 6, cache_write_5m = 7.5, cache_write_1h = 12, cache_read = 0.6, output = 22.5}
[models.m-two]
standard = {input = 0.8, cache_write_5m = 1, cache_write_1h = 1.6, cache_read = 0.08, output = 4}
"""
    return files.prices(spark, text).select("model", "standard.input", "standard.output", "above", "us_per_mille")

