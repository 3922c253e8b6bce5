"""JSON lines, commit listings and file trees as relations, by explicit schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Payload fields read into an event; the schemas of two kinds of transcript lines.
PAYLOAD = """session_id string, transcript_path string, cwd string, prompt string, source string, hook_event_name string, tool_name string,
 tool_input struct<file_path: string, old_string: string, new_string: string, offset: long, `limit`: long, command: string, pattern: string>,
 tool_response struct<filePath: string, structuredPatch: array<struct<oldStart: int, oldLines: int, newStart: int, newLines: int, lines: array<string>>>>,
 reason string, stop_hook_active boolean, duration_ms long"""
MESSAGES = """type string, timestamp string, message struct<id: string, model: string, usage: struct<input_tokens: long, cache_creation_input_tokens: long,
 cache_read_input_tokens: long, output_tokens: long, cache_creation: struct<ephemeral_5m_input_tokens: long, ephemeral_1h_input_tokens: long>>>"""
RECORDS = """type string, timestamp string, response_id string, model string, usage struct<input_tokens: long, cached_input_tokens: long,
 cache_write_input_tokens: long, output_tokens: long, reasoning_output_tokens: long>"""
EDIT_TOOLS, READ_TOOLS, RUN_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit"), ("Read",), ("Bash",)


def events_of_payloads(lines: DataFrame, value: str = "value") -> DataFrame:
    """Hook payloads, one JSON object a row, as events; rows that aren't objects give nulls throughout."""
    p = lines.select(F.from_json(value, PAYLOAD).alias("p")).select("p.*")
    kind = (
        F.when(F.col("hook_event_name") == "UserPromptSubmit", "prompt")
        .when(F.col("hook_event_name") == "PreCompact", "compact")
        .when(F.col("tool_name").isin(*EDIT_TOOLS), "edit")
        .when(F.col("tool_name").isin(*READ_TOOLS), "read")
        .when(F.col("tool_name").isin(*RUN_TOOLS), "command")
        .when(F.col("tool_name").isNotNull(), "search")
    )
    first = F.col("tool_input.offset")
    ranges = F.when(first.isNotNull(), F.array(F.struct(first.alias("first"), (first + F.coalesce("tool_input.limit", F.lit(1)) - 1).alias("last"))))
    hunks = F.transform("tool_response.structuredPatch", lambda h: F.struct(h["newStart"].cast("long").alias("first"), (h["newStart"] + h["newLines"] - 1).cast("long").alias("last")))
    path = F.coalesce("tool_response.filePath", "tool_input.file_path")
    return p.select("session_id", "cwd", F.col("hook_event_name").alias("hook"), "source", F.col("tool_name").alias("tool"), kind.alias("kind"), path.alias("path"), F.coalesce(hunks, ranges).alias("ranges"), F.col("tool_input.command").alias("command"), F.col("prompt").alias("prompt_text"), F.col("reason").alias("end_reason"))


def usage_of_messages(lines: DataFrame, session: str = "session", value: str = "value") -> DataFrame:
    """Token usage of transcripts with one line for each content block: a message's blocks repeat its id and its largest output counts."""
    m = lines.select(session, F.from_json(value, MESSAGES).alias("m")).where("m.type = 'assistant' and m.message.usage is not null")
    u = m.select(session, F.col("m.message.id").alias("response"), F.col("m.message.model").alias("model"), utc_ms(F.col("m.timestamp")).alias("ts"), "m.message.usage.*")
    biggest = F.max(F.struct("output_tokens", "ts", "model", "input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", F.col("cache_creation.ephemeral_1h_input_tokens").alias("one_hour"))).alias("b")
    return u.groupBy(session, "response").agg(biggest, F.min("ts").alias("ts")).select(session, "response", "ts", F.col("b.model").alias("model"), F.coalesce("b.input_tokens", F.lit(0)).alias("input"), F.coalesce("b.cache_creation_input_tokens", F.lit(0)).alias("cache_write"), F.col("b.one_hour").alias("cache_write_1h"), F.coalesce("b.cache_read_input_tokens", F.lit(0)).alias("cache_read"), F.coalesce("b.output_tokens", F.lit(0)).alias("output"))


def usage_of_records(lines: DataFrame, session: str = "session", line: str = "line", value: str = "value") -> DataFrame:
    """Token usage of transcripts whose model stands in the last context line before; cached input is part of the input there."""
    r = lines.select(session, line, F.from_json(value, RECORDS).alias("r")).select(session, line, "r.*")
    before = Window.partitionBy(session).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("model", F.last(F.when(F.col("type") == "turn_context", F.col("model")), ignorenulls=True).over(before)).where("type = 'token_usage_record'")
    read = F.coalesce("usage.cached_input_tokens", F.lit(0))
    write = F.coalesce("usage.cache_write_input_tokens", F.lit(0))
    return r.select(session, F.col("response_id").alias("response"), utc_ms(F.col("timestamp")).alias("ts"), "model", F.greatest(F.col("usage.input_tokens") - read - write, F.lit(0)).alias("input"), write.alias("cache_write"), read.alias("cache_read"), F.coalesce("usage.output_tokens", F.lit(0)).alias("output"))


def utc_ms(text: Column) -> Column:
    """Milliseconds of an RFC 3339 time; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def commits_of_listing(listing: DataFrame, value: str = "value") -> DataFrame:
    """(oid, parents, at, path, renamed_from) of a log listing: records between NULs, `oid parents|seconds` and then lines of `status<TAB>path[<TAB>new path]`."""
    rec = listing.select(F.explode(F.split(value, "\u0000")).alias("r")).where(F.length(F.trim("r")) > 0)
    lines = rec.select(F.filter(F.split(F.trim("r"), "\n"), lambda x: x != "").alias("l")).select(F.col("l")[0].alias("head"), F.explode_outer(F.slice("l", 2, F.size("l"))).alias("change"))
    head, part = F.split("head", r"\|"), F.split("change", "\t")
    ids = F.split(head[0], " ")
    renamed = part[0].startswith("R")
    return lines.select(ids[0].alias("oid"), F.filter(F.slice(ids, 2, F.size(ids)), lambda x: x != "").alias("parents"), head[1].cast("long").alias("at"), F.when(renamed, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1))).alias("path"), F.when(renamed, F.get(part, F.lit(1))).alias("renamed_from"))


# ---------------------------------------------------------------- files
#: Languages by extension; folders and names whose files are generated or vendored; names of secrets.
EXTENSIONS = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "java": "java", "kt": "kotlin", "scala": "scala", "c": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
    "swift": "swift", "sh": "bash", "lua": "lua", "dart": "dart", "ex": "elixir", "exs": "elixir", "html": "html", "css": "css", "sql": "sql",
}
GENERATED_FOLDERS = ("dist", "build", "target", ".next", "out", "coverage")
VENDORED_FOLDERS = ("node_modules", "vendor", "third_party")
GENERATED_NAME = r"(\.min\.js|\.map|[-.]lock(\.json|file)?|\.lock|go\.sum|lock\.yaml)$"
SECRET_NAME = r"(?i)(^|/)(\.env(\.[^/]*)?|[^/]*\.env|id_rsa[^/]*|id_ed25519[^/]*|[^/]*\.pem|[^/]*\.key|credentials[^/]*|secrets?)(/|$)"
TEST_PATH = r"(?i)((^|/)(tests?|__tests__)/|(^|/)test_[^/]*$|_test\.[^/.]*$|\.(test|spec)\.[^/.]*$)"
VENDORED, GENERATED, TEST = 1, 2, 4
#: Languages by a file's whole name; what tells a C++ header from a C one; what a generator writes at a file's head.
WHOLE_NAMES = {"Makefile": "make", "GNUmakefile": "make", "Dockerfile": "dockerfile", "Rakefile": "ruby", "Gemfile": "ruby", "BUILD": "python", "Jenkinsfile": "groovy", "CMakeLists.txt": "cmake"}
CPP_HEAD = r"(?m)^\s*(class\s+\w+|template\s*<|namespace\s+\w+|using\s+namespace|#include\s*<(iostream|vector|string|memory)>)|\bstd::"
GENERATED_HEAD = r"(?i)(@generated|do not edit|code generated by|automatically generated)"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column, head: Column | None = None) -> Column:
    """By the file's whole name, else its extension, else by the interpreter that its first line names; a .h file is C++ if its head is."""
    extension = F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))
    out = F.lit(None).cast("string")
    for name in sorted(set(EXTENSIONS.values())):
        out = F.when(extension.isin(*[e for e, n in EXTENSIONS.items() if n == name]), name).otherwise(out)
    for whole, name in WHOLE_NAMES.items():
        out = F.when(file_name(path) == whole, name).otherwise(out)
    if head is None:
        return F.when(extension == "h", "c").otherwise(out)
    shebang = F.regexp_extract(head, r"^#!.*?(python|bash|sh|node|ruby|php|lua)[0-9.]*\s*(\n|$)", 1)
    known = F.when(shebang.isin("bash", "sh"), "bash").when(shebang == "node", "javascript").when(shebang != "", shebang)
    return F.when(extension == "h", F.when(head.rlike(CPP_HEAD), "cpp").otherwise("c")).otherwise(F.coalesce(out, known))


def head_kind(head: Column) -> Column:
    """What a file's first bytes say: binary if a NUL is among them, generated if a generator signed, else text."""
    return F.when(F.instr(head, "\u0000") > 0, "binary").when(head.rlike(GENERATED_HEAD), "generated").otherwise("text")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore rules leave a path out: globs as in ignore files, later rules over earlier ones, `!` takes back, a slash anchors, a last one means folders."""
    out = F.lit(False)
    for rule in patterns:
        rule, take_back = (rule[1:], True) if rule.startswith("!") else (rule, False)
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        folder, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
        body, at = "", 0
        bare = rule.strip("/")
        while at < len(bare):
            if bare.startswith("**/", at):
                body, at = body + "(?:.*/)?", at + 3
            elif bare.startswith("**", at):
                body, at = body + ".*", at + 2
            else:
                c = bare[at]
                body, at = body + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), at + 1
        hit = path.rlike(("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)"))
        out = F.when(hit, not take_back).otherwise(out)
    return out


def flags(path: Column) -> Column:
    """Bits of a path: vendored, generated, test."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    vendored = F.arrays_overlap(folders, F.array(*map(F.lit, VENDORED_FOLDERS)))
    generated = F.arrays_overlap(folders, F.array(*map(F.lit, GENERATED_FOLDERS))) | file_name(path).rlike(GENERATED_NAME)
    return F.when(vendored, VENDORED).otherwise(0).bitwiseOR(F.when(generated, GENERATED).otherwise(0)).bitwiseOR(F.when(path.rlike(TEST_PATH), TEST).otherwise(0))


def is_secret(path: Column) -> Column:
    return path.rlike(SECRET_NAME)


def repository(spark: SparkSession, root: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, bytes, language, flags, hash, loc) of the files under a folder; secrets are listed and never opened, nor are files over most_bytes. Spark lists no files whose names begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    path = F.substr(at, F.lit(len(root.rstrip("/")) + 2))
    opened = ~is_secret(path) & (F.col("length") <= most_bytes)
    content = F.when(opened, F.col("content"))
    text = F.decode(content, "UTF-8")
    binary = F.instr(F.substring(text, 1, 8000), "\u0000") > 0
    lines = F.size(F.split(text, "\n")) - text.endswith("\n").cast("int")
    return files.select(path.alias("path"), F.col("length").alias("bytes"), language(path, F.substring(text, 1, 200)).alias("language"), flags(path).alias("flags"), F.sha2(content, 256).alias("hash"), F.when(~binary & (F.col("length") > 0), lines).alias("loc"))
