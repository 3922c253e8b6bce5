"""Hook payloads of many coding agents as one relation of events.

Agents differ in the names of fields, tools and events, not in what they tell; so there is one adapter with the names that a
field may have, the first that is there counts, and two tables of names. Everything is an expression over one JSON column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of tools by what they do.
TOOLS = {
    "read": ("Read", "read", "read_file", "view", "view_file"),
    "write": ("Write", "write", "write_file", "write_to_file", "create", "Create", "create_file", "fs_write"),
    "edit": ("Edit", "edit", "edit_file", "MultiEdit", "multiedit", "NotebookEdit", "patch", "replace", "replace_file_content", "replace_in_file", "multi_replace_file_content", "str_replace", "fs_append"),
    "patch": ("ApplyPatch", "apply_patch"),
    "search": ("Grep", "grep", "grep_search", "search_file_content", "search_files", "Glob", "glob", "file_search", "find", "find_by_name"),
    "command": ("Bash", "bash", "Shell", "Execute", "RunCommand", "PowerShell", "powershell", "exec", "execute_bash", "execute_command", "execute_pwsh", "run_command", "run_shell_command", "terminal"),
}
#: Names of events by what happened, case and marks between words aside.
EVENTS = {
    "session_start": ("sessionstart", "onsessionstart", "agentstart", "taskstart", "taskresume"),
    "session_end": ("sessionend", "onsessionend"),
    "prompt": ("userpromptsubmit", "promptsubmit", "beforesubmitprompt", "beforeagent", "chatmessage", "beforepromptbuild", "prellmcall", "turnstart"),
    "tool": ("posttooluse", "aftertool", "posttoolcall", "aftertoolcall", "toolresult", "toolexecuteafter"),
    "tool_failure": ("posttoolusefailure",),
    "compact": ("precompact", "precompress", "beforecompaction", "experimentalsessioncompacting"),
    "stop": ("stop", "agentend", "afteragent", "turnend", "taskcomplete", "stopfailure"),
    "subagent_start": ("subagentstart",),
    "subagent_stop": ("subagentstop",),
}
#: Where a field may stand, the first that is there counts.
FIELDS = {
    "session": ("$.session_id", "$.sessionId", "$.conversation_id", "$.conversationId", "$.taskId", "$.thread_id"),
    "cwd": ("$.cwd", "$.working_dir", "$.workspacePaths[0]", "$.workspaceRoots[0]"),
    "hook": ("$.hook_event_name", "$.hookEventName", "$.event_type", "$.hookName", "$.event"),
    "prompt": ("$.prompt", "$.user_prompt", "$.userPromptSubmit.prompt", "$.lastUserInput", "$.extra.user_message", "$.message"),
    "tool": ("$.tool_name", "$.toolName", "$.toolCall.name", "$.postToolUse.toolName", "$.tool"),
    "model": ("$.model.slug", "$.modelName", "$.model"),
}
INPUTS = ("$.tool_input", "$.toolInput", "$.toolCall.args", "$.postToolUse.parameters", "$.args")
INPUT_FIELDS = {
    "path": ("file_path", "filePath", "AbsolutePath", "TargetFile", "path", "SearchPath", "SearchDirectory", "operations[0].path"),
    "command": ("command", "cmd", "CommandLine"),
    "pattern": ("pattern", "Pattern", "Query", "query"),
    "first": ("offset", "start_line", "StartLine", "operations[0].start_line"),
    "last": ("end_line", "EndLine", "operations[0].end_line"),
}


def _first(value: str, paths) -> Column:
    return F.coalesce(*[F.get_json_object(value, p) for p in paths])


def _named(name: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(name.isin(*names), kind) for kind, names in table.items()])


def events(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with session, cwd, hook, kind, tool, path, command, pattern, first, last, prompt, model of the JSON payload in `value`.

    kind is what happened, or for a tool what it does; a payload that isn't JSON has nulls throughout, an unknown tool or event no
    kind. A write whose tool takes a patch counts as an edit.
    """
    f = {k: _first(value, p) for k, p in FIELDS.items()}
    inside = {k: F.coalesce(*[F.get_json_object(value, f"{i}.{n}") for n in names for i in INPUTS]) for k, names in INPUT_FIELDS.items()}
    happened = _named(F.lower(F.regexp_replace(f["hook"], r"[._\-]", "")), EVENTS)
    does = _named(f["tool"], TOOLS)
    kind = F.when(happened.isin("tool", "tool_failure"), F.when(does.isin("write", "patch"), "edit").otherwise(does)).otherwise(happened)
    return lines.select(
        "*", f["session"].alias("session"), f["cwd"].alias("cwd"), f["hook"].alias("hook"), kind.alias("kind"), f["tool"].alias("tool"), (happened == "tool_failure").alias("failed"),
        inside["path"].alias("path"), inside["command"].alias("command"), inside["pattern"].alias("pattern"), inside["first"].try_cast("long").alias("first"), inside["last"].try_cast("long").alias("last"),
        F.when(happened == "prompt", f["prompt"]).alias("prompt"), f["model"].alias("model"),
    )
