"""Chat formatting in windows of a token budget.

Prefix sums of the turns' tokens place every turn in its conversation; they are taken over stretches of turns and then over the
stretches, so that a conversation of any length is spread over tasks. Stretches of `section_tokens` tokens are cut
into windows of whole turns: the system turn, some turns that were there before, and as many new ones as fit. Only
new assistant turns are under the loss mask.

A turn is [SYS]text[/SYS], [INST]text[/INST] or <s>text</s> for system, user and assistant, and
[ROLE]name[/ROLE]text[/END] for any other. Inside a text a mark gets a backslash before its name, and one more if it has some, so
that no mark is left and taking one away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.llm.common import table, written

_MARK = re.compile(r"([<\[]/?)(\\*)(SYS|INST|ROLE|END|s)([>\]])")
_ESCAPED = re.compile(r"([<\[]/?)\\(\\*)(SYS|INST|ROLE|END|s)([>\]])")
_KINDS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_ROLES = {begin: (role, end) for role, (begin, end) in _KINDS.items()}
#: Up to eight letters and digits, or another character that is no space.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,8}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
#: A turn's two marks count as tokens, so that no turn is free.
MARK_TOKENS = 2
WINDOW = "section long, window int, text string, n_tokens long, n_turns int, n_repeated int, loss_starts array<int>, loss_ends array<int>"
DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2\3\4", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3\4", text)


def turn_tokens(text: Column) -> Column:
    """A turn's tokens, marks included, as far as a pattern can count them; callers with a tokenizer give a column of their own."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + MARK_TOKENS


class Turn(NamedTuple):
    role: str
    text: str
    tokens: int


def marked(turn: Turn) -> tuple[str, str, str]:
    """What opens the turn, its text without marks, and what closes it."""
    if turn.role in _KINDS:
        begin, end = _KINDS[turn.role]
        return begin, escape(turn.text), end
    return f"[ROLE]{escape(turn.role)}[/ROLE]", escape(turn.text), "[/END]"


def turns_in(text: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of each turn's escaped text, read back from a window."""
    at = 0
    while at < len(text):
        begin = next((b for b in (*_ROLES, "[ROLE]") if text.startswith(b, at)), None)
        if begin is None:
            raise ValueError(f"no turn begins at {at}")
        at += len(begin)
        role, end = _ROLES.get(begin, ("", "[/END]"))
        if begin == "[ROLE]":
            to = text.index("[/ROLE]", at)
            role, at = unescape(text[at:to]), to + len("[/ROLE]")
        to = text.index(end, at)
        yield role, at, to
        at = to + len(end)


class _Section:
    """The windows of one section, made while its turns arrive."""

    def __init__(self, key: tuple, budget: int, history: int):
        self.key, self.budget, self.most = key, budget, history
        self.system: Turn | None = None
        self.recent: deque[Turn] = deque()
        self.recent_tokens = 0
        self.context: list[Turn] = []
        self.fresh: list[Turn] = []
        self.used = 0
        self.made = 0

    def remember(self, turn: Turn) -> None:
        self.recent.append(turn)
        self.recent_tokens += turn.tokens
        while self.recent_tokens > self.most:
            self.recent_tokens -= self.recent.popleft().tokens

    def add(self, turn: Turn) -> Iterator[tuple]:
        """Takes a new turn; gives the window that it doesn't fit into any more."""
        if self.fresh and self.used + turn.tokens > self.budget:
            yield self.window()
        if not self.fresh:
            self.context = list(self.recent)
            self.used = sum(t.tokens for t in self.context) + (self.system.tokens if self.system else 0)
            drop = 0
            while drop < len(self.context) and self.used + turn.tokens > self.budget:
                self.used -= self.context[drop].tokens
                drop += 1
            self.context = self.context[drop:]
        self.fresh.append(turn)
        self.used += turn.tokens
        self.remember(turn)

    def window(self) -> tuple:
        turns = [*([self.system] if self.system else []), *self.context, *self.fresh]
        first = self.key[1] == 0 and self.made == 0
        repeated = len(turns) - len(self.fresh) - (1 if first and self.system else 0)
        parts, starts, ends, at = [], [], [], 0
        for k, turn in enumerate(turns):
            begin, text, end = marked(turn)
            parts += (begin, text, end)
            if k >= repeated and turn.role == "assistant":
                starts.append(at + len(begin))
                ends.append(at + len(begin) + len(text))
            at += len(begin) + len(text) + len(end)
        out = (*self.key, self.made, "".join(parts), self.used, len(turns), repeated, starts, ends)
        self.made += 1
        self.fresh, self.context = [], []
        return out

    def end(self) -> Iterator[tuple]:
        if not self.made and not self.fresh and self.system and self.key[1] == 0:
            self.used = self.system.tokens
            yield self.window()
        elif self.fresh:
            yield self.window()


def _format(schema: pa.Schema, budget: int, history: int, batch_bytes: int = 4 << 20):
    """Windows of sorted rows (conv_id, section, part, role, text, tokens); part 0: the system turn, 1: before the section, 2: new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Section | None = None
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def windows() -> Iterator[tuple]:
            nonlocal now
            for batch in batches:
                for conv, section, part, role, text, tokens in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    if now is None or now.key != (conv, section):
                        if now is not None:
                            yield from now.end()
                        now = _Section((conv, section), budget, history)
                    turn = Turn(role, text, tokens)
                    if part == 0:
                        now.system = turn
                    elif part == 1:
                        now.remember(turn)
                    else:
                        yield from now.add(turn)
            if now is not None:
                yield from now.end()

        for row in windows():
            rows.append(row)
            size += len(row[3])
            if size >= batch_bytes:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return run


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, section_tokens: int = 32768, tokens: Column | None = None, block_turns: int = 256) -> DataFrame:
    """conv_id, section, window, text, n_tokens, n_turns, n_repeated, loss_starts, loss_ends for conversations(conv_id, turn, role, text).

    Windows are ordered by section, then window. The first n_repeated turns of a window were in earlier ones; the loss spans are
    the (escaped) texts of the assistant turns after them, in characters. A window holds at most `budget` tokens, but one new
    turn at least; turns are never cut. History is the last turns of at most `history` tokens, fewer where the
    first new turn needs the room. A new window begins with every section.

    A conversation's first turn is retained in all windows if its role is system. Null text and role are ''; null turns come last;
    turns of one number go by role, then text, so repeated rows are turns of their own. Rows without conv_id are one
    conversation. Other columns aren't read; no rows give no windows. Needs section_tokens > history.
    """
    if section_tokens <= history:
        raise ValueError("section_tokens must be over history")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
        (turn_tokens(text) if tokens is None else tokens.cast("long")).alias("tokens"),
    ).withColumn("block", F.expr(f"turn div {block_turns}"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = written(rows.select("*", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"), (F.row_number().over(inside) - 1).cast("long").alias("place")))
    # the prefix sums of the blocks; first blocks start at 0, so only long conversations have rows here
    blocks = placed.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.sum("t").over(earlier).alias("t"), F.sum("n").over(earlier).alias("n")).where("n is not null")
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "t", "n")
    at = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    at = at.select("conv_id", "role", "text", "tokens", (F.col("before") + F.coalesce("t", F.lit(0))).alias("before"), (F.col("place") + F.coalesce("n", F.lit(0))).alias("place"))
    at = at.withColumn("own", F.expr(f"before div {section_tokens}"))
    is_system = (F.col("place") == 0) & (F.col("role") == "system")
    # a turn is in its section, and before the next one if it can be history there
    tail = F.col("before") >= (F.col("own") + 1) * section_tokens - history
    again = at.withColumn("section", F.explode(F.when(~is_system & tail, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    part = F.when(is_system, 0).when(F.col("section") > F.col("own"), 1).otherwise(2)
    turns = again.select("conv_id", "section", part.alias("part"), "place", "role", "text", "tokens")
    later = at.where("own > 0").groupBy(F.col("conv_id").alias("c"), "own").agg(F.count("*").alias("turns"))
    kept = at.where(is_system).join(later.withColumnRenamed("own", "section"), F.col("conv_id").eqNullSafe(F.col("c")))
    turns = turns.unionByName(kept.select("conv_id", "section", F.lit(0).alias("part"), "place", "role", "text", "tokens"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([turns.schema["conv_id"], *StructType.fromDDL(WINDOW).fields])
    ordered = turns.repartition("conv_id", "section").sortWithinPartitions("conv_id", "section", "part", "place")
    return ordered.select("conv_id", "section", "part", "role", "text", "tokens").mapInArrow(_format(to_arrow_schema(schema), budget, history), schema)


def _read_back(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        now: list | None = None
        turns = loss = None

        def done() -> list:
            return [now[0], now[1], turns.hexdigest(), now[2], loss.hexdigest(), now[3]]

        for batch in batches:
            for conv, text, repeated, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(done())
                    now, turns, loss = [conv, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for k, (role, a, b) in enumerate(turns_in(text)):
                    if k >= repeated:
                        now[1] += 1
                        turns.update(f"{role}\n{unescape(text[a:b])}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    target = unescape(text[a:b])
                    now[2] += len(target)
                    loss.update(target.encode())
                now[3] += len(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(done(), schema, strict=True)], schema=schema)

    return run


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the windows alone.

    A digest runs over a whole conversation, so its windows meet in one task, which streams them in order and holds one at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([windows.schema["conv_id"], *StructType.fromDDL(DIGEST).fields])
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "section", "window")
    return ordered.select("conv_id", "text", "n_repeated", "loss_starts", "loss_ends").mapInArrow(_read_back(to_arrow_schema(schema)), schema)


ORACLE = r"""
with recursive rows_ as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
t as (select *, row_number() over w - 1 pos, len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,8}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) + 2 k,
  len(regexp_replace(text, '([<\[]/?)(\\*)(SYS|INST|ROLE|END|s)([>\]])', '\1\\\2\3\4', 'g')) + case role when 'system' then 11 when 'user' then 13 when 'assistant' then 7
    else 19 + len(regexp_replace(role, '([<\[]/?)(\\*)(SYS|INST|ROLE|END|s)([>\]])', '\1\\\2\3\4', 'g')) end c
  from rows_ window w as (partition by conv_id order by turn nulls last, role, text)),
p as (select *, coalesce(sum(k) over w, 0)::bigint k0, coalesce(sum(c) over w, 0)::bigint c0, coalesce(sum(k) over w, 0)::bigint // 32768 section, pos = 0 and role = 'system' is_sys
  from t window w as (partition by conv_id order by pos rows between unbounded preceding and 1 preceding)),
sys as (select conv_id, k sk, c sc from p where is_sys),
q as (select p.*, coalesce(sk, 0) sk, coalesce(sc, 0) sc from p left join sys on sys.conv_id is not distinct from p.conv_id where not is_sys),
hist as (select a.conv_id, a.pos, min(h.pos) h from q a join q h on h.conv_id is not distinct from a.conv_id and h.pos <= a.pos
  and (h.pos = a.pos or (a.k0 - h.k0 <= 256 and a.sk + a.k0 + a.k - h.k0 <= 1024)) group by all),
span as (select a.conv_id, a.pos a, a.section, any_value(h.k0) hk, any_value(h.c0) hc, any_value(a.sc) sc, max(b.pos) + 1 b, max(b.c0 + b.c) bc from q a
  join hist on hist.conv_id is not distinct from a.conv_id and hist.pos = a.pos join q h on h.conv_id is not distinct from a.conv_id and h.pos = hist.h
  join q b on b.conv_id is not distinct from a.conv_id and b.section = a.section and b.pos >= a.pos and (b.pos = a.pos or a.sk + b.k0 + b.k - h.k0 <= 1024) group by all),
win as (select s.* from span s join (select conv_id, section, min(pos) pos from q group by all) f on f.conv_id is not distinct from s.conv_id and f.pos = s.a
  union all select s.* from win join span s on s.conv_id is not distinct from win.conv_id and s.section = win.section and s.a = win.b),
f as (select conv_id, sum(n) n from (select conv_id, sc + bc - hc n from win
  union all select p.conv_id, c from p where is_sys and not exists (select 1 from q where q.conv_id is not distinct from p.conv_id and q.section = 0)) group by 1)
select p.conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) turns_sha256,
  coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) loss_sha256,
  any_value(f.n)::bigint formatted_chars
from p join f on f.conv_id is not distinct from p.conv_id group by p.conv_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast(given.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(given.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_windows(given.unionByName(planted)))
