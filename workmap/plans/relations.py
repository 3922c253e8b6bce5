"""The store's relations over the driver's tables, each in one list of expressions that Spark and DuckDB read alike.

`Relations` gives them as DataFrames; `statement` registers a plan over them with the SQL it must equal, which gets the
relations that it names as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workmap.operators.scratch import parts_for
from workmap.plans.adapters import table
from workmap.plans.registry import QUERIES, SQL

#: Offsets that keep the ids of files, symbols and folders apart in the table of nodes.
SYMBOL_NODES, FOLDER_NODES = 1_000_000_000_000, 2_000_000_000_000

#: relation: (table, distinct, {column: expression})
_RELATIONS: dict[str, tuple[str, bool, dict[str, str]]] = {
    "sessions": ("customer", False, {"session_id": "c_custkey", "agent": "lower(c_mktsegment)", "parent": "case when c_custkey % 5 = 0 then c_custkey % 100 end", "started_at": "c_custkey * 7919 % 100003 * 1000", "ended_at": "case when c_custkey % 3 = 0 then c_custkey * 7919 % 100003 * 1000 + 3600000 end", "status": "case when c_custkey % 3 = 0 then 'ended' else 'live' end", "held_out": "c_custkey % 10 = 0"}),
    "tasks": ("orders", False, {"task_id": "o_orderkey", "session_id": "o_custkey", "seq": "o_orderkey + 1", "started_at": "o_orderkey * 7919 % 100003 * 1000", "ended_at": "case when o_orderstatus <> 'O' then o_orderkey * 7919 % 100003 * 1000 + 600000 end", "outcome": "case o_orderstatus when 'F' then 'success' when 'P' then 'unknown' end"}),
    "acts": ("orders", False, {"seq": "o_orderkey", "session_id": "o_custkey", "task_id": "case when o_orderkey % 11 <> 0 then o_orderkey - o_orderkey % 5 end", "ts": "o_orderkey * 7919 % 100003 * 1000", "kind": "case o_orderkey % 6 when 0 then 'read' when 1 then 'edit' when 2 then 'read' when 3 then 'check' when 4 then 'compact' else 'prompt' end", "node_id": "o_orderkey * 31 % 2000", "source": "case when o_orderkey % 4 = 0 then 'watcher' else 'hook' end", "range_start": "case when o_orderkey % 3 = 0 then o_orderkey % 50 end"}),
    "meta": ("nation", False, {"key": "n_name", "value": "cast(n_regionkey as string)"}),
    "git_state": ("region", False, {"key": "lower(r_name)", "value": "r_regionkey * 100"}),
    "files": ("part", False, {"file_id": "p_partkey", "path": "replace(lower(p_brand), '#', '_') || '/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || cast(p_partkey as string) || case p_partkey % 4 when 0 then '.rs' when 1 then '.py' when 2 then '.ts' else '.go' end", "lang": "case p_partkey % 4 when 0 then 'rust' when 1 then 'python' when 2 then 'typescript' else 'go' end", "bytes": "p_size * 40", "loc": "p_size", "content_hash": "md5(p_name)", "mtime": "p_partkey * 1000 + p_size", "flags": "p_partkey % 8"}),
    "symbols": ("orders", False, {"symbol_id": "o_orderkey", "file_id": "o_custkey", "parent_id": "case when o_orderkey % 7 = 0 then o_orderkey - 1 end", "kind": "case o_orderstatus when 'F' then 'function' when 'O' then 'method' else 'test' end", "name": "'sym_' || cast(o_orderkey % 997 as string)", "qual_name": "'mod_' || cast(o_custkey % 13 as string) || '::sym_' || cast(o_orderkey % 997 as string)", "start_byte": "o_orderkey % 400 * 40", "start_line": "o_orderkey % 400 + 1", "end_line": "o_orderkey % 400 + 1 + o_orderkey % 31", "sig_hash": "md5(o_orderpriority)"}),
    "refs": ("lineitem", True, {"src_file_id": "l_partkey", "src_symbol_id": "l_orderkey", "dst_name": "'sym_' || cast(l_suppkey * 7 % 997 as string)", "dst_symbol_id": "case when l_returnflag <> 'N' then l_suppkey * 10 end", "kind": "case l_linestatus when 'F' then 'call' else 'import' end", "line": "l_linenumber", "resolution": "case l_returnflag when 'A' then 'import' when 'R' then 'name' end"}),
    "passes_on": ("supplier", False, {"file_id": "s_suppkey", "position": "s_nationkey", "name": "'n' || cast(s_nationkey as string)", "taken": "'n' || cast(s_nationkey % 5 as string)", "path": "'lib/' || cast(s_nationkey % 3 as string)"}),
    "search": ("benchmark", False, {"node_id": "item_id", "tokens": "lower(text)"}),
    "interest": ("part", False, {"node_id": "p_partkey", "score": "cast(p_size as double) / 10", "last_seq": "p_partkey % 500"}),
    "episodes": ("orders", False, {"task_id": "o_orderkey", "ended_at": "o_orderkey * 7919 % 100003 * 1000", "outcome": "case o_orderstatus when 'F' then 'success' when 'P' then 'unknown' else 'failure' end", "changes": "o_custkey % 9"}),
    "archetypes": ("nation", False, {"archetype_id": "n_nationkey", "name": "lower(n_name)", "tasks": "n_regionkey * 3 + 1"}),
    "calibration": ("nation", False, {"version": "n_nationkey + 1", "rows_": "n_regionkey * 100", "intercept": "cast(n_regionkey as double) / 4"}),
    "injections": ("orders", False, {"injection_id": "o_orderkey", "task_id": "o_orderkey - o_orderkey % 3", "session_id": "o_custkey", "ts": "o_orderkey * 7919 % 100003 * 1000", "channel": "case when o_orderkey % 5 = 0 then 'hint' else 'prompt' end", "delivered": "o_orderstatus <> 'P'", "label": "case when o_orderkey % 4 < 2 then o_orderkey % 2 end", "used_count": "o_orderkey % 4"}),
    "items": ("lineitem", True, {"injection_id": "l_orderkey", "node_id": "l_partkey"}),
    "blame": ("lineitem", True, {"file_id": "l_partkey", "content_hash": "case when l_returnflag = 'A' then 'old' else 'now' end", "first": "l_linenumber * 10", "last": "l_linenumber * 10 + cast(l_quantity as int)", "put_at": "l_orderkey"}),
    "cards": ("orders", False, {"oid": "md5(cast(o_orderkey as string))", "number": "o_orderkey", "pr": "case when o_orderkey % 5 = 0 then o_orderkey % 300 end", "made_at": "o_orderkey * 7919 % 100003", "title": "lower(o_orderpriority)"}),
    "warnings": ("orders", False, {"warning_id": "o_orderkey", "task_id": "o_orderkey - o_orderkey % 4", "ts": "o_orderkey * 7919 % 100003 * 1000", "kind": "case o_orderkey % 4 when 0 then 'cochange' when 1 then 'call_site' when 2 then 'test' else 'origin' end", "src_node": "o_custkey", "dst_node": "o_orderkey * 31 % 2000", "resolved": "case o_orderkey % 3 when 0 then 1 when 1 then 0 end"}),
    "positions": ("orders", False, {"session_id": "o_custkey", "node_id": "o_orderkey * 31 % 2000 + o_orderkey * 10000", "ts": "o_orderkey * 7919 % 100003 * 1000", "mode": "case when o_orderkey % 4 = 0 then 'claim' else 'edit' end"}),
    "notices": ("customer", False, {"notice_id": "c_custkey", "session_id": "c_custkey % 150", "ts": "c_custkey * 7919 % 100003 * 1000", "delivered_at": "case when c_custkey % 3 = 0 then c_custkey * 7919 % 100003 * 1000 + 5000 end", "about": "c_nationkey"}),
    "handoffs": ("customer", False, {"handoff_id": "c_custkey", "session_id": "c_custkey % 150", "ts": "c_custkey * 7919 % 100003 * 1000", "closed_at": "case when c_custkey % 4 = 0 then c_custkey * 7919 % 100003 * 1000 + 7000 end", "failures": "case when c_custkey % 3 = 1 then c_mktsegment end"}),
    "facts": ("part", False, {"fact_id": "p_partkey", "claim": "p_name", "status": "case p_partkey % 5 when 0 then 'proposed' when 1 then 'approved' when 2 then 'suspect' when 3 then 'retired' else 'approved' end", "before_suspect": "case when p_partkey % 5 = 2 then 'approved' end", "superseded_by": "case when p_partkey % 9 = 0 then p_partkey + 1 end", "task_id": "case when p_partkey % 2 = 0 then p_partkey * 3 end", "changed_at": "p_partkey * 7919 % 100003 * 1000", "uses": "p_size"}),
    "anchors": ("lineitem", True, {"fact_id": "l_suppkey", "node_id": "case when l_linestatus = 'F' then l_partkey else l_orderkey + 1000000000000 end", "hash": "case when l_returnflag = 'A' then 'old' else md5(cast(l_partkey as string)) end"}),
    "given": ("lineitem", True, {"task_id": "l_orderkey", "fact_id": "l_suppkey"}),
    "usage": ("orders", False, {"session_id": "o_custkey", "turn": "o_orderkey", "response": "case when o_orderkey % 3 <> 0 then o_orderkey % 4001 end", "tokens": "o_orderkey % 977"}),
}
#: relation: the relations it is made of, by SQL that both sides read.
_DERIVED: dict[str, str] = {
    "folders": "select distinct cast(substr(p_brand, 7) as bigint) as folder_id, replace(lower(p_brand), '#', '_') as path from part",
    "nodes": f"select file_id as node_id, 'file' as kind, file_id as ref_id, cast(null as string) as path from files union all select symbol_id + {SYMBOL_NODES}, 'symbol', symbol_id, cast(null as string) from symbols union all select folder_id + {FOLDER_NODES}, 'dir', cast(null as bigint), path from folders",
    "links": "select l_suppkey as src, l_partkey as dst, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as type, max(l_discount) as w, count(*) as n, max(l_orderkey) as last_seq from lineitem group by 1, 2, 3",
    "ways": "select l_suppkey as src, l_partkey % 200 as dst, cast(count(*) as double) / 4 as weight, max(l_orderkey) as last_seq from lineitem group by 1, 2",
    "commits_of": "select l_partkey as file_id, count(distinct l_orderkey) as n, max(l_orderkey) as last_seq from lineitem group by 1",
    "hashes": "select nodes.node_id, case nodes.kind when 'file' then files.content_hash else symbols.sig_hash end as hash from nodes left join files on nodes.kind = 'file' and files.file_id = nodes.ref_id left join symbols on nodes.kind = 'symbol' and symbols.symbol_id = nodes.ref_id where nodes.kind <> 'dir'",
}


class Relations:
    """The relations of one folder of tables, as attributes."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A table of the folder; its files' schema is read once for these relations."""
        if name not in self._read:
            self._read[name] = table(self.spark, self.d, name)
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in _RELATIONS:
            base, distinct, columns = _RELATIONS[name]
            rows = self.table(base).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])
            return rows.distinct() if distinct else rows
        raise AttributeError(name)

    def plain(self, name: str) -> DataFrame:
        """A relation's rows with repeated ones, for those whom these don't change."""
        base, _, columns = _RELATIONS[name]
        return self.table(base).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])

    def dealt(self, name: str, *keys: str) -> DataFrame:
        """A relation dealt by keys over parts that hold so many rows of its table each, whatever the table's size; what is distinct is found there."""
        base, distinct, columns = _RELATIONS[name]
        rows = self.table(base).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])
        rows = rows.repartition(parts_for(self.spark, self.table(base).count()), *keys)
        return rows.distinct() if distinct else rows

    @property
    def folders(self) -> DataFrame:
        return self.table("part").selectExpr("cast(substr(p_brand, 7) as bigint) as folder_id", "replace(lower(p_brand), '#', '_') as path").distinct()

    @property
    def nodes(self) -> DataFrame:
        f = self.files.selectExpr("file_id as node_id", "'file' as kind", "file_id as ref_id", "cast(null as string) as path")
        s = self.symbols.selectExpr(f"symbol_id + {SYMBOL_NODES} as node_id", "'symbol' as kind", "symbol_id as ref_id", "cast(null as string) as path")
        return f.unionByName(s).unionByName(self.folders.selectExpr(f"folder_id + {FOLDER_NODES} as node_id", "'dir' as kind", "cast(null as bigint) as ref_id", "path"))

    @property
    def links(self) -> DataFrame:
        return self.links_of(self.table("lineitem"))

    @staticmethod
    def links_of(lines: DataFrame) -> DataFrame:
        """The links that lines make."""
        kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        return lines.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("type")).agg(F.max("l_discount").alias("w"), F.count("*").alias("n"), F.max("l_orderkey").alias("last_seq"))

    @property
    def ways(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 200).alias("dst")).agg((F.count("*") / 4).alias("weight"), F.max("l_orderkey").alias("last_seq"))

    @property
    def commits_of(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_partkey").alias("file_id")).agg(F.count_distinct("l_orderkey").alias("n"), F.max("l_orderkey").alias("last_seq"))

    @property
    def hashes(self) -> DataFrame:
        """What an anchor on a node is compared with: a file's content, a symbol's signature."""
        f = self.files.select(F.col("file_id").alias("node_id"), F.col("content_hash").alias("hash"))
        return f.unionByName(self.symbols.select((F.col("symbol_id") + SYMBOL_NODES).alias("node_id"), F.col("sig_hash").alias("hash")))


def _named(sql: str) -> list[str]:
    return [n for n in (*_RELATIONS, *_DERIVED) if re.search(rf"\b(from|join) {n}\b", sql)]


def relations_sql(sql: str) -> str:
    """sql behind the common table expressions of the relations that it names."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _named(text):
            if n in order:
                continue
            if n in _DERIVED:
                need(_DERIVED[n])
            order.append(n)

    need(sql)
    parts = []
    for n in order:
        if n in _DERIVED:
            parts.append(f"{n} as ({_DERIVED[n]})")
        else:
            base, distinct, columns = _RELATIONS[n]
            parts.append(f"{n} as (select {'distinct ' if distinct else ''}{', '.join(f'{e} as {c}' for c, e in columns.items())} from {base})")
    if not parts:
        return sql
    own = re.match(r"\s*with (recursive )?", sql)
    return f"with {own[1] or '' if own else ''}{', '.join(parts)}{', ' + sql[own.end():] if own else ' ' + sql}"


def statement(sql: str):
    """Registers f(relations) under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Relations(spark, d))
        SQL[f.__name__] = relations_sql(sql)
        return f

    return add


def ids(rows: DataFrame, condition: str, column: str, name: str | None = None) -> DataFrame:
    """A list of keys: a column's values where a condition holds."""
    return rows.where(condition).select(F.col(column).alias(name or column))
