"""The engine's relations, bound to the tables at hand. Each is SQL that Spark and ANSI engines read alike, over {table} marks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Function names that stand for a module's symbols, in turn.
SYMBOLS = [
    "malloc", "free", "system", "handle_input", "parse_url", "strcpy", "my_sprintf", "get_user", "do_exec", "setjmp", "widget_new", "widget_free", "conn_open",
    "conn_close", "buf_alloc", "buf_free", "ctx_create", "ctx_destroy", "_ZN4core3ptr13drop_in_place17h0123456789abcdefE", "_ZNSt6vectorIiE4push", "_RNvC1x3bad",
    "Java_org_x_Native", "PyObject_New", "_cgo_malloc", "runtime.mallocgc", "main.run", "llvm.memcpy", "pthread_create", "mmap", "Box::new", "item_1", "item_2",
    "item_3", "item_44", "validate_form", "call_remote", "std::string::assign", "ArrayList.init", "fopen", "dlsym",
]


def _pick(x: str, values: list[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {x} % {len(values)} {arms} END"


BINDINGS = {
    "issues": f"""
SELECT event_id AS issue_id,
  CASE event_type WHEN 'signup' THEN 'unchecked_return' WHEN 'view' THEN 'memory_leak' WHEN 'click' THEN 'cross_language_free' WHEN 'purchase' THEN 'invalid_free' ELSE 'write_to_immutable' END AS kind,
  concat(event_type, ' at ', CAST(event_id % 900 AS STRING)) AS message,
  CASE WHEN user_id % 11 = 0 THEN concat('drop_in_place_', CAST(user_id AS STRING)) ELSE concat('user_', CAST(user_id AS STRING)) END AS func,
  CASE WHEN user_id % 5 > 0 THEN concat('src/mod_', CAST(user_id % 7 AS STRING), '.c') END AS file,
  CAST(event_id % 40 AS INT) AS line,
  CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 150 THEN 'high' ELSE 'critical' END AS severity,
  round(least(value / 100, CAST(1 AS DOUBLE)), 6) AS confidence,
  {_pick('event_id', ['boundary', 'ffi_producer', 'reachable_from_boundary', 'internal_core', 'runtime_internal', 'unknown', None])} AS surface,
  user_id % 3 = 0 AS has_boundary,
  {_pick('user_id', ['user', 'stdlib', 'compiler_generated', 'third_party', 'unknown'])} AS origin
FROM {{events}}""",
    "facts": """
SELECT 'cfg_edge' AS kind, CAST(n_nationkey AS BIGINT) AS subject, CAST(n_regionkey + 1000 AS BIGINT) AS object, CAST(n_regionkey AS BIGINT) AS context FROM {nation}
UNION ALL SELECT 'dfg_edge', o_orderkey + 2000000000, o_custkey + 1000000000, CAST(0 AS BIGINT) FROM {orders}
UNION ALL SELECT 'alias_may', l_suppkey + 3000000000, l_partkey + 4000000000, CAST(0 AS BIGINT) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) a
UNION ALL SELECT 'allocation', o_orderkey + 2000000000, o_custkey + 1000000000, CAST(1 AS BIGINT) FROM {orders} WHERE o_orderstatus = 'F'
UNION ALL SELECT 'ownership_free', l_orderkey + 2000000000, l_suppkey + 3000000000, CAST(l_linenumber AS BIGINT) FROM {lineitem} WHERE l_returnflag = 'R'
UNION ALL SELECT 'taint', user_id, event_id, CAST(0 AS BIGINT) FROM {events} WHERE event_type = 'error'""",
    # every pair of a supplier and a part; both keys number the nodes of one graph, so that it has long ways and cycles
    "edges": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM {lineitem}",
    "dag": "SELECT DISTINCT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst FROM {lineitem} WHERE l_suppkey <> l_partkey",
    "factors": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CAST(CASE (l_suppkey + l_partkey) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.95 ELSE 0.3 END AS DOUBLE) AS factor FROM {lineitem}",
    "calls": """
SELECT DISTINCT concat('c', CAST(o_custkey AS STRING)) AS caller, concat('s', CAST(l_suppkey AS STRING)) AS callee, cn.n_regionkey AS caller_lang, sn.n_regionkey AS callee_lang
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} cn ON c_nationkey = cn.n_nationkey
JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} sn ON s_nationkey = sn.n_nationkey""",
    "allocs": f"""
SELECT o_orderkey AS ptr, concat('fn_', CAST(o_custkey AS STRING)) AS func,
  {_pick('o_custkey', ['malloc', '__rust_alloc', 'PyMem_Malloc', 'widget_new', 'fopen', 'calloc'])} AS callee,
  {_pick('o_custkey', ['c_heap', 'rust_global', 'python_mem', None, 'file', 'c_heap'])} AS family,
  {_pick('o_custkey', ['c', 'rust', 'python', 'c', 'c', 'cpp'])} AS lang,
  CAST(floor(o_totalprice * 10) AS BIGINT) AS size, o_orderkey % 50 = 0 AS is_global, o_orderstatus = 'P' AS is_conditional,
  CASE WHEN o_orderkey % 17 = 0 THEN 'rust_box' END AS container, o_orderkey % 23 = 0 AS is_borrowed, o_orderkey % 29 = 0 AS is_gc, o_orderkey % 31 = 0 AS has_raii, o_custkey % 4 = 0 AS on_ffi_path
FROM {{orders}}""",
    "frees": f"""
SELECT l_orderkey AS ptr, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS BIGINT) AS seq,
  concat('fn_', CAST(l_suppkey AS STRING)) AS func, CAST(l_linenumber % 3 AS INT) AS bb, {_pick('l_suppkey', ['c', 'rust', 'python'])} AS lang, {_pick('l_suppkey', ['free', '__rust_dealloc', 'PyMem_Free', 'widget_free', 'fclose'])} AS callee
FROM {{lineitem}} WHERE l_linestatus = 'F' AND l_returnflag = 'R'""",
    "locks": """
SELECT concat('user_', CAST(user_id AS STRING)) AS func, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ordinal, event_id % 5 AS lock_id, event_type = 'view' AS is_acquire
FROM {events} WHERE event_type IN ('view', 'purchase')""",
    "resource_events": f"""
SELECT user_id AS resource_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE event_type WHEN 'signup' THEN 'acquire' WHEN 'view' THEN 'borrow' WHEN 'click' THEN 'conditional_release' WHEN 'purchase' THEN 'release' ELSE 'global_store' END AS trigger,
  CASE WHEN user_id % 3 = 0 THEN 'c_heap' END AS alloc_family, {_pick('event_id', ['c_heap', 'cpp_new', None, None])} AS release_family, event_id % 2 = 0 AS has_valid_escape
FROM {{events}}""",
    "actions": f"SELECT user_id AS resource_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {_pick('event_id', ['alloc', 'free', 'borrow', 'transfer', 'reclaim', 'escape'])} AS action FROM {{events}}",
    "states": f"SELECT o_custkey AS merge_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, {_pick('o_orderkey', ['unknown', 'live', 'moved', 'borrowed', 'freed', 'escaped', 'live'])} AS state FROM {{orders}}",
    "ops": "SELECT concat('user_', CAST(user_id AS STRING)) AS func, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ordinal, CASE event_type WHEN 'signup' THEN 'alloc' WHEN 'purchase' THEN 'free' WHEN 'error' THEN 'error' ELSE 'other' END AS op, event_type FROM {events}",
    "candidates": f"""
SELECT o_orderkey AS candidate_id, round(CAST(0.3 + (o_orderkey % 14) * 0.05 AS DOUBLE), 6) AS raw_score, {_pick('o_orderkey', ['c_heap', None, 'cpp_new'])} AS alloc_family, {_pick('o_orderkey', ['c_heap', 'c_heap', None, 'rust_global', 'cpp_new'])} AS release_family,
  {_pick('o_custkey', ['valid_return', 'callback', 'thread', None])} AS escape_kind, {_pick('o_custkey', ['seen', 'Drop glue', 'RAII guard', 'destructor', 'other'])} AS note, o_orderkey % 3 = 0 AS is_on_ffi_path, CAST(o_orderkey % 256 AS INT) AS ffi_boundary_distance
FROM {{orders}}""",
    "symbols": f"SELECT c_custkey AS id, {_pick('c_custkey', SYMBOLS)} AS name FROM {{customer}}",
    "paths": f"SELECT o_custkey AS path_id, o_orderkey % 4 AS value_id, {_pick('o_orderkey', ['null', 'positive'])} AS kind, o_orderstatus = 'F' AS negated FROM {{orders}}",
    "votes": "SELECT source AS module, lang, CAST(CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END AS DOUBLE) AS weight FROM {documents} WHERE lang IS NOT NULL",
    "merged_events": "SELECT event_id, user_id, event_type, round(least(value / 100, CAST(1 AS DOUBLE)), 6) AS confidence FROM {events}",
}

_MARK = re.compile(r"\{(\w+)\}")


class Tables:
    """The tables of a folder, read once each, and the relations bound to them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._read[name]

    def bind(self, name: str) -> DataFrame:
        sql = BINDINGS[name]
        return self.spark.sql(sql, **{t: self[t] for t in set(_MARK.findall(sql))})


def ansi(name: str) -> str:
    """A relation as a subquery of ANSI SQL."""
    return f"({_MARK.sub(lambda m: m[1], BINDINGS[name])})"
