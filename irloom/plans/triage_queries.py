"""Queries of suppression, severity, platforms, candidates and paths. The SQL states results as literal rows or in its own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.operators import triage
from irloom.plans.bindings import ansi
from irloom.plans.engine_queries import EDGES, query


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


# Expected by hand: the symbols that belong to a library or a runtime.
_LIBRARY = ["_ZN4core3ptr13drop_in_place17h0123456789abcdefE", "runtime.mallocgc", "llvm.memcpy", "std::string::assign"]


@query(f"SELECT DISTINCT name, kind, name IN {tuple(_LIBRARY)} AND (kind = 'unchecked_return' OR (kind = 'drop' AND name LIKE '%drop_in_place%')) AS suppressed FROM {ansi('symbols')} s CROSS JOIN (VALUES ('unchecked_return'), ('double_free'), ('drop')) k(kind)")
def issue_suppression(t):
    """Advisory findings in library code go, double frees stay unless a compiler-made drop says so."""
    n = t.bind("symbols").select("name").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, ("unchecked_return", "double_free", "drop")))))
    n = n.withColumns({"k": F.when(F.col("kind") == "drop", "double_free").otherwise(F.col("kind")), "m": F.when(F.col("kind") == "drop", "freed by __rust_dealloc").otherwise("")})
    return n.select("name", "kind", F.expr(triage.suppressed("name", "k", "m")).alias("suppressed"))


_BOOSTS = [
    (1, "dlclose", "use-after-free detected", 2), (0, "dlclose", "contract violation", 1), (0, "EVP_CIPHER_CTX_new", "null not checked", 1), (0, "pthread_create", "callback escape", 1),
    (0, "malloc", "return-value-escape global", 1), (1, "free", "uaf on handle", 2), (0, "fork", "missing at-fork handler", 1), (1, "printf", "format string", None), (2, "dangerous_func", "any issue", None),
    (3, "free", "uaf", None), (1, "EVP_x", "null not checked", None), (1, "x", "return-value-escape", 1), (0, "f", "double-free", 2),
]


@query(f"SELECT base, func, what, CAST(boosted AS INT) AS boosted FROM {_values(_BOOSTS, 'base, func, what, boosted')}")
def severity_boosts(t):
    given = t.spark.createDataFrame([r[:3] for r in _BOOSTS], "base int, func string, what string")
    return given.withColumn("boosted", F.expr(triage.boosted("base", "func", "what")).cast("int"))


_WORDS = [("Callback", True), ("myCallback", True), ("my_Callback", True), ("Callback_fn", True), ("x.Callback", True), ("MYCallback", False), ("Callbacks", False), ("Callbackfn", False), ("callback", False), ("", False)]


@query(f"SELECT * FROM {_values(_WORDS, 'name, hit')}")
def word_boundaries(t):
    return t.spark.createDataFrame([r[:1] for r in _WORDS], "name string").withColumn("hit", F.expr(triage.word_boundary("name", "Callback")))


_PLATFORMS = [("_main", "macos", "main", "mach_o"), ("_main", "linux", "_main", "mach_o"), ("f@@YAXXZ", "coff", "f", "coff"), ("f@@YAXXZ", "elf", "f@@YAXXZ", "coff"), ("main", "mach_o", "main", None), ("__x", "mach_o", "_x", "mach_o"), ("", "macos", "", None)]


@query(f"SELECT * FROM {_values(_PLATFORMS, 'symbol, platform, plain, hint')}")
def platform_symbols(t):
    given = t.spark.createDataFrame([r[:2] for r in _PLATFORMS], "symbol string, platform string")
    return given.withColumns({"plain": F.expr(triage.platform_symbol("symbol", "platform")), "hint": F.expr(triage.platform_hint("symbol"))})


@query(f"SELECT candidate_id, round(CAST(CASE WHEN c < 0 THEN 0 WHEN c > 1 THEN 1 ELSE c END AS DOUBLE), 6) AS confidence FROM (SELECT candidate_id, raw_score - (candidate_id % 2) * 0.05 - (CASE WHEN candidate_id % 3 > 0 THEN 0.03 ELSE 0 END) AS c FROM {ansi('candidates')} x) y")
def platform_confidence(t):
    return t.bind("candidates").select("candidate_id", F.expr(triage.platform_confidence("raw_score", "candidate_id % 2 = 1", "candidate_id % 3 = 0")).alias("confidence"))


@query("SELECT o_orderkey AS candidate_id, round(CAST([0.85, 0.9, 0.7, 0.72, 0.75, 0.35, CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE 0.8 END, 0.6][o_orderkey % 8 + 1] AS DOUBLE), 6) AS score FROM orders")
def candidate_scores(t):
    kinds = F.array(*[F.lit(k) for k in [*triage.RAW_SCORES, "leak", "other"]])
    c = t["orders"].select(F.col("o_orderkey").alias("candidate_id"), kinds[(F.col("o_orderkey") % 8).cast("int")].alias("kind"), (F.col("o_custkey") % 2 == 0).alias("escaped"))
    return c.select("candidate_id", F.expr(triage.candidate_score("kind", "0.8", "escaped")).alias("score"))


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, r AS (SELECT DISTINCT dst AS node FROM e WHERE dst % 50 = 0 UNION SELECT src FROM r JOIN e ON dst = node) SELECT ptr, ptr IN (SELECT node FROM r) AS freed FROM (SELECT DISTINCT src AS ptr FROM e) p")
def free_paths(t):
    e = t.bind("edges")
    return triage.free_paths(e, e.where("dst % 50 = 0").select(F.col("dst").alias("ptr")).distinct(), e.select(F.col("src").alias("ptr")).distinct())


@query("SELECT o_orderkey AS ptr, o_orderstatus <> 'F' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = o_orderkey AND m.l_linenumber = l.l_linenumber AND m.l_returnflag = 'R')) AS leaked FROM orders")
def lost_arguments(t):
    args = t["lineitem"].select(F.col("l_orderkey").alias("ptr"), F.col("l_linenumber").alias("inst"), "l_returnflag")
    return triage.lost_arguments(t["orders"].select(F.col("o_orderkey").alias("ptr"), (F.col("o_orderstatus") == "F").alias("freed")), args, args.where("l_returnflag = 'R'"))


@query("SELECT o_orderkey AS ptr, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS known FROM orders")
def alloc_nodes(t):
    return triage.alloc_nodes(t["orders"].select(F.col("o_orderkey").alias("ptr")), t["lineitem"].select(F.col("l_orderkey").alias("id")))


@query("SELECT count(*) FILTER (WHERE z = 0) AS safe, count(*) FILTER (WHERE z = 1) AS unsafe, count(*) FILTER (WHERE z = 2) AS ffi, count(*) FILTER (WHERE z = 3) AS runtime_internal, count(*) FILTER (WHERE z = 4) AS unknown, round(count(*) FILTER (WHERE z IN (0, 3)) / CAST(count(*) AS DOUBLE), 6) AS skip_ratio FROM (SELECT c_custkey % 5 AS z FROM customer) x")
def zone_stats(t):
    zones = F.array(*[F.lit(z) for z in ("safe", "unsafe", "ffi", "runtime_internal", "unknown")])
    return triage.zone_stats(t["customer"].select(zones[(F.col("c_custkey") % 5).cast("int")].alias("zone")))


@query("SELECT o_custkey AS resource_id, CASE WHEN bool_or(o_orderkey % 7 = 0) THEN 'released_path' WHEN bool_or(o_orderkey % 7 = 1) THEN 'escaped_path' WHEN bool_or(o_orderkey % 11 = 0) THEN 'cleanup_path' ELSE 'leak_path' END AS class, count(*) AS paths, CASE WHEN bool_or(o_orderkey % 7 < 2 OR o_orderkey % 11 = 0) THEN 0 ELSE count(*) END AS leaky, CAST(CASE WHEN bool_or(o_orderkey % 7 < 2 OR o_orderkey % 11 = 0) THEN 0 ELSE 0.9 END AS DOUBLE) AS confidence FROM orders GROUP BY o_custkey")
def path_classes(t):
    effect = F.when(F.col("o_orderkey") % 7 == 0, "conditional_release").when(F.col("o_orderkey") % 7 == 1, "escapes_to_callback").otherwise("borrows")
    callee = F.when(F.col("o_orderkey") % 11 == 0, "conn_cleanup").when(F.col("o_orderkey") % 2 == 0, "use")
    return triage.path_classes(t["orders"].select(F.col("o_custkey").alias("resource_id"), effect.alias("effect"), callee.alias("callee")))
