"""Queries of the program operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from irloom.operators import graph, program
from irloom.plans.bindings import ansi
from irloom.plans.engine_queries import ALLOCS, EDGES, FREES, SYMBOLS, query

OPS = ansi("ops")


@query(f"SELECT DISTINCT name, {program.direction('name')} AS direction, {program.intrinsic('name')} AS intrinsic, {program.shim('name')} AS shim, {program.name_origin('name')} AS origin, {program.output_parameter('name')} AS output, {program.opcode_class('name')} AS class FROM {SYMBOLS}")
def symbol_noise(t):
    n = t.bind("symbols").select("name").distinct()
    return n.select("name", *[F.expr(f("name")).alias(c) for c, f in (("direction", program.direction), ("intrinsic", program.intrinsic), ("shim", program.shim), ("origin", program.name_origin), ("output", program.output_parameter), ("class", program.opcode_class))])


_MAPS = f"(SELECT ptr AS arg, ptr + 100000000 AS param, callee FROM {ALLOCS})"


@query(f"WITH d AS (SELECT *, {program.direction('callee')} AS direction FROM {_MAPS} m) SELECT arg AS src, param AS dst, CASE WHEN direction = 'in' THEN 'strong' ELSE 'weak' END AS strength FROM d WHERE direction <> 'out' UNION SELECT param, arg, CASE WHEN direction = 'out' THEN 'strong' ELSE 'weak' END FROM d WHERE direction <> 'in'")
def memory_propagation(t):
    return program.propagate_memory(t.bind("allocs").select(F.col("ptr").alias("arg"), (F.col("ptr") + 100_000_000).alias("param"), "callee"))


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), r AS (SELECT DISTINCT ptr % 97 AS node FROM {FREES} WHERE callee = 'fclose' UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def danger_surface(t):
    args = t.bind("frees").select("callee", (F.col("ptr") % 97).alias("ptr"))
    return program.danger_surface(t.spark.createDataFrame([("fclose",)], "callee string"), args, t.bind("edges"))


@query("SELECT s_suppkey AS name, s_suppkey % 3 = 0 AS address_taken FROM supplier WHERE s_acctbal > 0 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R' AND l_linestatus = 'F')")
def export_surfaces(t):
    functions = t["supplier"].select(F.col("s_suppkey").alias("name"), (F.col("s_acctbal") > 0).alias("visible"))
    calls = t["lineitem"].where("l_quantity = 50 AND l_returnflag = 'R' AND l_linestatus = 'F'").select(F.col("l_suppkey").alias("callee"))
    return program.exports(functions, calls, t["supplier"].where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("name"))).select("name", "address_taken")


@query("WITH RECURSIVE t AS MATERIALIZED (SELECT c_custkey AS id, CAST(floor(c_custkey / 3) AS BIGINT) AS parent FROM customer), r AS (SELECT id, parent AS ancestor, 1 AS depth FROM t WHERE parent <> id UNION ALL SELECT r.id, t.parent, depth + 1 FROM r JOIN t ON t.id = r.ancestor WHERE t.parent <> t.id) SELECT id, ancestor, depth FROM r")
def semantic_tree(t):
    return program.ancestors(t["customer"].select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 3).alias("parent")))


@query(f"SELECT a.ptr, CASE WHEN r.ptr IS NOT NULL THEN 'returned' WHEN s.g THEN 'global' WHEN s.ptr IS NOT NULL AND s.f THEN 'field' ELSE 'local' END AS escape FROM {ALLOCS} a LEFT JOIN (SELECT l_orderkey AS ptr, bool_or(l_linenumber = 1) AS g, bool_or(l_linenumber <> 1) AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) s ON s.ptr = a.ptr LEFT JOIN (SELECT DISTINCT l_orderkey AS ptr FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) r ON r.ptr = a.ptr")
def escape_kinds(t):
    stores = t["lineitem"].where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("ptr"), (F.col("l_linenumber") == 1).alias("to_global"))
    returns = t["lineitem"].where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("ptr"))
    return program.escapes(stores, returns, t.bind("allocs"))


@query(f"SELECT page_id, {program.path_origin('url')} AS origin FROM pages")
def path_noise(t):
    return t["pages"].select("page_id", F.expr(program.path_origin("url")).alias("origin"))


@query(f"WITH o AS (SELECT func, ordinal, op, lead(op) OVER (PARTITION BY func ORDER BY ordinal) AS second, lead(op, 2) OVER (PARTITION BY func ORDER BY ordinal) AS third FROM {OPS}), p AS (SELECT func, ordinal, CASE WHEN op = 'free' AND second = 'other' AND third = 'alloc' THEN 'regrow' WHEN op = 'alloc' AND second = 'other' AND third = 'free' THEN 'scratch' WHEN op = 'alloc' AND second = 'error' THEN 'failing' END AS pattern FROM o) SELECT * FROM p WHERE pattern IS NOT NULL")
def behaviour_patterns(t):
    return program.behaviours(t.bind("ops"))


_KIND = "CASE ptr % 6 WHEN 0 THEN 'arena' WHEN 1 THEN 'fixed' WHEN 2 THEN 'testing' WHEN 3 THEN 'general' WHEN 4 THEN 'page' ELSE 'other' END"


@query(f"SELECT ptr, {program.allocator_leak(_KIND, 'on_ffi_path', 'has_raii', 'is_conditional')} AS confidence FROM {ALLOCS}")
def allocator_leak_scores(t):
    return t.bind("allocs").select("ptr", F.expr(program.allocator_leak(_KIND, "on_ffi_path", "has_raii", "is_conditional")).alias("confidence"))


_WORDS = ["idiot", "NC 4.0", "the the", "ción", "Licensed under", "token", "||"]


@query("SELECT doc_id, " + " OR ".join(f"contains(text, '{w}')" for w in _WORDS) + " AS hit FROM documents")
def multi_pattern(t):
    return t["documents"].select("doc_id", program.any_pattern("text", _WORDS).alias("hit"))


@query(f"WITH b AS (SELECT DISTINCT name, list_transform(range(1, strlen(name) + 1), lambda i: CAST('0x' || substr(hex(encode(name)), 2 * i - 1, 2) AS HUGEINT)) AS bs FROM {SYMBOLS}) SELECT name, lower(lpad(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), bs), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616) AS UBIGINT)), 16, '0')) AS hash FROM b")
def fnv_hash(t):
    return t.bind("symbols").select("name").distinct().select("name", F.expr(program.fnv1a("name")).alias("hash"))


_NESTED = """WITH RECURSIVE s AS (SELECT DISTINCT name FROM @), r AS (SELECT name, substr(name, 4) AS rest, '' AS plain FROM s WHERE regexp_matches(name, '^_ZN[0-9]')
UNION ALL SELECT name, substr(rest, n + k + 1), CASE WHEN regexp_matches(substr(rest, k + 1, n), '^h[0-9a-f]{16}$') THEN plain WHEN plain = '' THEN substr(rest, k + 1, n) ELSE plain || '::' || substr(rest, k + 1, n) END
FROM (SELECT *, length(regexp_extract(rest, '^[0-9]+')) AS k, CAST(regexp_extract(rest, '^[0-9]+') AS INT) AS n FROM r WHERE regexp_matches(rest, '^[0-9]')) x)
SELECT name, plain FROM r WHERE NOT regexp_matches(rest, '^[0-9]') UNION ALL SELECT name, name FROM s WHERE NOT regexp_matches(name, '^_ZN[0-9]')"""


@query(_NESTED.replace("@", SYMBOLS))
def demangled(t):
    return t.bind("symbols").select("name").distinct().select("name", F.expr(program.demangle("name")).alias("plain"))


@query("SELECT CAST(sum(n) AS BIGINT) AS strings, count(*) AS distinct_strings, CAST(sum((n - 1) * coalesce(strlen(text), 0)) AS BIGINT) AS bytes_saved FROM (SELECT text, count(*) AS n FROM documents GROUP BY text) x")
def interner_stats(t):
    return program.interner(t["documents"], "text")


@query("WITH n AS (SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn FROM (SELECT quality = 1 AS a, n_chars >= 1000 AS b FROM labels JOIN documents USING (doc_id)) x) SELECT *, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM n")
def accuracy_metrics(t):
    both = t["labels"].join(t["documents"].select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("a"), (F.col("n_chars") >= 1000).alias("b"))
    return program.accuracy(both, "a", "b")


@query("SELECT event_type AS pass, count(*) AS runs, round(sum(floor(value * 4) / 4), 3) AS total_ms, round(avg(floor(value * 4) / 4), 6) AS mean_ms FROM events GROUP BY 1")
def pass_profile(t):
    return program.profile(t["events"].select(F.col("event_type").alias("pass"), (F.floor(F.col("value") * 4) / 4).alias("ms")))


@query(f"SELECT src AS node, count(*) AS ways, count(*) FILTER (dst < src) AS loops, CASE WHEN count(*) >= 3 THEN 3 ELSE 0 END + 2 * count(*) FILTER (dst < src) AS score FROM {EDGES} GROUP BY src ORDER BY score DESC, node LIMIT 20")
def hot_spots(t):
    return program.hot_spots(t.bind("edges"))


@query(f"SELECT (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM {EDGES}) AS edges, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error') AS tainted")
def graph_stats(t):
    return program.graph_stats(t["supplier"], t.bind("edges"), t["events"].where("event_type = 'error'").select(F.col("user_id").alias("node")))


_OPS3 = f"(SELECT func, ordinal, op, ordinal % 3 AS value, event_type FROM {OPS})"


@query(f"WITH o AS MATERIALIZED {_OPS3} SELECT u.func, u.value, u.ordinal, (SELECT max(c.ordinal) FROM o c WHERE c.func = u.func AND c.value = u.value AND c.op = 'free' AND c.ordinal < u.ordinal) AS checked_at FROM o u WHERE u.op = 'error'")
def latest_guards(t):
    o = t.bind("ops").withColumn("value", F.col("ordinal") % 3)
    return program.latest_guard(o.where("op = 'error'"), o.where("op = 'free'"))


@query(f"WITH o AS MATERIALIZED {_OPS3} SELECT func, value, ordinal FROM o u WHERE op = 'alloc' AND EXISTS (SELECT 1 FROM o c WHERE c.func = u.func AND c.value = u.value AND c.op = 'error')")
def guarded_uses(t):
    o = t.bind("ops").withColumn("value", F.col("ordinal") % 3)
    return program.guarded(o.where("op = 'alloc'"), o.where("op = 'error'")).select("func", "value", "ordinal")


@query(f"SELECT src AS node, CAST(floor((r - 1) / 8) AS BIGINT) AS chunk, string_agg(CAST(dst AS STRING), ',' ORDER BY dst) AS next FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM {EDGES}) x GROUP BY 1, 2")
def adjacency(t):
    return graph.adjacency(t.bind("edges"), 8).select("node", "chunk", F.array_join(F.col("next").cast("array<string>"), ",").alias("next"))
