"""The engine's queries over the bound relations, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irloom import vocab
from irloom.functions import names, scores
from irloom.operators import facts, graph, issues, lifecycle, matching
from irloom.plans.bindings import Tables, ansi

QUERIES: dict[str, Callable[..., DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


ISSUES, FACTS, EDGES, ALLOCS, FREES, SYMBOLS = ansi("issues"), ansi("facts"), ansi("edges"), ansi("allocs"), ansi("frees"), ansi("symbols")

# --- facts


@query(f"SELECT kind, count(*) AS n FROM {FACTS} GROUP BY kind")
def fact_counts(t):
    return facts.counts(t.bind("facts"))


@query(f"SELECT * FROM {FACTS} WHERE kind = 'allocation'")
def fact_by_kind(t):
    return facts.by_kind(t.bind("facts"), "allocation")


@query(f"SELECT * FROM {FACTS} WHERE subject = 2000000007")
def fact_by_subject(t):
    return facts.by_subject(t.bind("facts"), 2_000_000_007)


@query(f"SELECT * FROM {FACTS} WHERE object = 1000000003")
def fact_by_object(t):
    return facts.by_object(t.bind("facts"), 1_000_000_003)


@query(f"SELECT * FROM {FACTS} WHERE context = 3")
def fact_by_context(t):
    return facts.by_context(t.bind("facts"), 3)


@query(f"SELECT * FROM {FACTS} WHERE kind = 'ownership_free' AND subject = 2000000007")
def fact_by_kind_and_subject(t):
    return facts.by_kind_and_subject(t.bind("facts"), "ownership_free", 2_000_000_007)


@query(f"SELECT kind, subject, object, context, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY subject, object, context) - 1 AS ordinal FROM {FACTS}) x WHERE kind = 'taint' AND ordinal = 5")
def fact_get(t):
    return facts.get(t.bind("facts"), "taint", 5)


@query(f"SELECT * FROM {FACTS} UNION ALL SELECT kind, object, subject, context FROM {FACTS} WHERE kind = 'cfg_edge'")
def fact_insert(t):
    store = t.bind("facts")
    flipped = facts.by_kind(store, "cfg_edge").select("kind", F.col("object").alias("subject"), F.col("subject").alias("object"), "context")
    return facts.insert(store, flipped)


@query(f"SELECT DISTINCT * FROM {FACTS} WHERE kind = 'cfg_edge'")
def fact_unsaved(t):
    store = t.bind("facts")
    return facts.unsaved(store, facts.snapshot(store.where("kind <> 'cfg_edge'")))


@query(f"WITH RECURSIVE f AS MATERIALIZED (SELECT subject, object FROM {FACTS} WHERE kind = 'alias_may'), u AS MATERIALIZED (SELECT subject AS a, object AS b FROM f UNION SELECT object, subject FROM f), r AS (SELECT CAST(3000000001 AS BIGINT) AS node UNION SELECT b FROM r JOIN u ON a = node) SELECT node FROM r")
def alias_closure(t):
    return facts.alias_closure(t.bind("facts"), t.spark.range(3_000_000_001, 3_000_000_002).select(F.col("id").alias("node")))


@query(f"SELECT DISTINCT * FROM {FACTS} WHERE kind = 'ownership_free' UNION SELECT 'vulnerability', subject, object, context FROM {FACTS} WHERE kind = 'ownership_free'")
def fixpoint_freed(t):
    return facts.fixpoint(t.bind("facts").where("kind = 'ownership_free'"), [facts.freed_is_vulnerable]).facts


@query(f"WITH RECURSIVE e AS MATERIALIZED {ansi('dag')}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT 'alias_may' AS kind, src AS subject, dst AS object, CAST(0 AS BIGINT) AS context FROM r")
def fixpoint_transitive(t):
    start = t.bind("dag").select(F.lit("alias_may").alias("kind"), F.col("src").alias("subject"), F.col("dst").alias("object"), F.lit(0).cast("bigint").alias("context"))
    return facts.alias_fixpoint(start)


# --- graph


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, r AS (SELECT CAST(3 AS BIGINT) AS node UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def reachable(t):
    return graph.closure(t.bind("edges"), t.spark.range(3, 4).select(F.col("id").alias("node")))


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 10) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def boundary_bfs(t):
    return graph.reach(t.bind("edges"), t.spark.range(3, 4).select(F.col("id").alias("node")), 10)


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, r AS (SELECT CAST(5 AS BIGINT) AS node UNION SELECT src FROM r JOIN e ON dst = node) SELECT node FROM r")
def reverse_bfs(t):
    return graph.closure(graph.reverse(t.bind("edges")), t.spark.range(5, 6).select(F.col("id").alias("node")))


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, p AS (SELECT DISTINCT src, 7 AS dst FROM e WHERE src < 20), r AS (SELECT DISTINCT src AS root, src AS node FROM p UNION SELECT root, e.dst FROM r JOIN e ON e.src = node) SELECT p.src, p.dst, r.node IS NOT NULL AS reachable FROM p LEFT JOIN r ON r.root = p.src AND r.node = p.dst")
def can_reach(t):
    edges = t.bind("edges")
    return graph.can_reach(edges, edges.where("src < 20").select("src", F.lit(7).cast("bigint").alias("dst")).distinct()).withColumn("dst", F.col("dst").cast("int"))


@query(f"WITH RECURSIVE e AS MATERIALIZED {ansi('dag')}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT count(*) > 0 AS cyclic FROM r WHERE src = dst")
def cycle_in_dag(t):
    return t.spark.createDataFrame([(graph.has_cycle(t.bind("dag")),)], "cyclic boolean")


@query(f"WITH RECURSIVE e AS MATERIALIZED {EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS node FROM r WHERE src = dst")
def cyclic_nodes(t):
    return graph.cyclic_nodes(t.bind("edges"))


@query(f"WITH RECURSIVE e AS MATERIALIZED {ansi('factors')}, r AS (SELECT CAST(i AS BIGINT) AS node, CAST(1 AS DOUBLE) AS conf FROM range(3) s(i) UNION SELECT dst, round(conf * factor, 6) FROM r JOIN e ON src = node WHERE round(conf * factor, 6) >= 0.6) SELECT node, max(conf) AS conf FROM r GROUP BY node")
def taint_max_product(t):
    return graph.max_product(t.bind("factors"), t.spark.range(3).select(F.col("id").alias("node"), F.lit(1.0).alias("conf")), 0.6)


@query(f"WITH RECURSIVE e AS MATERIALIZED {ansi('dag')}, r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 0 AS depth UNION SELECT dst, src, depth + 1 FROM r JOIN e ON src = node WHERE depth < 8), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT node, min(parent) AS parent, m.depth FROM m JOIN r USING (node) WHERE r.depth = m.depth GROUP BY node, m.depth")
def taint_parents(t):
    return graph.first_parents(t.bind("dag"), t.spark.range(1, 2).select(F.col("id").alias("node")), 8)


@query(f"WITH RECURSIVE e AS MATERIALIZED {ansi('dag')}, r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 0 AS depth UNION SELECT dst, src, depth + 1 FROM r JOIN e ON src = node WHERE depth < 8), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node), w AS (SELECT node, min(parent) AS parent FROM m JOIN r USING (node) WHERE r.depth = m.depth GROUP BY node, m.depth), p AS (SELECT w.node, w.node AS head, CAST(node AS STRING) AS way FROM w WHERE node % 5 = 0 UNION ALL SELECT p.node, w.parent, concat(CAST(w.parent AS STRING), '>', way) FROM p JOIN w ON w.node = p.head WHERE w.parent IS NOT NULL) SELECT p.node, way AS path FROM p JOIN w ON w.node = p.head WHERE w.parent IS NULL")
def taint_sink_paths(t):
    parents = graph.first_parents(t.bind("dag"), t.spark.range(1, 2).select(F.col("id").alias("node")), 8)
    return graph.sink_paths(parents, parents.where("node % 5 = 0")).select("node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"SELECT coalesce(a.node, b.node) AS node, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree FROM (SELECT src AS node, count(*) AS out_degree FROM {EDGES} GROUP BY src) a FULL JOIN (SELECT dst AS node, count(*) AS in_degree FROM {EDGES} GROUP BY dst) b ON a.node = b.node")
def node_degree(t):
    return graph.degree(t.bind("edges"))


@query(f"SELECT DISTINCT src, dst FROM {EDGES} WHERE src <> dst")
def flow_edges(t):
    return graph.flow_edges(t.bind("edges"))


@query(f"SELECT src, dst FROM {EDGES} WHERE src < 50 AND dst < 50")
def checked_edges(t):
    return graph.checked_edges(t.spark.range(50), t.bind("edges"))[0]


# --- joins


@query(f"SELECT caller, callee, caller_lang, callee_lang FROM {ansi('calls')} WHERE caller_lang <> callee_lang")
def cross_language_calls(t):
    return t.bind("calls").where("caller_lang <> callee_lang")


@query(f"SELECT caller_lang, callee_lang, count(*) AS calls, count(DISTINCT caller) AS callers FROM {ansi('calls')} GROUP BY 1, 2")
def boundary_breakdown(t):
    return t.bind("calls").groupBy("caller_lang", "callee_lang").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("caller").alias("callers"))


@query(f"SELECT callee_lang, count(*) AS calls FROM {ansi('calls')} WHERE caller_lang <> callee_lang GROUP BY 1 ORDER BY calls DESC, callee_lang LIMIT 1")
def dominant_target(t):
    return t.bind("calls").where("caller_lang <> callee_lang").groupBy("callee_lang").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "callee_lang").limit(1)


@query("SELECT c_custkey AS id, c_nationkey AS name, s_suppkey AS define_id, s_name AS define_symbol FROM customer JOIN (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS r FROM supplier) s ON s_nationkey = c_nationkey AND r = 1")
def declare_define_match(t):
    declares = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("name"))
    defines = t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("name"), F.col("s_name").alias("symbol"))
    return matching.match_functions(declares, defines)


@query("SELECT o_orderkey AS name, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unmatched_declares(t):
    return matching.unmatched(t["orders"].select(F.col("o_orderkey").alias("name"), "o_custkey"), t["lineitem"].select(F.col("l_orderkey").alias("name")))


@query(f"SELECT ptr, func, callee FROM {ALLOCS} WHERE ptr NOT IN (SELECT ptr FROM {FREES})")
def unreleased_allocations(t):
    return matching.unreleased(t.bind("allocs"), t.bind("frees")).select("ptr", "func", "callee")


_MANAGED = "NOT is_global AND NOT has_raii AND NOT is_gc AND NOT is_borrowed AND container IS NULL"


@query(f"SELECT ptr, callee, confidence, CASE WHEN on_ffi_path THEN 'high' ELSE 'low' END AS severity FROM (SELECT *, {scores.leak()} AS confidence FROM {ALLOCS} WHERE ptr NOT IN (SELECT ptr FROM {FREES}) AND {_MANAGED}) x WHERE confidence >= 0.65")
def leak_scores(t):
    return matching.leaks(t.bind("allocs"), t.bind("frees")).select("ptr", "callee", "confidence", "severity")


@query(f"WITH f AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {chr(39)}{fam}{chr(39)})' for fam, _, r, _ in vocab.FAMILIES for n in r)}) v(callee, release_family)) SELECT x.ptr, x.callee, a.family AS alloc_family, f.release_family, CASE WHEN f.release_family IS NULL THEN 'unknown_release' WHEN a.family = f.release_family THEN 'same_family' ELSE 'mismatch' END AS result FROM {FREES} x LEFT JOIN f USING (callee) JOIN {ALLOCS} a ON a.ptr = x.ptr")
def family_matches(t):
    return matching.release_matches(t.bind("allocs"), t.bind("frees"), vocab.families(t.spark))


@query("SELECT a.l_orderkey AS func, a.p AS a, b.p AS b FROM (SELECT l_orderkey, l_returnflag, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) AS r FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_partkey FROM lineitem)) a JOIN (SELECT l_orderkey, l_returnflag, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) AS r FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_partkey FROM lineitem)) b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.r < b.r")
def may_alias_pairs(t):
    pointers = t["lineitem"].select(F.col("l_orderkey").alias("func"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("ptr")).distinct()
    return matching.same_type_pairs(pointers, None)


@query(f"WITH s AS (SELECT DISTINCT name, {names.stem('name')} AS stem, {names.allocator_score('name')} AS a, {names.deallocator_score('name')} AS d FROM {SYMBOLS}) SELECT x.name AS allocator, y.name AS deallocator, round((x.a + y.d) / 2, 6) AS score FROM s x JOIN s y ON x.stem = y.stem AND x.name <> y.name WHERE x.a >= 0.3 AND y.d >= 0.3")
def mined_pairs(t):
    return matching.mine_pairs(t.bind("symbols"))


@query("SELECT x.o_orderkey AS call_id, y.c_custkey AS func FROM orders x JOIN customer y ON x.o_orderstatus = CASE WHEN y.c_nationkey % 2 = 0 THEN 'F' ELSE 'P' END AND x.o_custkey % 25 = y.c_nationkey AND x.o_orderkey % 100 = y.c_custkey % 100")
def devirtualised_calls(t):
    calls = t["orders"].select(F.col("o_orderkey").alias("call_id"), F.col("o_orderstatus").alias("ret_type"), F.array((F.col("o_custkey") % 25).cast("string"), (F.col("o_orderkey") % 100).cast("string")).alias("param_types"))
    functions = t["customer"].select(F.col("c_custkey").alias("func"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("P").alias("ret_type"), F.array(F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 100).cast("string")).alias("param_types"))
    return matching.devirtualise(calls, functions)


# --- names


@query(f"SELECT DISTINCT name, {names.vulnerability('name')} AS vuln, {names.signals('name')} AS signals, {names.role('name')} AS role, {names.language('name')} AS lang, {names.language_confidence('name')} AS lang_confidence, {names.zone('name')} AS zone, {names.container('name')} AS container, {names.pattern_base('name')} AS base, {names.stem('name')} AS stem, {names.dangerous('name')} AS dangerous FROM {SYMBOLS}")
def name_classes(t):
    n = t.bind("symbols").select("name").distinct()
    return n.select("name", *[F.expr(f("name")).alias(c) for c, f in (("vuln", names.vulnerability), ("signals", names.signals), ("role", names.role), ("lang", names.language), ("lang_confidence", names.language_confidence), ("zone", names.zone), ("container", names.container), ("base", names.pattern_base), ("stem", names.stem), ("dangerous", names.dangerous))])


@query(f"SELECT DISTINCT name, {names.allocator_score('name')} AS alloc_score, {names.deallocator_score('name')} AS free_score FROM {SYMBOLS}")
def name_scores(t):
    return t.bind("symbols").select("name").distinct().select("name", F.expr(names.allocator_score("name")).alias("alloc_score"), F.expr(names.deallocator_score("name")).alias("free_score"))


@query(f"SELECT id, name, vuln, signals, score, {scores.boundary_severity('score')} AS severity FROM (SELECT *, {scores.boundary('signals', 'vuln', 'CAST(0.98 AS DOUBLE)')} AS score FROM (SELECT id, name, {names.vulnerability('name')} AS vuln, {names.signals('name')} AS signals FROM {SYMBOLS}) a) b WHERE {scores.boundary_passes('signals', 'vuln', 'score')}")
def boundary_scores(t):
    return matching.score_matches(t.bind("symbols"), 0.98)


@query("SELECT page_id, CASE WHEN left(url, 26) = 'https://tionsh.example.net' THEN 'rust' WHEN left(url, 8) = 'https://' THEN 'c' WHEN right(url, 5) = '.html' THEN 'cpp' WHEN right(url, 4) = '#top' THEN 'go' ELSE 'unknown' END AS lang FROM pages")
def override_lookup(t):
    rules = [("prefix", "https://", "c"), ("prefix", "https://tionsh.example.net", "rust"), ("suffix", "#top", "go"), ("suffix", ".html", "cpp")]
    return t["pages"].select("page_id", matching.longest_rule(t["pages"], "url", rules, "unknown").alias("lang"))


@query(f"SELECT page_id, {names.file_stem('url')} AS stem, CAST({names.json_string('url')} AS STRING) AS quoted FROM pages")
def path_functions(t):
    return t["pages"].select("page_id", F.expr(names.file_stem("url")).alias("stem"), F.concat(F.lit('"'), F.col("url"), F.lit('"')).alias("quoted"))


# --- issues


@query(f"SELECT issue_id, final_severity, classification FROM (SELECT *, row_number() OVER (PARTITION BY func, kind, file, line ORDER BY CASE WHEN severity = 'critical' THEN 1 ELSE 0 END, issue_id) AS turn FROM {issues.nested(issues.nested(ISSUES + ' i0', issues.surface_steps()), issues.risk_steps())}) z WHERE NOT suppressed AND (turn = 1 OR severity = 'critical')")
def issue_admission(t):
    return issues.admit(t.bind("issues")).select("issue_id", "final_severity", "classification")


@query(f"SELECT issue_id, kind, func FROM (SELECT *, row_number() OVER (PARTITION BY func, kind, file, line ORDER BY issue_id) AS r FROM {ISSUES}) x WHERE r = 1")
def issue_dedup(t):
    return issues.dedup(t.bind("issues")).select("issue_id", "kind", "func")


@query(f"SELECT min(issue_id) AS issue_id, kind, file, line FROM {ISSUES} GROUP BY kind, file, line")
def issue_dedup_compat(t):
    return issues.dedup(t.bind("issues"), ("kind", "file", "line")).select("issue_id", "kind", "file", "line")


@query(f"SELECT kind, message, count(*) AS n, arg_min(func, issue_id) AS func, min(issue_id) AS issue_id FROM {ISSUES} GROUP BY kind, message HAVING count(*) > 5")
def issue_fold_messages(t):
    return issues.fold_messages(t.bind("issues"))


@query(f"SELECT issue_id, kind, message FROM (SELECT *, count(*) OVER (PARTITION BY kind, message) AS n FROM {ISSUES}) x WHERE n <= 5")
def issue_unfolded(t):
    return issues.unfolded(t.bind("issues")).select("issue_id", "kind", "message")


@query(f"SELECT kind, base, count(*) AS n, arg_min(func, issue_id) AS first_func, arg_max(func, issue_id) AS last_func FROM (SELECT *, {names.pattern_base('func')} AS base FROM {ISSUES}) x WHERE base <> '' GROUP BY kind, base HAVING count(*) > 3")
def issue_fold_patterns(t):
    return issues.fold_patterns(t.bind("issues"))


@query(f"SELECT issue_id FROM {ISSUES} WHERE severity IN ('high', 'critical') AND {issues.boundary_sql()}")
def issue_filter_boundary(t):
    return issues.report_filter(t.bind("issues"), "high", boundary_only=True).select("issue_id")


@query(f"SELECT issue_id FROM {ISSUES} WHERE severity <> 'low' AND (surface IS NULL OR surface IN ('boundary', 'internal_core', 'unknown'))")
def issue_filter_surface(t):
    return issues.report_filter(t.bind("issues"), "medium", surfaces=["boundary", "internal_core"]).select("issue_id")


@query(f"SELECT issue_id, {issues.surface_sql()} AS surface FROM {ISSUES}")
def issue_surfaces(t):
    return issues.backfill_surfaces(t.bind("issues")).select("issue_id", "surface")


@query(f"SELECT count(*) AS issues, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (has_boundary) AS at_boundary FROM {ISSUES}")
def issue_stats(t):
    return issues.stats(t.bind("issues"))


@query(f"SELECT kind, {names.cwe('kind')} AS cwe, {names.category('kind')} AS category, {names.diagnostic_class('kind')} AS class, severity, count(*) AS n FROM {ISSUES} GROUP BY kind, severity")
def issue_summary(t):
    return t.bind("issues").groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n")).select("kind", F.expr(names.cwe("kind")).alias("cwe"), F.expr(names.category("kind")).alias("category"), F.expr(names.diagnostic_class("kind")).alias("class"), "severity", "n")


@query(f"SELECT issue_id, CASE WHEN func = 'user_7' THEN 'critical' WHEN left(func, 6) = 'user_1' THEN CASE severity WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END ELSE severity END AS severity FROM {ISSUES} WHERE func = 'user_7' OR left(func, 6) = 'user_1' OR right(func, 1) <> '9'")
def issue_custom_rules(t):
    rules = t.spark.createDataFrame([(1, "user_7", "exact", "override", "critical"), (2, "user_1", "prefix", "escalate", None), (3, "[0-9]*9$", "regex", "suppress", None)], "priority int, pattern string, match_type string, action string, severity string")
    return issues.customise(t.bind("issues"), rules).select("issue_id", "severity")


@query(f"SELECT event_id, {issues.anomaly_level('confidence')} AS level FROM {ansi('merged_events')}")
def anomaly_levels(t):
    return t.bind("merged_events").select("event_id", F.expr(issues.anomaly_level("confidence")).alias("level"))


@query(f"SELECT event_id, confidence, 'runtime_issue' AS diagnostic, 'warning' AS level FROM {ansi('merged_events')} WHERE confidence >= 0.7")
def event_diagnostics(t):
    return issues.event_diagnostics(t.bind("merged_events")).select("event_id", "confidence", "diagnostic", "level")


@query(f"SELECT issue_id, {names.confidence_level('confidence')} AS level, {names.rank('severity')} AS rank FROM {ISSUES}")
def issue_levels(t):
    return t.bind("issues").select("issue_id", F.expr(names.confidence_level("confidence")).alias("level"), F.expr(names.rank("severity")).alias("rank"))


# --- ordered operators


def _contract_sql() -> str:
    table = " ".join(f"WHEN s.state = '{a}' AND e.trigger = '{t}' THEN '{b}'" for a, t, b in vocab.CONTRACT)
    rel = "(e.trigger IN ('release', 'conditional_release') AND e.alloc_family IS NOT NULL AND e.release_family IS NOT NULL)"
    same, other = f"({rel} AND e.alloc_family = e.release_family)", f"({rel} AND e.alloc_family <> e.release_family)"
    uses = f"(s.state = 'released' AND e.trigger IN ({vocab.sql_list(lifecycle.USES_AFTER_RELEASE)}))"
    twice = "(s.state = 'released' AND e.trigger = 'release')"
    nxt = f"(CASE {table} END)"
    escape = "(e.has_valid_escape AND e.trigger IN ('return_to_caller', 'out_param_store', 'field_store', 'global_store'))"
    return f"""WITH RECURSIVE e AS MATERIALIZED {ansi('resource_events')},
x AS (SELECT DISTINCT resource_id, CAST(0 AS BIGINT) AS seq, 'unknown' AS state, 0 AS invalid, 0 AS after_release, 0 AS doubled, 0 AS mismatched FROM e
UNION ALL SELECT e.resource_id, e.seq,
  CASE WHEN {same} THEN CASE WHEN e.trigger = 'conditional_release' THEN 'retained' ELSE 'released' END WHEN {other} OR {uses} OR {twice} OR {nxt} IS NULL THEN s.state WHEN {escape} THEN 'transferred' ELSE {nxt} END,
  s.invalid + CASE WHEN NOT {same} AND NOT {other} AND NOT {uses} AND NOT {twice} AND {nxt} IS NULL THEN 1 ELSE 0 END,
  s.after_release + CASE WHEN NOT {same} AND NOT {other} AND {uses} THEN 1 ELSE 0 END,
  s.doubled + CASE WHEN NOT {same} AND NOT {other} AND NOT {uses} AND {twice} THEN 1 ELSE 0 END, s.mismatched + CASE WHEN {other} THEN 1 ELSE 0 END
FROM x s JOIN e ON e.resource_id = s.resource_id AND e.seq = s.seq + 1)
SELECT resource_id, arg_max(state, seq) AS state, max(invalid) AS invalid, max(after_release) AS after_release, max(doubled) AS doubled, max(mismatched) AS mismatched FROM x GROUP BY resource_id"""


@query(_contract_sql())
def contract_states(t):
    return lifecycle.contract_fold(t.bind("resource_events"))


def _lifetime_sql() -> str:
    nxt = "(CASE " + " ".join(f"WHEN e.action = '{a}'" + (f" AND s.state = '{need}'" if need else "") + f" THEN '{new}'" for a, need, new, _ in vocab.LIFETIME) + " END)"
    return f"WITH RECURSIVE e AS MATERIALIZED {ansi('actions')}, x AS (SELECT DISTINCT resource_id, CAST(0 AS BIGINT) AS seq, 'unknown' AS state, 0 AS failures FROM e UNION ALL SELECT e.resource_id, e.seq, coalesce({nxt}, s.state), s.failures + CASE WHEN {nxt} IS NULL THEN 1 ELSE 0 END FROM x s JOIN e ON e.resource_id = s.resource_id AND e.seq = s.seq + 1) SELECT resource_id, arg_max(state, seq) AS state, max(failures) AS failures FROM x GROUP BY resource_id"


@query(_lifetime_sql())
def lifetime_states(t):
    return lifecycle.lifetime_fold(t.bind("actions"))


@query(f"WITH RECURSIVE e AS MATERIALIZED {ansi('states')}, x AS (SELECT DISTINCT merge_id, CAST(0 AS BIGINT) AS seq, 'unknown' AS state FROM e UNION ALL SELECT e.merge_id, e.seq, {lifecycle.meet_sql('s.state', 'e.state')} FROM x s JOIN e ON e.merge_id = s.merge_id AND e.seq = s.seq + 1) SELECT merge_id, arg_max(state, seq) AS state FROM x GROUP BY merge_id")
def lattice_meet(t):
    return lifecycle.meet_fold(t.bind("states"))


@query(f"SELECT ptr, seq, bb, lang, nth, bb = first_bb AS same_block, langs FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ptr ORDER BY seq) AS INT) AS nth, first_value(bb) OVER (PARTITION BY ptr ORDER BY seq) AS first_bb, CAST(count(DISTINCT lang) OVER (PARTITION BY ptr) AS INT) AS langs FROM {FREES}) x WHERE nth > 1")
def double_frees(t):
    return lifecycle.double_frees(t.bind("frees").select("ptr", "seq", "bb", "lang")).select("ptr", "seq", "bb", "lang", "nth", "same_block", "langs")


@query(f"SELECT func, ordinal, lock_id, is_acquire, CAST(sum(CASE WHEN is_acquire THEN 1 ELSE -1 END) OVER (PARTITION BY func, lock_id ORDER BY ordinal) AS BIGINT) AS held FROM {ansi('locks')}")
def held_locks(t):
    return lifecycle.held_locks(t.bind("locks"))


@query(f"WITH o AS MATERIALIZED {ansi('locks')}, h AS (SELECT func, lock_id, ordinal AS since, (SELECT min(r.ordinal) FROM o r WHERE r.func = a.func AND r.lock_id = a.lock_id AND NOT r.is_acquire AND r.ordinal > a.ordinal) AS until FROM o a WHERE is_acquire) SELECT DISTINCT h.lock_id AS src, o.lock_id AS dst FROM h JOIN o ON o.func = h.func AND o.is_acquire AND o.ordinal > h.since AND (until IS NULL OR o.ordinal < until) AND o.lock_id <> h.lock_id")
def lock_order(t):
    return lifecycle.lock_order(t.bind("locks"))


@query(f"WITH o AS (SELECT *, sum(CASE WHEN is_acquire THEN 1 ELSE -1 END) OVER (PARTITION BY func, lock_id ORDER BY ordinal) AS run FROM {ansi('locks')}) SELECT func, lock_id, CAST(sum(CASE WHEN is_acquire THEN 1 ELSE -1 END) - least(min(run), 0) AS BIGINT) AS open FROM o GROUP BY func, lock_id")
def open_references(t):
    ops = t.bind("locks").withColumn("sign", F.when(F.col("is_acquire"), 1).otherwise(-1))
    return lifecycle.balance(ops, ["func", "lock_id"], "sign", "ordinal")


@query(f"WITH o AS MATERIALIZED {ansi('ops')} SELECT func, ordinal FROM (SELECT *, last_value(CASE WHEN op IN ('alloc', 'free') THEN op END IGNORE NULLS) OVER (PARTITION BY func ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM o) x WHERE op = 'error' AND state = 'alloc'")
def error_path_leaks(t):
    return lifecycle.error_path_leaks(t.bind("ops"))


@query(f"SELECT func, count(*) FILTER (is_acquire) AS acquired, count(*) FILTER (NOT is_acquire) AS released, arg_max(is_acquire, ordinal) AS held_at_exit FROM {ansi('locks')} GROUP BY func HAVING count(*) FILTER (is_acquire) <> count(*) FILTER (NOT is_acquire)")
def interpreter_lock_balance(t):
    return lifecycle.lock_balance(t.bind("locks"))


@query(f"SELECT DISTINCT path_id FROM (SELECT path_id, value_id, kind FROM {ansi('paths')} GROUP BY 1, 2, 3 HAVING count(DISTINCT negated) = 2) x")
def infeasible_paths(t):
    return lifecycle.infeasible_paths(t.bind("paths"))


# --- scores and votes


@query(f"SELECT candidate_id, score, {scores.verdict('score')} AS verdict FROM {issues.nested('(SELECT *, (contains(note, ' + chr(39) + 'destructor' + chr(39) + ') OR contains(note, ' + chr(39) + 'Drop' + chr(39) + ') OR contains(note, ' + chr(39) + 'RAII' + chr(39) + ')) AS has_destructor FROM ' + ansi('candidates') + ')', scores.verifier_steps())}")
def verdicts(t):
    return matching.verify(t.bind("candidates").withColumn("evidence", F.array("note")))


@query(f"WITH v AS (SELECT candidate_id, score, {scores.verdict('score')} AS verdict FROM {issues.nested('(SELECT *, (contains(note, ' + chr(39) + 'destructor' + chr(39) + ') OR contains(note, ' + chr(39) + 'Drop' + chr(39) + ') OR contains(note, ' + chr(39) + 'RAII' + chr(39) + ')) AS has_destructor FROM ' + ansi('candidates') + ')', scores.verifier_steps())}) SELECT verdict, count(*) AS n, round(avg(score), 6) AS mean FROM v GROUP BY verdict")
def verdict_counts(t):
    return matching.verify(t.bind("candidates").withColumn("evidence", F.array("note"))).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"WITH s AS (SELECT module, lang, round(sum(weight), 6) AS weight FROM {ansi('votes')} GROUP BY 1, 2), w AS (SELECT *, round(weight / sum(weight) OVER (PARTITION BY module), 6) AS share, max(weight) OVER (PARTITION BY module) AS best FROM s) SELECT module, lang, weight, share, CAST(row_number() OVER (PARTITION BY module ORDER BY weight DESC, lang) AS INT) AS place FROM w WHERE weight >= 0.15 * best")
def language_votes(t):
    return matching.weighted_vote(t.bind("votes"))


@query(f"SELECT ptr, {scores.double_free('bb = 0', 'lang = ' + chr(39) + 'c' + chr(39), 'lang = ' + chr(39) + 'rust' + chr(39), 'ptr % 7 = 0', 'ptr % 5 = 0', 'ptr % 3 = 0')} AS confidence FROM {FREES}")
def double_free_confidence(t):
    sql = scores.double_free("bb = 0", "lang = 'c'", "lang = 'rust'", "ptr % 7 = 0", "ptr % 5 = 0", "ptr % 3 = 0")
    return t.bind("frees").select("ptr", F.expr(sql).alias("confidence"))


@query(f"SELECT ptr, {scores.ownership_leak('CASE WHEN is_conditional THEN ' + chr(39) + 'maybe_owned' + chr(39) + ' ELSE ' + chr(39) + 'owned' + chr(39) + ' END', 'family IS NOT NULL', 'on_ffi_path')} AS confidence FROM {ALLOCS}")
def ownership_leak_confidence(t):
    sql = scores.ownership_leak("CASE WHEN is_conditional THEN 'maybe_owned' ELSE 'owned' END", "family IS NOT NULL", "on_ffi_path")
    return t.bind("allocs").select("ptr", F.expr(sql).alias("confidence"))


@query(f"SELECT func, count(*) AS allocs, CAST(sum(CASE WHEN freed THEN 1 ELSE 0 END) AS BIGINT) AS freed FROM (SELECT func, ptr IN (SELECT ptr FROM {FREES}) AS freed FROM {ALLOCS}) x GROUP BY func")
def function_counters(t):
    freed = t.bind("frees").select("ptr").distinct().withColumn("freed", F.lit(1))
    return t.bind("allocs").join(freed, "ptr", "left").groupBy("func").agg(F.count(F.lit(1)).alias("allocs"), F.sum(F.coalesce("freed", F.lit(0))).alias("freed"))


@query("SELECT quality, toxic, count(*) AS n, count(*) FILTER (n_chars >= 1000) AS long_texts FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def precision_table(t):
    return t["labels"].join(t["documents"].select("doc_id", "n_chars"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") >= 1000).alias("long_texts"))


@query("SELECT role, next_role, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) x WHERE next_role IS NOT NULL GROUP BY 1, 2")
def role_transitions(t):
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t["conversations"].withColumn("next_role", nxt).where("next_role IS NOT NULL").groupBy("role", "next_role").agg(F.count(F.lit(1)).alias("n"))


# --- flagship

_FLAG = f"""WITH RECURSIVE e AS MATERIALIZED {EDGES}, b AS (SELECT CAST(i AS BIGINT) AS node FROM range(5) s(i) UNION SELECT src FROM b JOIN e ON dst = node),
l AS (SELECT ptr, func, callee, confidence, CASE WHEN on_ffi_path THEN 'high' ELSE 'low' END AS severity FROM (SELECT *, {scores.leak()} AS confidence FROM {ALLOCS} WHERE ptr NOT IN (SELECT ptr FROM {FREES}) AND {_MANAGED}) x WHERE confidence >= 0.65)
SELECT ptr, func, callee, severity, confidence FROM l WHERE ptr % 97 IN (SELECT node FROM b)"""


@query(_FLAG)
def unreleased_at_boundary(t):
    """Allocations never released whose owner reaches a boundary, with leak scores."""
    near = graph.closure(graph.reverse(t.bind("edges")), t.spark.range(5).select(F.col("id").alias("node")))
    found = matching.leaks(t.bind("allocs"), t.bind("frees"))
    return found.withColumn("node", F.col("ptr") % 97).join(near, "node", "left_semi").select("ptr", "func", "callee", "severity", "confidence")
