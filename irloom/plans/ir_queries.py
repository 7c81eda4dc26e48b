"""Queries that parse text IR and run passes on it. The text is written from the events: a module a user, a call an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irloom import passes
from irloom.passes import base
from irloom.plans.engine_queries import query
from irloom.sources import ir_text

#: Events with their place in the user's module and the place of the last signup before them (or at them).
_EVENTS = """(SELECT *, max(CASE WHEN event_type = 'signup' THEN ordinal END) OVER (PARTITION BY user_id ORDER BY ordinal) AS last_alloc
FROM (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS ordinal FROM events) e)"""


def modules(t) -> DataFrame:
    """module_id, text: signup allocates, purchase releases the last allocation (or @g), view locks, click runs a command, error
    compares the last allocation (or @g) with null."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t["events"].withColumn("i", F.row_number().over(w) - 1)
    last = F.max(F.when(F.col("event_type") == "signup", F.col("i"))).over(Window.partitionBy("user_id").orderBy("i"))
    e = e.withColumn("p", F.coalesce(F.concat(F.lit("%p"), last.cast("string")), F.lit("@g")))
    line = (
        F.when(F.col("event_type") == "signup", F.format_string("  %%p%d = call ptr @malloc(i64 %d)", "i", "event_id"))
        .when(F.col("event_type") == "purchase", F.format_string("  call void @free(ptr %s)", "p"))
        .when(F.col("event_type") == "view", F.format_string("  call i32 @pthread_mutex_lock(ptr @m%d)", F.col("event_id") % 3))
        .when(F.col("event_type") == "click", F.format_string("  %%r%d = call i32 @system(ptr @s)", "i"))
        .otherwise(F.format_string("  %%c%d = icmp eq ptr %s, null", "i", "p"))
    )
    body = e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return body.select(F.col("user_id").cast("string").alias("module_id"), F.format_string('source_filename = "u%d.c"\ndefine void @f%d() {\n%s\n  ret void\n}\n', "user_id", "user_id", "body").alias("text"))


_PARSED: dict[tuple[str, str], ir_text.Module] = {}


def parsed(t) -> ir_text.Module:
    """The tables of the modules of a folder, parsed once an application."""
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _PARSED:
        _PARSED[key] = ir_text.from_texts(modules(t))
    return _PARSED[key]


def _issues(t, name: str) -> DataFrame:
    return passes.run(parsed(t), [name]).select("module_id", "func", "ordinal", "kind", "severity", "confidence")


@query(f"SELECT CASE event_type WHEN 'error' THEN 'icmp' ELSE 'call' END AS opcode, CASE event_type WHEN 'signup' THEN 'malloc' WHEN 'purchase' THEN 'free' WHEN 'view' THEN 'pthread_mutex_lock' WHEN 'click' THEN 'system' END AS callee, count(*) AS n FROM {_EVENTS} x GROUP BY 1, 2 UNION ALL SELECT 'ret', NULL, count(DISTINCT user_id) FROM events")
def ir_instructions(t):
    return parsed(t).instructions.groupBy("opcode", "callee").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(user_id AS STRING) AS module_id, concat('f', CAST(user_id AS STRING)) AS func, concat('u', CAST(user_id AS STRING), '.c') AS source_filename FROM events GROUP BY user_id")
def ir_functions(t):
    m = parsed(t)
    return m.functions.join(m.modules, "module_id").select("module_id", "func", "source_filename")


@query(f"SELECT callee, count(*) AS sites, count(DISTINCT user_id) AS callers FROM (SELECT user_id, CASE event_type WHEN 'signup' THEN 'malloc' WHEN 'purchase' THEN 'free' WHEN 'view' THEN 'pthread_mutex_lock' WHEN 'click' THEN 'system' END AS callee FROM {_EVENTS} x) y WHERE callee IS NOT NULL GROUP BY 1")
def ir_call_sites(t):
    return base.calls(parsed(t)).groupBy("callee").agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("module_id").alias("callers"))


_WHO = "CAST(user_id AS STRING) AS module_id, concat('f', CAST(user_id AS STRING)) AS func"


@query(f"SELECT {_WHO}, ordinal, 'double_free' AS kind, 'critical' AS severity, CAST(0.9 AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, last_alloc ORDER BY ordinal) AS nth FROM {_EVENTS} x WHERE event_type = 'purchase') y WHERE nth > 1")
def pass_double_free(t):
    return _issues(t, "memory-safety")


@query(f"SELECT {_WHO}, ordinal, 'invalid_free' AS kind, 'high' AS severity, CAST(0.85 AS DOUBLE) AS confidence FROM {_EVENTS} x WHERE event_type = 'purchase' AND last_alloc IS NULL")
def pass_invalid_free(t):
    return _issues(t, "free-validation")


@query(f"WITH x AS MATERIALIZED {_EVENTS} SELECT {_WHO}, ordinal, 'memory_leak' AS kind, 'medium' AS severity, CAST(0.7 AS DOUBLE) AS confidence FROM x WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM x y WHERE y.user_id = x.user_id AND y.event_type = 'purchase' AND y.last_alloc = x.ordinal)")
def pass_memory_leak(t):
    return _issues(t, "ownership-leak")


@query(f"WITH x AS MATERIALIZED {_EVENTS} SELECT {_WHO}, ordinal, 'unchecked_return' AS kind, 'high' AS severity, CAST(0.9 AS DOUBLE) AS confidence FROM x WHERE event_type = 'click' OR (event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM x y WHERE y.user_id = x.user_id AND y.event_type IN ('purchase', 'error') AND y.last_alloc = x.ordinal))")
def pass_return_check(t):
    return _issues(t, "return-check")


_CALLEE = "CASE event_type WHEN 'signup' THEN 'malloc' WHEN 'purchase' THEN 'free' WHEN 'view' THEN 'pthread_mutex_lock' WHEN 'click' THEN 'system' END"


@query(f"SELECT {_WHO}, concat('%p', CAST(last_alloc AS STRING)) AS value, last_alloc AS def_ordinal, ordinal FROM {_EVENTS} x WHERE event_type IN ('purchase', 'error') AND last_alloc IS NOT NULL")
def pass_dfg(t):
    return passes.facts(parsed(t), "dfg")


@query(f"SELECT {_WHO}, callee, count(*) AS sites, false AS defined FROM (SELECT user_id, {_CALLEE} AS callee FROM events) x WHERE callee IS NOT NULL GROUP BY user_id, callee")
def pass_call_graph(t):
    return passes.facts(parsed(t), "call-graph")


# every module is C and exports its one function, which calls C functions only
@query(f"SELECT DISTINCT {_WHO}, 'ffi_producer' AS surface FROM events")
def pass_surfaces(t):
    return passes.facts(parsed(t), "surface-classifier")


@query(f"SELECT {_WHO}, concat('%p', CAST(ordinal AS STRING)) AS value, 'heap' AS resolution, CAST(0.95 AS DOUBLE) AS confidence FROM {_EVENTS} x WHERE event_type = 'signup'")
def pass_resolutions(t):
    return passes.facts(parsed(t), "SemanticResolver")
