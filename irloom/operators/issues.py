"""Issue rows: admission, severity by risk and surface, deduplication, folding, filters and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irloom import vocab
from irloom.functions import names

FOLD_MESSAGE, FOLD_PATTERN = 5, 3
FFI_KINDS = ["cross_language_leak", "cross_language_free", "ffi_unsafe_call", "ffi_type_mismatch", "memory_leak", "use_after_free"]
EVIDENCE_KINDS = ["cross_language_free", "cross_language_leak", "ffi_unsafe_call", "ffi_type_mismatch", "borrow_escape"]
CLASS_KINDS = ["ffi_unsafe_call", "ffi_type_mismatch", "type_mismatch", "cross_language_leak", "cross_language_free", "borrow_escape"]


def risk_sql() -> str:
    return names.case([(f"origin = '{o}' AND severity = '{s}'", f"'{r}'") for o, row in vocab.RISK.items() for s, r in zip(vocab.SEVERITIES, row)], "'suppressed'")


def surface_steps() -> list[tuple[str, str]]:
    """Severity after the surface gates, step by step (column, SQL). From kind, severity, surface, has_boundary."""
    strong = f"(has_boundary OR {names.exact('kind', EVIDENCE_KINDS)})"
    kept = names.of_category("kind", vocab.NEVER_DOWNGRADED)
    return [
        ("evidence", strong),
        ("v1", "CASE WHEN surface IS NOT NULL AND kind = 'write_to_immutable' AND severity <> 'low' AND NOT evidence AND surface NOT IN ('boundary', 'ffi_producer') THEN 'medium' ELSE severity END"),
        ("v2", "CASE WHEN surface IN ('internal_core', 'runtime_internal', 'unknown') AND kind = 'invalid_free' AND v1 = 'high' AND NOT evidence THEN 'medium' ELSE v1 END"),
        ("v3", f"CASE WHEN surface IS NOT NULL AND NOT evidence AND surface NOT IN ('boundary', 'ffi_producer') AND NOT {kept} AND v2 IN ('critical', 'high') THEN 'medium' ELSE v2 END"),
        ("after_surface", f"CASE WHEN surface = 'runtime_internal' AND v3 <> 'low' AND NOT {kept} THEN 'low' ELSE v3 END"),
    ]


def risk_steps() -> list[tuple[str, str]]:
    """Whether an issue is reported and its final severity. From kind, origin, severity, has_boundary, after_surface."""
    lasting = names.of_category("kind", vocab.NEVER_SUPPRESSED)
    kept = names.of_category("kind", vocab.NEVER_DOWNGRADED)
    order = names.rank("after_surface")
    return [
        ("risk", risk_sql()),
        ("suppressed", f"(risk = 'suppressed' AND NOT ({lasting} OR has_boundary) AND severity <> 'critical')"),
        ("risk2", f"CASE WHEN risk = 'suppressed' AND ({lasting} OR has_boundary) THEN 'low' WHEN risk = 'suppressed' AND severity = 'critical' THEN 'critical' ELSE risk END"),
        ("rr", names.rank("risk2")),
        ("ar", order),
        ("final_rank", f"CASE WHEN {kept} THEN ar WHEN (ar = 3 AND rr < 3) OR (ar = 2 AND rr IN (0, 1)) OR (ar = 1 AND rr = 0) THEN greatest(rr, greatest(ar - 1, 0)) ELSE ar END"),
        ("final_severity", "CASE final_rank WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"),
        ("classification", f"CASE WHEN {names.exact('kind', CLASS_KINDS)} OR has_boundary THEN 'ffi_boundary' ELSE 'local_only' END"),
    ]


def with_steps(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df


def nested(source: str, steps: list[tuple[str, str]]) -> str:
    """The same steps as nested SELECTs over a SQL source."""
    for name, sql in steps:
        source = f"(SELECT *, {sql} AS {name} FROM {source})"
    return source


def admit(issues: DataFrame) -> DataFrame:
    """The issues that are reported, with final_severity and classification. Critical ones pass the check for repeats."""
    judged = with_steps(with_steps(issues, surface_steps()), risk_steps())
    first = F.row_number().over(Window.partitionBy("func", "kind", "file", "line").orderBy(F.when(F.col("severity") == "critical", 1).otherwise(0), "issue_id"))
    judged = judged.withColumn("turn", first)
    return judged.where(~F.col("suppressed") & ((F.col("turn") == 1) | (F.col("severity") == "critical")))


def dedup(issues: DataFrame, keys: tuple[str, ...] = ("func", "kind", "file", "line")) -> DataFrame:
    """The first issue (by id) of each key; without shuffling rows twice: the first is found by min, not by sorting groups."""
    cols = [c for c in issues.columns if c not in keys]
    return issues.groupBy(*keys).agg(F.min_by(F.struct(*cols), "issue_id").alias("s")).select(*[F.col(k) if k in keys else F.col(f"s.{k}").alias(k) for k in issues.columns])


def fold_messages(issues: DataFrame, over: int = FOLD_MESSAGE) -> DataFrame:
    """kind, message, n, func, issue_id: groups of over `over` issues, represented by their first."""
    return issues.groupBy("kind", "message").agg(F.count(F.lit(1)).alias("n"), F.min_by("func", "issue_id").alias("func"), F.min("issue_id").alias("issue_id")).where(F.col("n") > over)


def unfolded(issues: DataFrame, over: int = FOLD_MESSAGE) -> DataFrame:
    """Issues whose (kind, message) isn't folded."""
    folded = fold_messages(issues, over).select("kind", "message")
    return issues.join(folded, ["kind", "message"], "left_anti")


def fold_patterns(issues: DataFrame, over: int = FOLD_PATTERN) -> DataFrame:
    """kind, base, n, first_func, last_func: functions numbered `<base>N`, over `over` of them."""
    based = issues.withColumn("base", F.expr(names.pattern_base("func"))).where("base <> ''")
    return based.groupBy("kind", "base").agg(F.count(F.lit(1)).alias("n"), F.min_by("func", "issue_id").alias("first_func"), F.max_by("func", "issue_id").alias("last_func")).where(F.col("n") > over)


def boundary_sql() -> str:
    return f"CASE WHEN surface IS NOT NULL THEN surface IN ('boundary', 'ffi_producer') WHEN has_boundary THEN true ELSE {names.exact('kind', FFI_KINDS)} END"


def surface_sql() -> str:
    return (
        f"CASE WHEN surface IS NOT NULL THEN surface WHEN {names.exact('kind', FFI_KINDS)} THEN CASE WHEN has_boundary THEN 'boundary' "
        f"WHEN severity IN ('critical', 'high') THEN 'ffi_producer' ELSE 'reachable_from_boundary' END "
        f"WHEN {names.runtime_internal('func')} THEN 'runtime_internal' ELSE 'internal_core' END"
    )


def report_filter(issues: DataFrame, least: str = "low", boundary_only: bool = False, surfaces: list[str] | None = None) -> DataFrame:
    out = issues.where(F.expr(names.rank("severity")) >= vocab.SEVERITIES.index(least))
    if boundary_only:
        out = out.where(F.expr(boundary_sql()))
    if surfaces:
        out = out.where(F.col("surface").isNull() | F.col("surface").isin(*surfaces) | (F.col("surface") == "unknown"))
    return out


def backfill_surfaces(issues: DataFrame) -> DataFrame:
    return issues.withColumn("surface", F.expr(surface_sql()))


def customise(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """User rules (priority, pattern, match_type, action, severity): the first that fits a function; suppress drops, the others set
    a severity. Rules are what a user writes in a configuration: each row is compared with them all in one pass."""
    found = [r.asDict() for r in rules.orderBy("priority").collect()]
    action = severity = None
    for r in found:
        p = r["pattern"]
        fits = {"exact": F.col("func") == p, "prefix": F.col("func").startswith(p), "suffix": F.col("func").endswith(p), "contains": F.col("func").contains(p), "regex": F.col("func").rlike(p)}[r["match_type"]]
        action = F.when(fits, r["action"]) if action is None else action.when(fits, r["action"])
        severity = F.when(fits, F.lit(r["severity"])) if severity is None else severity.when(fits, F.lit(r["severity"]))
    if action is None:
        return issues
    higher = F.element_at(F.array(*[F.lit(s) for s in vocab.SEVERITIES]), F.least(F.expr(names.rank("severity")) + 2, F.lit(4)))
    out = issues.withColumn("__a", F.coalesce(action, F.lit("keep"))).withColumn("__s", severity)
    out = out.withColumn("severity", F.when(F.col("__a") == "escalate", higher).when((F.col("__a") == "override") & F.col("__s").isNotNull(), F.col("__s")).otherwise(F.col("severity")))
    return out.where(F.col("__a") != "suppress").drop("__a", "__s")


def stats(issues: DataFrame) -> DataFrame:
    """One row: all, by severity, by boundary."""
    return issues.agg(F.count(F.lit(1)).alias("issues"), *[F.count_if(F.col("severity") == s).alias(s) for s in vocab.SEVERITIES], F.count_if("has_boundary").alias("at_boundary"))


def event_diagnostics(events: DataFrame, least: float = 0.7) -> DataFrame:
    return events.where(F.col("confidence") >= least).withColumns({"diagnostic": F.lit("runtime_issue"), "level": F.lit("warning")})


def anomaly_level(x: str) -> str:
    return names.case([(f"{x} >= 0.8", "'error'"), (f"{x} >= 0.5", "'warning'")], "'info'")
