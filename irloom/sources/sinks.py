"""Reports: JSON, SARIF, text, graph. Rows are formatted where they are; what is printed comes to the driver a partition at a time."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom import vocab

# SARIF levels of severities.
LEVELS = {"low": "note", "medium": "warning", "high": "error", "critical": "error"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def json_lines(issues: DataFrame) -> DataFrame:
    """value: one JSON object for each issue, fields in the table's order."""
    return issues.select(F.to_json(F.struct(*issues.columns)).alias("value"))


def sarif_results(issues: DataFrame) -> DataFrame:
    """value: one SARIF result for each issue (kind, message, severity, file, line, and trace if there is one)."""
    level = F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v)])
    col = F.col("col") if "col" in issues.columns else F.lit(1)
    place = lambda file, line, column: F.struct(F.struct(F.struct(F.coalesce(file, F.lit("unknown")).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce(line, F.lit(1)), F.lit(1)).alias("startLine"), F.greatest(F.coalesce(column, F.lit(1)), F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))
    parts = [F.col("kind").alias("ruleId"), level[F.col("severity")].alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place(F.col("file"), F.col("line"), col)).alias("locations")]
    if "trace" in issues.columns:
        step = lambda s: F.struct(F.struct(F.struct(s["description"].alias("text")).alias("message"), place(s["file"], s["line"], F.lit(1))["physicalLocation"].alias("physicalLocation")).alias("location"))
        flows = F.array(F.struct(F.array(F.struct(F.transform("trace", step).alias("locations"))).alias("threadFlows")))
        parts.append(F.when(F.size("trace") > 0, flows).alias("codeFlows"))
    return issues.select(F.to_json(F.struct(*parts)).alias("value"))


def sarif(issues: DataFrame) -> str:
    """A whole SARIF document of all issues, by id. It is one string: for issues that don't fit one, ``write`` gives results as lines."""
    found = [json.loads(r.value) for r in sarif_results(issues.orderBy("issue_id")).toLocalIterator()]
    rules = [{"id": k, "properties": {"cwe": f"CWE-{n}", "category": c}} for k, n, c in vocab.ISSUE_KINDS]
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "irloom", "rules": rules}}, "results": found}]})


def text_report(issues: DataFrame, top: int = 20) -> str:
    """Counts by severity and kind, and the issues of highest severity and confidence."""
    counts = issues.groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n")).collect()
    rank = F.expr("CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END")
    lines = [f"Issues: {sum(r.n for r in counts)}"]
    for s in reversed(vocab.SEVERITIES):
        of = sorted((r for r in counts if r.severity == s), key=lambda r: (-r.n, r.kind))
        if of:
            lines.append(f"  {s}: {sum(r.n for r in of)} ({', '.join(f'{r.kind} {r.n}' for r in of)})")
    for r in issues.orderBy(rank, F.desc("confidence"), "issue_id").limit(top).collect():
        lines.append(f"[{r.severity}] {r.kind} in {r.func} at {r.file or 'unknown'}:{r.line or 0} ({r.confidence:.2f}) {r.message}")
    return "\n".join(lines)


def graph_rows(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (functions with their issues and worst severity) and edges (function to kind)."""
    worst = F.max(F.expr("CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"))
    nodes = issues.groupBy(F.col("func").alias("id")).agg(F.count(F.lit(1)).alias("issues"), worst.alias("rank"))
    edges = issues.groupBy(F.col("func").alias("src"), F.col("kind").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return nodes, edges


def graph_html(issues: DataFrame, most: int = 500) -> str:
    """A page with the graph of the functions that have most issues."""
    nodes, edges = graph_rows(issues)
    top = nodes.orderBy(F.desc("issues"), "id").limit(most)
    kept = edges.join(top.select(F.col("id").alias("src")), "src", "left_semi")
    data = {"nodes": [r.asDict() for r in top.collect()], "edges": [r.asDict() for r in kept.orderBy("src", "dst").limit(20 * most).collect()]}
    rows = "".join(f"<tr><td>{html.escape(n['id'] or '')}</td><td>{n['issues']}</td><td>{vocab.SEVERITIES[n['rank']]}</td></tr>" for n in data["nodes"])
    held = json.dumps(data).replace("</", "<\\/")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Issues</title></head><body><table><tr><th>function</th><th>issues</th><th>worst</th></tr>{rows}</table><script id='graph' type='application/json'>{held}</script></body></html>"


def write(issues: DataFrame, path: str, kind: str = "json") -> None:
    """Issue rows to files: json or sarif as lines, parquet, csv."""
    if kind == "json":
        json_lines(issues).write.mode("overwrite").text(path)
    elif kind == "sarif":
        sarif_results(issues).write.mode("overwrite").text(path)
    elif kind in ("parquet", "csv"):
        issues.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"unknown report: {kind}")


def call_graph_lines(edges: DataFrame) -> DataFrame:
    """value: a line for each caller and callee of the call-graph view, with the sites and whether the callee is outside the module."""
    return edges.select(F.concat(F.col("module_id"), F.lit(": "), F.col("func"), F.lit(" -> "), F.col("callee"), F.format_string(" (%d)", "sites"), F.when(F.col("defined"), "").otherwise(" extern")).alias("value"))
