"""From IR files to a report: load, run passes, admit, deduplicate, fold, filter, write."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irloom import passes
from irloom.functions import names
from irloom.functions.storage import materialise
from irloom.operators import issues, matching, triage
from irloom.passes import contracts
from irloom.sources import config, ir_text, sinks


def raw_issues(module: ir_text.Module, only: list[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Issue rows with ids, files, surfaces and origins; file and line are those of the function's debug record, the surface is the
    function's by its calls (none for issues of structs and declarations). Rules are library contracts, if there are any."""
    found = passes.run(module, only)
    if rules is not None:
        found = contracts.unowned(found, module, rules).unionByName(contracts.run(module, rules))
    found = materialise(found, "issues")
    where = module.functions.where("subprogram IS NOT NULL").select("module_id", "func", "subprogram").join(module.metadata.select("module_id", F.col("id").alias("subprogram"), F.col("line").alias("l")), ["module_id", "subprogram"], "left")
    files = module.modules.select("module_id", F.col("source_filename").alias("file"))
    out = found.join(where.select("module_id", "func", "l"), ["module_id", "func"], "left").join(files, "module_id", "left")
    out = out.join(passes.facts(module, "surface-classifier").select("module_id", "func", "surface"), ["module_id", "func"], "left")
    zone = F.expr(names.zone("func"))
    origin = F.when(zone == "runtime", "compiler_generated").when(zone == "stdlib", "stdlib").otherwise("user")
    number = F.row_number().over(Window.partitionBy("module_id").orderBy("func", "ordinal", "kind", "pass"))
    return out.select(
        F.xxhash64("module_id", "func", "ordinal", "kind", "pass", number).alias("issue_id"), "module_id", "pass", "kind", "message", "func", "file", F.coalesce("l", F.lit(0)).alias("line"), "ordinal",
        "severity", "confidence", "surface", F.coalesce(F.col("surface") == "boundary", F.lit(False)).alias("has_boundary"), origin.alias("origin"),
    )


def analyse(module: ir_text.Module, settings: config.Config) -> DataFrame:
    """The issues that the settings ask for."""
    rules = None
    if settings.contracts:
        with open(settings.contracts, encoding="utf-8") as f:
            rules = config.contracts(module.modules.sparkSession, f.read())
    found = triage.suppress(issues.backfill_surfaces(raw_issues(module, list(settings.passes) or None, rules)))
    found = issues.admit(found).withColumn("severity", F.col("final_severity")).drop("final_severity")
    found = issues.dedup(found, ("module_id", "func", "kind", "file", "line", "ordinal"))
    if settings.custom_rules:
        rules = found.sparkSession.createDataFrame([(i, r["pattern"], r.get("match_type", "exact"), r["action"], r.get("severity")) for i, r in enumerate(settings.custom_rules)], "priority int, pattern string, match_type string, action string, severity string")
        found = issues.customise(found, rules)
    return issues.report_filter(found, settings.min_severity, settings.boundary_only, list(settings.surfaces))


def cross_module(module: ir_text.Module, confidence: float = 1.0) -> DataFrame:
    """Declarations matched with another module's definitions, scored as boundary calls."""
    declares = module.functions.where("is_declaration").select("module_id", F.col("func").alias("name"))
    defines = module.functions.where("NOT is_declaration").select(F.col("func").alias("name"), F.col("module_id").alias("id"))
    return matching.score_matches(matching.match_functions(declares, defines).where("define_id <> module_id"), confidence)


def main(argv: list[str], spark: SparkSession | None = None) -> str:
    line = config.parse_args(argv)
    path = line.pop("config") or config.discover()
    settings = config.merge(config.load(path) if path else config.Config(), line)
    if not settings.inputs:
        raise SystemExit("no input")
    spark = spark or SparkSession.builder.appName("irloom").getOrCreate()
    found = analyse(ir_text.from_texts(spark.read.text(list(settings.inputs), wholetext=True).select(F.col("_metadata.file_path").alias("module_id"), F.col("value").alias("text"))), settings)
    if settings.output and settings.format in ("json", "sarif"):
        sinks.write(found, settings.output, settings.format)
        return settings.output
    report = {"text": sinks.text_report, "sarif": sinks.sarif, "html": sinks.graph_html, "json": lambda f: "\n".join(r.value for r in sinks.json_lines(f.orderBy("issue_id")).toLocalIterator())}[settings.format](found)
    if settings.output:
        with open(settings.output, "w", encoding="utf-8") as f:
            f.write(report)
    return report


if __name__ == "__main__":
    print(main(sys.argv[1:]))
