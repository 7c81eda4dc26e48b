"""Library contracts (``config.contracts``) applied to a module: wrong releases, and allocations that are not the caller's to release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.passes import base, issue
from irloom.passes.base import KEY
from irloom.sources.ir_text import Module


def mismatches(m: Module, rules: DataFrame) -> DataFrame:
    """Issues where a library's resource is released by a function that no pair of its contract allows. Rules have the columns of
    ``config.contracts``; a pointer is released by a function that any rule, or the engine itself, knows as a release."""
    rules = rules.select("allocate", "release", "confidence").distinct()
    made = base.calls(m).where("result IS NOT NULL").join(rules.select(F.col("allocate").alias("callee")).distinct(), "callee", "left_semi").select(*KEY, F.col("result").alias("ptr"), F.col("callee").alias("allocate"))
    known = base.calls(m).where(F.size("operands") > 0).join(rules.select(F.col("release").alias("callee")).distinct().withColumn("ruled", F.lit(True)), "callee", "left")
    freed = known.where(F.col("ruled") | F.col("callee").isin(base.RELEASES)).select(*KEY, "ordinal", base.argument(0).alias("ptr"), F.col("callee").alias("release"))
    met = base.rooted(m, freed).join(made, [*KEY, "ptr"]).join(rules.select("allocate", "release"), ["allocate", "release"], "left_anti")
    sure = rules.groupBy("allocate").agg(F.max("confidence").alias("sure"))
    return issue(met.join(sure, "allocate"), "contract_mismatch", "high", F.col("sure"), "resource is released by a function that its contract does not allow").distinct()


def leaks(m: Module, rules: DataFrame) -> DataFrame:
    """Issues for resources that the caller owns by contract and neither releases, returns, stores nor hands on."""
    owned = rules.where("ownership IN ('caller', 'custom')").groupBy(F.col("allocate").alias("callee")).agg(F.max("confidence").alias("sure"))
    made = base.calls(m).where("result IS NOT NULL").join(owned, "callee").select(*KEY, "ordinal", F.col("result").alias("ptr"), "sure")
    gone = base.rooted(m, base.uses(m).where(F.col("opcode").isin("ret", "call", "invoke", "phi", "select", "insertvalue") | ((F.col("opcode") == "store") & (F.col("idx") == 0))).select(*KEY, F.col("value").alias("ptr"))).distinct()
    return issue(made.join(gone, [*KEY, "ptr"], "left_anti"), "memory_leak", "medium", F.col("sure"), "resource of a library is never released")


def run(m: Module, rules: DataFrame) -> DataFrame:
    """Issues by contract, as ``passes.run`` gives them."""
    return mismatches(m, rules).unionByName(leaks(m, rules)).withColumn("pass", F.lit("contracts"))


def unowned(found: DataFrame, m: Module, rules: DataFrame) -> DataFrame:
    """found without leaks of what is not the caller's: borrowed, collected or released by the callee, by contract."""
    free = rules.where("ownership IN ('gc', 'callee', 'borrowed')").select(F.col("allocate").alias("callee")).distinct()
    sites = base.calls(m).join(free, "callee", "left_semi").select(*KEY, "ordinal", F.lit("memory_leak").alias("kind")).distinct()
    return found.join(sites, [*KEY, "ordinal", "kind"], "left_anti").select(*found.columns)
