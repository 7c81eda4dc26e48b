"""Concurrency passes and the instrumentation planner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom import vocab
from irloom.operators import graph, lifecycle
from irloom.passes import base, detector, issue
from irloom.passes.base import KEY
from irloom.sources.ir_text import Module


def lock_ops(m: Module) -> DataFrame:
    """func (with its module), ordinal, lock_id, is_acquire."""
    return base.called(m, vocab.LOCK_ACQUIRE + vocab.LOCK_RELEASE).where("size(operands) > 0").select(F.concat_ws("\x01", *KEY).alias("func"), "ordinal", F.when(base.argument(0).startswith("@"), F.concat_ws("\x01", "module_id", base.argument(0))).otherwise(F.concat_ws("\x01", *KEY, base.argument(0))).alias("lock_id"), F.col("callee").isin(vocab.LOCK_ACQUIRE).alias("is_acquire"))


@detector("lock")
def lock_cycles(m: Module) -> DataFrame:
    """Functions that take part in a cycle of the lock order."""
    ops = lock_ops(m)
    order = lifecycle.lock_order(ops)
    nodes = graph.cyclic_nodes(order).select(F.col("node").alias("lock_id"))
    bad = ops.where("is_acquire").join(nodes, "lock_id", "left_semi").groupBy("func").agg(F.min("ordinal").alias("ordinal"), F.countDistinct("lock_id").alias("n")).where("n > 1")
    return issue(bad.select(F.split("func", "\x01")[0].alias("module_id"), F.split("func", "\x01")[1].alias("func"), "ordinal"), "thread_safety_violation", "high", 0.8, "locks are taken in a cycle")


@detector("thread-crossing")
def threads(m: Module) -> DataFrame:
    """Signal handlers' unsafe calls; stack memory handed to a new thread; globals written by functions that run as threads without a lock."""
    handlers = base.operands(m).where(F.col("callee").isin("signal", "sigaction") & F.col("o.is_global")).select("module_id", F.expr("substring(o.value, 2)").alias("func")).distinct()
    unsafe = base.called(m, ["malloc", "free", "printf", "fprintf", "exit", "pthread_mutex_lock"]).join(handlers, KEY, "left_semi")
    out = issue(unsafe, "thread_safety_violation", "high", 0.8, "signal handler is not safe")
    stack = m.instructions.where("opcode = 'alloca'").select(*KEY, F.col("result").alias("ptr"))
    given = base.rooted(m, base.called(m, ["pthread_create"]).select(*KEY, "ordinal", base.argument(3).alias("ptr"))).join(stack, [*KEY, "ptr"], "left_semi")
    out = out.unionByName(issue(given, "borrow_escape", "medium", 0.7, "stack memory is handed to a thread"))
    starts = base.called(m, ["pthread_create"]).select("module_id", F.expr("substring(operands[2].value, 2)").alias("func")).distinct()
    locked = base.called(m, vocab.LOCK_ACQUIRE).select(*KEY).distinct()
    writes = m.instructions.where("opcode = 'store' AND operands[1].is_global").join(starts, KEY, "left_semi").join(locked, KEY, "left_anti")
    return out.unionByName(issue(writes, "data_race", "high", 0.75, "global is written without a lock"))


def plan_points(m: Module, most: int = 100) -> DataFrame:
    """Blocks to instrument, by score: branching (three ways or more), back edges, lock operations, allocations; the best `most`."""
    edges = base.cfg_edges(m)
    hot = edges.groupBy(*KEY, F.col("src_bb").alias("bb")).agg(F.count(F.lit(1)).alias("ways"), F.max((F.col("dst_bb") <= F.col("src_bb")).cast("int")).alias("loop"))
    marks = base.calls(m).groupBy(*KEY, "bb").agg(F.count_if(F.col("callee").isin(vocab.LOCK_ACQUIRE + vocab.LOCK_RELEASE)).alias("locks"), F.count_if(F.col("callee").isin(base.ACQUIRES + base.RELEASES)).alias("memory"))
    both = hot.join(marks, [*KEY, "bb"], "full").na.fill(0)
    score = F.when(F.col("ways") >= 3, 3).otherwise(0) + F.col("loop") * 2 + F.col("locks") * 2 + F.col("memory")
    return both.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), *KEY, "bb").limit(most)
