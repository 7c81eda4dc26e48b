"""Memory passes: allocation checks, frees, leaks, lifetimes, overflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irloom import vocab
from irloom.functions.storage import materialise
from irloom.passes import base, detector, issue, view
from irloom.passes.base import KEY
from irloom.sources.ir_text import Module


@detector("malloc-check")
def malloc_check(m: Module) -> DataFrame:
    """Results of C allocators that are used (beyond compares, calls and returns) with no null compare anywhere in the function."""
    made = base.called(m, vocab.ALLOCATORS).where("result IS NOT NULL").select(*KEY, F.col("result").alias("value"), "ordinal")
    use = base.uses(m)
    touched = use.where(~F.col("opcode").isin("call", "invoke", "icmp", "ret")).select(*KEY, "value").distinct()
    checked = m.instructions.where("opcode = 'icmp' AND exists(operands, o -> o.is_null)").select(*KEY, F.explode("operands").alias("o")).select(*KEY, F.col("o.value").alias("value")).distinct()
    return issue(made.join(touched, [*KEY, "value"], "left_semi").join(checked, [*KEY, "value"], "left_anti"), "malloc_unchecked", "medium", 0.7, "allocation is used without a null check")


# Functions whose results matter most.
CRITICAL_RETURNS = ["malloc", "system", "exec", "popen", "open", "read", "write"]


@detector("return-check")
def return_check(m: Module) -> DataFrame:
    """Results of functions that must be checked and are never used; surer where the name is, or holds, that of a critical one."""
    made = base.called(m, vocab.MUST_CHECK + vocab.COMMANDS).select(*KEY, F.coalesce("result", F.lit("")).alias("value"), "ordinal", "callee")
    unused = made.join(base.uses(m).select(*KEY, "value").distinct(), [*KEY, "value"], "left_anti")
    part = sum((F.col("callee").contains(n).cast("int") for n in CRITICAL_RETURNS), F.lit(0))
    unused = unused.withColumn("sure", F.when(F.col("callee").isin(CRITICAL_RETURNS), 0.9).otherwise(F.least(F.round(0.6 + 0.15 * part, 6), F.lit(1.0))))
    return issue(unused, "unchecked_return", F.when(F.col("sure") >= 0.8, "high").when(F.col("sure") >= 0.6, "medium").otherwise("low"), F.col("sure"), "return value is never used")


@detector("integer-overflow")
def integer_overflow(m: Module) -> DataFrame:
    """Narrow arithmetic: add and mul of at most 8 bits with a constant of 1000 or more or two values, sub of two values."""
    width = F.regexp_extract("type", r"^i(\d+)$", 1).try_cast("int")
    consts = F.expr("exists(operands, o -> o.is_const)")
    big = F.expr("exists(operands, o -> o.int_value >= 1000)")
    hit = (F.col("opcode").isin("add", "mul") & (big | ~consts)) | ((F.col("opcode") == "sub") & ~consts)
    return issue(m.instructions.where((width <= 8) & hit), "integer_overflow", "medium", 0.6, "narrow arithmetic may wrap")


@detector("buffer-overflow")
def buffer_overflow(m: Module) -> DataFrame:
    """Constant indexes at or beyond an array's length; checked copies whose size passes the destination's; unbounded copies."""
    length = F.regexp_extract("type", r"^\[(\d+) x", 1).try_cast("long")
    gep = m.instructions.where("opcode = 'getelementptr'").withColumn("n", length).withColumn("last", F.expr("element_at(operands, -1).int_value"))
    out = issue(gep.where("n IS NOT NULL AND size(operands) >= 3 AND last >= n"), "buffer_overflow", "high", 0.85, "constant index beyond the array")
    chk = base.calls(m).where(F.col("callee").rlike("^__mem(cpy|move|set)_chk$")).where("operands[2].int_value > operands[3].int_value AND operands[3].int_value >= 0")
    plain = base.called(m, vocab.COPIES)
    stack = m.instructions.where("opcode = 'alloca'").select(*KEY, F.col("result").alias("dst"), F.regexp_extract("type", r"^\[(\d+) x i8\]", 1).try_cast("long").alias("room"))
    copies = base.calls(m).where(F.col("callee").rlike(r"^(llvm\.mem(cpy|move|set).*|memcpy|memmove|memset|read|recv|fgets)$"))
    sized = base.rooted(m, copies.select(*KEY, "ordinal", F.when(F.col("callee").isin("read", "recv"), base.argument(1)).otherwise(base.argument(0)).alias("ptr"), F.when(F.col("callee") == "fgets", F.expr("operands[1].int_value")).otherwise(F.expr("operands[2].int_value")).alias("size")))
    over = sized.join(stack.withColumnRenamed("dst", "ptr"), [*KEY, "ptr"]).where("size > room")
    return out.unionByName(issue(chk, "buffer_overflow", "high", 0.85, "copy is larger than its destination")).unionByName(issue(plain, "buffer_overflow", "medium", 0.7, "copy without a bound")).unionByName(issue(over, "buffer_overflow", "high", 0.85, "copy is larger than its buffer"))


def _freed(m: Module) -> DataFrame:
    """Releases with the root of what they release. Made once for a module."""
    if "freed" not in m.kept:
        m.kept["freed"] = materialise(base.rooted(m, base.releases(m)), "freed")
    return m.kept["freed"]


def _earliest(m: Module) -> DataFrame:
    """module_id, func, ptr, bb, first: the first release of ptr in the block or in one that reaches it. A later row is after a
    release if it is after this one: releases need not be paired."""
    own = _freed(m).groupBy(*KEY, "ptr", "bb").agg(F.min("ordinal").alias("first"))
    from_far = own.withColumnRenamed("bb", "src_bb").join(base.block_reach(m), [*KEY, "src_bb"]).select(*KEY, "ptr", F.col("dst_bb").alias("bb"), "first")
    return own.unionByName(from_far).groupBy(*KEY, "ptr", "bb").agg(F.min("first").alias("first"))


@detector("memory-safety", ("cfg",))
def double_free(m: Module) -> DataFrame:
    """A pointer released again in the same block, or in a block that the first release's reaches; exclusive branches are no pair."""
    met = _freed(m).join(_earliest(m), [*KEY, "ptr", "bb"]).where("first < ordinal")
    return issue(met.select(*KEY, "ordinal").distinct(), "double_free", "critical", 0.9, "pointer is released twice on one path")


@detector("ptr-lifetime", ("cfg",))
def use_after_free(m: Module) -> DataFrame:
    """Loads, stores and calls on a pointer after its release, on one path; other releases are double frees, not uses."""
    deref = base.uses(m).where(F.col("opcode").isin("load", "store", "call", "invoke") & ~F.coalesce(F.col("callee").isin(base.RELEASES), F.lit(False)))
    u = base.rooted(m, deref.select(*KEY, F.col("value").alias("ptr"), "bb", "ordinal"))
    met = u.join(_earliest(m), [*KEY, "ptr", "bb"]).where("ordinal > first")
    return issue(met.select(*KEY, "ordinal").distinct(), "use_after_free", "critical", 0.8, "pointer is used after its release")


@detector("ownership-leak", ("cfg",))
def memory_leak(m: Module) -> DataFrame:
    """Allocations of a function that it neither releases, returns, stores nor hands to a call."""
    made = base.allocations(m)
    gone = base.rooted(m, base.uses(m).where(F.col("opcode").isin("ret", "call", "invoke") | ((F.col("opcode") == "store") & (F.col("idx") == 0)) | F.col("opcode").isin("phi", "select", "insertvalue")).select(*KEY, F.col("value").alias("ptr"))).distinct()
    return issue(made.join(gone, [*KEY, "ptr"], "left_anti"), "memory_leak", "medium", 0.7, "allocation is never released")


@detector("free-validation")
def free_validation(m: Module) -> DataFrame:
    """Releases of stack slots, globals and constants."""
    f = _freed(m)
    stack = m.instructions.where("opcode = 'alloca'").select(*KEY, F.col("result").alias("ptr")).distinct()
    out = issue(f.join(stack, [*KEY, "ptr"], "left_semi"), "invalid_free", "high", 0.85, "stack memory is released")
    return out.unionByName(issue(f.where(F.col("ptr").startswith("@")), "invalid_free", "high", 0.85, "global memory is released"))


@detector("cross-language-free")
def cross_language_free(m: Module) -> DataFrame:
    """Memory of one family released by another's function; and a C release inside Rust code or the other way round."""
    made = base.allocations(m).select(*KEY, "ptr", F.col("family").alias("made"))
    f = _freed(m)
    mixed = f.join(made, [*KEY, "ptr"]).where("family <> made")
    out = issue(mixed, "cross_language_free", "critical", 0.9, "memory is released by another family's function")
    odd = f.where(((base.function_language() == "rust") & (F.col("family") == "c_heap")) | ((base.function_language() == "c") & (F.col("family") == "rust_global"))).join(made.select(*KEY, "ptr"), [*KEY, "ptr"], "left_anti")
    return out.unionByName(issue(odd, "cross_language_free", "high", 0.75, "memory is released by another language"))


@detector("null-deref")
def null_dereference(m: Module) -> DataFrame:
    """Loads and stores through a constant null."""
    hit = m.instructions.where("(opcode = 'load' AND operands[0].is_null) OR (opcode = 'store' AND operands[1].is_null)")
    return issue(hit, "null_dereference", "high", 0.9, "null is dereferenced")


@detector("stack-escape")
def stack_escape(m: Module) -> DataFrame:
    """Addresses of stack slots that are returned or stored to a global."""
    stack = m.instructions.where("opcode = 'alloca'").select(*KEY, F.col("result").alias("ptr"))
    ret = base.rooted(m, m.instructions.where("opcode = 'ret' AND operands[0].type = 'ptr'").select(*KEY, "ordinal", base.argument(0).alias("ptr")))
    put = base.rooted(m, m.instructions.where("opcode = 'store' AND operands[1].is_global").select(*KEY, "ordinal", base.argument(0).alias("ptr")))
    return issue(ret.unionByName(put).join(stack, [*KEY, "ptr"], "left_semi"), "borrow_escape", "high", 0.8, "stack address leaves its function")


@detector("write-to-immutable")
def write_to_immutable(m: Module) -> DataFrame:
    """Stores through values cast from constants or readonly names."""
    hit = m.instructions.where("opcode = 'store'").select(*KEY, "ordinal", base.argument(1).alias("ptr"))
    hit = base.rooted(m, hit).where(F.col("ptr").rlike(r"^@(\.str|__const|const_|kConst)"))
    return issue(hit, "write_to_immutable", "high", 0.85, "constant memory is written")


@detector("static-buffer")
def static_buffer(m: Module) -> DataFrame:
    """Two results of a function with a static buffer that are alive together in one function."""
    shared = ["ctime", "asctime", "localtime", "gmtime", "strerror", "inet_ntoa", "getpwnam", "strtok", "tmpnam", "getenv"]
    w = Window.partitionBy(*KEY, "callee")
    hit = base.called(m, shared).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("first", F.min("ordinal").over(w)).where("n > 1 AND ordinal > first")
    return issue(hit, "static_buffer_misuse", "medium", 0.7, "static buffer is overwritten")


@detector("error-path-leak")
def error_path_leak(m: Module) -> DataFrame:
    """Calls that may fail while the function holds an allocation and then returns without releasing it."""
    from irloom.operators import lifecycle

    op = F.when(F.col("callee").isin(base.ACQUIRES), "alloc").when(F.col("callee").isin(base.RELEASES), "free").when(F.col("callee").rlike("(^|_)(err|error|fail|abort|panic)"), "error").otherwise("other")
    ops = base.calls(m).select(F.concat_ws("\x01", *KEY).alias("func"), "ordinal", op.alias("op"))
    found = lifecycle.error_path_leaks(ops).select(F.split("func", "\x01")[0].alias("module_id"), F.split("func", "\x01")[1].alias("func"), "ordinal")
    return issue(found, "memory_leak", "high", 0.85, "allocation is held on an error path")


@view("cfg")
def cfg(m: Module) -> DataFrame:
    """module_id, func, src_bb, dst_bb of all control-flow edges."""
    return base.cfg_edges(m)
