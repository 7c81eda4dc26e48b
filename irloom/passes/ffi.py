"""Passes that follow values over language boundaries, and the views that other passes rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom import vocab
from irloom.functions import names
from irloom.functions.storage import materialise
from irloom.operators import graph
from irloom.passes import base, detector, issue, view
from irloom.passes.base import KEY
from irloom.passes.boundary import tainted
from irloom.sources.ir_text import Module


def boundary_calls(m: Module) -> DataFrame:
    """Calls whose caller and callee have different languages, intrinsics left out, with both languages and the pointer arguments."""
    c = base.calls(m).where("left(callee, 1) <> '%' AND left(callee, 5) <> 'llvm.'").withColumns({"caller_lang": base.function_language(), "callee_lang": base.function_language("callee")})
    return c.where("caller_lang <> callee_lang").withColumn("pointers", F.expr("filter(operands, o -> o.type = 'ptr' AND NOT o.is_null)"))


def surfaces(m: Module) -> DataFrame:
    """module_id, func, surface: boundary by its own calls, producer if exported to another language, reachable over calls from
    either, runtime by name, else internal. Applied to modules of one language too."""
    f = m.functions.where("NOT is_declaration").select(*KEY, "linkage")
    at = boundary_calls(m).select(*KEY).distinct().withColumn("b", F.lit(True))
    made = f.where(F.col("linkage").isin("external", "weak", "weak_odr") & (base.function_language() == "c")).select(*KEY).distinct().withColumn("p", F.lit(True))
    key = lambda a: F.concat_ws("\x01", "module_id", a)
    edges = base.calls(m).select(key("func").alias("src"), key("callee").alias("dst")).distinct()
    near = graph.closure(edges, at.select(key("func").alias("node"))).select(F.split("node", "\x01")[0].alias("module_id"), F.split("node", "\x01")[1].alias("func"), F.lit(True).alias("r"))
    out = f.join(at, KEY, "left").join(made, KEY, "left").join(near, KEY, "left")
    kind = F.when(F.col("b"), "boundary").when(F.expr(names.runtime_internal("func")), "runtime_internal").when(F.col("r"), "reachable_from_boundary").when(F.col("p"), "ffi_producer").otherwise("internal_core")
    return out.select(*KEY, kind.alias("surface"))


# What a call tells of its result (pattern, kind, confidence).
RESOLUTIONS = [
    ("(malloc|calloc|realloc|_alloc$|__rust_alloc|_Znwm)", "heap", 0.95),
    ("into_raw", "transferred", 0.9),
    ("from_raw", "reclaimed", 0.9),
    ("(as_ptr|as_mut_ptr)", "borrowed", 0.85),
    ("drop_in_place", "dropped", 0.9),
    ("(UnsafeCell|RefCell|Mutex)", "interior_mutable", 0.85),
    ("(Pin|pin_)", "pinned", 0.8),
    ("^(open|socket|pipe|dup|accept|epoll_create)$", "descriptor", 0.9),
]


def resolutions(m: Module) -> DataFrame:
    """module_id, func, value, resolution, confidence: what is known of the results of calls; all patterns in one pass."""
    hits = F.filter(F.array(*[F.when(F.col("callee").rlike(p), F.struct(F.lit(k).alias("resolution"), F.lit(c).alias("confidence"))) for p, k, c in RESOLUTIONS]), lambda x: x.isNotNull())
    return base.calls(m).where("result IS NOT NULL").select(*KEY, F.col("result").alias("value"), F.explode(hits).alias("h")).select(*KEY, "value", "h.*")


def danger_pointers(m: Module) -> DataFrame:
    """module_id, func, value: pointers handed over a boundary and all their casts and copies."""
    start = boundary_calls(m).select(*KEY, F.explode("pointers").alias("o")).select(*KEY, F.col("o.value").alias("value"))
    a = base.aliases(m)
    key = lambda v: F.concat_ws("\x01", *KEY, v)
    near = graph.closure(graph.undirected(a.select(key("value").alias("src"), key("base").alias("dst"))), start.select(key("value").alias("node")))
    return near.select(*[F.split("node", "\x01")[i].alias(c) for i, c in enumerate([*KEY, "value"])])


@view("dfg", ("cfg",))
def dfg(m: Module) -> DataFrame:
    """module_id, func, value, def_ordinal, ordinal: from what defines a value to what uses it."""
    return base.dfg_edges(m)


@view("alias", ("cfg", "dfg"))
def alias(m: Module) -> DataFrame:
    """module_id, func, value, root, group: what a value must be (derived from root by casts and copies), or null; values of one
    function, type and group may be the same. Rows are values, so a group of n isn't n * n pairs."""
    made = m.instructions.where("result IS NOT NULL AND opcode IN ('call', 'invoke', 'load', 'alloca', 'getelementptr', 'phi', 'select', 'bitcast', 'addrspacecast')").select(*KEY, F.col("result").alias("value"), F.when(F.col("opcode").isin("getelementptr", "alloca", "bitcast", "addrspacecast"), "ptr").otherwise(F.coalesce("type", F.lit("ptr"))).alias("group"))
    return made.join(base.roots(m), [*KEY, "value"], "left").select(*KEY, "value", "root", "group")


@view("surface-classifier")
def surface_classifier(m: Module) -> DataFrame:
    """module_id, func, surface of every defined function."""
    return surfaces(m).distinct()


@view("SemanticResolver")
def semantic_resolver(m: Module) -> DataFrame:
    """module_id, func, value, resolution, confidence: what calls tell of their results."""
    return resolutions(m)


@detector("danger-surface", ("call-graph", "ptr-lifetime"))
def danger_surface(m: Module) -> DataFrame:
    """Allocations handed over a boundary that their function neither releases nor returns."""
    made = base.allocations(m).withColumn("value", F.col("ptr")).join(danger_pointers(m), [*KEY, "value"], "left_semi")
    kept = base.rooted(m, base.uses(m).where(F.col("opcode").isin("ret") | F.col("callee").isin(base.RELEASES)).select(*KEY, F.col("value").alias("ptr"))).distinct()
    return issue(made.join(kept, [*KEY, "ptr"], "left_anti"), "cross_language_leak", "medium", 0.8, "pointer is handed over a boundary and never released")


@detector("ffi-detector", ("cfg", "dfg", "pointer-flow"))
def ffi_detector(m: Module) -> DataFrame:
    """User input in arguments of dangerous calls over a boundary, by the kind of call; sizes of copies that are tainted."""
    t = tainted(m)
    args = boundary_calls(m).where(F.expr(names.dangerous("callee"))).withColumn("vuln", F.expr(names.vulnerability("callee"))).select(*KEY, "ordinal", "vuln", F.explode("operands").alias("o")).withColumn("value", F.col("o.value"))
    hit = args.join(t, [*KEY, "value"]).groupBy(*KEY, "ordinal", "vuln").agg(F.max("conf").alias("conf"))
    out = None
    for kind, severity in (("command_injection", "critical"), ("buffer_overflow", "high"), ("format_string", "high")):
        part = issue(hit.where(F.col("vuln") == kind), kind, severity, F.col("conf"), "user input reaches a dangerous call over a boundary")
        out = part if out is None else out.unionByName(part)
    copies = base.operands(m).where(F.col("callee").rlike("^(llvm.mem(cpy|move).*|memcpy|memmove)$") & (F.col("o.idx") == 2)).withColumn("value", F.col("o.value"))
    return out.unionByName(issue(copies.join(t, [*KEY, "value"]), "buffer_overflow", "high", F.col("conf"), "size of a copy is user input"))


@detector("ffi-type-mismatch", ("call-graph",))
def type_mismatch(m: Module) -> DataFrame:
    """Arguments against the declared parameters of a call over a boundary: width first, then kind; the first of a call counts."""
    f = m.functions.select("module_id", F.col("func").alias("callee"), "param_types")
    args = boundary_calls(m).join(f, ["module_id", "callee"]).select(*KEY, "ordinal", F.explode("operands").alias("o"), "param_types").withColumn("want", F.expr("try_element_at(param_types, o.idx + 1)")).withColumn("got", F.col("o.type"))
    bits = lambda c: F.regexp_extract(c, r"^i(\d+)$", 1).try_cast("int")
    kind = F.when(bits("got").isNotNull() & bits("want").isNotNull() & (bits("got") > bits("want")), 1).when(bits("got").isNotNull() & bits("want").isNotNull() & (bits("got") < bits("want")), 2).when((F.col("got") == "ptr") != (F.col("want") == "ptr"), 3)
    first = args.withColumn("k", kind).where("k IS NOT NULL AND want IS NOT NULL").groupBy(*KEY, "ordinal").agg(F.min("k").alias("k"))
    return issue(first, "ffi_type_mismatch", F.when(F.col("k") == 2, "medium").otherwise("high"), F.when(F.col("k") == 1, 0.85).otherwise(0.8), "argument does not fit the parameter")


@detector("ffi-body-check", ("ffi-boundary",))
def body_check(m: Module) -> DataFrame:
    """Heap pointers handed to foreign functions of which nothing is known; formats that are no constants."""
    made = base.allocations(m).select(*KEY, F.col("ptr").alias("value"))
    known = base.ACQUIRES + base.RELEASES + vocab.FORMATS + vocab.COPIES
    args = boundary_calls(m).where(~F.col("callee").isin(known)).select(*KEY, "ordinal", F.explode("pointers").alias("o")).withColumn("value", F.col("o.value"))
    out = issue(args.join(made, [*KEY, "value"], "left_semi").dropDuplicates([*KEY, "ordinal"]), "ffi_unsafe_call", "medium", 0.7, "heap memory goes to an unknown foreign function")
    fmt = boundary_calls(m).where(F.col("callee").isin("printf", "vprintf", "syslog")).where("NOT operands[0].is_global")
    return out.unionByName(issue(fmt, "format_string", "high", 0.9, "format is no constant"))


@detector("cross-lang-dataflow", ("ffi-boundary", "pointer-flow"))
def cross_language_frees(m: Module) -> DataFrame:
    """Pointers released by functions of two languages or more in one function, and pointers released twice across functions."""
    f = base.rooted(m, base.releases(m)).withColumn("lang", base.function_language("callee"))
    many = f.groupBy(*KEY, "ptr").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("lang")).alias("langs"), F.max("ordinal").alias("ordinal")).where("n >= 2 AND langs >= 2")
    out = issue(many, "double_free", "high", 0.95, "pointer is released by two languages")
    return out.unionByName(issue(handed_twice(m), "double_free", "high", 0.9, "pointer is released again by a function it is handed to, or after it"))


def handed_twice(m: Module) -> DataFrame:
    """module_id, func, ordinal: releases of a pointer after another one on the same path, one of the two inside a called function."""
    direct = base.rooted(m, base.releases(m)).select(*KEY, "ptr", "bb", "ordinal", F.lit(False).alias("handed"))
    every = materialise(direct.unionByName(base.handed_releases(m).select(*KEY, "ptr", "bb", "ordinal", F.lit(True).alias("handed"))), "handed-twice")
    first = every.groupBy(*KEY, "ptr", F.col("bb").alias("src_bb"), F.col("handed").alias("before")).agg(F.min("ordinal").alias("first"))  # the first of a block stands for all
    pairs = every.withColumnRenamed("bb", "dst_bb").join(first, [*KEY, "ptr"]).where("first < ordinal AND (handed OR before)")
    met = pairs.join(base.block_reach(m).withColumn("linked", F.lit(True)), [*KEY, "src_bb", "dst_bb"], "left").where("src_bb = dst_bb OR linked")
    return met.select(*KEY, "ordinal").distinct()


@detector("callback-lifecycle", ("ffi-boundary", "call-graph"))
def callback_lifecycle(m: Module) -> DataFrame:
    """Functions whose address is taken and that panic or throw; boxes consumed twice by from_raw."""
    taken = base.operands(m).where("o.is_global AND callee IS NOT NULL").select("module_id", F.expr("substring(o.value, 2)").alias("func")).distinct()
    thrown = base.calls(m).where(F.col("callee").rlike("(panic|__cxa_throw|rust_begin_unwind)")).join(taken, KEY, "left_semi")
    out = issue(thrown, "ffi_unsafe_call", "critical", 0.95, "callback may unwind into its caller")
    twice = base.calls(m).where(F.col("callee").contains("from_raw")).select(*KEY, "ordinal", base.argument(0).alias("ptr"))
    again = twice.groupBy(*KEY, "ptr").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("ordinal")).where("n > 1")
    return out.unionByName(issue(again, "use_after_free", "high", 0.8, "box is taken back twice"))


@detector("error-propagation", ("ffi-boundary", "call-graph"))
def error_propagation(m: Module) -> DataFrame:
    """Results of foreign functions that report errors (integers or pointers) and are never used; exceptions that leave a function
    without handler for callers of another language."""
    used = base.uses(m).select(*KEY, "value").distinct()
    asked = boundary_calls(m).where(F.col("type").rlike(r"^(i\d+|ptr)") & F.col("callee").rlike("(_init|_open|_read|_write|_send|_recv|_connect|_exec|_load|_parse|errno|status)")).withColumn("value", F.coalesce("result", F.lit("")))
    out = issue(asked.join(used, [*KEY, "value"], "left_anti"), "unchecked_return", "medium", 0.75, "error of a foreign function is ignored")
    # throws of a function without personality (no handler of its own) that another language calls
    throws = base.calls(m).where(F.col("callee").rlike(r"(^__cxa_(re)?throw$|^_Unwind_RaiseException$|rust_begin_unwind|panic)"))
    bare = m.functions.where("NOT is_declaration AND personality IS NULL").select(*KEY)
    asked_for = boundary_calls(m).select("module_id", F.col("callee").alias("func")).distinct()
    crossing = throws.join(bare, KEY, "left_semi").join(asked_for, KEY, "left_semi")
    return out.unionByName(issue(crossing, "ffi_unsafe_call", "high", 0.8, "exception leaves for a caller of another language"))


@detector("abi-mismatch", ("abi-compat",))
def abi_mismatch(m: Module) -> DataFrame:
    """Packed structs, and variadic functions called from another language."""
    packed = m.structs.where("packed").select("module_id", F.col("name").alias("func"), F.lit(0).alias("ordinal"))
    out = issue(packed, "ffi_type_mismatch", "low", 0.6, "packed struct may be laid out differently elsewhere")
    var = m.functions.where("variadic").select("module_id", F.col("func").alias("callee"))
    risky = boundary_calls(m).where(~F.col("callee").isin(vocab.FORMATS)).join(var, ["module_id", "callee"], "left_semi")
    return out.unionByName(issue(risky, "type_mismatch", "low", 0.6, "variadic function is called over a boundary"))


@detector("finalizer", ("gc-safety",))
def finalizers(m: Module) -> DataFrame:
    """Finalizers that call back into the collected language."""
    inside = base.calls(m).where(F.col("func").rlike("(?i)(finalize|__del__|tp_dealloc)") & F.col("callee").rlike("^(PyObject_Call|PyErr_|Call(Void|Object|Int)Method)"))
    return issue(inside, "use_after_free", "high", 0.8, "finalizer calls back")
