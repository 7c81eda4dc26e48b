"""Passes on language boundaries: unsafe calls, taint, types, ABI, layouts, unwinding, references and callbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom import vocab
from irloom.functions import names, scores
from irloom.functions.storage import materialise
from irloom.operators import lifecycle
from irloom.passes import base, detector, issue, view
from irloom.passes.base import KEY
from irloom.sources.ir_text import Module


@view("call-graph")
def call_graph(m: Module) -> DataFrame:
    """module_id, func, callee, sites, defined: who calls whom how often, and whether the callee is defined in the module."""
    here = m.functions.where("NOT is_declaration").select("module_id", F.col("func").alias("callee"), F.lit(True).alias("defined")).distinct()
    sites = base.calls(m).groupBy(*KEY, "callee").agg(F.count(F.lit(1)).alias("sites"))
    return sites.join(here, ["module_id", "callee"], "left").select(*KEY, "callee", "sites", F.coalesce("defined", F.lit(False)).alias("defined"))


@detector("ffi-boundary", ("call-graph",))
def unsafe_calls(m: Module) -> DataFrame:
    """Calls from one language into another whose name is dangerous and passes the score gates."""
    c = base.calls(m).withColumns({"caller_lang": base.function_language(), "callee_lang": base.function_language("callee"), "vuln": F.expr(names.vulnerability("callee")), "signals": F.expr(names.signals("callee")), "risky": F.expr(names.dangerous("callee"))})
    c = c.where("caller_lang <> callee_lang AND callee_lang <> 'builtin' AND risky").withColumn("score", F.expr(scores.boundary("signals", "vuln", "CAST(1 AS DOUBLE)")))
    kept = c.where(F.expr(scores.boundary_passes("signals", "vuln", "score")))
    return issue(kept, "ffi_unsafe_call", F.expr(scores.boundary_severity("score")), F.col("score"), "dangerous call across languages")


@detector("null-guard", ("ffi-boundary",))
def unguarded(m: Module) -> DataFrame:
    """Results of dlopen, dlsym and nullable JNI functions that are never compared with null."""
    nullable = base.calls(m).where(F.col("callee").isin(*vocab.DYNAMIC[:2]) | F.col("callee").rlike("(FindClass|GetMethodID|GetFieldID|NewGlobalRef|GetStringUTFChars)$"))
    checked = base.uses(m).where("opcode = 'icmp'").select(*KEY, "value").distinct()
    return issue(nullable.where("result IS NOT NULL").withColumn("value", F.col("result")).join(checked, [*KEY, "value"], "left_anti"), "unchecked_return", "medium", 0.65, "nullable result has no guard")


def taint_edges(m: Module) -> DataFrame:
    """module_id, func, src, dst, factor: how much taint an instruction hands from a value to another."""
    o = base.operands(m)
    to = o.where("result IS NOT NULL").select(*KEY, F.col("o.value").alias("src"), F.col("result").alias("dst"), "opcode", "callee", "many")
    san = F.create_map(*[F.lit(x) for n, _, f in vocab.SANITIZERS for x in (n, f)])
    factor = (
        F.when(F.col("opcode").isin("bitcast", "inttoptr", "ptrtoint", "zext", "sext", "trunc", "select", "freeze"), 1.0)
        .when(F.col("opcode").isin("add", "sub", "mul", "udiv", "sdiv", "urem", "srem", "and", "or", "xor", "shl", "lshr", "ashr"), 0.9)
        .when(F.col("opcode").isin("load", "phi"), 0.95)
        .when(F.col("opcode") == "getelementptr", F.greatest(1 - 0.1 * (F.col("many") - 1), F.lit(0.5)))  # by the number of indexes
        .when(F.col("callee").isNotNull(), F.coalesce(san[F.col("callee")], F.lit(0.95)))
    )
    direct = to.withColumn("factor", factor).where("factor IS NOT NULL").select(*KEY, "src", "dst", "factor")
    stores = m.instructions.where("opcode = 'store'").select(*KEY, base.argument(0).alias("src"), base.argument(1).alias("dst"), F.lit(1.0).alias("factor"))
    fmt = base.called(m, vocab.FORMATS).where("size(operands) > 1").select(*KEY, base.argument(1).alias("src"), base.argument(0).alias("dst"), F.lit(0.95).alias("factor"))
    back = base.aliases(m).select(*KEY, F.col("value").alias("src"), F.col("base").alias("dst"), F.lit(1.0).alias("factor"))
    return direct.unionByName(stores).unionByName(fmt).unionByName(back)


def tainted(m: Module, floor: float = 0.1) -> DataFrame:
    """module_id, func, value, conf: what user input reaches inside each function: results and arguments of calls to sources, and
    the parameters of functions that are named like one."""
    from irloom.operators.graph import max_product

    out = base.called(m, vocab.SOURCES)
    seeds = out.where("result IS NOT NULL").select(*KEY, F.col("result").alias("v")).union(out.select(*KEY, F.explode("operands").alias("o")).where("NOT o.is_const AND NOT o.is_global").select(*KEY, "o.value"))
    made = m.instructions.where("result IS NOT NULL").select(*KEY, F.col("result").alias("value"))
    named = base.uses(m).where(F.col("func").isin(vocab.SOURCES) & F.col("value").startswith("%")).join(made, [*KEY, "value"], "left_anti")
    seeds = seeds.union(named.select(*KEY, "value"))
    key = lambda v: F.concat_ws("\x01", *KEY, v)
    edges = taint_edges(m).where(~F.col("src").rlike("^(@|-?[0-9]|null)")).select(key("src").alias("src"), key("dst").alias("dst"), "factor")
    best = max_product(edges, seeds.select(key("v").alias("node"), F.lit(1.0).alias("conf")), floor)
    part = F.split("node", "\x01")
    return best.select(part[0].alias("module_id"), part[1].alias("func"), part[2].alias("value"), "conf")


@detector("pointer-flow", ("call-graph",))
def injections(m: Module) -> DataFrame:
    """Commands with any tainted argument; format strings that are tainted."""
    t = tainted(m)
    args = base.operands(m).where("callee IS NOT NULL").withColumn("value", F.col("o.value"))
    cmd = args.where(F.col("callee").isin(vocab.COMMANDS)).join(t, [*KEY, "value"]).groupBy(*KEY, "ordinal").agg(F.max("conf").alias("conf"))
    place = F.when(F.col("callee").isin("fprintf", "dprintf", "vfprintf", "sprintf", "vsprintf", "asprintf", "syslog"), 1).when(F.col("callee").isin("snprintf", "vsnprintf"), 2).otherwise(0)
    fmt = args.where(F.col("callee").isin(vocab.FORMATS) & (F.col("o.idx") == place) & ~F.col("o.is_global")).join(t, [*KEY, "value"])
    return issue(cmd, "command_injection", "critical", F.col("conf"), "user input reaches a command").unionByName(issue(fmt, "format_string", "high", F.col("conf"), "user input is a format"))


@detector("abi-compat", ("call-graph",))
def abi(m: Module) -> DataFrame:
    """Declarations against another module's definition: parameter count, then kinds of parameters and result."""
    d = m.functions.where("is_declaration AND NOT func LIKE 'llvm.%'").select("module_id", "func", "n_params", "param_types", "ret_type", "variadic")
    kinds_of = [F.col("n_params").alias("n"), F.col("param_types").alias("types"), F.col("ret_type").alias("ret")]
    # a signature is met once, however many modules define it; it counts if another module than the declaration's does
    f = m.functions.where("NOT is_declaration").groupBy("func", *kinds_of).agg(F.min("module_id").alias("one"), F.max("module_id").alias("other"))
    met = d.join(f, "func").where("one <> module_id OR other <> module_id").withColumn("ordinal", F.lit(0))
    count = met.where("NOT variadic AND n_params <> n")
    kinds = met.where("n_params = n AND (exists(zip_with(param_types, types, (a, b) -> a <> b), x -> x) OR ret_type <> ret)")
    return issue(count, "type_mismatch", "high", 0.9, "parameter counts differ").unionByName(issue(kinds, "ffi_type_mismatch", "medium", 0.8, "parameter or result types differ")).distinct()


@detector("call-types")
def call_types(m: Module) -> DataFrame:
    """Calls against the declaration in their own module: number of arguments."""
    f = m.functions.where("NOT variadic").select("module_id", F.col("func").alias("callee"), "n_params")
    return issue(base.calls(m).join(f, ["module_id", "callee"]).where("size(operands) <> n_params"), "callback_signature_mismatch", "medium", 0.6, "call does not fit the declaration")


@detector("layout-mismatch")
def layouts(m: Module) -> DataFrame:
    """Structs of one name with other fields or packing in a module further on; a layout counts once, by the last module that has it."""
    a = m.structs.select("module_id", F.regexp_replace("name", r"^(struct|class|union)\.", "").alias("name"), F.struct("packed", "fields").alias("layout"))
    last = materialise(a.groupBy("name", "layout").agg(F.max("module_id").alias("last")), "layouts")
    top = last.groupBy("name").agg(F.max_by("layout", F.struct("last", "layout")).alias("top"), F.max("last").alias("end"))
    rest = last.join(top, "name").where("layout <> top").groupBy("name").agg(F.max("last").alias("before"))  # names with two layouts or more
    hit = a.join(top, "name").join(rest, "name").where("module_id < CASE WHEN layout = top THEN before ELSE end END")
    return issue(hit.select("module_id", F.col("name").alias("func"), F.lit(0).alias("ordinal")).distinct(), "ffi_type_mismatch", "high", 0.75, "struct layouts differ")


@detector("string-safety")
def strings(m: Module) -> DataFrame:
    """Strings of Rust, Go or Zig (by the maker's name) handed to C string functions."""
    made = base.calls(m).where(F.col("callee").rlike(r"(as_ptr|as_bytes|into_boxed_str|StringData|unsafe\.String)") & F.col("result").isNotNull()).select(*KEY, F.col("result").alias("value"))
    sink = base.operands(m).where(F.col("callee").isin("strlen", "strcpy", "strcat", "strcmp", "printf", "puts", "fopen", "strdup")).withColumn("value", F.col("o.value"))
    return issue(sink.join(made.distinct(), [*KEY, "value"], "left_semi"), "ffi_unsafe_call", "medium", 0.85, "string without terminator reaches C")


@detector("unwind-boundary")
def unwinding(m: Module) -> DataFrame:
    """Panics, throws and long jumps in exported unmangled functions, which callers of another language can't unwind."""
    exported = m.functions.where("NOT is_declaration AND linkage IN ('external', 'weak', 'weak_odr')").where(base.function_language() == "c").select(*KEY)
    kind = F.when(F.col("callee").rlike("(rust_begin_unwind|panic)"), "rust").when(F.col("callee").isin("__cxa_throw", "_Unwind_RaiseException"), "cpp").when(F.col("callee").isin("longjmp", "siglongjmp"), "jump")
    hit = base.calls(m).withColumn("k", kind).where("k IS NOT NULL").join(exported, KEY, "left_semi")
    return issue(hit, "ffi_unsafe_call", F.when(F.col("k") == "jump", "high").otherwise("critical"), 0.85, "unwinding crosses a boundary")


# References of the virtual machine, what takes and what gives them back.
_JNI = [("NewGlobalRef", "DeleteGlobalRef"), ("NewLocalRef", "DeleteLocalRef"), ("GetStringUTFChars", "ReleaseStringUTFChars"), ("GetPrimitiveArrayCritical", "ReleasePrimitiveArrayCritical"), ("GetByteArrayElements", "ReleaseByteArrayElements"), ("MonitorEnter", "MonitorExit")]


@detector("jni-leak", ("ffi-boundary",))
def jni(m: Module) -> DataFrame:
    """References of the virtual machine that are taken and not given back; a release with nothing open counts for nothing."""
    pair = sign = None
    for a, r in sorted(_JNI, key=lambda p: -len(p[0])):
        one, other = F.col("callee").endswith(a), F.col("callee").endswith(r)
        pair = F.when(one | other, a) if pair is None else pair.when(one | other, a)
        sign = F.when(one, 1).when(other, -1) if sign is None else sign.when(one, 1).when(other, -1)
    e = base.calls(m).select(*KEY, "ordinal", pair.alias("pair"), sign.alias("sign")).where("pair IS NOT NULL")
    left = lifecycle.balance(e, [*KEY, "pair"], "sign", "ordinal").where("open > 0").join(e.where("sign = 1").groupBy(*KEY, "pair").agg(F.max("ordinal").alias("ordinal")), [*KEY, "pair"])
    return issue(left, "memory_leak", "high", 0.85, "reference is never given back")


@detector("gc-safety", ("ffi-boundary",))
def interpreter_lock(m: Module) -> DataFrame:
    """Functions that leave the interpreter's lock unbalanced."""
    ops = base.called(m, ["PyGILState_Ensure", "PyGILState_Release", "PyEval_SaveThread", "PyEval_RestoreThread"])
    ops = ops.select(F.concat_ws("\x01", *KEY).alias("func"), "ordinal", F.col("callee").isin("PyGILState_Ensure", "PyEval_RestoreThread").alias("is_acquire"))
    bad = lifecycle.lock_balance(ops).select(F.split("func", "\x01")[0].alias("module_id"), F.split("func", "\x01")[1].alias("func"), F.lit(0).alias("ordinal"))
    return issue(bad, "data_race", "high", 0.85, "interpreter lock is unbalanced")


# What makes objects of a runtime, and what takes references out of others (anywhere in a name).
_MAKES = {"jni": ["NewObject", "NewString", "NewArray", "AllocObject"], "python": ["PyObject_New", "PyLong_FromLong", "PyFloat_FromDouble", "PyUnicode_FromString", "PyList_New", "PyDict_New", "PyTuple_New"]}
_REFERS = {"jni": ["GetObjectField", "GetObjectArrayElement", "CallObjectMethod", "CallStaticObjectMethod", "GetStaticObjectField"], "python": ["PyObject_GetAttr", "PyObject_GetItem", "PyDict_GetItem", "PyList_GetItem", "PyTuple_GetItem", "PySequence_GetItem"]}


@detector("reference-cycle", ("gc-safety",))
def reference_cycles(m: Module) -> DataFrame:
    """Functions that make objects of one collected runtime and take references from the other's: a cycle neither can collect."""
    where = lambda table: F.coalesce(*[F.when(F.col("callee").rlike("|".join(v)), k) for k, v in table.items()])
    c = base.calls(m).select(*KEY, "ordinal", "callee", where(_MAKES).alias("made"), where(_REFERS).alias("referred"))
    made = c.where("made IS NOT NULL").groupBy(*KEY, "made", F.col("callee").alias("maker")).agg(F.min("ordinal").alias("ordinal"))
    refs = c.where("referred IS NOT NULL").select(*KEY, "referred", F.col("callee").alias("by")).distinct()
    return issue(made.join(refs, KEY).where("made <> referred"), "memory_leak", "medium", 0.75, "objects of two collected runtimes may hold one another")


@detector("refcount")
def refcounts(m: Module) -> DataFrame:
    """Objects whose references are taken more often than given back in a function."""
    e = base.called(m, ["Py_INCREF", "Py_XINCREF", "Py_DECREF", "Py_XDECREF"]).select(*KEY, "ordinal", base.argument(0).alias("ptr"), F.when(F.col("callee").contains("INC"), 1).otherwise(-1).alias("sign"))
    left = lifecycle.balance(e, [*KEY, "ptr"], "sign", "ordinal").where("open > 0").withColumn("ordinal", F.lit(0))
    return issue(left, "memory_leak", "medium", 0.75, "reference count grows")


@detector("callback", ("call-graph",))
def callbacks(m: Module) -> DataFrame:
    """Function parameters stored to globals; stack memory handed to a registration that keeps it."""
    keeps = base.operands(m).where(F.col("callee").rlike("(register|set_callback|add_listener|atexit|signal|on_event)") & ~F.col("o.is_const"))
    stack = m.instructions.where("opcode = 'alloca'").select(*KEY, F.col("result").alias("ptr"))
    held = base.rooted(m, keeps.select(*KEY, "ordinal", F.col("o.value").alias("ptr"))).join(stack, [*KEY, "ptr"], "left_semi")
    made = m.instructions.where("result IS NOT NULL").select(*KEY, F.col("result").alias("ptr"))
    put = m.instructions.where("opcode = 'store' AND operands[1].is_global AND operands[0].type = 'ptr' AND left(operands[0].value, 1) = '%'").select(*KEY, "ordinal", base.argument(0).alias("ptr")).join(made, [*KEY, "ptr"], "left_anti")
    return issue(held, "use_after_free", "high", 0.8, "callback keeps stack memory").unionByName(issue(put, "callback_ownership_risk", "high", 0.85, "parameter is kept in a global"))


# Names of foreign functions that keep what they are given.
KEEPS = "(register|set_|store|keep|retain|callback|listener|spawn|create|queue|push)"


@detector("rust-rules", ("ffi-boundary", "SemanticResolver"))
def rust_rules(m: Module) -> DataFrame:
    """Rust to C: pointers of as_ptr handed on; boxes given away by into_raw and not taken back; stack memory that a foreign function
    keeps; memory handed over and released; fields used after what holds them is dropped; writes behind fields of readonly parameters;
    parameters called from a local."""
    rust = base.calls(m).where(base.function_language() == "rust")
    lent = rust.where(F.col("callee").contains("as_ptr") & F.col("result").isNotNull()).select(*KEY, F.col("result").alias("value"))
    sink = base.operands(m).where("callee IS NOT NULL").where((base.function_language("callee") == "c") & ~F.col("callee").contains("as_ptr")).withColumn("value", F.col("o.value"))
    out = issue(sink.join(lent.distinct(), [*KEY, "value"], "left_semi"), "borrow_escape", "high", 0.8, "borrowed pointer leaves Rust")
    given = rust.where(F.col("callee").contains("into_raw"))
    back = base.calls(m).where(F.col("callee").contains("from_raw")).select("module_id").distinct()
    out = out.unionByName(issue(given.join(back, "module_id", "left_anti"), "cross_language_leak", "high", 0.85, "box is given away and never taken back"))
    stack = m.instructions.where("opcode = 'alloca'").select(*KEY, F.col("result").alias("ptr"))
    passed = sink.where((base.function_language() == "rust") & ~F.col("callee").isin(base.RELEASES) & ~F.col("callee").startswith("llvm.") & F.col("value").startswith("%"))
    handed = base.rooted(m, passed.select(*KEY, "callee", "ordinal", F.col("value").alias("ptr")))
    kept = handed.where(F.col("callee").rlike(KEEPS)).join(stack, [*KEY, "ptr"], "left_semi")
    out = out.unionByName(issue(kept, "borrow_escape", "high", 0.82, "stack memory is kept by a foreign function"))
    drops = base.called(m, base.RELEASES).where((base.function_language() == "rust") & ~F.col("callee").isin("__rust_dealloc") & (F.size("operands") > 0))
    freed = base.rooted(m, drops.select(*KEY, "ordinal", base.argument(0).alias("ptr")))
    first = handed.groupBy(*KEY, "ptr").agg(F.min("ordinal").alias("given"))
    out = out.unionByName(issue(freed.join(first, [*KEY, "ptr"]).where("ordinal > given"), "use_after_free", "high", 0.72, "memory handed to a foreign function is released"))
    dropped = base.calls(m).where((base.function_language() == "rust") & (F.col("callee").contains("drop_in_place") | F.col("callee").isin(base.RELEASES)) & (F.size("operands") > 0))
    gone = base.rooted(m, dropped.select(*KEY, "ordinal", base.argument(0).alias("ptr"))).groupBy(*KEY, "ptr").agg(F.min("ordinal").alias("gone"))
    fields = m.instructions.where("opcode = 'getelementptr' AND left(type, 1) = '%' AND size(operands) >= 3").select(*KEY, F.col("result").alias("value"))
    used = fields.join(base.uses(m).select(*KEY, "value", "ordinal"), [*KEY, "value"]).groupBy(*KEY, "value").agg(F.max("ordinal").alias("ordinal"))
    late = base.rooted(m, used.withColumn("ptr", F.col("value"))).join(gone, [*KEY, "ptr"]).where("ordinal > gone")
    out = out.unionByName(issue(late, "borrow_escape", "high", 0.78, "field is used after what holds it is dropped"))
    return out.unionByName(field_writes(m)).unionByName(local_callbacks(m))


def field_writes(m: Module) -> DataFrame:
    """Stores through a pointer that was loaded from a field of a readonly parameter."""
    given = base.parameters(m).where("readonly").where(base.function_language() == "rust").select(*KEY, "ptr")
    fields = m.instructions.where("opcode = 'getelementptr' AND left(type, 1) = '%' AND size(operands) >= 3").select(*KEY, F.col("result").alias("field"), F.col("result").alias("ptr"))
    fields = base.rooted(m, fields).join(given, [*KEY, "ptr"], "left_semi").select(*KEY, "field")
    loaded = m.instructions.where("opcode = 'load'").select(*KEY, base.argument(0).alias("field"), F.col("result").alias("ptr")).join(fields, [*KEY, "field"], "left_semi").select(*KEY, "ptr").distinct()
    put = base.rooted(m, m.instructions.where("opcode = 'store'").select(*KEY, "ordinal", base.argument(1).alias("ptr")))
    return issue(put.join(loaded, [*KEY, "ptr"], "left_semi"), "write_to_immutable", "high", 0.85, "memory behind a field of a readonly parameter is written")


def local_callbacks(m: Module) -> DataFrame:
    """Parameters that are kept in a stack slot and called from there."""
    slots = m.instructions.where("opcode = 'alloca'").select(*KEY, F.col("result").alias("slot"))
    given = base.parameters(m).where(base.function_language() == "rust").select(*KEY, "ptr")
    put = m.instructions.where("opcode = 'store'").select(*KEY, "ordinal", base.argument(0).alias("ptr"), base.argument(1).alias("slot")).join(given, [*KEY, "ptr"], "left_semi").join(slots, [*KEY, "slot"], "left_semi")
    got = m.instructions.where("opcode = 'load'").select(*KEY, base.argument(0).alias("slot"), F.col("result").alias("callee"))
    asked = got.join(base.calls(m).select(*KEY, "callee"), [*KEY, "callee"], "left_semi").select(*KEY, "slot")
    return issue(put.join(asked, [*KEY, "slot"], "left_semi"), "callback_ownership_risk", "high", 0.78, "parameter is kept in a local and called")
