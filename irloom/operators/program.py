"""Operators on a program's relations: views of the IR, call direction, danger surface, exports, trees, escapes, noise, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irloom.functions import names
from irloom.functions.names import any_of, case, contains, exact, has_any, prefix, suffix
from irloom.functions.storage import materialise
from irloom.operators import graph

# --- views of the IR

# Classes of instructions.
OPCODES = {
    "memory": ["alloca", "load", "store", "getelementptr", "fence", "cmpxchg", "atomicrmw"],
    "call": ["call", "invoke", "callbr"],
    "terminator": ["ret", "br", "switch", "indirectbr", "resume", "unreachable"],
    "cast": ["bitcast", "inttoptr", "ptrtoint", "trunc", "zext", "sext", "fptrunc", "fpext", "addrspacecast"],
    "arithmetic": ["add", "sub", "mul", "udiv", "sdiv", "urem", "srem", "fadd", "fsub", "fmul", "fdiv", "and", "or", "xor", "shl", "lshr", "ashr"],
    "compare": ["icmp", "fcmp"],
    "merge": ["phi", "select"],
}


def opcode_class(x: str) -> str:
    return case([(exact(x, ops), f"'{k}'") for k, ops in OPCODES.items()], "'other'")


def buckets(instructions: DataFrame) -> DataFrame:
    """module_id, func, class, n: how many instructions of each class a function has."""
    return instructions.groupBy("module_id", "func", F.expr(opcode_class("opcode")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def traversal_index(instructions: DataFrame, functions: DataFrame) -> DataFrame:
    """module_id, func, calls, allocs, frees of each defined function, those without any included."""
    n = instructions.groupBy("module_id", "func").agg(F.count_if(F.col("callee").isNotNull()).alias("calls"), F.count_if(F.expr(contains("callee", "alloc"))).alias("allocs"), F.count_if(F.expr(contains("callee", "free"))).alias("frees"))
    return functions.where("NOT is_declaration").select("module_id", "func").join(n, ["module_id", "func"], "left").na.fill(0)


def evidence(modules: DataFrame, functions: DataFrame) -> DataFrame:
    """module_id, producer, personalities: what tells a module's language."""
    p = functions.where("personality IS NOT NULL").groupBy("module_id").agg(F.sort_array(F.collect_set("personality")).alias("personalities"))
    return modules.select("module_id", "producer", "source_filename").join(p, "module_id", "left")


def locations(instructions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Instructions with line and file of their debug record."""
    m = metadata.select("module_id", F.col("id").alias("dbg"), "line", "file")
    return instructions.join(m, ["module_id", "dbg"], "left")


# --- calls

# Words of a callee that tell where its argument's memory goes.
INTO, OUT, BOTH = ["free", "close", "delete", "destroy", "write", "send", "put"], ["new", "alloc", "create", "open", "get", "read", "recv"], ["realloc", "swap", "exchange", "update"]


def direction(x: str) -> str:
    """Which way memory goes through a call's argument: inout before out before in."""
    return case([(has_any(x, BOTH), "'inout'"), (has_any(x, OUT), "'out'"), (has_any(x, INTO), "'in'")], "'in'")


def propagate_memory(maps: DataFrame) -> DataFrame:
    """src, dst, strength of argument maps (arg, param, callee): in goes to the parameter, out comes back, inout does both weakly."""
    d = maps.withColumn("direction", F.expr(direction("callee")))
    there = F.struct(F.col("arg").alias("src"), F.col("param").alias("dst"), F.when(F.col("direction") == "in", "strong").otherwise("weak").alias("strength"))
    back = F.struct(F.col("param").alias("src"), F.col("arg").alias("dst"), F.when(F.col("direction") == "out", "strong").otherwise("weak").alias("strength"))
    ways = F.when(F.col("direction") == "in", F.array(there)).when(F.col("direction") == "out", F.array(back)).otherwise(F.array(there, back))
    return d.select(F.explode(ways).alias("w")).select("w.*").distinct()


def danger_surface(boundary: DataFrame, args: DataFrame, aliases: DataFrame) -> DataFrame:
    """node: pointers (args: callee, ptr) that reach a boundary callee (callee), and all their aliases (src, dst)."""
    start = args.join(boundary.select("callee").distinct(), "callee", "left_semi").select(F.col("ptr").alias("node"))
    return graph.closure(graph.undirected(aliases), start)


def exports(functions: DataFrame, calls: DataFrame, taken: DataFrame) -> DataFrame:
    """Defined symbols (name, visible) that no local call (callee) reaches, with whether their address is taken (name)."""
    quiet = functions.where("visible").join(calls.select(F.col("callee").alias("name")).distinct(), "name", "left_anti")
    return quiet.join(taken.select("name").distinct().withColumn("address_taken", F.lit(True)), "name", "left").na.fill(False, ["address_taken"])


def ancestors(tree: DataFrame, most: int = 64) -> DataFrame:
    """id, ancestor, depth for a tree (id, parent): every chain of parents, by doubling the distance covered each round."""
    hop = materialise(tree.where("parent IS NOT NULL AND parent <> id").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "tree")
    known, reach = hop, 1
    while reach < most:
        a, b = known.alias("a"), known.where(F.col("depth") <= reach).alias("b")
        longer = a.where(F.col("a.depth") == reach).join(b, F.col("a.ancestor") == F.col("b.id")).select("a.id", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        longer = materialise(longer, "tree")
        if longer.isEmpty():
            break
        known, reach = known.union(longer), reach * 2
    return known


def escapes(stores: DataFrame, returns: DataFrame, allocs: DataFrame) -> DataFrame:
    """ptr, escape of allocations: returned before stored to a global before stored to a field before local."""
    s = stores.groupBy("ptr").agg(F.bool_or("to_global").alias("g"), F.bool_or(~F.col("to_global")).alias("f"))
    r = returns.select("ptr").distinct().withColumn("r", F.lit(True))
    kind = F.when(F.col("r"), "returned").when(F.col("g"), "global").when(F.col("f"), "field").otherwise("local")
    return allocs.select("ptr").join(s, "ptr", "left").join(r, "ptr", "left").select("ptr", kind.alias("escape"))


# --- noise

# Names and paths of code that isn't the user's.
INTRINSICS = ["llvm.dbg.", "llvm.lifetime.", "llvm.assume", "llvm.expect", "llvm.memcpy", "llvm.memset", "llvm.memmove", "llvm.trap", "llvm.va_"]
SHIMS = ["__rust_alloc", "__rg_alloc", "__rdl_alloc", "__rust_dealloc", "__rg_dealloc", "__rdl_dealloc", "je_malloc", "mi_malloc", "tc_malloc"]
STDLIB_PATHS = ["/rustc/", "/usr/include/", "/usr/lib/", "library/core/", "library/alloc/", "library/std/", "lib/std/", "/go/src/runtime/"]
THIRD_PARTY_PATHS = ["/.cargo/registry/", "/vendor/", "/third_party/", "/node_modules/", "/pkg/mod/", "/site-packages/"]
GENERATED_PATHS = ["/target/debug/build/", "/zig-cache/", "bindings.rs", ".pb.", "_generated."]


def intrinsic(x: str) -> str:
    return any_of([prefix(x, n) for n in INTRINSICS])


def shim(x: str) -> str:
    return any_of([contains(x, n) for n in SHIMS])


def path_origin(x: str) -> str:
    return case([(has_any(x, GENERATED_PATHS), "'compiler_generated'"), (has_any(x, STDLIB_PATHS), "'stdlib'"), (has_any(x, THIRD_PARTY_PATHS), "'third_party'")], "'user'")


def name_origin(x: str) -> str:
    return case([(intrinsic(x), "'compiler_generated'"), (has_any(x, ["drop_in_place", "drop_glue", "__cxx_global"]), "'compiler_generated'"), (any_of([prefix(x, "_ZNSt"), prefix(x, "_ZN4core"), prefix(x, "_ZN5alloc"), prefix(x, "runtime."), prefix(x, "std.")]), "'stdlib'")], "'user'")


def origin(name: str, path: str) -> str:
    """Three layers at once: what the name says, else what the path says."""
    return f"CASE WHEN {name_origin(name)} <> 'user' THEN {name_origin(name)} ELSE {path_origin(path)} END"


def output_parameter(x: str) -> str:
    return any_of([prefix(x, "out_"), suffix(x, "_out"), suffix(x, "_ptr"), prefix(x, "p_"), exact(x, ["out", "result", "ret", "dest", "dst"])])


def behaviours(ops: DataFrame) -> DataFrame:
    """Runs of three operations (func, ordinal, op) that tell a pattern: where it starts and which it is."""
    w = Window.partitionBy("func").orderBy("ordinal")
    three = ops.withColumns({"second": F.lead("op").over(w), "third": F.lead("op", 2).over(w)})
    kind = F.when((F.col("op") == "free") & (F.col("second") == "other") & (F.col("third") == "alloc"), "regrow").when((F.col("op") == "alloc") & (F.col("second") == "other") & (F.col("third") == "free"), "scratch").when((F.col("op") == "alloc") & (F.col("second") == "error"), "failing")
    return three.withColumn("pattern", kind).where("pattern IS NOT NULL").select("func", "ordinal", "pattern")


# How sure a leak is by kind of allocator, from 0.8.
ALLOCATOR_KINDS = [("arena", 0.6), ("fixed", 0.7), ("testing", 0.5), ("general", 0.2)]


def allocator_leak(kind: str, on_boundary: str, managed: str, cleaned: str) -> str:
    less = " ".join(f"WHEN {kind} = '{k}' THEN {v}" for k, v in ALLOCATOR_KINDS)
    more = f"CASE WHEN {kind} = 'page' THEN 0.1 ELSE 0 END + CASE WHEN {on_boundary} THEN 0.2 ELSE 0 END"
    return f"round(CAST(greatest(0, least(1, 0.8 - CASE {less} ELSE 0 END + {more} - CASE WHEN {managed} THEN 0.3 ELSE 0 END - CASE WHEN {cleaned} THEN 0.3 ELSE 0 END)) AS DOUBLE), 6)"


# --- strings


def any_pattern(column: str, patterns: list[str]) -> Column:
    """Whether a text holds any of the patterns: one alternation, walked once."""
    import re

    return F.col(column).rlike("|".join(re.escape(p) for p in sorted(patterns, key=len, reverse=True)))


def fnv1a(column: str) -> str:
    """The 64-bit FNV-1a hash of a string's bytes as 16 hexadecimal digits; halves of 32 bits, so nothing overflows."""
    b = f"transform(sequence(1, octet_length({column})), i -> CAST(conv(hex(substring(CAST({column} AS BINARY), i, 1)), 16, 10) AS BIGINT))"
    low = "(a.lo ^ b)"
    step = (
        f"named_struct('hi', ((a.hi * 435 + (({low} * 435) div 4294967296)) % 4294967296 + ({low} % 16777216) * 256) % 4294967296, 'lo', ({low} * 435) % 4294967296)"
    )
    whole = f"aggregate({b}, named_struct('hi', 3421674724L, 'lo', 2216829733L), (a, b) -> {step}, a -> lower(concat(lpad(hex(a.hi), 8, '0'), lpad(hex(a.lo), 8, '0'))))"
    return f"CASE WHEN octet_length({column}) = 0 THEN 'cbf29ce484222325' ELSE {whole} END"


def demangle(column: str) -> str:
    """Parts of a length-prefixed nested name (`_ZN4core3ptr…E`) joined with ::, without a trailing hash; other names stay."""
    # state: rest of the name, parts so far; each step takes one length-prefixed part
    digits = "regexp_extract(s.rest, '^([0-9]+)', 1)"
    size = f"CAST(coalesce(nullif({digits}, ''), '0') AS INT)"
    step = f"CASE WHEN {size} = 0 THEN s ELSE named_struct('rest', substring(s.rest, length({digits}) + {size} + 1), 'parts', concat(s.parts, array(substring(s.rest, length({digits}) + 1, {size})))) END"
    parts = f"aggregate(sequence(1, 32), named_struct('rest', substring({column}, 4), 'parts', CAST(array() AS ARRAY<STRING>)), (s, i) -> {step}, s -> s.parts)"
    kept = f"filter({parts}, p -> NOT p RLIKE '^h[0-9a-f]{{16}}$')"
    return f"CASE WHEN {column} RLIKE '^_ZN[0-9]' THEN array_join({kept}, '::') ELSE {column} END"


# --- metrics


def interner(df: DataFrame, column: str) -> DataFrame:
    """strings, distinct, bytes_saved by keeping each string once."""
    each = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("strings"), F.count(F.lit(1)).alias("distinct_strings"), F.sum((F.col("n") - 1) * F.coalesce(F.octet_length(column), F.lit(0))).alias("bytes_saved"))


def accuracy(df: DataFrame, truth: str, found: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two boolean columns, to 6 places."""
    n = df.agg(F.count_if(F.col(truth) & F.col(found)).alias("tp"), F.count_if(~F.col(truth) & F.col(found)).alias("fp"), F.count_if(F.col(truth) & ~F.col(found)).alias("fn"))
    part = lambda a, b: F.round(F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1)), 6)
    return n.withColumns({"precision": part("tp", "fp"), "recall": part("tp", "fn"), "f1": F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 6)})


def profile(runs: DataFrame) -> DataFrame:
    """pass, runs, total_ms, mean_ms of timed runs (pass, ms)."""
    return runs.groupBy("pass").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("ms"), 3).alias("total_ms"), F.round(F.avg("ms"), 6).alias("mean_ms"))


def hot_spots(edges: DataFrame, most: int = 20) -> DataFrame:
    """node, ways, loops, score of branching nodes: three ways or more count 3, each edge backwards 2; the best `most`."""
    n = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("ways"), F.count_if(F.col("dst") < F.col("src")).alias("loops"))
    score = F.when(F.col("ways") >= 3, 3).otherwise(0) + 2 * F.col("loops")
    return n.withColumn("score", score).orderBy(F.desc("score"), "node").limit(most)


def graph_stats(nodes: DataFrame, edges: DataFrame, taint: DataFrame) -> DataFrame:
    """nodes, edges, tainted: one row."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(nodes, "nodes").join(one(edges, "edges")).join(one(taint.select("node").distinct(), "tainted"))  # one row each


def guarded(uses: DataFrame, checks: DataFrame) -> DataFrame:
    """Uses (func, value, ordinal) whose value is compared with null in their function (func, value)."""
    return uses.join(checks.select("func", "value").distinct(), ["func", "value"], "left_semi")


def latest_guard(uses: DataFrame, checks: DataFrame) -> DataFrame:
    """Uses with the ordinal of the last check of their value before them, or null: a window over both, not a range join."""
    both = uses.select("func", "value", "ordinal", F.lit(1).alias("use")).union(checks.select("func", "value", "ordinal", F.lit(0).alias("use")))
    w = Window.partitionBy("func", "value").orderBy("ordinal", "use").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("use") == 0, F.col("ordinal")), ignorenulls=True).over(w)
    return both.withColumn("checked_at", last).where("use = 1").select("func", "value", "ordinal", "checked_at")


def summary_names(x: str) -> str:
    return names.diagnostic_class(x)
