"""What becomes of a finding: suppression by pattern, severity by context, platform names, candidates' raw scores, resources' paths.

Predicates are SQL text over columns, as in ``functions.names``; tables are joined and grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom import vocab
from irloom.functions.names import any_of, case, contains, exact, has_any, of_category, prefix
from irloom.operators import graph

# Names by which code of libraries, runtimes and compilers is known (p: at the start, c: anywhere).
STDLIB_P = [
    "debug.", "hash_map.", "array_hash_map.", "std.", "builtin.", "mem.", "log.", "Io.", "fs.", "os.", "process.", "Thread.", "crypto.", "compress.", "http.", "json.", "ascii.", "base64.",
    "random.", "time.", "unicode.", "net.", "async.", "core::", "alloc::", "std::",
    "__builtin_", "__memcpy_chk", "__memmove_chk", "__memset_chk", "__strcpy_chk", "__strcat_chk", "__strncpy_chk", "__sprintf_chk", "__snprintf_chk", "__printf_chk", "__fprintf_chk",
    "__vprintf_chk", "__vfprintf_chk", "__stack_chk_fail", "__stack_chk_guard", "__cxa_", "__gxx_personality", "__llvm_", "__sanitizer_", "__ubsan_", "__asan_", "__msan_", "__tsan_",
]
STDLIB_C = ["std::__", "__gnu_debug"]
SHIM_P = ["__cxa_", "__gxx_personality", "_ZTI", "_ZTS", "_ZTV", "swift_retain", "swift_release", "swift_allocObject", "$sS", "runtime.", "internal/task.", "llvm.", "__asan_", "__msan_", "__tsan_", "__ubsan_", "__sanitizer_"]
SHIM_C = [
    "_Znw", "_Zdl", "_Zna", "_Zda", "operator new", "operator delete", "_objc_", "objc_msgSend", "objc_alloc", "objc_release", "_dispatch_", "dispatch_async", "dispatch_sync",
    "__rust_alloc", "__rust_dealloc", "drop_in_place", "rust_begin_unwind", "rust_panic", "__zig_probe_stack", "__zig_tag_name_", "reachUnreachable", "unwrapNull", "__stack_chk",
    "_dyld_", "_dl_", "__security_init_cookie", "__report_gsfailure", "_CRT$", ".CRT$",
]
WINDOWS_C = [
    "__except_handler", "___CxxFrameHandler", "__CxxFrameHandler3", "__C_specific_handler", "__GSHandlerCheck", "_initterm", "_crtInit", "_crtExit", "_CRT_INIT", "_crt_atexit", "_atexit_helper",
    "_register_onexit_function", "_cinit_compute_numpages", "__security_check_cookie", "__report_gsfailure", "__report_rangecheckfailure", "__report_error", "__fail_fast_handler", "__fastfail",
    "TlsCallback_", "__dyn_tls_init", "__tlregdtor",
]
COMPILER_P = ["_ZNSt", "_ZN4core", "_ZN5alloc", "_ZN3std", "_ZGV", "_ZZ", "__cxx_", "_GLOBAL__", "$ss", "$sS"]
DROP_SIGNS = ["__rust_dealloc", "__rust_alloc", "drop_in_place"]
FOREIGN_SIGNS = ["c_hash", "c_alloc", "c_free", "cross-FFI", "cross_language", "FFI Boundary", "FFI call", "malloc(", "free(", "extern "]
CRYPTO = ["EVP_", "RSA_", "DSA_", "EC_", "AES_", "BIO_", "HMAC_", "SHA", "MD5"]
CLEANUP = ["_cleanup", "_fail", "errdefer", "defer_", "__cxa_begin_catch", "goto ", "__attribute__((cleanup", "RAII", "destructor", "~", "Drop(", "drop("]
#: Raw scores of candidates by kind.
RAW_SCORES = {"cross_family_free": 0.85, "use_after_release": 0.9, "callback_escape": 0.7, "thread_escape": 0.72, "borrow_escape": 0.75, "needs_model": 0.35}
ESCAPED_LESS = 0.3


def _starts(x: str, names: list[str]) -> str:
    return any_of([prefix(x, n) for n in names])


def stdlib_internal(func: str) -> str:
    return f"({_starts(func, STDLIB_P)} OR {has_any(func, STDLIB_C)})"


def runtime_shim(func: str, windows: bool = True) -> str:
    """Shims of any runtime, and those of the Windows runtime where the target is Windows or not known."""
    msvc = f" OR {has_any(func, WINDOWS_C)} OR ({prefix(func, '?')} AND {has_any(func, ['?_type_info@', '??_R', '??_7'])})" if windows else ""
    return f"({_starts(func, SHIM_P)} OR {has_any(func, SHIM_C)}{msvc})"


def real_bug(func: str, kind: str, message: str) -> str:
    """Findings that no pattern may suppress: lasting kinds, but for double frees inside compiler-made Rust drops."""
    inside = f"({kind} = 'double_free' AND {_starts(func, COMPILER_P)})"
    drop = f"({has_any(message, DROP_SIGNS)} AND NOT {has_any(message, FOREIGN_SIGNS)})"
    mangled = f"({contains(message, '_RNv')} AND {contains(message, '__rust_dealloc')})"
    return f"({of_category(kind, vocab.NEVER_SUPPRESSED)} AND NOT ({inside} AND ({drop} OR {mangled})))"


def suppressed(func: str, kind: str, message: str, windows: bool = True) -> str:
    return f"(NOT {real_bug(func, kind, message)} AND ({stdlib_internal(func)} OR {runtime_shim(func, windows)}))"


def suppress(issues: DataFrame, windows: bool = True) -> DataFrame:
    """The issues (func, kind, message) that no pattern suppresses."""
    return issues.where(~F.expr(suppressed("coalesce(func, '')", "kind", "coalesce(message, '')", windows)))


def boosted(base: str, func: str, what: str) -> str:
    """Severity (0 medium, 1 high, 2 critical) by the function's name and the words of the finding; null: stays as it is."""
    low, critical = f"{base} < 1", "2"
    return case(
        [
            (f"{base} > 2", "NULL"),
            (f"{contains(func, 'dlclose')} AND {low}", "1"),
            (f"{contains(func, 'dlclose')} AND {has_any(what, ['use-after-free', 'alive'])}", critical),
            (f"{has_any(func, CRYPTO)} AND {contains(what, 'null')} AND {low}", "1"),
            (f"{has_any(what, ['callback', 'escape'])} AND {low}", "1"),
            (contains(what, "return-value-escape"), "1"),
            (has_any(what, ["uaf", "double-free"]), critical),
            (f"{contains(func, 'fork')} AND {low}", "1"),
        ],
        "NULL",
    )


def noise(func: str) -> str:
    return f"({prefix(func, 'llvm.')} OR {contains(func, 'threadlocal')})"


def word_boundary(x: str, word: str) -> str:
    """Whether x is the word, ends with it after a separator or where camel case begins, or begins with it before a separator."""
    n = len(word)
    before, after = f"substring({x}, length({x}) - {n}, 1)", f"substring({x}, {n + 1}, 1)"
    camel = f" OR ({before} BETWEEN 'a' AND 'z')" if word[:1].isupper() and word[:1].isascii() else ""
    ends = f"(length({x}) > {n} AND right({x}, {n}) = '{word}' AND ({exact(before, ['_', '.', '-'])}{camel}))"
    return f"({x} = '{word}' OR {ends} OR (length({x}) > {n} AND {prefix(x, word)} AND {exact(after, ['_', '.', '-'])}))"


def platform_symbol(x: str, platform: str) -> str:
    """A symbol without its platform's decoration: the leading underscore of Mach-O, what follows @@ in COFF."""
    return case([(f"{platform} IN ('macos', 'mach_o') AND {prefix(x, '_')}", f"substring({x}, 2)"), (f"{platform} IN ('windows', 'coff') AND {contains(x, '@@')}", f"split_part({x}, '@@', 1)")], x)


def platform_hint(x: str) -> str:
    return case([(prefix(x, "_"), "'mach_o'"), (contains(x, "@@"), "'coff'")], "NULL")


def platform_confidence(confidence: str, crossing: str, known: str) -> str:
    less = f"CASE WHEN {crossing} THEN 0.05 ELSE 0 END + CASE WHEN {known} THEN 0 ELSE 0.03 END"
    return f"round(CAST(least(greatest({confidence} - ({less}), 0), 1) AS DOUBLE), 6)"


def candidate_score(kind: str, confidence: str, escaped: str) -> str:
    """Raw score of a candidate: fixed by kind; leaks have their confidence, less where the resource escapes validly."""
    leak = f"{confidence} - CASE WHEN {escaped} THEN {ESCAPED_LESS} ELSE 0 END"
    return f"round(CAST({case([(f'{kind} = {k!r}', str(v)) for k, v in RAW_SCORES.items()] + [(f'{kind} = {chr(39)}leak{chr(39)}', leak)], '0.6')} AS DOUBLE), 6)"


def free_paths(flow: DataFrame, frees: DataFrame, pointers: DataFrame) -> DataFrame:
    """ptr, freed: whether a pointer, or something that flows from it (flow: src, dst), is released (frees: ptr).

    Walks once against the flow from all releases, instead of along it from each pointer."""
    reached = graph.closure(graph.reverse(flow), frees.select(F.col("ptr").alias("node"))).select(F.col("node").alias("ptr"), F.lit(True).alias("hit"))
    return pointers.select("ptr").join(reached, "ptr", "left").select("ptr", F.coalesce("hit", F.lit(False)).alias("freed"))


def lost_arguments(allocs: DataFrame, args: DataFrame, rets: DataFrame) -> DataFrame:
    """ptr, leaked: pointers never freed (allocs: ptr, freed) of which some call (args: ptr, inst) gives nothing back (rets: ptr, inst)."""
    back = rets.select("ptr", "inst").distinct().withColumn("returned", F.lit(True))
    calls = args.select("ptr", "inst").distinct().join(back, ["ptr", "inst"], "left").groupBy("ptr").agg(F.bool_or(F.col("returned").isNull()).alias("lost"))
    return allocs.join(calls, "ptr", "left").select("ptr", (~F.col("freed") & F.coalesce("lost", F.lit(False))).alias("leaked"))


def alloc_nodes(allocs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Allocations with their node in the graph (node: id), on whole ids; those without one have null."""
    return allocs.join(nodes.select(F.col("id").alias("ptr"), F.lit(True).alias("known")).distinct(), "ptr", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def zone_stats(functions: DataFrame) -> DataFrame:
    """One row from functions (zone): counts of zones, and the share that needs no analysis (safe and runtime)."""
    n = {z: F.count_if(F.col("zone") == z) for z in ("safe", "unsafe", "ffi", "runtime_internal", "unknown")}
    ratio = F.coalesce(F.try_divide(n["safe"] + n["runtime_internal"], F.count(F.lit(1))), F.lit(0.0))
    return functions.agg(*[c.alias(z) for z, c in n.items()], F.round(ratio, 6).alias("skip_ratio"))


def path_classes(edges: DataFrame) -> DataFrame:
    """resource_id, class, paths, leaky, confidence from edges (resource_id, effect, callee): released before escaped before cleaned
    up before leaking; a resource without edges has no row."""
    releases = F.count_if(F.col("effect").isin("releases", "conditional_release"))
    escapes = F.count_if(F.col("effect").isin("returns_owned", "transfers", "consumes_arg", "stores_arg_to_owner", "stores_arg_to_global", "initializes_out_param", "escapes_to_callback"))
    out = edges.groupBy("resource_id").agg(F.count(F.lit(1)).alias("paths"), releases.alias("r"), escapes.alias("e"), F.bool_or(F.expr(has_any("coalesce(callee, '')", CLEANUP))).alias("c"))
    kind = F.when(F.col("r") > 0, "released_path").when(F.col("e") > 0, "escaped_path").when(F.col("c"), "cleanup_path").otherwise("leak_path")
    leaks = kind == "leak_path"
    return out.select("resource_id", kind.alias("class"), "paths", F.when(leaks, F.col("paths")).otherwise(0).alias("leaky"), F.when(leaks, 0.9).otherwise(0.0).alias("confidence"))
