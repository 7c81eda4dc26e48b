"""Bug and noise pairs in textual IR: a bug gives issues of its kind, noise gives none."""

import pytest
from pyspark.sql import functions as F

from irloom import passes
from irloom.operators import matching
from irloom.passes import base
from irloom.sources import ir_text

BUGS = {
    "double_free": "define void @f() {\n%p = call ptr @malloc(i64 8)\ncall void @free(ptr %p)\ncall void @free(ptr %p)\nret void\n}",
    "use_after_free": "define i32 @f() {\n%p = call ptr @malloc(i64 8)\ncall void @free(ptr %p)\n%x = load i32, ptr %p\nret i32 %x\n}",
    "memory_leak": "define void @f() {\n%p = call ptr @malloc(i64 8)\nret void\n}",
    "malloc_unchecked": "define void @f() {\n%p = call ptr @malloc(i64 8)\nstore i32 1, ptr %p\ncall void @free(ptr %p)\nret void\n}",
    "cross_language_free": "define void @f() {\n%p = call ptr @malloc(i64 8)\ncall void @__rust_dealloc(ptr %p, i64 8, i64 8)\nret void\n}",
    "invalid_free": "define void @f() {\n%p = alloca i32\ncall void @free(ptr %p)\nret void\n}",
    "unchecked_return": "define void @f(ptr %d) {\n%n = call i64 @fread(ptr %d, i64 1, i64 2, ptr null)\nret void\n}",
    "integer_overflow": "define i8 @f(i8 %a, i8 %b) {\n%c = add i8 %a, %b\nret i8 %c\n}",
    "buffer_overflow": "define void @f() {\n%b = alloca [8 x i8]\n%e = getelementptr inbounds [8 x i8], ptr %b, i64 0, i64 9\nret void\n}",
    "command_injection": "define void @f() {\n%e = call ptr @getenv(ptr @k)\n%r = call i32 @system(ptr %e)\n%c = icmp eq i32 %r, 0\nret void\n}",
    "format_string": "define void @f(ptr %b) {\n%n = call ptr @fgets(ptr %b, i32 9, ptr null)\n%r = call i32 (ptr, ...) @printf(ptr %b)\nret void\n}",
    "null_dereference": "define i32 @f() {\n%x = load i32, ptr null\nret i32 %x\n}",
    "borrow_escape": "define ptr @f() {\n%p = alloca i32\nret ptr %p\n}",
    "thread_safety_violation": "define void @f() {\ncall i32 @pthread_mutex_lock(ptr @a)\ncall i32 @pthread_mutex_lock(ptr @b)\nret void\n}\ndefine void @g() {\ncall i32 @pthread_mutex_lock(ptr @b)\ncall i32 @pthread_mutex_lock(ptr @a)\nret void\n}",
    "data_race": "define void @f() {\n%s = call i32 @PyGILState_Ensure()\nret void\n}",
    "callback_ownership_risk": "define void @f(ptr %cb) {\nstore ptr %cb, ptr @kept\nret void\n}",
    "cross_language_leak": "define void @_RNvC1x1f(ptr %b) {\n%p = call ptr @_RNvBox_into_raw(ptr %b)\nret void\n}",
    "static_buffer_misuse": "define void @f(ptr %t) {\n%a = call ptr @ctime(ptr %t)\n%b = call ptr @ctime(ptr %t)\nret void\n}",
    "write_to_immutable": "define void @f() {\nstore i8 1, ptr @.str\nret void\n}",
    "ffi_unsafe_call": "define void @_RNvC1x1f(ptr %s) {\n%r = call i32 @do_exec(ptr %s)\n%c = icmp eq i32 %r, 0\nret void\n}",
    "callback_signature_mismatch": "declare void @h(i32)\ndefine void @f() {\ncall void @h(i32 1, i32 2)\nret void\n}",
}
NOISE = {
    "checked and released": "define void @f() {\n%p = call ptr @malloc(i64 8)\n%c = icmp eq ptr %p, null\nbr i1 %c, label %no, label %yes\nyes:\nstore i32 1, ptr %p\ncall void @free(ptr %p)\nbr label %no\nno:\nret void\n}",
    "exclusive branches": "define void @f(i1 %c, ptr %p) {\nbr i1 %c, label %a, label %b\na:\ncall void @free(ptr %p)\nbr label %e\nb:\ncall void @free(ptr %p)\nbr label %e\ne:\nret void\n}",
    "returned": "define ptr @f() {\n%p = call ptr @malloc(i64 8)\nret ptr %p\n}",
    "inside the array": "define void @f() {\n%b = alloca [8 x i8]\n%e = getelementptr inbounds [8 x i8], ptr %b, i64 0, i64 7\nret void\n}",
    "literal format": "define void @f(i32 %x) {\n%r = call i32 (ptr, ...) @printf(ptr @.str, i32 %x)\nret void\n}",
    "one lock order": "define void @f() {\ncall i32 @pthread_mutex_lock(ptr @a)\ncall i32 @pthread_mutex_lock(ptr @b)\nret void\n}\ndefine void @g() {\ncall i32 @pthread_mutex_lock(ptr @a)\ncall i32 @pthread_mutex_lock(ptr @b)\nret void\n}",
    "balanced": "define void @f() {\n%s = call i32 @PyGILState_Ensure()\ncall void @PyGILState_Release(i32 %s)\nret void\n}",
    "wide arithmetic": "define i64 @f(i64 %a, i64 %b) {\n%c = add i64 %a, %b\nret i64 %c\n}",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"bug/{k}", t) for k, t in BUGS.items()] + [(f"noise/{k}", t) for k, t in NOISE.items()]
    return [(r.module_id, r.kind, r["pass"]) for r in passes.run(ir_text.from_texts(spark.createDataFrame(rows, "module_id string, text string"))).collect()]


@pytest.mark.parametrize("kind", list(BUGS))
def test_bug_is_found(found, kind):
    assert kind in {k for m, k, _ in found if m == f"bug/{kind}"}


@pytest.mark.parametrize("name", list(NOISE))
def test_noise_is_quiet(found, name):
    assert not [x for x in found if x[0] == f"noise/{name}"]


def test_tables(spark, tmp_path):
    text = """source_filename = "a.rs"
target triple = "x86_64-unknown-linux-gnu"
%struct.P = type <{ i32, ptr }>
declare noundef ptr @malloc(i64 noundef)
define internal i32 @"odd name"(i32 %x, ...) personality ptr @rust_eh_personality !dbg !5 {
start:
  %c = icmp slt i32 %x, 3
  br i1 %c, label %a, label %b
a:                                                ; preds = %start
  %y = call i32 (ptr, ...) @printf(ptr @.s, i32 %x), !dbg !7
  br label %b
b:
  %z = phi i32 [ 1, %start ], [ %y, %a ]
  %p = load ptr, ptr @g, align 8
  %i = call i32 %p(i32 %z)
  ret i32 %z
}
!5 = distinct !DISubprogram(name: "odd", line: 12, file: !1)
"""
    (tmp_path / "m.ll").write_text(text)
    m = ir_text.load(spark, str(tmp_path))
    assert m.modules.select("source_filename", "triple").first()[:] == ("a.rs", "x86_64-unknown-linux-gnu")
    f = {r.func: r for r in m.functions.collect()}
    assert f["malloc"].is_declaration and f["malloc"].param_types == ["i64"] and f["malloc"].ret_type == "ptr"
    assert (f["odd name"].linkage, f["odd name"].variadic, f["odd name"].personality, f["odd name"].n_params) == ("internal", True, "rust_eh_personality", 1)
    assert m.structs.first()[1:] == ("struct.P", ["i32", "ptr"], True)
    assert m.metadata.select("kind", "line", "name").first()[:] == ("DISubprogram", 12, "odd")
    rows = m.instructions.orderBy("ordinal").collect()
    assert [r.opcode for r in rows] == ["icmp", "br", "call", "br", "phi", "load", "call", "ret"]
    assert rows[0].pred == "slt" and rows[2].callee == "printf" and rows[2].dbg == "!7" and rows[6].callee == "%p" and rows[4].labels == ["start", "a"]
    assert sorted((r.src_bb, r.dst_bb) for r in base.cfg_edges(m).collect()) == [(0, 1), (0, 2), (1, 2)]
    assert matching.call_graph(base.calls(m), m.functions).count() == 0
    assert base.dfg_edges(m).where(F.col("value") == "%z").count() == 2


def test_two_modules(spark):
    a = "%struct.S = type { i32, i32 }\ndeclare i32 @h(i32)\ndefine void @f() {\nret void\n}"
    b = "%struct.S = type { i32, i64 }\ndefine i32 @h(i32 %a, i32 %b) {\nret i32 0\n}"
    m = ir_text.from_texts(spark.createDataFrame([("a", a), ("b", b)], "module_id string, text string"))
    kinds = {(r.func, r.kind) for r in passes.run(m, ["abi-compat", "layout-mismatch"]).collect()}
    assert kinds == {("h", "type_mismatch"), ("S", "ffi_type_mismatch")}


def test_plan_points(spark):
    from irloom.passes import safety

    text = "define void @f(i32 %x) {\nbr label %l\nl:\n%p = call ptr @malloc(i64 8)\ncall void @free(ptr %p)\nbr i1 true, label %l, label %e\ne:\nret void\n}"
    m = ir_text.from_texts(spark.createDataFrame([("a", text)], "module_id string, text string"))
    assert [(r.bb, r.score) for r in safety.plan_points(m).collect()] == [(1, 4)]


def test_order_is_topological():
    at = {n: i for i, n in enumerate(passes.order())}
    assert all(at[d] < at[n] for n, p in passes.REGISTRY.items() for d in p.deps)


PAIRS = {
    "ffi-detector": ("command_injection", "define void @_RNvC1x1f() {\n%e = call ptr @getenv(ptr @k)\n%r = call i32 @system(ptr %e)\nret void\n}", "define void @_RNvC1x1f() {\n%e = call ptr @getenv(ptr @k)\n%r = call i32 @system(ptr @ls)\nret void\n}"),
    "ffi-type-mismatch": ("ffi_type_mismatch", "declare i32 @h(i32)\ndefine void @_RNvC1x1f(i64 %x) {\n%r = call i32 @h(i64 %x)\nret void\n}", "declare i32 @h(i64)\ndefine void @_RNvC1x1f(i64 %x) {\n%r = call i32 @h(i64 %x)\nret void\n}"),
    "ffi-body-check": ("ffi_unsafe_call", "define void @_RNvC1x1f() {\n%p = call ptr @malloc(i64 8)\ncall void @take(ptr %p)\nret void\n}", "define void @_RNvC1x1f() {\n%p = call ptr @malloc(i64 8)\ncall void @free(ptr %p)\nret void\n}"),
    "cross-lang-dataflow": ("double_free", "define void @f(ptr %p) {\ncall void @free(ptr %p)\ncall void @PyMem_Free(ptr %p)\nret void\n}", "define void @f(ptr %p) {\ncall void @free(ptr %p)\nret void\n}"),
    "callback-lifecycle": ("ffi_unsafe_call", "define void @cb() {\ncall void @core_panic(ptr @m)\nret void\n}\ndefine void @f() {\ncall void @each(ptr @cb)\nret void\n}", "define void @cb() {\nret void\n}\ndefine void @f() {\ncall void @each(ptr @cb)\nret void\n}"),
    "error-propagation": ("unchecked_return", "define void @_RNvC1x1f() {\n%r = call i32 @db_open(ptr @p)\nret void\n}", "define i32 @_RNvC1x1f() {\n%r = call i32 @db_open(ptr @p)\nret i32 %r\n}"),
    "danger-surface": ("cross_language_leak", "define void @_RNvC1x1f() {\n%p = call ptr @malloc(i64 8)\ncall void @take(ptr %p)\nret void\n}", "define void @_RNvC1x1f() {\n%p = call ptr @malloc(i64 8)\ncall void @take(ptr %p)\ncall void @free(ptr %p)\nret void\n}"),
    "abi-mismatch": ("ffi_type_mismatch", "%struct.P = type <{ i8, i64 }>", "%struct.P = type { i8, i64 }"),
    "finalizer": ("use_after_free", "define void @Foo_finalize(ptr %o) {\n%r = call ptr @PyObject_CallNoArgs(ptr %o)\nret void\n}", "define void @Foo_run(ptr %o) {\n%r = call ptr @PyObject_CallNoArgs(ptr %o)\nret void\n}"),
}


@pytest.fixture(scope="module")
def paired(spark):
    rows = [(f"{n}/{w}", t) for n, (_, bug, noise) in PAIRS.items() for w, t in (("bug", bug), ("noise", noise))]
    m = ir_text.from_texts(spark.createDataFrame(rows, "module_id string, text string"))
    return {(r.module_id, r["pass"], r.kind) for r in passes.run(m, list(PAIRS)).collect()}


@pytest.mark.parametrize("name", list(PAIRS))
def test_pair(paired, name):
    assert (f"{name}/bug", name, PAIRS[name][0]) in paired
    assert not [x for x in paired if x[0] == f"{name}/noise" and x[1] == name]


def test_views(spark):
    from irloom.passes import ffi

    text = "define void @_RNvC1x1a() {\n%p = call ptr @malloc(i64 8)\ncall void @helper(ptr %p)\nret void\n}\ndefine internal void @helper(ptr %q) {\n%c = bitcast ptr %q to ptr\nret void\n}\ndefine void @alone() {\nret void\n}"
    m = ir_text.from_texts(spark.createDataFrame([("m", text)], "module_id string, text string"))
    assert {r.func: r.surface for r in ffi.surfaces(m).collect()} == {"_RNvC1x1a": "boundary", "helper": "reachable_from_boundary", "alone": "ffi_producer"}
    assert [(r.value, r.resolution) for r in ffi.resolutions(m).collect()] == [("%p", "heap")]
    assert {r.value for r in ffi.danger_pointers(m).collect()} == {"%p"} and passes.facts(m, "alias").count() == 2


def test_lock_between_cycles_is_quiet(spark):
    """Locks a, b and d, e are taken in cycles; c lies between the two, on none."""
    pair = lambda n, x, y: f"define void @{n}() {{\ncall i32 @pthread_mutex_lock(ptr @{x})\ncall i32 @pthread_mutex_lock(ptr @{y})\nret void\n}}"
    text = "\n".join(pair(n, *p) for n, p in {"f1": "ab", "f2": "ba", "g1": "de", "g2": "ed", "h1": "bc", "h2": "cd"}.items())
    m = ir_text.from_texts(spark.createDataFrame([("m", text)], "module_id string, text string"))
    assert {r.func for r in passes.run(m, ["lock"]).collect()} == {"f1", "f2", "g1", "g2"}


def test_roots_are_found_however_far(spark):
    steps = "\n".join(f"%p{i + 1} = getelementptr i8, ptr %p{i}, i64 1" for i in range(40))
    text = f"define void @f() {{\n%p0 = call ptr @malloc(i64 8)\n{steps}\ncall void @free(ptr %p40)\ncall void @free(ptr %p0)\nret void\n}}"
    m = ir_text.from_texts(spark.createDataFrame([("m", text)], "module_id string, text string"))
    assert {r.root for r in base.roots(m).collect()} == {"%p0"} and base.roots(m).count() == 40
    assert {r.kind for r in passes.run(m, ["memory-safety", "ownership-leak"]).collect()} == {"double_free"}


def test_views_give_facts(spark):
    text = "define void @f(i1 %c) {\n%p = call ptr @malloc(i64 8)\n%q = bitcast ptr %p to ptr\nbr i1 %c, label %a, label %b\na:\ncall void @g(ptr %q)\nbr label %b\nb:\nret void\n}\ndefine void @g(ptr %x) {\nret void\n}"
    m = ir_text.from_texts(spark.createDataFrame([("m", text)], "module_id string, text string"))
    rows = lambda name: {tuple(r)[1:] for r in passes.facts(m, name).collect()}
    assert rows("cfg") == {("f", 0, 1), ("f", 0, 2), ("f", 1, 2)}
    assert {r[:1] + r[1:2] for r in rows("dfg")} == {("f", "%p"), ("f", "%q")}
    assert rows("alias") == {("f", "%p", None, "ptr"), ("f", "%q", "%p", "ptr")}
    assert rows("call-graph") == {("f", "malloc", 1, False), ("f", "g", 1, True)}
    assert {r[0] for r in rows("surface-classifier")} == {"f", "g"} and rows("SemanticResolver") == {("f", "%p", "heap", 0.95)}
    assert {p.name for p in passes.REGISTRY.values() if p.is_view} == {"cfg", "dfg", "alias", "call-graph", "surface-classifier", "SemanticResolver"}


def test_surfaces_reach_the_report(spark):
    from irloom import pipeline

    text = "define void @_RNvC1x1f(ptr %p) {\ncall void @free(ptr %p)\ncall void @free(ptr %p)\nret void\n}\ndefine void @h(ptr %p) {\ncall void @free(ptr %p)\ncall void @free(ptr %p)\nret void\n}"
    m = ir_text.from_texts(spark.createDataFrame([("m", text)], "module_id string, text string"))
    found = {(r.func, r.surface, r.has_boundary) for r in pipeline.raw_issues(m, ["memory-safety"]).collect()}
    assert found == {("_RNvC1x1f", "boundary", True), ("h", "ffi_producer", False)}


RUST = {
    "stack kept": ("borrow_escape", 0.82, "%s = alloca i32\ncall void @register_buffer(ptr %s)"),
    "stack lent": (None, None, "%s = alloca i32\ncall void @fill(ptr %s)"),
    "handed and freed": ("use_after_free", 0.72, "call void @take(ptr %b)\ncall void @free(ptr %b)"),
    "freed by Rust": (None, None, "call void @take(ptr %b)\ncall void @__rust_dealloc(ptr %b, i64 8, i64 8)"),
    "field after drop": ("borrow_escape", 0.78, "%f = getelementptr %Pair, ptr %b, i32 0, i32 1\ncall void @_RNv_drop_in_place(ptr %b)\n%x = load i32, ptr %f"),
    "field of a readonly parameter written": ("write_to_immutable", 0.85, "%f = getelementptr %Pair, ptr %r, i32 0, i32 1\n%v = load ptr, ptr %f\nstore i8 1, ptr %v"),
    "field of another parameter written": (None, None, "%f = getelementptr %Pair, ptr %b, i32 0, i32 1\n%v = load ptr, ptr %f\nstore i8 1, ptr %v"),
    "called from a local": ("callback_ownership_risk", 0.78, "%s = alloca ptr\nstore ptr %b, ptr %s\n%c = load ptr, ptr %s\ncall void %c()"),
    "kept in a local": (None, None, "%s = alloca ptr\nstore ptr %b, ptr %s\n%c = load ptr, ptr %s"),
    "field before drop": (None, None, "%f = getelementptr %Pair, ptr %b, i32 0, i32 1\n%x = load i32, ptr %f\ncall void @_RNv_drop_in_place(ptr %b)"),
}


def test_rust_rules(spark):
    rows = [(k, f"define void @_RNvC1x1f(ptr %b, ptr readonly %r) {{\n{body}\nret void\n}}") for k, (_, _, body) in RUST.items()]
    found = {}
    for r in passes.run(ir_text.from_texts(spark.createDataFrame(rows, "module_id string, text string")), ["rust-rules"]).collect():
        found.setdefault(r.module_id, set()).add((r.kind, r.confidence))
    assert found == {k: {(kind, conf)} for k, (kind, conf, _) in RUST.items() if kind}


def test_return_checks_are_graded(spark):
    text = "define void @f(ptr %d) {\n%a = call ptr @malloc(i64 1)\n%b = call ptr @fopen(ptr %d, ptr %d)\n%c = call ptr @calloc(i64 1, i64 1)\nret void\n}"
    m = ir_text.from_texts(spark.createDataFrame([("m", text)], "module_id string, text string"))
    assert {(r.ordinal, r.severity, r.confidence) for r in passes.run(m, ["return-check"]).collect()} == {(0, "high", 0.9), (1, "medium", 0.75), (2, "medium", 0.6)}


def test_taint_of_sources_and_indexes(spark):
    from irloom.passes.boundary import tainted

    text = "define void @main(ptr %argv) {\n%a = getelementptr ptr, ptr %argv, i64 1\n%b = getelementptr [4 x [4 x i8]], ptr %a, i64 0, i64 1, i64 2\nret void\n}\ndefine void @other(ptr %p) {\n%q = load ptr, ptr %p\nret void\n}"
    m = ir_text.from_texts(spark.createDataFrame([("m", text)], "module_id string, text string"))
    assert {(r.func, r.value): r.conf for r in tainted(m).collect()} == {("main", "%argv"): 1.0, ("main", "%a"): 0.9, ("main", "%b"): 0.63}


HELPERS = "define void @drop_it(ptr %a, ptr %x) {\ncall void @free(ptr %x)\nret void\n}\ndefine void @pass_on(ptr %y) {\ncall void @drop_it(ptr null, ptr %y)\nret void\n}\ndefine void @look(ptr %x) {\nret void\n}\n"
ACROSS = {
    "handed, then released": (1, "call void @pass_on(ptr %p)\ncall void @free(ptr %p)"),
    "released, then handed": (1, "call void @free(ptr %p)\n%q = getelementptr i8, ptr %p, i64 0\ncall void @drop_it(ptr null, ptr %q)"),
    "handed twice": (1, "call void @pass_on(ptr %p)\ncall void @pass_on(ptr %p)"),
    "other parameter": (0, "call void @drop_it(ptr %p, ptr %z)\ncall void @free(ptr %p)"),
    "only read": (0, "call void @look(ptr %p)\ncall void @free(ptr %p)"),
    "exclusive": (0, "br i1 %c, label %a, label %b\na:\ncall void @pass_on(ptr %p)\nbr label %e\nb:\ncall void @free(ptr %p)\nbr label %e\ne:"),
}


def test_releases_across_functions(spark):
    rows = [(k, f"{HELPERS}define void @f(ptr %p, ptr %z, i1 %c) {{\n{body}\nret void\n}}") for k, (_, body) in ACROSS.items()]
    found = [r.module_id for r in passes.run(ir_text.from_texts(spark.createDataFrame(rows, "module_id string, text string")), ["cross-lang-dataflow"]).collect()]
    assert {k: found.count(k) for k in ACROSS} == {k: n for k, (n, _) in ACROSS.items()}


def test_reference_cycles_and_crossing_throws(spark):
    rows = [
        ("cycle", "define void @f(ptr %o) {\n%a = call ptr @PyList_New(i64 0)\n%b = call ptr @GetObjectField(ptr %o)\nret void\n}"),
        ("one runtime", "define void @f(ptr %o) {\n%a = call ptr @PyList_New(i64 0)\n%b = call ptr @PyList_GetItem(ptr %o, i64 0)\nret void\n}"),
        ("throws", "define void @_RNvC1x1f() {\ncall void @helper()\nret void\n}\ndefine void @helper() {\ncall void @__cxa_throw(ptr null, ptr null, ptr null)\nunreachable\n}"),
        ("caught", "define void @_RNvC1x1f() {\ncall void @helper()\nret void\n}\ndefine void @helper() personality ptr @__gxx_personality_v0 {\ncall void @__cxa_throw(ptr null, ptr null, ptr null)\nunreachable\n}"),
    ]
    m = ir_text.from_texts(spark.createDataFrame(rows, "module_id string, text string"))
    assert [(r.module_id, r.kind, r.confidence) for r in passes.run(m, ["reference-cycle"]).collect()] == [("cycle", "memory_leak", 0.75)]
    assert [(r.module_id, r.func, r.severity) for r in passes.run(m, ["error-propagation"]).collect()] == [("throws", "helper", "high")]


def test_layouts_and_signatures_of_many_modules(spark):
    """Brute force over all pairs of modules."""
    layouts = {"m1": "i32, i64", "m2": "i32, i64", "m3": "i32", "m4": "i64", "m5": "i32, i64", "m6": "i32"}
    rows = [(k, f"%struct.S = type {{ {v} }}\ndefine i32 @main(i32 %a) {{\nret i32 0\n}}") for k, v in layouts.items()] + [("d", "declare i32 @main(i32, ptr)"), ("e", "declare i32 @main(i32)"), ("g", "declare i64 @main(i32)")]
    m = ir_text.from_texts(spark.createDataFrame(rows, "module_id string, text string"))
    want = {a for a in layouts for b in layouts if a < b and layouts[a] != layouts[b]}
    assert sorted(r.module_id for r in passes.run(m, ["layout-mismatch"]).collect()) == sorted(want)
    assert sorted((r.module_id, r.kind) for r in passes.run(m, ["abi-compat"]).collect()) == [("d", "type_mismatch"), ("g", "ffi_type_mismatch")]


def test_library_contracts(spark, tmp_path):
    from irloom import pipeline
    from irloom.sources import config, sinks

    toml = '[contracts.x]\n[[contracts.x.pair]]\nname = "h"\nallocate = ["x_new"]\nrelease = ["x_free", "x_unref"]\nownership = "caller"\nconfidence = 0.8\n[[contracts.x.pair]]\nname = "n"\nallocate = ["malloc"]\nrelease = ["x_sweep"]\nownership = "gc"\n'
    body = {"right": "%p = call ptr @x_new()\ncall void @x_unref(ptr %p)", "wrong": "%p = call ptr @x_new()\ncall void @free(ptr %p)", "lost": "%p = call ptr @x_new()", "collected": "%p = call ptr @malloc(i64 8)"}
    m = ir_text.from_texts(spark.createDataFrame([(k, f"define void @f() {{\n{b}\nret void\n}}") for k, b in body.items()], "module_id string, text string"))
    rules = config.contracts(spark, toml)
    found = sorted((r.module_id, r.kind, r.confidence) for r in pipeline.raw_issues(m, ["ownership-leak"], rules).collect())
    assert found == [("lost", "memory_leak", 0.8), ("wrong", "contract_mismatch", 0.8)]
    assert ("collected", "memory_leak") in {(r.module_id, r.kind) for r in pipeline.raw_issues(m, ["ownership-leak"]).collect()}
    (tmp_path / "c.toml").write_text(toml)
    kinds = {r.kind for r in pipeline.analyse(m, config.merge(config.Config(), {k: v for k, v in config.parse_args(["x", "--contracts", str(tmp_path / "c.toml"), "--passes", "ownership-leak"]).items() if k != "config"})).collect()}
    assert "contract_mismatch" in kinds
    assert [r.value for r in sinks.call_graph_lines(passes.facts(m, "call-graph")).orderBy("value").collect()][0] == "collected: f -> malloc (1) extern"


def test_releases_are_not_paired(spark, monkeypatch):
    """Many releases of one pointer: each but the first on its way is found, from a table with one row a pointer and block."""
    from irloom.passes import memory

    frees = "call void @free(ptr %p)\n"
    uses = "store i32 1, ptr %p\n"
    text = "define void @f(i1 %c, ptr %p) {\nbr i1 %c, label %a, label %b\na:\n" + frees * 30 + "br label %e\nb:\n" + frees * 2 + uses + "br label %e\ne:\n" + frees * 3 + uses + "ret void\n}"
    m = ir_text.from_texts(spark.createDataFrame([("m", text)], "module_id string, text string"))
    found = [r.ordinal for r in passes.run(m, ["memory-safety"]).collect()]
    after = [r.ordinal for r in passes.run(m, ["ptr-lifetime"]).collect()]
    assert sorted(found) == [*range(2, 31), 33, 36, 37, 38] and sorted(after) == [34, 39]
    assert memory._earliest(m).count() == 3 and "freed" in m.kept


def test_parsed_rows_travel_in_full_batches(spark, monkeypatch):
    """Rows of many small modules share a batch; a module of more rows than a batch is whole."""
    import pyarrow as pa

    monkeypatch.setattr(ir_text, "BATCH", 50)
    texts = [(f"m{i}", f"define void @f{i}() {{\n  call void @free(ptr @g)\n  ret void\n}}") for i in range(40)] + [("big", "define void @f() {\n" + "  call void @free(ptr @g)\n" * 120 + "  ret void\n}"), ("none", None)]
    seen, real = [], pa.RecordBatch.from_arrays
    run = {}
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, real=frame.mapInArrow, **k: run.update(f=f) or real(self, f, schema, **k))
    m = ir_text.from_texts(spark.createDataFrame(texts, "module_id string, text string"))
    assert m.modules.count() == 42 and m.functions.count() == 41 and m.instructions.count() == 40 * 2 + 121
    batch = real([pa.array([t[0] for t in texts]), pa.array([t[1] for t in texts])], ["module_id", "text"])
    seen = [b.num_rows for b in run["f"](iter([batch]))]
    assert sum(seen) == 42 + 41 + 201 and seen[:-1] == [50] * (len(seen) - 1)
