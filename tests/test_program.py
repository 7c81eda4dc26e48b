"""Program operators and the entry module."""

import importlib
import importlib.util
import random
import sys

import pytest
from pyspark.sql import functions as F

from irloom.functions import names
from irloom.operators import matching, program
from irloom.plans import bindings, catalog
from irloom.sources import ir_text

TEXT = """source_filename = "a.rs"
define void @f(ptr %x) personality ptr @rust_eh_personality {
%p = call ptr @malloc(i64 8), !dbg !3
call void @free(ptr %p)
%a = add i32 1, 2
ret void
}
define void @g() {
ret void
}
!3 = !DILocation(line: 7, column: 2, scope: !1)
!4 = distinct !DICompileUnit(language: DW_LANG_Rust, producer: "rustc 1.80")
"""


@pytest.fixture(scope="module")
def module(spark):
    return ir_text.from_texts(spark.createDataFrame([("m", TEXT)], "module_id string, text string"))


def test_views(module):
    assert {(r["class"], r.n) for r in program.buckets(module.instructions).where("func = 'f'").collect()} == {("call", 2), ("arithmetic", 1), ("terminator", 1)}
    index = {r.func: (r.calls, r.allocs, r.frees) for r in program.traversal_index(module.instructions, module.functions).collect()}
    assert index == {"f": (2, 1, 1), "g": (0, 0, 0)}
    e = program.evidence(module.modules, module.functions).first()
    assert e.personalities == ["rust_eh_personality"] and e.producer == "rustc 1.80"
    assert [r.line for r in program.locations(module.instructions, module.metadata).where("dbg IS NOT NULL").collect()] == [7]


def test_hash_and_demangling(spark):
    rng = random.Random(3)
    words = ["", "a", "foobar"] + ["".join(chr(rng.randrange(32, 400)) for _ in range(rng.randrange(1, 30))) for _ in range(50)]

    def fnv(s):
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % (1 << 64)
        return f"{h:016x}"

    got = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"{program.fnv1a('w')} AS h").collect()}
    assert got == {w: fnv(w) for w in words}
    asks = {"_ZN4core3ptr17h0123456789abcdefE": "core::ptr", "_ZN3foo3barEv": "foo::bar", "free": "free", "_ZNSt6vectorE": "_ZNSt6vectorE"}
    assert {r.w: r.d for r in spark.createDataFrame([(w,) for w in asks], "w string").selectExpr("w", f"{program.demangle('w')} AS d").collect()} == asks


def test_trees_and_memory(spark):
    tree = spark.createDataFrame([(i, i // 2) for i in range(1, 40)] + [(0, None)], "id bigint, parent bigint")
    got = {(r.id, r.ancestor): r.depth for r in program.ancestors(tree).collect()}
    want = {}
    for i in range(1, 40):
        at, d = i, 0
        while at:
            at, d = at // 2, d + 1
            want[i, at] = d
    assert got == want
    maps = spark.createDataFrame([(1, 2, "my_free"), (3, 4, "x_create"), (5, 6, "xrealloc")], "arg bigint, param bigint, callee string")
    assert {(r.src, r.dst, r.strength) for r in program.propagate_memory(maps).collect()} == {(1, 2, "strong"), (4, 3, "strong"), (5, 6, "weak"), (6, 5, "weak")}


def test_noise_and_metrics(spark):
    one = lambda sql, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).selectExpr(f"{sql} AS x").first().x
    assert one(program.origin("n", "p"), n="main_loop", p="/home/u/.cargo/registry/x.rs") == "third_party"
    assert one(program.origin("n", "p"), n="llvm.dbg.value", p="a.c") == "compiler_generated" and one(program.origin("n", "p"), n="f", p="a.c") == "user"
    assert one(program.output_parameter("n"), n="out_len") and not one(program.output_parameter("n"), n="len")
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (True, True)], "t boolean, f boolean")
    assert program.accuracy(df, "t", "f").first()[:] == (2, 1, 1, 0.666667, 0.666667, 0.666667)
    assert program.interner(spark.createDataFrame([("ab",), ("ab",), ("c",), (None,)], "s string"), "s").first()[:] == (4, 3, 2)
    assert one(names.zone("n"), n="drop_in_place") == "runtime"


def test_every_query_has_sql_and_marks_resolve():
    q, s = catalog.queries(), catalog.oracle_sql()
    assert set(q) == set(s) and len(q) > 90
    assert all("{" not in bindings.ansi(n) for n in bindings.BINDINGS)


def test_entry_without_the_optional_package(monkeypatch):
    for name in ("irloom.llm", "irloom.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # what can't be imported, for want of a file or of something it needs
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert not [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] and "pipeline" not in entry.queries()
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
    assert len([n for n in importlib.import_module("__spark_entry__").queries() if n.startswith("op") and n[2].isdigit()]) in (0, 10)


def test_graph_relations_hold_every_pair(spark, tmp_path):
    pairs = {(s, p) for s in range(4) for p in (s + 1, 3 * s, 150 + s)}
    rows = [(1, s, p, 7, "N", 2) for s, p in sorted(pairs)] * 2
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity long, l_returnflag string, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, kinds in (("nation", "n_nationkey long, n_regionkey long"), ("orders", "o_orderkey long, o_custkey long, o_orderstatus string"), ("events", "user_id long, event_id long, event_type string")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    t = bindings.Tables(spark, str(tmp_path))
    dag = {(min(x), max(x)) for x in pairs if x[0] != x[1]}
    for name, want in (("edges", pairs), ("dag", dag), ("factors", pairs)):
        got = t.bind(name).select("src", "dst").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    alias = t.bind("facts").where("kind = 'alias_may'").collect()
    assert {(r.subject - 3_000_000_000, r.object - 4_000_000_000) for r in alias} == pairs
    closed = set(dag)
    while more := {(a, d) for a, b in closed for c, d in closed if b == c} - closed:
        closed |= more
    assert {(r.subject, r.object) for r in catalog.queries()["fixpoint_transitive"](spark, str(tmp_path)).collect()} == closed


def test_joins_hold_every_id(spark, tmp_path):
    lines = [(k, p, 0, "R", "F", "2020-01-01", 1, 1, 1, 1, 1) for k, n in ((1, 3), (9_000, 80)) for p in range(n)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate string, l_linenumber int, l_quantity long, l_extendedprice long, l_discount long, l_tax long"
    spark.createDataFrame([(k, p, 4 if k == 9_000 else 1, *rest) for k, p, _, *rest in lines], kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, 3, "F"), (9_007, 3, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(107, 3), (207, 4)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path))
    assert run("may_alias_pairs").count() == 3 + 80 * 79 // 2
    spark.createDataFrame([(7, 4, "F"), (9_007, 4, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert {r.call_id for r in run("devirtualised_calls").collect()} == {7, 9_007}
    assert {r.node for r in run("danger_surface").collect()} == set(range(80))


def test_devirtualised_signatures_are_exact(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 3)
    monkeypatch.setattr(matching, "SLICE", 6)
    types = [("F", ["a,b"]), ("F", ["a", "b"]), ("F", []), ("F|a", ["b"]), ("F", ["a|b"]), (None, ["a", "b"]), ("F", [None, "a", "b"]), ("F", None), ("P", ["x"])]
    calls = [(i, *types[i % 8 if i % 3 else 0]) for i in range(100)] + [(7, *types[1])] * 2 + [(None, *types[1])]
    functions = [(i, *types[i % 7]) for i in range(60)] + [(None, *types[0]), (1, *types[8]), (1, *types[5])]
    known = lambda t: t[0] is not None and t[1] is not None and None not in t[1]
    want = sorted(str((c[0], f[0])) for c in calls for f in functions if c[1:] == f[1:] and known(c[1:]))
    got = matching.devirtualise(spark.createDataFrame(calls, "call_id long, ret_type string, param_types array<string>"), spark.createDataFrame(functions, "func long, ret_type string, param_types array<string>"))
    assert sorted(str((r.call_id, r.func)) for r in got.collect()) == want and len(want) > 700


def test_devirtualised_pairs_take_little_room(spark, tmp_path):
    """200 signatures of 100 calls and 100 functions each, dealt in turn: all two million pairs are written, in less than half a byte each."""
    kind = F.array((F.col("id") % 200).cast("string"))
    calls = spark.range(20_000).select(F.col("id").alias("call_id"), F.lit("F").alias("ret_type"), kind.alias("param_types"))
    matching.devirtualise(calls, calls.withColumnRenamed("call_id", "func")).coalesce(4).write.parquet(f"{tmp_path}/pairs")
    back = spark.read.parquet(f"{tmp_path}/pairs")
    assert back.distinct().count() == 2_000_000 == back.where("call_id % 200 = func % 200").count()
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < 1_000_000
