"""Operators on small fixtures, by hand and against plain Python."""

import json
import random

import pytest

from irloom import pipeline, vocab
from irloom.functions import names, scores
from irloom.operators import facts, graph, issues, lifecycle, matching
from irloom.sources import config, sinks
from irloom.streaming import events

FACTS = [("cfg_edge", 1, 2, 0), ("cfg_edge", 2, 3, 0), ("dfg_edge", 1, 3, 0), ("cfg_edge", 4, 5, 1), ("dfg_edge", 4, 6, 1)]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(FACTS, "kind string, subject bigint, object bigint, context bigint")


def test_fact_queries(store):
    assert facts.by_kind(store, "cfg_edge").count() == 3 and facts.by_subject(store, 1).count() == 2
    assert facts.by_object(store, 3).count() == 2 and facts.by_context(store, 0).count() == 3
    assert facts.by_kind_and_subject(store, "cfg_edge", 4).count() == 1
    assert facts.get(store, "cfg_edge", 1).first()[:4] == ("cfg_edge", 2, 3, 0) and facts.get(store, "cfg_edge", 9).count() == 0
    assert facts.unsaved(store, store.where("context = 0")).count() == 2 and facts.insert(store, store).count() == 10


def test_fixpoint(spark):
    rows = [("alias_may", i, i + 1, 0) for i in range(6)] + [("ownership_free", 1, 2, 0)]
    out = facts.fixpoint(spark.createDataFrame(rows, "kind string, subject bigint, object bigint, context bigint"), [facts.alias_transitivity, facts.freed_is_vulnerable])
    got = {(r.kind, r.subject, r.object) for r in out.facts.collect()}
    assert out.converged and {("alias_may", i, j) for i in range(6) for j in range(i + 1, 7)} <= got and ("vulnerability", 1, 2) in got
    assert out.new_facts == 15 + 1


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def nodes_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


@pytest.mark.parametrize("seed", range(3))
def test_graph_against_python(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)]
    e = edges_of(spark, pairs)
    depth, front = {0: 0}, [0]
    while front:
        front = sorted({b for a, b in pairs if a in front} - set(depth))
        depth |= {b: max(depth.values()) + 1 for b in front}
    assert {r.node: r.depth for r in graph.reach(e, nodes_of(spark, [0])).collect()} == depth
    conf = {0: 1.0}
    for _ in range(60):
        for a, b in pairs:
            if a in conf and round(conf[a] * 0.9, 6) >= 0.5:
                conf[b] = max(conf.get(b, 0), round(conf[a] * 0.9, 6))
    from pyspark.sql import functions as F

    assert {r.node: r.conf for r in graph.max_product(e.withColumn("factor", F.lit(0.9)), nodes_of(spark, [0]).withColumn("conf", F.lit(1.0)), 0.5).collect()} == conf


def test_cycles_and_paths(spark):
    assert graph.has_cycle(edges_of(spark, [(1, 2), (2, 3), (3, 1)])) and not graph.has_cycle(edges_of(spark, [(1, 2), (2, 3)]))
    assert graph.has_cycle(edges_of(spark, [(1, 2), (2, 1), (3, 4), (4, 5)])) and graph.has_cycle(edges_of(spark, [(1, 1)]))
    chain = edges_of(spark, [(i, i + 1) for i in range(15)])
    assert graph.reach(chain, nodes_of(spark, [0]), 10).count() == 11
    parents = graph.first_parents(edges_of(spark, [(1, 2), (1, 3), (2, 4), (3, 4)]), nodes_of(spark, [1]))
    assert [r.path for r in graph.sink_paths(parents, nodes_of(spark, [4])).collect()] == [[1, 2, 4]]
    asks = edges_of(spark, [(1, 3), (3, 1)])
    assert {(r.src, r.reachable) for r in graph.can_reach(edges_of(spark, [(1, 2), (2, 3)]), asks).collect()} == {(1, True), (3, False)}
    good, bad = graph.checked_edges(spark.range(3), edges_of(spark, [(0, 1), (1, 9)]))
    assert good.count() == 1 and bad.count() == 1
    assert [(r.node, r.next) for r in graph.adjacency(edges_of(spark, [(1, 3), (1, 2), (1, 2)]), 1).orderBy("chunk").collect()] == [(1, [2]), (1, [3])]


def test_pass_order():
    assert graph.pass_order({"b": ["a"], "a": [], "c": ["b"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="missing"):
        graph.pass_order({"a": ["x"]})
    with pytest.raises(ValueError, match="cycle"):
        graph.pass_order({"a": ["b"], "b": ["a"]})


def test_contract_fold_every_cell_and_chunks(spark):
    rng = random.Random(1)
    triggers = sorted({t for _, t, _ in vocab.CONTRACT}) + ["retain", "unknown"]
    table = {(a, t): b for a, t, b in vocab.CONTRACT}
    rows, want = [], {}
    for r in range(80):
        state, counts = "unknown", dict(invalid=0, after_release=0, doubled=0, mismatched=0)
        for s in range(rng.randrange(1, 25)):
            t, af, rf, esc = rng.choice(triggers), rng.choice([None, "c_heap"]), rng.choice([None, "c_heap", "x"]), rng.random() < 0.5
            rows.append((r, s, t, af, rf, esc))
            if t in ("release", "conditional_release") and af and rf:
                if af == rf:
                    state = "retained" if t == "conditional_release" else "released"
                else:
                    counts["mismatched"] += 1
            elif state == "released" and t in lifecycle.USES_AFTER_RELEASE:
                counts["after_release"] += 1
            elif state == "released" and t == "release":
                counts["doubled"] += 1
            elif (state, t) not in table:
                counts["invalid"] += 1
            else:
                state = "transferred" if esc and t in ("return_to_caller", "out_param_store", "field_store", "global_store") else table[state, t]
        want[r] = (state, *counts.values())
    df = spark.createDataFrame(rows, "resource_id bigint, seq bigint, trigger string, alloc_family string, release_family string, has_valid_escape boolean")
    for chunk in (4096, 5):
        assert {r.resource_id: tuple(r[1:]) for r in lifecycle.contract_fold(df, chunk=chunk).collect()} == want


def test_balance_and_locks(spark):
    rows = [("f", 0, -1), ("f", 1, 1), ("f", 2, 1), ("f", 3, -1), ("g", 0, 1), ("g", 1, -1)]
    assert {r.func: r.open for r in lifecycle.balance(spark.createDataFrame(rows, "func string, ordinal int, sign int"), ["func"], "sign", "ordinal").collect()} == {"f": 1, "g": 0}
    ops = [("f", 0, 1, True), ("f", 1, 2, True), ("f", 2, 2, False), ("f", 200, 3, True), ("f", 300, 1, False), ("f", 301, 4, True), ("g", 0, 5, False), ("g", 1, 6, True)]
    got = {(r.src, r.dst) for r in lifecycle.lock_order(spark.createDataFrame(ops, "func string, ordinal int, lock_id bigint, is_acquire boolean")).collect()}
    assert got == {(1, 2), (1, 3), (3, 4)}


@pytest.mark.parametrize("ffi,callee,size,cond,want", [(False, "malloc", 8, False, 0.65), (True, "malloc", 8, False, 0.85), (True, "malloc", 2 << 20, False, 0.95), (False, "widget", 200_000, False, 0.63), (False, "malloc", 8, True, 0.4875)])
def test_leak_score(spark, ffi, callee, size, cond, want):
    row = spark.createDataFrame([(ffi, callee, size, cond)], "on_ffi_path boolean, callee string, size bigint, is_conditional boolean").selectExpr(f"{scores.leak()} AS s").first()
    assert row.s == pytest.approx(want, abs=1e-6)


def test_names(spark):
    q = lambda sql, n: spark.createDataFrame([(n,)], "name string").selectExpr(f"{sql} AS x").first().x
    assert q(names.language("name"), "_ZN4core3ptr17h0123456789abcdefE") == "rust" and q(names.language("name"), "_ZN3fooE") == "cpp" and q(names.language("name"), "free") == "c"
    assert q(names.pattern_base("name"), "ffi_alloc_12") == "ffi_alloc_" and q(names.pattern_base("name"), "12") == "" and q(names.stem("name"), "buf_alloc") == "buf"
    assert q(names.canonical("name"), "@\x01_malloc") == "malloc" and q(names.file_stem("name"), "/a/b.c.ll") == "b.c" and q(names.role("name"), "my_free") == "free"


def issue_rows(spark):
    rows = [(i, "memory_leak", "same", f"ffi_alloc_{i}", "a.c", i, "high", 0.8, None, False, "user") for i in range(1, 5)]
    rows += [(10 + i, "double_free", "many", "f", "a.c", 1, "critical", 0.9, "internal_core", False, "stdlib") for i in range(6)]
    return spark.createDataFrame(rows, "issue_id bigint, kind string, message string, func string, file string, line int, severity string, confidence double, surface string, has_boundary boolean, origin string")


def test_issue_operators(spark):
    df = issue_rows(spark)
    assert issues.dedup(df).count() == 5 and issues.fold_messages(df).first().n == 6 and issues.unfolded(df).count() == 4
    assert issues.fold_patterns(df).first()[:] == ("memory_leak", "ffi_alloc_", 4, "ffi_alloc_1", "ffi_alloc_4")
    kept = issues.admit(df)
    assert kept.where("kind = 'double_free'").count() == 6 and {r.final_severity for r in kept.where("kind = 'double_free'").collect()} == {"critical"}
    assert issues.report_filter(df, "critical").count() == 6 and issues.stats(df).first().issues == 10


def test_matching(spark):
    declares = spark.createDataFrame([("a", 1), ("b", 2)], "name string, at int")
    defines = spark.createDataFrame([("a", 1), ("a", 5), ("z", 2)], "name string, id int")
    assert [r.define_id for r in matching.match_functions(declares, defines).collect()] == [5] and matching.unmatched(declares, defines).first().name == "b"
    pairs = matching.mine_pairs(spark.createDataFrame([("buf_alloc",), ("buf_free",), ("x_free",)], "name string")).collect()
    assert [(p.allocator, p.deallocator) for p in pairs] == [("buf_alloc", "buf_free")]
    wide = spark.createDataFrame([("f", "t", i) for i in range(70)], "func string, type string, ptr int")
    assert matching.same_type_pairs(wide).count() == 64 * 63 // 2


def test_sinks_and_config(spark, tmp_path):
    df = issue_rows(spark)
    doc = json.loads(sinks.sarif(df))
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 10 and {r["level"] for r in doc["runs"][0]["results"]} == {"error"}
    assert "critical: 6" in sinks.text_report(df) and "ffi_alloc_1" in sinks.graph_html(df)
    sinks.write(df, f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").count() == 10
    (tmp_path / "irloom.json").write_text('{"min_severity": "high", "passes": ["lock"]}')
    found = config.merge(config.load(config.discover(str(tmp_path))), config.parse_args(["a.ll", "--min-severity", "medium"]) | {"config": None} and {k: v for k, v in config.parse_args(["a.ll", "--min-severity", "medium"]).items() if k != "config"})
    assert (found.min_severity, found.passes, found.inputs) == ("medium", ("lock",), ("a.ll",))
    with pytest.raises(ValueError):
        config.from_dict({"nope": 1})
    toml = '[contracts.x]\n[[contracts.x.pair]]\nname = "h"\nallocate = ["x_new"]\nrelease = ["x_free", "x_unref"]\nownership = "caller"\n'
    assert config.contracts(spark, toml).count() == 2


def test_whole_run(spark, tmp_path):
    (tmp_path / "a.ll").write_text('source_filename = "a.c"\ndefine void @f() {\n%p = call ptr @malloc(i64 8)\ncall void @free(ptr %p)\ncall void @free(ptr %p)\nret void\n}\n')
    out = pipeline.main([f"{tmp_path}/a.ll", "--format", "text", "--min-severity", "high"], spark)
    assert "double_free in f at a.c" in out


def test_streams(spark, tmp_path):
    rows = [(1, 0, "acquire"), (1, 1, "borrow"), (1, 2, "release"), (2, 0, "release")]
    spark.createDataFrame(rows, "resource_id long, seq long, trigger string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("resource_id long, seq long, trigger string").parquet(f"{tmp_path}/in")
    q = events.contract_states(stream).writeStream.outputMode("update").format("memory").queryName("contracts").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.resource_id, r.state, r.invalid) for r in spark.sql("SELECT * FROM contracts").collect()} == {(1, "borrowed", 1), (2, "unknown", 1)}


def test_folds_do_not_depend_on_chunks(spark):
    import random

    from irloom.operators import lifecycle

    rng = random.Random(3)
    actions = spark.createDataFrame([(i % 9, i, rng.choice(["alloc", "free", "borrow", "transfer", "reclaim", "escape"])) for i in range(200)], "resource_id long, seq long, action string")
    states = spark.createDataFrame([(i % 9, i, rng.choice(lifecycle.MEET_STATES)) for i in range(60)], "merge_id long, seq long, state string")
    for fold, rows in ((lifecycle.lifetime_fold, actions), (lifecycle.meet_fold, states)):
        whole = sorted(map(tuple, fold(rows).collect()))
        assert all(sorted(map(tuple, fold(rows, chunk).collect())) == whole for chunk in (1, 3))


def test_alias_fixpoint_is_that_of_the_rule(spark, monkeypatch):
    """Cycles, facts on themselves, contexts, negative and far ids: as the rule gives round by round; chains' ends are no rows of a join."""
    import random

    rng = random.Random(4)
    ids = [-70_000, -1, 0, 1, 2, 63, 64, 65, 32_767, 32_768, 1 << 40]
    rows = [("alias_may", rng.choice(ids), rng.choice([*ids, 500, 600]), rng.randrange(2)) for _ in range(16)] + [("alias_may", 7, 7, 0), ("taint", 1, 500, 0)]
    store = spark.createDataFrame(rows, "kind string, subject long, object long, context long")
    alias = store.where("kind = 'alias_may'")
    want = sorted(map(tuple, facts.fixpoint(alias, [lambda delta, _: facts.alias_chain(delta, alias)]).facts.collect()))
    assert sorted(map(tuple, facts.alias_fixpoint(store).collect())) == want and len(want) > 20
    assert facts.alias_fixpoint(store.limit(0)).count() == 0
    star = spark.createDataFrame([("alias_may", 1, 2, 0)] + [("alias_may", 2, 100 + i, 0) for i in range(300)], store.schema)
    kept = []
    monkeypatch.setattr(facts, "snapshot", lambda df, f=facts.snapshot: kept.append((df.columns, f(df))) or kept[-1][1])
    assert facts.alias_fixpoint(star).count() == 601
    assert max(d.count() for c, d in kept if c == ["subject", "context", "node"]) == 1  # the way 1 -> 2, and none of the ends


def test_alias_fixpoint_moves_bits_not_ways(spark, monkeypatch):
    """More sources than a row has bits, all on the same long way: what is kept on the way stays below the facts that come in. Nulls stay by themselves."""
    arcs = [(s, 5_000, c) for s in range(1_100) for c in (0, 1)] + [(5_000 + i, 5_001 + i, 1) for i in range(8)] + [(5_003, 3, 1), (5_008, -9, 1), (5_008, 1 << 33, 1)]
    lone = [(None, 5_000, 0), (5_000, None, 1), (3, None, None)]
    store = spark.createDataFrame([("alias_may", *x) for x in arcs + lone + arcs[:5]], "kind string, subject long, object long, context long")
    kept = []
    monkeypatch.setattr(facts, "snapshot", lambda df, f=facts.snapshot: kept.append(f(df)) or kept[-1])
    out = facts.alias_fixpoint(store)
    assert max(d.count() for d in kept) <= 2 * len(arcs)
    on = {}
    for a, b, _ in arcs:
        on.setdefault(a, set()).add(b)
    want = set(lone)
    for a, b, c in arcs:
        todo = [b]
        want.add((a, b, c))
        while todo:
            for d in on.get(todo.pop(), ()):
                if d != a and (a, d, c) not in want:
                    want.add((a, d, c))
                    todo.append(d)
    got = [(r.subject, r.object, r.context) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_can_reach_stops_and_shares_rounds(spark, monkeypatch):
    """More sources than bits, cycles, targets without a way on, pairs of one node and nulls; a met source goes no further."""
    import random

    rng = random.Random(6)
    arcs = {(rng.randrange(150), rng.randrange(150)) for _ in range(190)}
    on = {}
    for a, b in arcs:
        on.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = {a}, [a]
        while todo:
            for b in on.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    edges = spark.createDataFrame(sorted(arcs), "src long, dst long")
    pairs = [(a, b) for a in range(0, 150) for b in (3, 77, a)] + [(1, 9_999), (None, 3), (3, None), (1, 3)]
    got = sorted(map(tuple, graph.can_reach(edges, spark.createDataFrame(pairs, "src long, dst long")).collect()), key=str)
    assert got == sorted([(a, b, a is not None and b in reached(a)) for a, b in pairs], key=str)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    rounds = []
    monkeypatch.setattr(graph, "materialise", lambda df, name, f=graph.materialise: rounds.append(name) or f(df, name))
    assert graph.can_reach(chain, spark.createDataFrame([(0, 2), (1, 2)], "src long, dst long")).where("reachable").count() == 2 and len(rounds) < 12


def test_reach_sends_small_fronts_and_hashes_large_ones(spark, monkeypatch):
    """Arcs are neither made distinct nor sorted: they stream past the front, whichever way it is met."""
    edges = spark.createDataFrame([(i, (i * 7 + k) % 90) for i in range(60) for k in (1, 2, 2)], "src long, dst long")
    seeds, plans = spark.createDataFrame([(5,), (5,)], "node long"), []
    monkeypatch.setattr(graph, "materialise", lambda df, name, f=graph.materialise: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, name))
    sent = sorted(map(tuple, graph.reach(edges, seeds).collect()))
    assert "Aggregate" not in plans[0] and "BroadcastHashJoin" in plans[2]
    monkeypatch.setattr(graph, "FRONT", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plans.clear()
    assert sorted(map(tuple, graph.reach(edges, seeds).collect())) == sent and len(sent) > 5
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plans[2]
