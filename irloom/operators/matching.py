"""Joins of the engine: declarations with definitions, calls with callees, allocations with frees, names with rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irloom.functions import names, scores
from irloom.functions.storage import materialise


def match_functions(declares: DataFrame, defines: DataFrame) -> DataFrame:
    """Declarations (name, ...) with the last definition (name, id, ...) of their name in another module."""
    last = defines.groupBy("name").agg(F.max_by(F.struct(*[c for c in defines.columns if c != "name"]), "id").alias("d"))
    return declares.join(last, "name").select(declares["*"], F.col("d.id").alias("define_id"), *[F.col(f"d.{c}").alias(f"define_{c}") for c in defines.columns if c not in ("name", "id")])


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("name").distinct(), "name", "left_anti")


def score_matches(matches: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Matches (name) that pass the boundary gates, with vuln, signals, score and severity.

    A name is judged once, however many matches it has. Each step binds what the one before gives to a lambda's variable: as columns, the filter would be pushed below the
    projections and repeat their expressions many times over."""
    named = f"array(named_struct('vuln', {names.vulnerability('name')}, 'signals', {names.signals('name')}))"
    score = scores.boundary("q.signals", "q.vuln", f"CAST({confidence} AS DOUBLE)")
    scored = f"transform({named}, q -> named_struct('vuln', q.vuln, 'signals', q.signals, 'score', {score}))"
    passes = scores.boundary_passes("q.signals", "q.vuln", "q.score")
    judged = f"transform({scored}, q -> named_struct('vuln', q.vuln, 'signals', q.signals, 'score', q.score, 'severity', {scores.boundary_severity('q.score')}, 'passes', {passes}))[0]"
    # written before they are filtered and joined: else the optimiser repeats the expression in filters and in each column
    judged_names = materialise(matches.select("name").distinct().withColumn("__r", F.expr(judged)), "scores").where("__r.passes")
    return matches.join(judged_names, "name").select(*matches.columns, *[F.col(f"__r.{c}").alias(c) for c in ("vuln", "signals", "score", "severity")])


def call_sites(instructions: DataFrame) -> DataFrame:
    """callee, func, inst of every call: the index by callee is the table's clustering."""
    return instructions.where("callee IS NOT NULL").select("callee", "func", F.col("ordinal").alias("inst"))


def call_graph(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """src, dst: caller and callee where the callee is known by name."""
    return calls.join(functions.select(F.col("func").alias("callee")).distinct(), "callee", "left_semi").select(F.col("func").alias("src"), F.col("callee").alias("dst")).distinct()


SIGNATURE = ["ret_type", "param_types"]
TILE = 256  # most ids of calls, and of functions, that are unfolded at once: Spark holds these pairs in memory
SLICE = 4096  # most calls of a signature that stay together in one task
TASK_CALLS = 100_000  # calls a task: a Parquet dictionary (1 MB) has room for all of their ids


def _tiles(df: DataFrame, column: str) -> DataFrame:
    """SIGNATURE, slice, tile, ids: the rows of each signature in arrays of at most TILE, numbered in each signature."""
    place = (F.row_number().over(Window.partitionBy(*SIGNATURE).orderBy(column)) - 1).cast("long")
    numbered = df.select(*SIGNATURE, column, place.alias("place")).select(*SIGNATURE, F.expr(f"place div {SLICE}").alias("slice"), F.expr(f"place div {TILE}").alias("tile"), column)
    return numbered.groupBy(*SIGNATURE, "slice", "tile").agg(F.transform(F.collect_list(F.struct(column)), lambda x: x[column]).alias("ids"))  # in structs nulls are kept


def devirtualise(indirect: DataFrame, functions: DataFrame) -> DataFrame:
    """Indirect calls (call_id, ret_type, param_types) with the functions of that signature: an equality, not a theta join; an unknown type is equal to none.

    The result has a row for each pair, so it grows as a product; what is moved does not, but for a copy of a signature's
    functions for each SLICE of its calls. Tiles of calls meet tiles of functions and are unfolded where they
    are written: a call's run of rows and the short list of functions that comes back with each call take next to nothing in Parquet, in any number. The slices of a common
    signature are spread over the tasks. The merge join unfolds one pair of tiles at a time, a hash join all that a tile meets."""
    tasks = max(indirect.sparkSession.sparkContext.defaultParallelism, indirect.count() // TASK_CALLS + 1)
    indirect, functions = (f.where("ret_type IS NOT NULL AND NOT exists(param_types, x -> x IS NULL)") for f in (indirect, functions))
    last = indirect.groupBy(*SIGNATURE).agg(F.expr(f"(count(1) - 1) div {SLICE}").alias("last"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("slice")
    callees = _tiles(functions, "func").join(last, SIGNATURE).select(*SIGNATURE, every, F.col("ids").alias("funcs"))
    by = [*SIGNATURE, "slice"]
    met = _tiles(indirect, "call_id").repartition(tasks, *by).join(callees.repartition(tasks, *by).hint("merge"), by)
    return met.select(F.explode("ids").alias("call_id"), "funcs").select("call_id", F.explode("funcs").alias("func"))


def unreleased(allocs: DataFrame, frees: DataFrame) -> DataFrame:
    return allocs.join(frees.select("ptr").distinct(), "ptr", "left_anti")


def leaks(allocs: DataFrame, frees: DataFrame, threshold: float = scores.LEAK_THRESHOLD) -> DataFrame:
    """Allocations without a free, less the managed ones, with confidence and severity; at or over the threshold."""
    managed = ["rust_box", "rust_vec", "rust_string", "cpp_unique_ptr", "cpp_shared_ptr", "std_vector", "std_string", "zig_arraylist", "zig_hashmap", "zig_buffer", "zig_multiarraylist"]
    out = unreleased(allocs, frees).where(~F.col("is_global") & ~F.col("has_raii") & ~F.col("is_gc") & ~F.col("is_borrowed") & ~F.coalesce(F.col("container").isin(managed), F.lit(False)))
    out = out.withColumn("confidence", F.expr(scores.leak())).where(F.col("confidence") >= threshold)
    return out.withColumn("severity", F.when(F.col("on_ffi_path"), "high").otherwise("low"))


def cross_language(edges: DataFrame, languages: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends have different languages (node, lang), or no known callee."""
    a, b = languages.select(F.col("node").alias("src"), F.col("lang").alias("caller_lang")), languages.select(F.col("node").alias("dst"), F.col("lang").alias("callee_lang"))
    return edges.join(a, "src", "left").join(b, "dst", "left").where(F.col("callee_lang").isNull() | (F.col("caller_lang") != F.col("callee_lang")))


def same_type_pairs(pointers: DataFrame, most: int | None = 64) -> DataFrame:
    """a, b: pointers (func, type, ptr) of one function and type, the first `most` of each group by id (None: all): may alias."""
    rank = F.row_number().over(Window.partitionBy("func", "type").orderBy("ptr"))
    few = pointers.withColumn("rank", rank)
    few = few if most is None else few.where(F.col("rank") <= most)
    a, b = few.alias("a"), few.alias("b")
    return a.join(b, (F.col("a.func") == F.col("b.func")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.rank") < F.col("b.rank"))).select("a.func", F.col("a.ptr").alias("a"), F.col("b.ptr").alias("b"))


def mine_pairs(functions: DataFrame, least: float = 0.3) -> DataFrame:
    """Allocator and deallocator candidates (name) of one stem, with the mean of their scores: an equality on the stem."""
    scored = functions.select("name").distinct().withColumns({"stem": F.expr(names.stem("name")), "a": F.expr(names.allocator_score("name")), "d": F.expr(names.deallocator_score("name"))})
    alloc, free = scored.where(f"a >= {least}").select("stem", F.col("name").alias("allocator"), "a"), scored.where(f"d >= {least}").select("stem", F.col("name").alias("deallocator"), "d")
    pairs = alloc.join(free, "stem").where("allocator <> deallocator")
    return pairs.withColumn("score", F.round((F.col("a") + F.col("d")) / 2, 6)).select("allocator", "deallocator", "score")


def longest_rule(df: DataFrame, column: str, rules: list[tuple[str, str, str]], default: str) -> Column:
    """Value of the rule that fits: exact before prefix before suffix, the longer pattern first. rules: (type, pattern, value)."""
    found = None
    order = {"exact": 0, "prefix": 1, "suffix": 2}
    for kind, pattern, value in sorted(rules, key=lambda r: (order[r[0]], -len(r[1]), r[1])):
        c = df[column]
        fits = {"exact": c == pattern, "prefix": c.startswith(pattern), "suffix": c.endswith(pattern)}[kind]
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found.otherwise(default) if found is not None else F.lit(default)


def release_matches(allocs: DataFrame, releases: DataFrame, families: DataFrame) -> DataFrame:
    """ptr, result of each release (ptr, callee) against its allocation's family: same_family, mismatch, unknown_release."""
    family = F.broadcast(families.where("op = 'release'").select(F.col("name").alias("callee"), F.col("family").alias("release_family")))  # the shipped list
    met = releases.join(family, "callee", "left").join(allocs.select("ptr", F.col("family").alias("alloc_family")), "ptr")
    result = F.when(F.col("release_family").isNull(), "unknown_release").when(F.col("alloc_family") == F.col("release_family"), "same_family").otherwise("mismatch")
    return met.select("ptr", "callee", "alloc_family", "release_family", result.alias("result"))


def weighted_vote(votes: DataFrame, least_share: float = 0.15) -> DataFrame:
    """module, lang, weight, share, place: votes (module, lang, weight) summed; languages under a share of the winner drop out."""
    sums = votes.groupBy("module", "lang").agg(F.round(F.sum("weight"), 6).alias("weight"))
    w = Window.partitionBy("module")
    sums = sums.withColumns({"share": F.round(F.col("weight") / F.sum("weight").over(w), 6), "best": F.max("weight").over(w)})
    kept = sums.where(F.col("weight") >= least_share * F.col("best"))
    return kept.withColumn("place", F.row_number().over(w.orderBy(F.desc("weight"), "lang"))).drop("best")


def verify(candidates: DataFrame) -> DataFrame:
    """candidate_id, score, verdict: the verifiers in order, each clamped."""
    out = candidates.withColumn("has_destructor", F.expr("exists(evidence, e -> contains(e, 'destructor') OR contains(e, 'Drop') OR contains(e, 'RAII'))"))
    for name, sql in scores.verifier_steps():
        out = out.withColumn(name, F.expr(sql))
    return out.select("candidate_id", "score", F.expr(scores.verdict("score")).alias("verdict"))
