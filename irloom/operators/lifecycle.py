"""Ordered operators: state machines over events, balances, lock order, double frees.

A state machine's step is a function of a small set of states, and such functions compose: events are folded in chunks of bounded
size from every state, then the chunks' functions are folded from the start state. No resource's events meet in one row; they are
numbered by a window, which sorts a resource's events in one task and holds none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irloom import vocab

CHUNK = 4096
MEET_STATES = ["unknown", "live", "moved", "borrowed", "freed", "escaped", "invalid"]
CONTRACT_STATES = ["owned", "borrowed", "maybe_owned", "transferred", "retained", "released", "invalid", "unknown"]
USES_AFTER_RELEASE = ["borrow", "return_to_caller", "out_param_store", "field_store", "callback_escape", "thread_escape", "consume"]


def _map(pairs: list[tuple[str, str]]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs) + ")"


def _contract_step(s: str, e: str) -> str:
    """New struct (state, invalid, after_release, doubled, mismatched) from the struct s and the event e."""
    table = _map([(f"{a}:{t}", b) for a, t, b in vocab.CONTRACT])
    release = f"({e}.trigger IN ('release', 'conditional_release') AND {e}.af IS NOT NULL AND {e}.rf IS NOT NULL)"
    nxt = f"element_at({table}, concat({s}.state, ':', {e}.trigger))"
    uses = f"({s}.state = 'released' AND {e}.trigger IN ({vocab.sql_list(USES_AFTER_RELEASE)}))"
    twice = f"({s}.state = 'released' AND {e}.trigger = 'release')"
    same, other = f"({release} AND {e}.af = {e}.rf)", f"({release} AND {e}.af <> {e}.rf)"
    escapes = f"({e}.escape AND {e}.trigger IN ('return_to_caller', 'out_param_store', 'field_store', 'global_store'))"
    state = (
        f"CASE WHEN {same} THEN CASE WHEN {e}.trigger = 'conditional_release' THEN 'retained' ELSE 'released' END WHEN {other} OR {uses} OR {twice} OR {nxt} IS NULL THEN {s}.state "
        f"WHEN {escapes} THEN 'transferred' ELSE {nxt} END"
    )
    one = lambda cond: f"CASE WHEN {cond} THEN 1 ELSE 0 END"
    return (
        f"named_struct('state', {state}, 'invalid', {s}.invalid + {one(f'NOT {same} AND NOT {other} AND NOT {uses} AND NOT {twice} AND {nxt} IS NULL')}, "
        f"'after_release', {s}.after_release + {one(f'NOT {same} AND NOT {other} AND {uses}')}, 'doubled', {s}.doubled + {one(f'NOT {same} AND NOT {other} AND NOT {uses} AND {twice}')}, "
        f"'mismatched', {s}.mismatched + {one(other)})"
    )


def _lists(rows: DataFrame, key: str, chunk: int) -> DataFrame:
    """key, chunk, es: rows (key, seq, e) in lists of `chunk`, in order of e, whose first field is seq."""
    at = F.floor((F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1) / chunk)
    return rows.withColumn("chunk", at).groupBy(key, "chunk").agg(F.sort_array(F.collect_list("e")).alias("es"))


def contract_fold(events: DataFrame, start: str = "unknown", chunk: int = CHUNK) -> DataFrame:
    """resource_id, state, invalid, after_release, doubled, mismatched after all events (resource_id, seq, trigger, alloc_family,
    release_family, has_valid_escape), in order of seq. Family match comes first, then use after release, then the table."""
    e = events.select("resource_id", "seq", F.struct("seq", "trigger", F.col("alloc_family").alias("af"), F.col("release_family").alias("rf"), F.coalesce("has_valid_escape", F.lit(False)).alias("escape")).alias("e"))
    lists = _lists(e, "resource_id", chunk)
    zero = lambda state: f"named_struct('state', {state}, 'invalid', 0, 'after_release', 0, 'doubled', 0, 'mismatched', 0)"
    fold = f"transform(array({vocab.sql_list(CONTRACT_STATES)}), q -> aggregate(es, {zero('q')}, (s, e) -> {_contract_step('s', 'e')}))"
    parts = lists.select("resource_id", F.struct("chunk", F.expr(fold).alias("f")).alias("p"))
    whole = parts.groupBy("resource_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # a row for CHUNK events
    at = f"element_at(p.f, CAST(array_position(array({vocab.sql_list(CONTRACT_STATES)}), s.state) AS INT))"
    keys = ("invalid", "after_release", "doubled", "mismatched")
    step = f"named_struct('state', {at}.state, " + ", ".join(f"'{k}', s.{k} + {at}.{k}" for k in keys) + ")"
    end = F.expr(f"""aggregate(ps, {zero(f"'{start}'")}, (s, p) -> {step})""")
    return whole.select("resource_id", end.alias("s")).select("resource_id", "s.*")


def contract_checks(events: DataFrame) -> DataFrame:
    """Each event with the state that the table alone gives its predecessor's trigger and whether the step is legal."""
    before = F.lag("trigger").over(Window.partitionBy("resource_id").orderBy("seq"))
    table = F.create_map(*[F.lit(x) for a, t, b in vocab.CONTRACT for x in (f"{a}:{t}", b)])
    prev = F.coalesce(table[F.concat(F.lit("unknown:"), before)], F.lit("unknown"))
    return events.withColumn("from_state", prev).withColumn("to_state", table[F.concat("from_state", F.lit(":"), "trigger")]).withColumn("legal", F.col("to_state").isNotNull())


def lifetime_fold(actions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """resource_id, state, failures after all actions (resource_id, seq, action) in order; a failing action leaves the state."""
    arms = " ".join(f"WHEN e.action = '{a}'" + (f" AND s.state = '{need}'" if need else "") + f" THEN '{new}'" for a, need, new, _ in vocab.LIFETIME)
    nxt = f"CASE {arms} END"
    states = sorted({"unknown"} | {x for _, need, new, _ in vocab.LIFETIME for x in (need, new) if x})
    lists = _lists(actions.select("resource_id", "seq", F.struct("seq", "action").alias("e")), "resource_id", chunk)
    one = f"aggregate(es, named_struct('state', q, 'failures', 0), (s, e) -> named_struct('state', coalesce({nxt}, s.state), 'failures', s.failures + CASE WHEN {nxt} IS NULL THEN 1 ELSE 0 END))"
    parts = lists.select("resource_id", F.struct("chunk", F.expr(f"transform(array({vocab.sql_list(states)}), q -> {one})").alias("f")).alias("p"))
    whole = parts.groupBy("resource_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # a row for CHUNK actions
    at = f"element_at(p.f, CAST(array_position(array({vocab.sql_list(states)}), s.state) AS INT))"
    end = f"aggregate(ps, named_struct('state', 'unknown', 'failures', 0), (s, p) -> named_struct('state', {at}.state, 'failures', s.failures + {at}.failures))"
    return whole.select("resource_id", F.expr(end).alias("s")).select("resource_id", "s.*")


def meet_sql(a: str, b: str) -> str:
    """The lattice meet of two lifetime states; not associative, so callers fold in a fixed order."""
    clash = " OR ".join(f"({a} = '{x}' AND {b} = '{y}') OR ({a} = '{y}' AND {b} = '{x}')" for x, y in vocab.LIFETIME_CONFLICTS)
    return (
        f"CASE WHEN {a} = 'unknown' THEN {b} WHEN {b} = 'unknown' THEN {a} WHEN {a} = 'invalid' OR {b} = 'invalid' THEN 'invalid' WHEN {a} = {b} THEN {a} "
        f"WHEN {clash} THEN 'invalid' WHEN {a} = 'escaped' OR {b} = 'escaped' THEN 'escaped' WHEN {a} = 'borrowed' OR {b} = 'borrowed' THEN 'borrowed' ELSE 'live' END"
    )


def meet_fold(states: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """merge_id, state: the meet of the states (merge_id, seq, state) that come together, in order of seq.

    The fold goes over chunks: what a chunk makes of each state it may start from, then from chunk to chunk."""
    every = f"array({vocab.sql_list(MEET_STATES)})"
    lists = _lists(states.select("merge_id", "seq", F.struct("seq", "state").alias("e")), "merge_id", chunk)
    fold = f"transform({every}, q -> aggregate(es, q, (s, e) -> {meet_sql('s', 'e.state')}))"
    parts = lists.select("merge_id", F.struct("chunk", F.expr(fold).alias("f")).alias("p"))
    whole = parts.groupBy("merge_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return whole.select("merge_id", F.expr(f"aggregate(ps, 'unknown', (s, p) -> element_at(p.f, CAST(array_position({every}, s) AS INT)))").alias("state"))


def double_frees(frees: DataFrame) -> DataFrame:
    """Each further free of a pointer (ptr, seq, bb, lang): with the number of frees so far, whether the block is that of the first,
    and how many languages free it."""
    order = Window.partitionBy("ptr").orderBy("seq")
    whole = Window.partitionBy("ptr")
    out = frees.withColumns({"nth": F.row_number().over(order), "first_bb": F.first("bb").over(order), "langs": F.size(F.collect_set("lang").over(whole))})
    return out.where("nth > 1").withColumn("same_block", F.col("bb") == F.col("first_bb"))


def held_locks(ops: DataFrame) -> DataFrame:
    """Lock operations (func, ordinal, lock_id, is_acquire) with how often the lock is held after each."""
    order = Window.partitionBy("func", "lock_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return ops.withColumn("held", F.sum(F.when(F.col("is_acquire"), 1).otherwise(-1)).over(order))


def held_intervals(ops: DataFrame) -> DataFrame:
    """func, lock_id, since, until: from each acquire to the next release of that lock in the function (null: to its end)."""
    order = Window.partitionBy("func", "lock_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    until = F.first(F.when(~F.col("is_acquire"), F.col("ordinal")), ignorenulls=True).over(order)
    return ops.withColumn("until", until).where("is_acquire").select("func", "lock_id", F.col("ordinal").alias("since"), "until")


def lock_order(ops: DataFrame, span: int = 64) -> DataFrame:
    """src, dst: lock dst is acquired while src is held, in one function.

    A range join made equal: intervals are spread over buckets of `span` ordinals, acquires meet those of their own bucket."""
    held = held_intervals(ops)
    last = ops.groupBy("func").agg(F.max("ordinal").alias("last"))
    held = held.join(last, "func").withColumn("until", F.coalesce("until", F.col("last") + 1))
    spread = held.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("since") / span), F.floor(F.col("until") / span))))
    takes = ops.where("is_acquire").select("func", F.col("lock_id").alias("dst"), "ordinal", F.floor(F.col("ordinal") / span).alias("bucket"))
    met = spread.join(takes, ["func", "bucket"]).where((F.col("ordinal") > F.col("since")) & (F.col("ordinal") < F.col("until")) & (F.col("dst") != F.col("lock_id")))
    return met.select(F.col("lock_id").alias("src"), "dst").distinct()


def balance(events: DataFrame, keys: list[str], sign: str, order: str) -> DataFrame:
    """keys, open: what is acquired and not released; a release with nothing open is dropped. `sign` is 1 or -1.

    With running sums, the answer is the last sum less the lowest one (or zero, if no sum is under it)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("run", F.sum(sign).over(w))
    return runs.groupBy(*keys).agg((F.sum(sign) - F.least(F.min("run"), F.lit(0))).alias("open"))


def error_path_leaks(ops: DataFrame) -> DataFrame:
    """Calls that return an error while the function holds an allocation: ops has func, ordinal, op in alloc, free, error, other."""
    w = Window.partitionBy("func").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op").isin("alloc", "free"), F.col("op")), ignorenulls=True).over(w)
    return ops.withColumn("state", state).where((F.col("op") == "error") & (F.col("state") == "alloc")).select("func", "ordinal")


def lock_balance(ops: DataFrame) -> DataFrame:
    """func, acquired, released, held_at_exit of an interpreter lock (func, ordinal, is_acquire); unbalanced functions only."""
    out = ops.groupBy("func").agg(F.count_if("is_acquire").alias("acquired"), F.count_if(~F.col("is_acquire")).alias("released"), F.max_by("is_acquire", "ordinal").alias("held_at_exit"))
    return out.where("acquired <> released OR (NOT held_at_exit AND acquired > 0 AND acquired <> released)")


def infeasible_paths(conditions: DataFrame) -> DataFrame:
    """path_id of paths that state a condition and its negation on one value (path_id, value_id, kind, negated)."""
    both = conditions.groupBy("path_id", "value_id", "kind").agg(F.bool_or("negated").alias("some"), F.bool_and("negated").alias("all"))
    return both.where("some AND NOT all").select("path_id").distinct()
