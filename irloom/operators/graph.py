"""Graph operators on edge tables (src, dst). Loops run on the driver, one distributed join a round, state in shared storage."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irloom.functions.storage import materialise


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def flow_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without self loops."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def checked_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends among nodes (id), and the others."""
    ids = nodes.select(F.col("id")).distinct()
    good = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")
    return good, edges.join(good.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


#: Nodes of a front that is sent to all executors; a larger one is hashed, and arcs stream past it unsorted.
FRONT = 100_000


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """node, depth: fewest edges from any seed (node) to each node, up to `most` edges."""
    arcs = materialise(edges.select("src", "dst"), "arcs")
    seen = materialise(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    front, depth, n = seen, 0, seen.count()
    while n and (most is None or depth < most):
        depth += 1
        front = F.broadcast(front) if n <= FRONT else front.hint("shuffle_hash")
        front = front.join(arcs, F.col("node") == arcs["src"]).select(F.col("dst").alias("node")).distinct()
        front = materialise(front.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        n = front.count()
        if n:
            seen = seen.union(front)
        if depth % 16 == 0:
            seen = materialise(seen, "reach")
    return seen


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return reach(edges, seeds).select("node")


def can_reach(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, reachable for each pair. Sources travel 64 at a time as bits of one number, along arcs that lead on or to a target
    only; a source whose targets are all met travels no further."""
    on = edges.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    arcs = edges.select("src", "dst").join(on, F.col("dst") == F.col("node"), "left_semi").distinct()
    arcs = materialise(arcs.select(F.col("src").alias("node"), F.col("dst").alias("to")), "arcs")
    roots = materialise(pairs.select(F.col("src").alias("root")).distinct().withColumn("n", F.monotonically_increasing_id()), "pairs")
    seen = materialise(roots.select(F.shiftright("n", 6).alias("lot"), F.col("root").alias("node"), F.expr("shiftleft(1L, CAST(n % 64 AS INT))").alias("bits")), "pairs")
    left = pairs.where("src <> dst").select("src", "dst").distinct().join(seen, F.col("src") == F.col("node")).select("src", "dst", "lot", "bits")
    left, front = materialise(left, "pairs"), seen
    while not left.isEmpty():
        open_ = left.groupBy(F.col("lot").alias("l")).agg(F.expr("bit_or(bits)").alias("open"))
        front = front.join(open_, F.col("lot") == F.col("l")).select("lot", "node", F.col("bits").bitwiseAND(F.col("open")).alias("bits")).where("bits <> 0")
        came = front.join(arcs, "node").groupBy("lot", F.col("to").alias("node")).agg(F.expr("bit_or(bits)").alias("new"))
        front = materialise(came.join(seen, ["lot", "node"], "left").select("lot", "node", F.expr("new & ~coalesce(bits, 0L)").alias("bits")).where("bits <> 0"), "pairs")
        if front.isEmpty():
            break
        seen = materialise(seen.union(front).groupBy("lot", "node").agg(F.expr("bit_or(bits)").alias("bits")), "pairs")
        met = front.select(F.col("lot").alias("l"), F.col("node").alias("dst"), F.col("bits").alias("came"))
        left = materialise(left.join(met, (left["lot"] == met["l"]) & (left["dst"] == met["dst"]) & (left["bits"].bitwiseAND(met["came"]) != 0), "left_anti"), "pairs")
    missed = left.select("src", "dst", F.lit(True).alias("missed"))
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return pairs.join(missed, ["src", "dst"], "left").select("src", "dst", (whole & F.col("missed").isNull()).alias("reachable"))


def trim(edges: DataFrame) -> DataFrame:
    """The edges left once nodes without way in or out are peeled off: those on cycles and between them."""
    left = materialise(edges.select("src", "dst").distinct(), "cycle")
    n = left.count()
    while n:
        out, into = left.select("src").distinct(), left.select(F.col("dst").alias("d")).distinct()
        left = left.join(into, left["src"] == into["d"], "left_semi")
        left = materialise(left.join(out.withColumnRenamed("src", "s"), left["dst"] == F.col("s"), "left_semi"), "cycle")
        m = left.count()
        if m == n:
            break
        n = m
    return left


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """node: what lies on a cycle, by strongly connected components.

    Each node takes the smallest node that reaches it as its colour; what reaches that node inside its colour is its component.
    Components of all colours are found at once and taken out, and what is left is trimmed and coloured anew."""
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    found, left = materialise(loops, "components"), trim(edges.where("src <> dst"))
    while not left.isEmpty():
        colour = materialise(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")), "colours")
        front = colour
        while not front.isEmpty():
            came = left.join(front, left["src"] == front["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            front = materialise(colour.join(came, "node").where("new < colour").select("node", F.col("new").alias("colour")), "colours")
            colour = materialise(colour.join(front.withColumnRenamed("colour", "new"), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")), "colours")
        a, b = colour.select(F.col("node").alias("src"), "colour"), colour.select(F.col("node").alias("dst"), F.col("colour").alias("other"))
        inside = materialise(left.join(a, "src").join(b, "dst").where("colour = other").select("src", "dst"), "colours")
        roots = colour.where("node = colour").select("node")
        component = materialise(reach(reverse(inside), roots).select("node"), "components")
        # a root with no other node in its component lies on no cycle; the nodes of larger ones have edges between them
        whole = component.join(colour, "node").groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.union(component.join(colour, "node").join(whole, "colour", "left_semi").select("node"))
        rest = left.join(component.withColumnRenamed("node", "src"), "src", "left_anti")
        left = trim(rest.join(component.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return found.distinct()


def has_cycle(edges: DataFrame) -> bool:
    return not trim(edges).isEmpty()


def first_parents(edges: DataFrame, sources: DataFrame, rounds: int = 8) -> DataFrame:
    """node, parent, depth: taint from sources (node) along edges for some rounds; of equal parents the smallest."""
    arcs = edges.select("src", "dst").distinct()
    seen = materialise(sources.select("node").distinct().select("node", F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth")), "taint")
    front = seen
    for depth in range(1, rounds + 1):
        front = front.join(arcs, front["node"] == arcs["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = materialise(front.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "taint")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def sink_paths(parents: DataFrame, sinks: DataFrame, hops: int = 64) -> DataFrame:
    """node, path (source first) of each tainted sink, by following parents; stops after `hops` or on a cycle."""
    way = parents.where("parent IS NOT NULL").select(F.col("node").alias("n"), F.col("parent").alias("p"))
    front = materialise(parents.join(sinks.select("node").distinct(), "node", "left_semi").select("node", F.array("node").alias("path")), "paths")
    done = None
    for _ in range(hops):
        step = front.join(way, F.element_at("path", 1) == F.col("n"), "left")
        goes = F.col("p").isNotNull() & ~F.array_contains("path", F.col("p"))
        stopped = step.where(~goes).select("node", "path")
        done = stopped if done is None else done.union(stopped)
        front = materialise(step.where(goes).select("node", F.concat(F.array("p"), "path").alias("path")), "paths")
        if front.isEmpty():
            return done
    return done.union(front)


def max_product(edges: DataFrame, seeds: DataFrame, floor: float = 0.1) -> DataFrame:
    """node, conf: the best product of factors (edges: src, dst, factor <= 1) from seeds (node, conf); under `floor` it dies.

    Products are rounded to 6 places, so equal paths compare equal; only nodes that improved travel on, until none does."""
    arcs = materialise(edges.groupBy("src", "dst").agg(F.max("factor").alias("factor")), "factors")
    best = materialise(seeds.groupBy("node").agg(F.max("conf").alias("conf")), "taint")
    front = best
    while True:
        came = front.join(arcs, front["node"] == arcs["src"]).select(F.col("dst").alias("node"), F.round(F.col("conf") * F.col("factor"), 6).alias("conf")).where(F.col("conf") >= floor)
        came = came.groupBy("node").agg(F.max("conf").alias("new"))
        front = materialise(came.join(best, "node", "left").where(F.col("conf").isNull() | (F.col("new") > F.col("conf"))).select("node", F.col("new").alias("conf")), "taint")
        if front.isEmpty():
            break
        best = materialise(best.union(front).groupBy("node").agg(F.max("conf").alias("conf")), "taint")
    return best


def degree(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(into, "node", "full").na.fill(0, ["out_degree", "in_degree"])


def adjacency(edges: DataFrame, most: int = 1 << 16) -> DataFrame:
    """node, next: sorted successors in chunks of at most `most`, so that a hub is no single row."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    return edges.select("src", "dst").distinct().withColumn("chunk", F.floor(rank / most)).groupBy(F.col("src").alias("node"), "chunk").agg(F.sort_array(F.collect_list("dst")).alias("next"))


def pass_order(deps: dict[str, list[str]]) -> list[str]:
    """Passes in dependency order, of equal ones in the order given; unknown names and cycles are errors."""
    unknown = sorted({d for ds in deps.values() for d in ds} - set(deps))
    if unknown:
        raise ValueError(f"missing dependency: {', '.join(unknown)}")
    rank = {p: i for i, p in enumerate(deps)}
    sorter = TopologicalSorter(deps)
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"cycle: {' -> '.join(e.args[1])}") from e
    order: list[str] = []
    ready: list[str] = []
    while sorter.is_active():
        ready = sorted([*ready, *sorter.get_ready()], key=rank.__getitem__)
        order.append(ready[0])
        sorter.done(ready.pop(0))
    return order
