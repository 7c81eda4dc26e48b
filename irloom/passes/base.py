"""Views that passes share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom import vocab
from irloom.functions import names
from irloom.functions.storage import materialise
from irloom.operators import graph
from irloom.sources.ir_text import Module

KEY = ["module_id", "func"]
ACQUIRES = sorted({n for _, a, _, _ in vocab.FAMILIES for n in a} | set(vocab.ALLOCATORS))
RELEASES = sorted({n for _, _, r, _ in vocab.FAMILIES for n in r} | set(vocab.DEALLOCATORS))
_FAMILY = {n: f for f, a, r, _ in vocab.FAMILIES for n in [*a, *r]} | {n: "c_heap" for n in [*vocab.ALLOCATORS, *vocab.DEALLOCATORS]}


def calls(m: Module) -> DataFrame:
    return m.instructions.where("callee IS NOT NULL")


def called(m: Module, callees: list[str]) -> DataFrame:
    return calls(m).where(F.col("callee").isin(callees))


def family(column: str = "callee"):
    return F.create_map(*[F.lit(x) for k, v in sorted(_FAMILY.items()) for x in (k, v)])[F.col(column)]


def operands(m: Module) -> DataFrame:
    """One row for each operand: the instruction's columns and o."""
    return m.instructions.select("module_id", "func", "bb", "block", "ordinal", "result", "opcode", "callee", "pred", "type", F.size("operands").alias("many"), F.explode("operands").alias("o"))


def uses(m: Module) -> DataFrame:
    """value used, by which instruction."""
    return operands(m).select(*KEY, F.col("o.value").alias("value"), "bb", "ordinal", "opcode", "callee", F.col("o.idx").alias("idx"))


def argument(i: int):
    return F.col("operands")[i]["value"]


def allocations(m: Module) -> DataFrame:
    """module_id, func, ptr, callee, family, size, bb, ordinal."""
    size = F.when(F.col("callee") == "calloc", F.col("operands")[0]["int_value"] * F.col("operands")[1]["int_value"]).otherwise(F.col("operands")[0]["int_value"])
    return called(m, ACQUIRES).where("result IS NOT NULL").select(*KEY, F.col("result").alias("ptr"), "callee", family().alias("family"), size.alias("size"), "bb", "ordinal")


def releases(m: Module) -> DataFrame:
    return called(m, RELEASES).where(F.size("operands") > 0).select(*KEY, argument(0).alias("ptr"), "callee", family().alias("family"), "bb", "ordinal")


def cfg_edges(m: Module) -> DataFrame:
    """module_id, func, src_bb, dst_bb: labels joined with the blocks they name, so forward branches count too."""
    blocks = m.instructions.select(*KEY, F.col("block").alias("label"), F.col("bb").alias("dst_bb")).distinct()
    jumps = m.instructions.where(F.col("opcode").isin("br", "switch", "invoke", "callbr", "indirectbr")).select(*KEY, F.col("bb").alias("src_bb"), F.explode("labels").alias("label"))
    return jumps.join(blocks, [*KEY, "label"]).select(*KEY, "src_bb", "dst_bb").distinct()


def dfg_edges(m: Module) -> DataFrame:
    """module_id, func, value, ordinal: from the instruction that defines a value to those that use it."""
    defs = m.instructions.where("result IS NOT NULL").select(*KEY, F.col("result").alias("value"), F.col("ordinal").alias("def_ordinal"))
    return uses(m).join(defs, [*KEY, "value"]).select(*KEY, "value", "def_ordinal", "ordinal")


def block_reach(m: Module) -> DataFrame:
    """module_id, func, src_bb, dst_bb: blocks that can be reached from one another, by path doubling inside each function that
    releases something, itself or by a call (it is asked of those only). Made once for a module."""
    if "block-reach" not in m.kept:
        asked = releases(m).select(*KEY).union(handed_releases(m).select(*KEY)).distinct()
        m.kept["block-reach"] = _doubled(cfg_edges(m).join(asked, KEY, "left_semi"))
    return m.kept["block-reach"]


def _doubled(edges: DataFrame) -> DataFrame:
    reach = materialise(edges, "cfg")
    n = -1
    while True:
        a, b = reach.alias("a"), reach.alias("b")
        longer = a.join(b, (F.col("a.module_id") == F.col("b.module_id")) & (F.col("a.func") == F.col("b.func")) & (F.col("a.dst_bb") == F.col("b.src_bb"))).select("a.module_id", "a.func", "a.src_bb", "b.dst_bb")
        reach = materialise(reach.union(longer).distinct(), "cfg")
        k = reach.count()
        if k == n:
            return reach
        n = k


def function_language(column: str = "func"):
    return F.expr(names.language(column))


def aliases(m: Module) -> DataFrame:
    """module_id, func, value, base: a value and what it is a plain copy, cast or element of (one step)."""
    step = operands(m).where(F.col("opcode").isin("bitcast", "addrspacecast", "getelementptr", "inttoptr", "ptrtoint", "freeze") & (F.col("o.idx") == 0) & F.col("result").isNotNull())
    return step.select(*KEY, F.col("result").alias("value"), F.col("o.value").alias("base"))


def roots(m: Module) -> DataFrame:
    """module_id, func, value, root: what a value is derived from, however many copies, casts and elements away. Made once for a
    module: each round doubles the way, so a chain of n steps takes log n rounds (values that go round in a circle end after 32)."""
    if "roots" not in m.kept:
        up = materialise(aliases(m).groupBy(*KEY, "value").agg(F.min("base").alias("root")), "roots")
        for _ in range(32):
            more = up.select(*KEY, F.col("value").alias("root"), F.col("root").alias("next"))
            if up.join(more, [*KEY, "root"], "left_semi").isEmpty():
                break
            up = materialise(up.join(more, [*KEY, "root"], "left").select(*KEY, "value", F.coalesce("next", "root").alias("root")), "roots")
        m.kept["roots"] = up
    return m.kept["roots"]


def rooted(m: Module, df: DataFrame, column: str = "ptr") -> DataFrame:
    """df with `column` replaced by the value it is derived from."""
    up = roots(m).select(*KEY, F.col("value").alias(column), F.col("root").alias("__root"))
    return df.join(up, [*KEY, column], "left").withColumn(column, F.coalesce("__root", column)).drop("__root")


def parameters(m: Module) -> DataFrame:
    """module_id, func, ptr, idx, readonly: the named parameters of defined functions."""
    named = m.functions.where("NOT is_declaration").select(*KEY, "readonly", F.posexplode("params").alias("idx", "ptr"))
    return named.select(*KEY, "ptr", "idx", F.col("readonly")[F.col("idx")].alias("readonly"))


def handed_releases(m: Module) -> DataFrame:
    """module_id, func, ptr, callee, bb, ordinal: pointers handed to a function of the module that releases that parameter, itself or
    by handing it on. A function that releases only what it was not given isn't meant. Made once for a module."""
    if "handed" not in m.kept:
        own = parameters(m).select(*KEY, "ptr", "idx")
        node = lambda func, idx: F.concat_ws("\x01", "module_id", func, F.col(idx).cast("string"))
        here = m.functions.where("NOT is_declaration").select("module_id", F.col("func").alias("callee")).distinct()
        args = operands(m).where("callee IS NOT NULL AND o.type = 'ptr'").where(~F.col("callee").isin(RELEASES)).join(here, ["module_id", "callee"], "left_semi")
        args = materialise(rooted(m, args.select(*KEY, "callee", "bb", "ordinal", F.col("o.value").alias("ptr"), F.col("o.idx").alias("arg"))), "handed")
        seeds = rooted(m, releases(m)).join(own, [*KEY, "ptr"]).select(node("func", "idx").alias("node")).distinct()
        onward = args.join(own, [*KEY, "ptr"]).select(node("callee", "arg").alias("src"), node("func", "idx").alias("dst"))
        gone = graph.closure(onward, seeds).select("node").distinct()
        m.kept["handed"] = materialise(args.withColumn("node", node("callee", "arg")).join(gone, "node", "left_semi").select(*KEY, "ptr", "callee", "bb", "ordinal"), "handed")
    return m.kept["handed"]
