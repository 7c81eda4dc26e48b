"""Mixing sources to target weights by hash-threshold histograms.

A row's hash is 60 bits of the MD5 of its id and text. Per source, word counts are summed by the leading bits of the hash; the
bucket where the running sum passes the source's budget is the only one refined, by its next bits, until a bucket holds one
hash value. The source then takes the rows whose hash lies below that value, and of the rows at the value as many as come nearest
to the budget (they are copies of one row; half of a row counts as one). So the mix is a filter: no sort, no shuffle of texts; only
copies at a threshold are numbered, part by part. Thresholds of one source are nested: a larger budget takes a superset.

A target above the source's size is met by whole passes over the source plus one filtered pass; no row is taken more often than
``MOST`` times. Targets share the total by weight; what a source cannot take is reshared by weight among the others.

Defined cases: a null or empty text has size 0 and takes 0 words; null is a source of its own, last in order; rows equal in id
and text follow each other in the order of taking, in any order among themselves; an empty table gives an empty result; columns called like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irloom.llm.common import WORD, materialise, table

WEIGHTS, MOST = (1, 2, 3), 3
#: Bits of the hash, and bits that one histogram tells apart.
BITS, STEP = 60, 12


def row_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    whole = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, target from source, source_size: one row for each source, so one window over them all is small.

    With sources in order of (most * size) / weight, those before the first whose cap reaches the level
    (total - caps so far) / (weights left) stand at their caps, the others at level * weight."""
    w = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    w = w.withColumns({
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum(F.col("source_size").cast("double")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share,
    })
    w = w.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    w = w.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"])
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """source, source_size, target, full (whole passes), below (hashes under it are taken once more), edge and edge_take (so many
    of the rows of that hash are taken once more; null where that is all or none).

    sized has source, size, hash; goal is what ``targets`` gives."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goal.withColumn("full", full).select(
        "source", "source_size", "target", "full",
        (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"),
        F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("long").alias("below"),
        F.lit(None).cast("long").alias("edge"), F.lit(None).cast("long").alias("edge_take"),
    )
    state = state.withColumn("below", F.when(F.col("budget") <= 0, F.lit(0).cast("long")))
    for bits in range(STEP, BITS + 1, STEP):
        rest, mine = 1 << (BITS - bits), F.col("below").isNull()
        open_ = state.where(mine).select(F.col("source").alias("s"), "prefix", "budget", "base")
        inside = sized.join(open_, F.col("source").eqNullSafe(F.col("s")) & (F.expr(f"hash div {rest << STEP}L") == F.col("prefix")))
        buckets = inside.groupBy("source", F.expr(f"hash div {rest}L").alias("bucket")).agg(F.sum("size").alias("in_bucket"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.count(F.lit(1)).alias("rows"), F.max("budget").alias("budget"), F.max("base").alias("base"))
        upto = F.col("base") + F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket"))  # 4096 buckets at most
        edge = (
            buckets.withColumn("upto", upto)
            .where(F.col("upto") > F.col("budget"))
            .groupBy(F.col("source").alias("s"))
            .agg(F.min(F.struct("bucket", "upto", "in_bucket", "lo", "hi", "rows")).alias("e"))
        )
        start = F.col("e.upto") - F.col("e.in_bucket")
        take = F.least(F.floor((F.col("budget") - start) / (F.col("e.in_bucket") / F.col("e.rows")) + 0.5), F.col("e.rows"))
        one = F.when(take >= F.col("e.rows"), F.col("e.lo") + 1).otherwise(F.col("e.lo"))
        some = mine & (F.col("e.lo") == F.col("e.hi")) & (take > 0) & (take < F.col("e.rows"))
        found = F.when(F.col("e").isNull(), F.lit(1 << BITS)).when(F.col("e.lo") == F.col("e.hi"), one).when(start >= F.col("budget"), F.col("e.bucket") * rest)
        state = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "full", "budget",
            F.when(mine, F.coalesce(start, "base")).otherwise(F.col("base")).alias("base"),
            F.when(mine, F.coalesce("e.bucket", "prefix")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(mine, found).otherwise(F.col("below")).alias("below"),
            F.when(some, F.col("e.lo")).otherwise(F.col("edge")).alias("edge"), F.when(some, take).otherwise(F.col("edge_take")).alias("edge_take"),
        )
        state = materialise(state, "mix-thresholds")
        if state.where(F.col("below").isNull()).isEmpty():
            break
    return state.select("source", "source_size", "target", "full", "below", "edge", "edge_take")


def _sized(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "source", words().alias("size"), row_hash().alias("hash"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row)."""
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    sized = materialise(_sized(docs), "mix-sizes")
    return _apply(docs.withColumns({"mix_size": words(), "__h": row_hash()}), sized, weights, most, share)


def _apply(rows: DataFrame, sized: DataFrame, weights, most, share) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = thresholds(sized, targets(sizes, weights, most, share))
    t = found.select(
        F.col("source").alias("__s"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.col("full").alias("__full"), F.col("below").alias("__below"), F.col("edge").alias("__edge"), F.col("edge_take").alias("__take"),
    )
    # a row for each source; joined by what Spark measures of it
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("__s")))
    added = ["__s", "__full", "__below", "__h", "__edge", "__take"]
    whole = F.col("__full") + (F.col("__h") < F.col("__below")).cast("long")
    if found.where(F.col("edge").isNotNull()).isEmpty():
        return joined.withColumn("mix_copies", whole).drop(*added)
    at_edge = F.coalesce(F.col("__h") == F.col("__edge"), F.lit(False))
    counted = _numbered(joined.where(at_edge)).withColumn("mix_copies", F.col("__full") + (F.col("__at") <= F.col("__take")).cast("long"))
    return joined.where(~at_edge).withColumn("mix_copies", whole).drop(*added).unionByName(counted.drop(*added, "__at"))


def _numbered(copies: DataFrame) -> DataFrame:
    """copies (rows equal in id, text and source, for each source) with __at from 1. A part of the written rows is numbered by itself."""
    held = materialise(copies.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "mix-copies")
    each = held.groupBy("source", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = each.select(F.col("source").alias("__source"), F.col("__part").alias("__of"), (F.sum("__n").over(Window.partitionBy("source").orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = held.withColumn("__in", F.row_number().over(Window.partitionBy("source", "__part").orderBy("__row")))
    joined = inside.join(before, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__of")))
    return joined.withColumn("__at", F.col("__before") + F.col("__in")).drop("__part", "__row", "__source", "__of", "__before", "__in")


def op9_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each; see the module."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = materialise(_sized(docs), "mix-sizes")
    mixed = _apply(sized.withColumnRenamed("size", "mix_size").withColumnRenamed("hash", "__h"), sized, WEIGHTS, MOST, 1.0)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {BITS // 4}) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CAST(rk % 3 + 1 AS DOUBLE) AS weight, source_size * {MOST}.0::DOUBLE AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
v AS (SELECT *, (total - before) / left_ AS level FROM f),
l AS (SELECT arg_min(level, cap / weight * 1e6 + rk) AS level FROM v WHERE cap >= level * weight),
t AS (SELECT v.source, v.source_size, least(cap, coalesce(l.level * weight, cap)) AS target FROM v, l),
b AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_ FROM t),
g AS (SELECT source, h, CAST(sum(size) AS DOUBLE) AS g, count(*) AS c FROM d GROUP BY source, h),
c AS (SELECT source, h, g, c, sum(g) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS at_ FROM d)
SELECT d.doc_id, d.size, b.source_size, b.target, d.size * (b.full_ + CASE WHEN c.g > 0 AND d.at_ <= least(c.c, floor((b.target - b.full_ * b.source_size - (c.upto - c.g)) / (c.g / c.c) + 0.5)) AND b.target > b.full_ * b.source_size THEN 1 ELSE 0 END) AS taken
FROM o AS d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""

QUERIES = {"op9_hash_threshold_mix": op9_hash_threshold_mix}
ORACLE = {"op9_hash_threshold_mix": ORACLE_SQL}
