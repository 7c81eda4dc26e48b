"""Sharding by a Feistel permutation over global row numbers.

Law ``rows``: with N rows and k shards, the row with global number n (its rank by id, then by text and size) gets the place
p = permute(n) in 0..N-1, the shard p mod k and the slot p div k. Shard counts are at most one apart and slots have no gaps,
by construction. ``place`` is a closed form, so the shard and slot of any row number can be computed without the table, and
``unplace`` finds the row number of a slot.

The permutation alternates modular Feistel rounds on Z_a x Z_b with a*b >= N, a = ceil(sqrt N); places from N up (fewer than a
of them) walk the cycle until they fall below N.

Row numbers need no global sort: percentiles of the id cut the rows into ranges of like size, a count per range gives each
range's first number and a window ranks inside a range. A repeated id that is itself a percentile, and the null id, get ranges of
their own by text checksum; rows equal in id, checksum and size that would fill a range are written and numbered part by part. So
no id and no repeated row meets in one task.

Defined cases: a null or empty text has checksum 0; ids are numbers, or text that reads as one (what doesn't, and null, comes
first); repeated rows get numbers of their own, those equal in id, checksum and size in any order; an empty table gives an empty
result; columns called like the added ones are replaced.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irloom.llm.common import materialise, table

SEED = 20_240_611
ROUNDS = 6
WALK = 32
PRIME = 2_147_483_647
#: Rows of one range, and ranges at most.
RANGE_ROWS, MOST_RANGES = 1024, 65_536
#: Parts that a lot of equal rows is numbered in.
PARTS = 1024


def sides(n: int) -> tuple[int, int]:
    """a, b with a*b >= n and a*b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    out, x = [], (seed % (PRIME - 1)) + 1
    for _ in range(ROUNDS):
        key = []
        for _ in range(3):
            x = x * 48_271 % PRIME  # the minimal standard generator
            key.append(x)
        out.append(tuple(key))
    return out


def _mix_int(v: int, key: tuple[int, int, int]) -> int:
    y = (v % PRIME * key[0] + key[1]) % PRIME
    y ^= y >> 15
    return y * key[2] % PRIME


def _step_int(x: int, a: int, b: int, seed: int) -> int:
    left, right = x // b, x % b
    for i, key in enumerate(round_keys(seed)):
        if i % 2:
            right = (right + _mix_int(left, key)) % b
        else:
            left = (left + _mix_int(right, key)) % a
    return left * b + right


def _back_int(x: int, a: int, b: int, seed: int) -> int:
    left, right = x // b, x % b
    for i, key in reversed(list(enumerate(round_keys(seed)))):
        if i % 2:
            right = (right - _mix_int(left, key)) % b
        else:
            left = (left - _mix_int(right, key)) % a
    return left * b + right


def place(number: int, n: int, seed: int = SEED) -> int:
    """The place of a row number, on the driver."""
    a, b = sides(n)
    x = _step_int(number, a, b, seed)
    while x >= n:
        x = _step_int(x, a, b, seed)
    return x


def unplace(at: int, n: int, seed: int = SEED) -> int:
    """The row number of a place: the inverse of ``place``."""
    a, b = sides(n)
    x = _back_int(at, a, b, seed)
    while x >= n:
        x = _back_int(x, a, b, seed)
    return x


def with_place(df: DataFrame, number: str, n: int, seed: int = SEED, out: str = "place") -> DataFrame:
    """Add the place of the row number in column `number`. Each round is a projection of its own, so expressions stay small."""
    a, b = sides(n)
    keep = [c for c in df.columns if c != out]
    outside = a * b - n
    walk = min(outside, WALK)

    def step(frame: DataFrame, x: str) -> DataFrame:
        """Feistel pass of column x into column __x; left and right halves are columns meanwhile."""
        frame = frame.withColumns({"__l": F.expr(f"{x} div {b}L"), "__r": F.expr(f"{x} % {b}L")})
        for i, (k0, k1, k2) in enumerate(round_keys(seed)):
            v, to, m = ("__l", "__r", b) if i % 2 else ("__r", "__l", a)
            frame = frame.withColumn("__y", F.expr(f"({v} % {PRIME}L * {k0}L + {k1}L) % {PRIME}L"))
            frame = frame.withColumn(to, F.expr(f"({to} + (__y ^ shiftright(__y, 15)) * {k2}L % {PRIME}L) % {m}L"))
        return frame.withColumn("__x", F.expr(f"__l * {b}L + __r")).drop("__l", "__r", "__y")

    done = step(df.select(*keep, F.col(number).cast("long").alias("__n")), "__n")
    if walk:
        body = _lambda_step("acc", a, b, seed)
        done = done.withColumn("__x", F.expr(f"CASE WHEN __x < {n}L THEN __x ELSE aggregate(sequence(1, {walk}), __x, (acc, i) -> CASE WHEN acc < {n}L THEN acc ELSE {body} END) END"))
        if walk < outside:  # walks of over 32 steps have odds under N ** -16
            done = done.withColumn("__x", F.when(F.col("__x") < n, F.col("__x")).otherwise(F.raise_error(F.lit("a cycle walk is too long: take another seed")).cast("long")))
    return done.withColumn(out, F.col("__x")).drop("__x", "__n")


def _lambda_step(x: str, a: int, b: int, seed: int) -> str:
    """The same pass as one expression: halves travel through aggregate() over the keys, so nothing is repeated."""
    keys = ", ".join(f"named_struct('i', {i}, 'a', {k[0]}L, 'b', {k[1]}L, 'c', {k[2]}L)" for i, k in enumerate(round_keys(seed)))
    y = f"((CASE WHEN k.i % 2 = 1 THEN h.l ELSE h.r END % {PRIME}L * k.a + k.b) % {PRIME}L)"
    mixed = f"(({y} ^ shiftright({y}, 15)) * k.c % {PRIME}L)"
    return (
        f"aggregate(array({keys}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), "
        f"(h, k) -> named_struct('l', CASE WHEN k.i % 2 = 0 THEN (h.l + {mixed}) % {a}L ELSE h.l END, 'r', CASE WHEN k.i % 2 = 1 THEN (h.r + {mixed}) % {b}L ELSE h.r END), "
        f"h -> h.l * {b}L + h.r)"
    )


def with_row_number(df: DataFrame, n: int, id_col: str, checksum: Column, size: Column, ties: list[Column] = (), out: str = "global_row") -> DataFrame:
    """Number all rows from 0 by id (nulls first), checksum (0 to 2**32 - 1), size, then `ties`."""
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  folded to one constant
    ident = F.expr(f"try_cast(`{id_col}` AS BIGINT)")
    cuts, nulls = [], 0
    if ranges > 1:
        found, known = df.select(F.percentile_approx(ident, literal([i / ranges for i in range(1, ranges)], "array<double>"), 10 * ranges), F.count(ident)).first()
        cuts, nulls = sorted(found or []), n - known
    times = Counter(cuts)  # an id that is a cut k times holds some k ranges' rows: it gets about as many by checksum
    heavy = sorted(x for x, k in times.items() if k > 1)
    cuts = sorted(times)
    by = df.withColumns({"__id": ident, "__t": checksum * (1 << 31) + F.least(size, F.lit((1 << 31) - 1)), **{f"__t{i}": t for i, t in enumerate(ties)}})
    ident = F.col("__id")
    # the number of cuts below the id, found in two levels of about sqrt(ranges) each; ids that are cuts stand alone
    if cuts:
        wide = math.isqrt(len(cuts) - 1) + 1
        rows = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
        tops, parts = literal([r[-1] for r in rows], "array<bigint>"), literal([*rows, []], "array<array<bigint>>")
        by = by.withColumn("__top", F.size(F.filter(tops, lambda x: x < ident)))
        by = by.withColumn("__part", F.element_at(parts, F.col("__top") + 1))
        by = by.withColumn("__low", F.col("__top") * wide + F.size(F.filter(F.col("__part"), lambda x: x < ident)))
        by = by.withColumn("__b", F.col("__low") * 2 + F.array_contains(F.col("__part"), ident).cast("int")).drop("__top", "__part", "__low")
    else:
        by = by.withColumn("__b", F.lit(0))
    by = by.withColumn("__b", F.when(ident.isNull(), F.lit(-1)).otherwise(F.col("__b")).cast("long"))
    alone = ident.isNull() | (ident.isin(heavy) if heavy else F.lit(False))
    # rows alike that fill a range: each such lot holds a share of 1 / ranges or more, so there are not more lots than ranges
    lots = by.where(alone).groupBy("__b", "__t").count().where(F.col("count") >= max(RANGE_ROWS, n / ranges)).select("__b", "__t").collect() if ranges > 1 else []
    bits = lambda share: max(1, math.ceil(share)).bit_length()
    held = F.element_at(literal([bits(times[x]) for x in heavy], "array<int>"), F.array_position(literal(heavy, "array<bigint>"), ident).cast("int")) if heavy else F.lit(1)
    by = by.withColumn("__bits", F.when(ident.isNull(), F.lit(bits(nulls * ranges / max(n, 1)))).otherwise(held))
    by = by.withColumn("__s", F.when(alone, F.expr("shiftright(__t, 63 - __bits)")).otherwise(F.lit(0)).cast("long")).drop("__bits")
    if lots:
        values = literal(sorted({r[1] for r in lots}), "array<bigint>")
        pairs = literal([{"b": r[0], "t": r[1]} for r in lots], "array<struct<b:bigint,t:bigint>>")
        place = F.size(F.filter(values, lambda x: x < F.col("__t"))) * 2 + F.array_contains(values, F.col("__t")).cast("int")
        by = by.withColumn("__w", F.when(alone, place).otherwise(F.lit(0)))
        lot = alone & F.array_contains(pairs, F.struct(F.col("__b").alias("b"), F.col("__t").alias("t")))
        alike = materialise(by.where(lot).withColumns({"__p": F.spark_partition_id() % PARTS, "__row": F.monotonically_increasing_id()}), "shard-lots")
        by = by.where(~lot).withColumns({"__p": F.lit(0), "__row": F.lit(0).cast("long")}).unionByName(alike)
    else:
        by = by.withColumns({"__w": F.lit(0), "__p": F.lit(0), "__row": F.lit(0).cast("long")})
    keys = ["__b", "__s", "__w", "__p"]
    counts = by.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    first = counts.select(*keys, (F.sum("__c").over(Window.orderBy(*keys)) - F.col("__c")).alias("__first"))
    # a row for each range and cut, two or so for each range that repeated ids fill, PARTS for each lot
    order = [F.col("__id").asc_nulls_first(), F.col("__t"), *[F.col(f"__t{i}") for i in range(len(ties))], F.col("__row")]
    numbered = by.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).join(F.broadcast(first), keys)
    return numbered.withColumn(out, F.col("__first") + F.col("__at")).drop(*keys, "__id", "__t", "__row", "__at", "__first", *[f"__t{i}" for i in range(len(ties))])


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """df with the columns global_row, shard and slot (law ``rows``)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    n = df.count()
    df = df.drop("global_row", "shard", "slot")
    checksum = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
    others = F.xxhash64(*[F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])  # maps have no hash
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    numbered = with_row_number(df, n, id_col, checksum, size, [others])
    placed = with_place(numbered, "global_row", n, seed, "__place")
    return placed.withColumns({"shard": (F.col("__place") % shards).cast("int"), "slot": F.expr(f"__place div {shards}L")}).drop("__place")


SHARDS = 8


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law ``rows``; see the module."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    n = docs.count()
    placed = with_place(with_row_number(sized, n, "doc_id", F.col("text_crc32"), F.col("size")), "global_row", n, SEED, "place")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % SHARDS).cast("int").alias("shard"),
        F.expr(f"place div {SHARDS}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "global_row",
    )


def _oracle() -> str:
    keys = round_keys(SEED)
    rounds = ["r0 AS (SELECT id, step, x, a, b, n, x // b AS l, x % b AS r FROM now)"]
    for i, (k0, k1, k2) in enumerate(keys):
        v = "l" if i % 2 else "r"
        y = f"(({v} % {PRIME} * {k0} + {k1}) % {PRIME})"
        mixed = f"(xor({y}, {y} >> 15) * {k2} % {PRIME})"
        new = f"l, (r + {mixed}) % b AS r" if i % 2 else f"(l + {mixed}) % a AS l, r"
        rounds.append(f"r{i + 1} AS (SELECT id, step, x, a, b, n, {new} FROM r{i})")
    one_pass = lambda src: f"(WITH now AS (SELECT * FROM {src}), {', '.join(rounds)} SELECT id, step + 1 AS step, l * b + r AS x, a, b, n FROM r{len(keys)})"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS hx FROM documents),
e AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
k AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hx, '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, v: xor(c >> 8, tbl[xor(c, v) % 256 + 1]))) AS BIGINT) AS text_crc32 FROM t, e),
m AS (SELECT count(*) AS n, CAST(greatest(1, ceil(sqrt(count(*)))) AS BIGINT) AS a FROM k),
q AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS id, doc_id, size, text_crc32 FROM k),
z AS (SELECT id, 0 AS step, id AS x, a, (n + a - 1) // a AS b, n FROM q, m),
w AS (SELECT * FROM {one_pass("z")} UNION ALL SELECT * FROM {one_pass("(SELECT * FROM w WHERE x >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INTEGER) AS shard, x // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, id AS global_row
FROM q JOIN w USING (id) WHERE x < n
"""


QUERIES = {"op3_feistel_shards": op3_feistel_shards}
ORACLE = {"op3_feistel_shards": _oracle()}
