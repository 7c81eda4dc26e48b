"""Maximum inner product search with score-aware (anisotropic) quantisation, four-bit table scans and exact reranking.

Directions (vectors at length 1) are cut into subspaces of two dimensions with 16 codewords each, so a code takes four bits. The
quantiser minimises |r|^2 + (eta - 1) * (r . x)^2 over residuals r of a direction x: error along it, which shifts the large inner
products, costs eta times as much as error across it. Codes are chosen by coordinate descent under that loss; codewords solve the
weighted least squares it gives, one subspace after another (2 x 2 systems). The codebook is fitted on at most about ``SAMPLE``
rows; every row is indexed.

A query becomes a table of 16 products for each subspace (two of them joined to one of 256, for one lookup a byte). The index is
dealt into chunks by a hash of the vector, the queries into blocks by a hash of their id; each chunk meets each block in a group
of bounded size, in one plan for any number of queries. There the tables are scanned, the ``RERANK`` (or k, if more) best vectors
get their inner products in double precision from the original vectors, and the best k of each query go on to be merged. Sizes of
chunks and blocks follow from the row counts alone. Equal vectors are one entry of the index with its smallest ids, so copies take
one place.

Defined cases: a vector that is null, empty, zero, or has null or non-finite components takes no part, nor does a row without id;
missing components of shorter vectors are zero; a score that isn't a number (sums of infinite products) comes last; rows that share
the query's id are the query's own; of query rows with one id the smallest vector asks; fewer candidates than k give them all; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irloom.llm.common import materialise, table

SAMPLE, ROUNDS, SWEEPS = 8_192, 3, 2
#: Cosine from which on scores matter; sets eta.
THRESHOLD = 0.2
RERANK = 200
#: Fewest and most rows of a chunk and queries of a block, and the share of all that they take in between.
CHUNK, BLOCK = (4_096, 65_536, 16), (1_024, 16_384, 2)


@dataclass(frozen=True)
class Codebook:
    words: np.ndarray  # subspaces x 16 x width
    eta: float


def _split(x: np.ndarray) -> np.ndarray:
    """Rows as subspaces of two dimensions, an even number of them; missing dimensions are zero."""
    n, d = x.shape
    wide = -(-d // 4) * 4
    padded = np.zeros((n, wide))
    padded[:, :d] = x
    return padded.reshape(n, wide // 2, 2)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1, and their lengths (no longer than a double can say)."""
    top = np.abs(x).max(axis=1, keepdims=True)
    part = x / top
    size = np.linalg.norm(part, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return part / size, np.minimum(top * size, np.finfo(float).max)[:, 0]


def encode(x: np.ndarray, book: Codebook, codes: np.ndarray | None = None) -> np.ndarray:
    """The codes of the directions in x: each subspace in turn takes the codeword of least loss, others held."""
    parts = _split(x)
    n, m, _ = parts.shape
    if codes is None:
        codes = np.stack([_nearest(parts[:, j], book.words[j]) for j in range(m)], axis=1)
    rows = np.arange(m)
    along = ((book.words[rows, codes] - parts) * parts).sum(axis=(1, 2))
    each = np.arange(n)
    for _ in range(SWEEPS):
        for j in range(m):
            p, w = parts[:, j], book.words[j]
            dot = p @ w.T
            par = dot - (p**2).sum(axis=1)[:, None]  # the residual of each codeword along the direction
            others = along - par[each, codes[:, j]]
            loss = (w**2).sum(axis=1) - 2 * dot + (book.eta - 1) * (others[:, None] + par) ** 2
            codes[:, j] = loss.argmin(axis=1)
            along = others + par[each, codes[:, j]]
    return codes


def _nearest(p: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * p @ words.T).argmin(axis=1)


def fit(x: np.ndarray, threshold: float = THRESHOLD) -> Codebook:
    n, d = x.shape
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    parts = _split(x)
    m = parts.shape[1]
    words = parts[np.linspace(0, n - 1, 16).astype(int)].transpose(1, 0, 2).copy()
    for _ in range(8):  # plain k-means to start from
        for j in range(m):
            near = _nearest(parts[:, j], words[j])
            count = np.bincount(near, minlength=16)
            for k in range(2):
                total = np.bincount(near, parts[:, j, k], minlength=16)
                words[j, :, k] = np.where(count > 0, total / np.maximum(count, 1), words[j, :, k])
    book, codes, rows = Codebook(words, eta), None, np.arange(m)
    for _ in range(ROUNDS):
        codes = encode(x, book, codes)
        along = ((words[rows, codes] - parts) * parts).sum(axis=(1, 2))
        for j in range(m):
            p, c = parts[:, j], codes[:, j]
            others = along - ((words[j][c] - p) * p).sum(axis=1)
            want = p * (1 + (eta - 1) * ((p**2).sum(axis=1) - others))[:, None]
            total = lambda v, c=c: np.bincount(c, v, minlength=16)
            left = np.empty((16, 2, 2))
            for a in (0, 1):
                for b in (0, 1):
                    left[:, a, b] = total((a == b) + (eta - 1) * p[:, a] * p[:, b]) + (a == b) * 1e-9
            right = np.stack([total(want[:, 0]), total(want[:, 1])], axis=1)
            some = np.bincount(c, minlength=16) > 0
            words[j][some] = np.linalg.solve(left[some], right[some][:, :, None])[:, :, 0]
            along = others + ((words[j][c] - p) * p).sum(axis=1)
        book = Codebook(words, eta)
    return book


def pack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def tables(queries: np.ndarray, book: Codebook) -> np.ndarray:
    """queries x pairs of subspaces x 256 products."""
    each = np.einsum("qmk,mck->qmc", _split(queries), book.words)
    return (each[:, 0::2, :, None] + each[:, 1::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def _vectors(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """The vectors of a list column as rows of d components; what a vector lacks is zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    if len(flat) == len(column) * d:
        return flat.reshape(-1, d)
    sizes = pa.compute.list_value_length(column).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), d))
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id long, v array<double> of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: each vector once, with its smallest ids in order, as often as they occur; enough for k that aren't a query's own."""
    each = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    first = each.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    ids = F.sort_array(F.collect_list(F.struct("vec_id", "n")))
    return first.groupBy("v").agg(F.slice(F.flatten(F.transform(ids, lambda r: F.array_repeat(r["vec_id"], r["n"]))), 1, 2 * k).alias("ids"))


def _parts(rows: int, bounds: tuple[int, int, int]) -> int:
    """How many parts of a size within the bounds."""
    least, most, share = bounds
    return max(1, -(-rows // min(most, max(least, -(-rows // share)))))


def search(df: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (a column of vec_id), its k nearest other rows."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    asks = rows.where(is_query(F.col("vec_id")))
    n, d, queries = rows.select(F.count(F.lit(1)), F.max(F.size("v")), F.count(F.when(is_query(F.col("vec_id")), 1))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    odds = min(1.0, SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(odds * (1 << 30)) + 1).select("v").limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:
        sample = rows.select("v").limit(SAMPLE).toArrow()
    x = directions(_vectors(sample.column("v"), d))[0]
    book = spark.sparkContext.broadcast(fit(x[np.lexsort(x.T[::-1])]))  # 16 words of each subspace
    chunks, blocks, rerank = _parts(n, CHUNK), _parts(queries, BLOCK), max(rerank, k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit, size = directions(_vectors(b.column("v"), d))
                yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("ids"), b.column("v"), pa.array(size), pa.array([c.tobytes() for c in pack(encode(unit, book.value))], pa.binary())], ["chunk", "ids", "v", "size", "code"])

    def scan(found: pa.Table, asked: pa.Table) -> pa.Table:
        ids = asked.column("vec_id").to_numpy()
        own = found.column("ids").combine_chunks()
        lengths = pa.compute.list_value_length(own).to_numpy().astype(np.int64)
        starts, own = np.cumsum(lengths) - lengths, own.flatten().to_numpy()
        exact, x, size = _vectors(asked.column("v"), d), _vectors(found.column("v"), d), found.column("size").to_numpy()
        codes = np.frombuffer(b"".join(found.column("code").to_pylist()), np.uint8).reshape(len(lengths), -1)
        columns = np.ascontiguousarray(codes.T).astype(np.intp)
        total, one = np.empty(len(lengths), np.float32), np.empty(len(lengths), np.float32)
        near, scores, many = [], [], []
        for s in range(0, len(ids), 256):
            for q, lut in enumerate(tables(directions(exact[s : s + 256])[0], book.value), s):
                np.take(lut[0], columns[0], out=total, mode="clip")
                for j in range(1, len(columns)):
                    np.take(lut[j], columns[j], out=one, mode="clip")
                    total += one
                rough = total * size
                some = np.argpartition(-rough, rerank)[: rerank + 1] if len(lengths) > rerank + 1 else np.arange(len(lengths))
                each = lengths[some]
                at = np.repeat(starts[some] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                with np.errstate(over="ignore", invalid="ignore"):
                    i, score = own[at], np.repeat(x[some] @ exact[q], each)
                others = i != ids[q]
                i, score = i[others], score[others]
                top = np.lexsort((i, -score))[:k]
                near.append(i[top])
                scores.append(score[top])
                many.append(len(top))
        none = [np.zeros(0)]
        return pa.table({"query_id": np.repeat(ids, many), "vec_id": np.concatenate(near or none).astype(np.int64), "score": np.concatenate(scores or none)})

    each = distinct(rows, k).withColumn("chunk", F.pmod(F.xxhash64("v"), F.lit(chunks)).cast("int")).select("chunk", "ids", "v")
    indexed = materialise(each.mapInArrow(index, "chunk int, ids array<long>, v array<double>, size double, code binary"), "ann-index")
    asks = materialise(asks.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "ann-queries")
    held = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = held.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector; see the module."""
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


QUERIES = {"op2_anisotropic_search": op2_anisotropic_search}
ORACLE: dict[str, str] = {}
