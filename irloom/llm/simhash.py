"""Near-duplicates by SimHash, searched with vantage-point trees.

1. Fingerprints. Words are cut from the text with A-Z lowered, shingled and hashed with XXH64 (seed 42); a bit is 1 if it is set
   in over half of the shingle hashes (a rule with a similarity counts each shingle once). A text without words has fingerprint
   zero. More than 64 bits come from remixed hashes.
2. Shards. A vantage-point tree over a bounded sample of fingerprints gives the shards: each node splits by the Hamming distance
   to its vantage point, at about the median. Every fingerprint belongs to one leaf; as a visitor it also enters each leaf that
   the triangle bound cannot rule out. Bounds work on blocks of bits: two fingerprints within t bits of each other differ by at
   most t // m bits in one of m blocks, so each block has a tree of its own with that smaller radius, which prunes far more than
   a radius of t on all bits would. With m <= t + 1 blocks and that radius no pair is lost. A leaf whose share of the sample
   makes it larger than a shard is cut into parts, and each two of them meet in a shard of their own: no leaf fills one task.
3. Inside a shard the tree goes on in memory; leaves compare all bits exactly, but what lies within a third of the bits of one
   point needs no comparison among itself. A shard returns a minimum spanning forest of its pairs, never the pairs, so a large
   group of copies costs as many rows as it has fingerprints.
4. A rule with a similarity then joins the shingle sets of both ends to each edge and keeps the edges whose sets have that
   Jaccard similarity. A path in a minimum spanning forest has no edge longer than the pair that it joins, so a similar pair
   stays together unless a still closer pair on its path fails.
   Fingerprints find most similar pairs, but not all. An exact way finds the rest: of two similar sets, each has one of the other's
   shingles among its first ones, in any order that is the same for all (the commonest last, so that few sets share a first one).
   Sets that share one and are not together yet are compared, if their sizes and the shingle's places allow the similarity. Sets
   travel only for pairs that the parities of their shingles, about a bit for each, do not rule out.
5. Forests meet by star contraction (large star, small star) on DataFrames, until nothing changes.

Only distinct fingerprints (distinct shingle sets, where a similarity counts) are searched: copies are folded before the first
shuffle. A node's name begins with its smallest id, so the root of a component carries the component's smallest id.

Defined cases: a null text is an empty one; all texts without words share fingerprint zero and are linked like any others; rows
with the same id and different texts keep their own fingerprints; a null id takes part and is never the smallest; an empty table
gives an empty result; extra columns stay (``doc_id`` and ``text`` are read by name).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.llm.common import materialise, table, text_slices

XXH_SEED = 42
#: Fingerprints that fit the tree (all are indexed), fingerprints of a shard's own aimed at, and depth of the shared tree.
SAMPLE, SHARD_ROWS, MOST_DEPTH = 65_536, 16_384, 16
LEAF = 256
#: Texts that fit the order of shingles, common shingles that it puts last, and first shingles of one part.
ORDER_TEXTS, ORDER_MOST, PART = 4_096, 1 << 17, 1 << 20
#: Edges that one task contracts by itself.
FEW = 200_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """What counts as linked: `bits` or fewer differing bits of 64 * `lanes`; `blocks` trees, each of radius `radius`.

    With `similarity`, pairs within `bits` are candidates, and their shingle sets decide."""

    shingle: int = 4
    lanes: int = 1
    bits: int = 4
    blocks: int = 3
    radius: int = 1
    similarity: float | None = None


EXACT = Rule()


def similar(rows: int | None = None, similarity: float = 0.8, shingle: int = 5) -> Rule:
    """The rule for pairs of shingle sets of that similarity. It is one rule for any number of rows: a pair's fate hangs on the two
    texts, not on how many others there are.

    Sets with Jaccard J have cosine 2J / (1 + J), so a bit differs with odds p = acos(2J / (1 + J)) / pi, 0.151 at 0.8. Candidates
    go two deviations beyond the mean, which keeps 0.977 of the pairs just at J and more of those above; of the pairs just at 0.8
    some block agrees up to its radius for 0.995. Of unrelated pairs, 16 * 17 / 2 ** 16 agree in some block by chance: that is the
    part of the comparisons that grows with the square of the rows."""
    lanes, blocks, radius = 4, 16, 1
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = 64 * lanes
    return Rule(shingle, lanes, int(width * p + 2 * math.sqrt(width * p * (1 - p))), blocks, radius, similarity)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), XXH_SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], XXH_SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Splitmix64 of the hash, for lanes after the first."""
    with np.errstate(over="ignore"):
        z = h + _GOLDEN * np.uint64(lane)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The majority word of each run of hashes; counts are the runs' lengths, all over 0.

    Eight masks spread the bits over byte counters, which are summed over up to 255 hashes at a time."""
    starts = np.cumsum(counts) - counts
    pieces = -(-counts // 255)
    first = np.cumsum(pieces) - pieces
    cut = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    out = np.zeros(len(counts), np.uint64)
    for shift in range(8):
        lanes = (hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101)
        some = np.add.reduceat(lanes, cut).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(some, first, axis=0) * 2 > counts[:, None]
        for byte in range(8):
            out |= ones[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(t, width), np.uint64)) for t in texts]


def fingerprint_array(texts: list[bytes], rule: Rule) -> np.ndarray:
    """Fingerprints of the texts: one row each, `lanes` words wide."""
    return _majorities(shingle_sets(texts, rule.shingle) if rule.similarity else [shingle_hashes(t, rule.shingle) for t in texts], rule)


def _majorities(hashes: list, rule: Rule) -> np.ndarray:
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros((len(hashes), rule.lanes), np.uint64)
    some = counts > 0
    if some.any():
        flat = np.concatenate([np.asarray(row, np.uint64) for row in hashes])
        for lane in range(rule.lanes):
            out[some, lane] = majority(_remix(flat, lane) if lane else flat, counts[some])
    return out


def _as_binary(words: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(words.astype(">u8"))
    width = data.shape[1] * 8
    offsets = np.arange(0, (len(data) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _from_binary(values: pa.Array | pa.ChunkedArray, lanes: int) -> np.ndarray:
    raw = b"".join(values.to_pylist())
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, lanes)


def _common(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met more than once in a sample of the texts (text, __mark), ascending, and in how many texts of it."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("__mark"), F.lit(1 << 20)) < int(ORDER_TEXTS / max(1, n) * (1 << 20)) + 1).select("text", "__mark").dropDuplicates(["__mark"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], rule.shingle)
            found, times = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["shingle", "times"])

    met = some.mapInArrow(count, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times")).where("times > 1")
    found = met.orderBy(F.desc("times"), "shingle").limit(ORDER_MOST).toArrow()
    shingle, times = found.column("shingle").to_numpy().view(np.uint64), found.column("times").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], times[order]


def _first(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set, ascending by how common they are, then by value: so many that a similar set shares one of them."""
    most = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1 if len(shingles) else 0
    known, times = common
    if not len(known):
        return shingles[:most]
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    often = known[at] == shingles
    rare = shingles[~often][:most]
    return rare if len(rare) == most else np.concatenate((rare, shingles[often][np.argsort(times[at[often]], kind="stable")]))[:most]


def _packed(shingles: np.ndarray) -> bytes:
    """40 bits of each: four bytes of all, then one of all. Chance meetings only cost a comparison."""
    return (shingles & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (shingles >> np.uint64(32)).astype(np.uint8).tobytes()


def _odd(shingles: np.ndarray) -> bytes:
    """Bits that are 1 where an odd number of shingles falls; their number is a power of two, no less than the shingles."""
    n = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    return np.packbits(np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1 == 1, bitorder="little").tobytes()


def _least_apart(x: bytes, y: bytes) -> int:
    """So many shingles at least are in only one of the two sets; the longer bits are folded."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    n = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n)) ^ np.bitwise_xor.reduce(y.reshape(-1, n))).sum())


def fingerprints(docs: DataFrame, rule: Rule = EXACT, extra: list[str] | None = None) -> DataFrame:
    """doc_id, fp (big-endian bytes) and digest of every row; `extra` columns (long) come along.

    Rows of one digest are copies: it is the fingerprint itself or, with a similarity, a hash of the shingle set. A similarity also
    gives the set's size, its first shingles and parities (docs then has __mark, a hash of the text)."""
    extra = extra or []
    known = docs.sparkSession.sparkContext.broadcast(_common(docs, rule)) if rule.similarity else None  # 16 bytes for each of ORDER_MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            if rule.similarity:
                sets = shingle_sets(texts, rule.shingle)
                fp = _as_binary(_majorities(sets, rule))
                digest = pa.array([xxhash.xxh64_digest(x.tobytes(), XXH_SEED) for x in sets], pa.binary())
                more = [pa.array([len(x) for x in sets], pa.int32()), pa.array([_packed(_first(x, known.value, rule.similarity)) for x in sets], pa.binary()), pa.array([_odd(x) for x in sets], pa.binary())]
            else:
                fp = digest = _as_binary(fingerprint_array(texts, rule))
                more = []
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column(c) for c in extra], fp, digest, *more], ["doc_id", *extra, "fp", "digest", *["size", "first", "odd"][: len(more)]])

    kinds = ["doc_id long", *[f"`{c}` long" for c in extra], "fp binary, digest binary", *(["size int, first binary, odd binary"] if rule.similarity else [])]
    return docs.select(F.col("doc_id").cast("long"), *extra, "text").mapInArrow(run, ", ".join(kinds))


def _masks(rule: Rule) -> list[tuple[int, np.uint64]]:
    """Lane and mask of each block."""
    each = rule.blocks // rule.lanes
    cuts = [round(64 * i / each) for i in range(each + 1)]
    return [(lane, np.uint64(((1 << (b - a)) - 1) << a)) for lane in range(rule.lanes) for a, b in zip(cuts, cuts[1:])]


def _distance(points: np.ndarray, at: np.ndarray, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ at) & mask).astype(np.int16)


def build(sample: np.ndarray, mask: np.uint64, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage words and radii of a full tree, in heap order, of one lane's sample."""
    size = (1 << depth) - 1
    vantage, radius = np.zeros(size, np.uint64), np.zeros(size, np.int16)
    rows = [sample]
    for node in range(size):
        own = rows[node]
        if len(own):
            tries = own[np.linspace(0, len(own) - 1, min(5, len(own))).astype(int)]
            best = None
            for v in tries:
                d = _distance(own, v, mask)
                mu = int(np.median(d))
                for m in (mu - 1, mu):
                    lean = abs(int((d <= m).sum()) * 2 - len(own))
                    if best is None or lean < best[0]:
                        best = (lean, v, m, d)
            _, vantage[node], radius[node], d = best
            rows += [own[d <= radius[node]], own[d > radius[node]]]
        else:
            rows += [own, own]
        rows[node] = None
    return vantage, radius


def route(lane: np.ndarray, tree: tuple[np.ndarray, np.ndarray], mask: np.uint64, depth: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, leaf and own (else visitor) of every entry of `lane` into the leaves that it belongs to or has to visit.

    A pair split by a node meets in the inner side only: there the outer one visits; visitors then go wherever the bound allows."""
    vantage, radius = tree
    row, node, own = np.arange(len(lane)), np.zeros(len(lane), np.int64), np.ones(len(lane), bool)
    for _ in range(depth):
        d = _distance(lane[row], vantage[node], mask)
        mu = radius[node]
        inner, visits = d <= mu, ~own
        left = inner & own | visits & (d <= mu + r)
        right = ~inner & own | visits & (d > mu - r)
        crosses = ~inner & own & (d <= mu + r)
        row = np.concatenate((row[left], row[right], row[crosses]))
        node, own = np.concatenate((2 * node[left] + 1, 2 * node[right] + 2, 2 * node[crosses] + 1)), np.concatenate((own[left], own[right], np.zeros(int(crosses.sum()), bool)))
    return row, node - ((1 << depth) - 1), own


class Forest:
    """Union of rows by smallest root; edges come in arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            self.up[x] = self.up[y]
            x = self.up[y]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._roots(a), self._roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (a, b), of length d, make a minimum spanning forest of n points: each tree takes its shortest way out."""
    order = np.lexsort((b, a, d))
    a, b, rank, forest = a[order], b[order], np.arange(len(order)), Forest(n)
    chosen = [np.zeros(0, np.int64)]
    while True:
        root = forest._roots(np.arange(n))
        x, y = root[a[rank]], root[b[rank]]
        apart = x != y
        rank, x, y = rank[apart], x[apart], y[apart]
        if not len(rank):
            return order[np.concatenate(chosen)]
        best = np.full(n, len(a))
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        forest.link(a[pick], b[pick])


class Pairs:
    """Pairs of n points as they are found, reduced to a minimum spanning forest time and again."""

    def __init__(self, n: int, close: int):
        self.n, self.close = n, close
        self.kept = np.zeros((3, 0), np.int64)
        self.new: list[np.ndarray] = []
        self.near = np.arange(n)  # root by pairs of length up to `close`: longer pairs inside it are no forest's

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        want = (a != b) & ((d <= self.close) | (self.near[a] != self.near[b]))
        if want.any():
            self.new.append(np.stack((a[want], b[want], d[want])).astype(np.int64))
            if sum(x.shape[1] for x in self.new) > 500_000:
                self.edges()

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            every = np.concatenate((self.kept, *self.new), axis=1)
            self.kept, self.new = every[:, spanning(*every, self.n)], []
            forest = Forest(self.n)
            short = self.kept[2] <= self.close
            forest.link(self.kept[0][short], self.kept[1][short])
            self.near = forest._roots(np.arange(self.n))
        return self.kept[0], self.kept[1]


def search(fps: np.ndarray, own: np.ndarray, lane: int, mask: np.uint64, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of the pairs among own rows, and of visitors with own rows, within rule.bits on all lanes."""
    pairs = Pairs(len(fps), rule.bits * 3 // 5)
    words = np.ascontiguousarray(fps[:, lane])
    every = np.uint64(0xFFFFFFFFFFFFFFFF)

    def across(points: np.ndarray, asks: np.ndarray) -> None:
        step = max(1, 400_000 // max(1, len(points)))
        for i in range(0, len(asks), step):
            q = asks[i : i + step]
            d = np.zeros((len(q), len(points)), np.int16)
            for w in range(fps.shape[1]):
                d += np.bitwise_count(fps[q, w][:, None] ^ fps[points, w][None, :])
            a, b = np.nonzero(d <= rule.bits)
            pairs.add(q[a], points[b], d[a, b])

    def compare(points: np.ndarray, visitors: np.ndarray) -> None:
        across(points, visitors)
        while len(points) > LEAF:  # points around one of them are within twice that radius of each other: a star joins them
            d = np.bitwise_count(fps[points] ^ fps[points[0]]).sum(axis=1)
            ball = d <= rule.bits // 3
            if ball.sum() * 20 < len(points):
                break
            pairs.add(np.full(int(ball.sum()), points[0]), points[ball], d[ball])
            across(points[ball], points[~ball])
            points = points[~ball]
        across(points, points)

    stack = [(np.nonzero(own)[0], np.nonzero(~own)[0])]
    while stack:
        points, visitors = stack.pop()
        if not len(points):
            continue
        if len(points) <= LEAF:
            compare(points, visitors)
            continue
        for m, r in ((mask, rule.radius),) + (((every, rule.bits),) if rule.lanes == 1 else ()):
            v = words[points[len(points) // 2]]
            d = _distance(words[points], v, m)
            mu = int(np.median(d))
            if (d <= mu).all():
                mu -= 1
            inner = d <= mu
            if min(inner.sum(), (~inner).sum()) * 20 >= len(points):
                dv = _distance(words[visitors], v, m)
                outer = points[~inner]
                stack.append((points[inner], np.concatenate((visitors[dv <= mu + r], outer[d[~inner] <= mu + r]))))
                stack.append((outer, visitors[dv > mu - r]))
                break
        else:
            compare(points, visitors)
    return pairs.edges()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contraction of all edges of a task."""
    table = pa.Table.from_batches([b.select(["a", "b"]) for b in batches], pa.schema({"a": pa.binary(), "b": pa.binary()}))
    ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks], pa.binary()).combine_chunks().dictionary_encode()
    order = pa.compute.sort_indices(ends.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = rank[ends.indices.to_numpy()]
    forest = Forest(len(rank))
    forest.link(at[: len(at) // 2], at[len(at) // 2 :])
    root = forest._roots(np.arange(len(rank)))
    far = np.nonzero(root != np.arange(len(rank)))[0]
    names = ends.dictionary.take(order)
    yield pa.RecordBatch.from_arrays([names.take(pa.array(far)), names.take(pa.array(root[far]))], ["a", "b"])


def _contract(edges: DataFrame) -> DataFrame:
    """a, b with b the smallest of a's component, for every a that isn't; edges have a > b.

    Few edges are one task's work, which spares the rounds; what comes out is the same."""
    if edges.count() <= FEW:
        return materialise(edges.select("a", "b").coalesce(1).mapInArrow(_stars, "a binary, b binary"), "sim-stars")
    seen = None
    while True:  # every round but the last lowers some label; their number grows with the logarithm of the size
        # large star: each node hands its larger neighbours to the smallest node it knows
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        least = materialise(least, "sim-least")  # by itself, so that the join may be split where a hub has many edges, or broadcast
        large = materialise(edges.join(least, F.col("b") == F.col("n")).select("a", F.col("m").alias("b")).where("a > b").distinct(), "sim-large")
        # small star: each node hands its smaller neighbours, and itself, to the smallest of them
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "sim-low")
        small = large.join(low.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
        edges = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(low.select("a", F.col("m").alias("b"))).distinct(), "sim-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            return edges
        seen = now


def forests(unique: DataFrame, rule: Rule = EXACT) -> DataFrame:
    """Edges a > b (nodes) of spanning forests of all pairs within rule.bits among the rows (node, fp) of unique."""
    n = unique.count()
    sample = unique.select("fp")
    if n > SAMPLE:
        sample = sample.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)) + 1).limit(2 * SAMPLE)
    fitted = np.frombuffer(b"".join(sorted(sample.toArrow().column("fp").to_pylist())), ">u8").astype(np.uint64).reshape(-1, rule.lanes)  # one job, however many partitions
    depth = 0
    while depth < MOST_DEPTH and (n >> depth) > SHARD_ROWS // 2:
        depth += 1
    masks = _masks(rule)
    trees = []
    for lane, mask in masks:
        tree = build(fitted[:, lane], mask, depth)
        _, leaf, own = route(fitted[:, lane], tree, mask, depth, rule.radius)
        held = np.bincount(leaf[own], minlength=1 << depth) * (n / max(1, len(fitted)))
        trees.append((tree, np.maximum(1, np.ceil(held / SHARD_ROWS)).astype(np.int64)))
    known = unique.sparkSession.sparkContext.broadcast(trees)  # 18 bytes a node

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = _from_binary(batch.column("fp"), rule.lanes)
            part_of = _remix(np.frombuffer(b"".join(x[-8:] for x in batch.column("node").to_pylist()), ">u8").astype(np.uint64), 1)
            for k, (lane, mask) in enumerate(masks):
                tree, parts = known.value[k]
                row, leaf, own = route(fps[:, lane], tree, mask, depth, rule.radius)
                many = parts[leaf]
                at = np.repeat(np.arange(len(row)), many)
                other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                row, leaf, own = row[at], leaf[at], own[at]
                mine = np.where(own, (part_of[row] % many[at].astype(np.uint64)).astype(np.int64), other)
                places = pa.array(row)
                shard = (leaf + (k << depth)) << 32 | np.minimum(mine, other) << 16 | np.maximum(mine, other)
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("node").take(places), batch.column("fp").take(places), pa.array(own)], ["shard", "node", "fp", "own"])

    def pair(group: pa.Table) -> pa.Table:
        node = group.column("node").combine_chunks()
        order = pa.compute.sort_indices(node)
        node, fps, own = node.take(order), _from_binary(group.column("fp"), rule.lanes)[order.to_numpy()], group.column("own").to_numpy()[order.to_numpy()]
        lane, mask = masks[group.column("shard")[0].as_py() >> 32 >> depth]
        a, b = search(fps, own, lane, mask, rule)
        return pa.Table.from_arrays([node.take(pa.array(np.maximum(a, b))), node.take(pa.array(np.minimum(a, b)))], ["a", "b"])

    dealt = unique.select("node", "fp").mapInArrow(deal, "shard long, node binary, fp binary, own boolean")
    return dealt.groupBy("shard").applyInArrow(pair, "a binary, b binary").distinct()


def verified(edges: DataFrame, unique: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The edges between texts whose shingle sets have at least the rule's similarity.

    docs has doc_id, text and __mark, unique the id and mark that stand for a node. A node's set travels as its 64-bit hashes."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    holders = unique.join(ends, "node").select("node", F.col("c.doc_id").alias("__id"), F.col("c.__mark").alias("__m"))
    texts = docs.join(holders, docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["__mark"] == F.col("__m"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], rule.shingle)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "shingles"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= rule.similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    held = materialise(texts.mapInArrow(sets, "node binary, shingles binary").dropDuplicates(["node"]), "sim-sets")
    side = lambda end, name: held.select(F.col("node").alias(end), F.col("shingles").alias(name))
    return edges.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(judge, "a binary, b binary")


def shared(own: DataFrame) -> DataFrame:
    """shingle, digest, size, place: every first shingle (of own) that different sets have, its sets and its place in them."""
    parts = (own.agg(F.sum(F.octet_length("first"))).first()[0] or 0) // 5 // PART + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, rows = np.unique(_from_binary(batch.column("digest"), 1)[:, 0], return_index=True)
            first, size = batch.column("first").take(pa.array(rows)).to_pylist(), batch.column("size").to_numpy()[rows]
            count = np.fromiter(map(len, first), np.int64, len(first)) // 5
            shingle = np.frombuffer(b"".join(x[: n * 4] for x, n in zip(first, count)), "<u4")
            high = np.frombuffer(b"".join(x[n * 4 :] for x, n in zip(first, count)), np.uint8)
            place = np.minimum(np.arange(len(shingle)) - np.repeat(np.cumsum(count) - count, count), 0xFFFF).astype(np.uint16)
            part = shingle.astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            of = np.repeat(np.arange(len(first)), count)
            for k in np.nonzero(np.diff(cuts))[0]:
                at = order[cuts[k] : cuts[k + 1]]
                sets, times = np.unique(of[at], return_counts=True)
                columns = [shingle[at], high[at], place[at], names[sets], size[sets].astype(np.int32), times.astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([pa.array([int(k)]), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], ["part", "shingles", "highs", "places", "names", "sizes", "times"])

    def meet(group: pa.Table) -> pa.Table:
        whole = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), kind)
        shingle, times = whole("shingles", "<u4").astype(np.int64) | whole("highs", np.uint8).astype(np.int64) << 32, whole("times", np.uint32)
        order = np.argsort(shingle, kind="stable")
        same = shingle[order][1:] == shingle[order][:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        of = np.repeat(np.arange(len(times)), times)[order]
        shingle, place, name, size = shingle[order], whole("places", np.uint16)[order], whole("names", np.uint64)[of], whole("sizes", np.int32)[of]
        order = np.lexsort((name, shingle))
        shingle, place, name, size = (x[order] for x in (shingle, place, name, size))
        new = np.concatenate(([True], shingle[1:] != shingle[:-1]))[: len(shingle)]
        other = new | np.concatenate(([True], name[1:] != name[:-1]))[: len(shingle)]  # copies of a set count once
        group_of = np.cumsum(new) - 1
        keep = other & (np.bincount(group_of[other], minlength=int(new.sum()))[group_of] > 1 if len(new) else other)
        return pa.table({"shingle": shingle[keep], "digest": name[keep].view(np.int64), "size": size[keep], "place": place[keep].astype(np.int32)})

    binaries = "shingles binary, highs binary, places binary, names binary, sizes binary, times binary"
    return own.select("digest", "size", "first").mapInArrow(deal, f"part long, {binaries}").groupBy("part").applyInArrow(meet, "shingle long, digest long, size int, place int")


def rest(own: DataFrame, unique: DataFrame, stars: DataFrame, rule: Rule) -> DataFrame:
    """Pairs a > b (nodes) of different components that may be similar: all that are, and few others."""
    number = lambda c: F.conv(F.hex(F.substring(c, -8, 8)), 16, -10).cast("long")
    roots = unique.join(stars.select(F.col("a").alias("node"), "b"), "node", "left").select(number("node").alias("digest"), number(F.coalesce("b", "node")).alias("root"))
    met = materialise(shared(own).join(roots, "digest"), "sim-shared")
    apart = met.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    held = met.join(apart, "shingle").groupBy("shingle").agg(F.collect_list(F.struct("digest", "root", "size", "place")).alias("sets"))
    least, share = rule.similarity, rule.similarity / (1 + rule.similarity)

    def once(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["x", "y"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, many = [np.zeros((2, 0), np.int64)], 0
            for sets in batch.column("sets"):
                digest, root, size, place = (sets.values.field(c).to_numpy() for c in ("digest", "root", "size", "place"))
                order = np.argsort(size, kind="stable")
                digest, root, size, place = digest[order], root[order], size[order], place[order]
                roots, count = np.unique(root, return_counts=True)
                large = root == roots[count.argmax()]  # what is together already is never paired
                others = np.nonzero(~large)[0]
                # of two, the smaller has the shingle at one of its very first places, and the other is not much larger
                begins = np.nonzero(size - place >= 2 * share * size - 1e-6)[0]
                ends = np.searchsorted(size, size[begins] / least + 1e-6, side="right")
                for i, end in zip(begins.tolist(), ends.tolist()):
                    y = others[np.searchsorted(others, i + 1) : np.searchsorted(others, end)] if large[i] else np.arange(i + 1, end)
                    y = y[(root[y] != root[i]) & (np.minimum(size[i] - place[i], size[y] - place[y]) >= share * (size[i] + size[y]) - 1e-6)]
                    found.append(np.stack((np.full(len(y), digest[i]), digest[y])))
                    many += len(y)
                    if many > 1 << 20:
                        yield once(found)
                        found, many = found[:1], 0
            yield once(found)

    pairs = held.mapInArrow(pair, "x long, y long").distinct()
    node = unique.select(number("node").alias("digest"), "node")
    pairs = pairs.join(node.withColumnsRenamed({"digest": "x", "node": "xn"}), "x").join(node.withColumnsRenamed({"digest": "y", "node": "yn"}), "y")
    return pairs.select(F.greatest("xn", "yn").alias("a"), F.least("xn", "yn").alias("b"))


def possible(edges: DataFrame, own: DataFrame, rule: Rule) -> DataFrame:
    """The edges that the parities of both ends' shingles leave possible."""
    named = edges.select("a", "b", F.substring("a", -8, 8).alias("x"), F.substring("b", -8, 8).alias("y"))
    ends = named.select(F.col("x").alias("digest")).union(named.select("y")).distinct()
    odd = materialise(own.select("digest", "size", "odd").join(ends, "digest", "left_semi").dropDuplicates(["digest"]), "sim-odd")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("xs").to_numpy() + batch.column("ys").to_numpy()) * ((1 - rule.similarity) / (1 + rule.similarity)) + 1e-6
            apart = [_least_apart(x, y) for x, y in zip(batch.column("xo").to_pylist(), batch.column("yo").to_pylist())]
            yield batch.filter(pa.array(np.array(apart, float) <= most)).select(["a", "b"])

    side = lambda c: odd.select(F.col("digest").alias(c), F.col("size").alias(c + "s"), F.col("odd").alias(c + "o"))
    return named.join(side("x"), "x").join(side("y"), "y").select("a", "b", "xs", "ys", "xo", "yo").mapInArrow(judge, "a binary, b binary")


_LOWEST = -(1 << 63)


def _nodes(own: DataFrame) -> DataFrame:
    """node, fp, c of each distinct fp and digest; node is a byte for a null id, its smallest id in order of bytes, the digest.

    c is the row that stands for the node: none (no id), doc_id and the other columns of own that it has."""
    marks = [c for c in own.columns if c == "__mark"]
    unique = own.groupBy("fp", "digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *marks)).alias("c"))
    order = F.lpad(F.hex(F.coalesce("c.doc_id", F.lit(0)).bitwiseXOR(F.lit(_LOWEST))), 16, "0")
    return unique.select(F.concat(F.unhex(F.concat(F.when(F.col("c.none"), "FF").otherwise("00"), order)), F.col("digest")).alias("node"), "fp", "digest", "c")


def _least(node: Column) -> Column:
    """The smallest id that a node's name begins with."""
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_LOWEST)))


def components(docs: DataFrame, rule: Rule = EXACT) -> DataFrame:
    """doc_id, fp, component_id (the smallest id of the component) of every row of docs."""
    named = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "__mark": F.xxhash64("text")}).select("doc_id", "text", "__mark")
    own = materialise(fingerprints(named, rule, ["__mark"]) if rule.similarity else fingerprints(docs, rule), "sim-fingerprints")
    unique, stars = _linked(own, named, rule)
    roots = unique.join(stars.select(F.col("a").alias("node"), "b"), "node", "left").select("fp", "digest", _least(F.coalesce("b", "node")).alias("component_id"))
    return own.join(materialise(roots, "sim-components"), ["fp", "digest"]).select("doc_id", "fp", "component_id")


def _linked(own: DataFrame, docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The nodes, and for each that isn't the first of its component (a) the first (b)."""
    unique = materialise(_nodes(own), "sim-distinct")
    edges = materialise(forests(unique, rule), "sim-links")
    if rule.similarity:
        edges = materialise(possible(edges, own, rule), "sim-possible")
        stars = _contract(materialise(verified(edges, unique, docs, rule), "sim-verified"))
        more = materialise(rest(own, unique, stars, rule), "sim-rest")
        more = materialise(possible(more, own, rule), "sim-possible")
        if more.isEmpty():
            return unique, stars
        return unique, _contract(materialise(stars.select("a", "b").union(verified(more, unique, docs, rule)), "sim-verified"))
    return unique, _contract(edges)


def keep_one(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row of docs for each component: of the rows with its smallest id, one of the smallest text hash.

    Rows without id stay where their component has no row with one. Decisions are joined back by id and a hash of the text."""
    rule = rule or similar()
    there = docs.withColumn("__mark", F.xxhash64("text"))
    keyed = there.select(F.col("doc_id").cast("long"), "text", "__mark")
    own = materialise(fingerprints(keyed, rule, ["__mark"]), "sim-fingerprints")
    unique, stars = _linked(own, keyed, rule)
    chosen = materialise(unique.join(stars, unique["node"] == stars["a"], "left_anti").select("c.doc_id", "c.__mark"), "sim-chosen")
    again = materialise(own.join(chosen, own["doc_id"].eqNullSafe(chosen["doc_id"]) & (own["__mark"] == chosen["__mark"])).groupBy(own["doc_id"], own["__mark"]).count().where("count > 1").drop("count"), "sim-repeated")
    same = lambda other: there["doc_id"].cast("long").eqNullSafe(other["doc_id"]) & (there["__mark"] == other["__mark"])
    kept = there.join(chosen, same(chosen), "left_semi")
    if again.isEmpty():
        return kept.drop("__mark")
    once = kept.join(again, kept["doc_id"].cast("long").eqNullSafe(again["doc_id"]) & (kept["__mark"] == again["__mark"]), "left_semi").dropDuplicates(["doc_id", "__mark"])
    rest = kept.join(again, kept["doc_id"].cast("long").eqNullSafe(again["doc_id"]) & (kept["__mark"] == again["__mark"]), "left_anti")
    return rest.union(once).drop("__mark")


def op6_vantage_point_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see the module."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op6_vantage_point_simhash": op6_vantage_point_simhash}
ORACLE: dict[str, str] = {}
