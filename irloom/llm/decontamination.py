"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of L bytes is found in a text if some passage lies within e = floor(RATE * L) edits of it, both normalised
(A-Z and Latin-1 capitals lowered, runs of blanks, punctuation and symbols made one space). Three steps, each without loss:

1. Lemma on segments. An item is cut into segments of at most 64 bytes; one of them keeps at most its share k of the edits, so
   it shares at least S + 1 - q - k*q of its q-grams with the passage. A text window with fewer q-grams of any item is dropped.
2. Lemma in bands. In the windows left, each q-gram shared with an item falls on a diagonal (text place less item place). Counts
   run over overlapping bands of diagonals, each at least e + 1 wide beyond the overlap; a band with fewer than L + 1 - q - e*q
   hits is dropped.
3. Banded alignment of the item with the region, free at both ends of the region; what needs over e edits is dropped.

Texts are never shuffled: the items (blocks of bounded size, one pass each) travel to the texts, which stay where they are read.
A worker indexes a block once and keeps the index (about 25 times the block's bytes) until it meets another block.

Defined cases: null or empty texts have no hits; an item shorter than q + 1 normalised bytes, or one whose bound by the lemma is
under 1 (which takes a `rate` of 1 / q or more, or a few bytes), is looked for as an exact passage between word ends only; null
and empty items never match; repeated rows and items count each for themselves; an empty benchmark
or table gives an empty result; extra columns are ignored. Of overlapping hits of one item the best, then the first, is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.llm.common import table, text_slices

Q, RATE, SEGMENT = 8, 0.05, 64
#: Bytes of benchmark text broadcast at once; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20
_ODD, _BITS = np.uint64(0x9E3779B97F4A7C15), 22


def _fold() -> np.ndarray:
    to = np.full(256, 32, np.uint8)
    to[0] = 0
    to[128:] = np.arange(128, 256)
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        to[c] = c
    to[65:91] = np.arange(97, 123)
    return to


_FOLD = _fold()


def normalise(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes, and the place of each in raw. Byte 0 separates texts and stays."""
    out = _FOLD[raw]
    if len(out):
        after = np.zeros(len(out), bool)
        after[1:] = out[:-1] == 0xC3
        out[after & (out >= 0x80) & (out <= 0x9E) & (out != 0x97)] += 0x20
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 32) | ((out[:-1] != 32) & (out[:-1] != 0))
        keep[0] = out[0] != 32
        place = np.nonzero(keep)[0]
        return out[place], place
    return out, np.zeros(0, np.int64)


def _grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; the last 7 places run into zeros."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,)).copy()


class Benchmark:
    """Items with their q-grams, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float = RATE):
        self.ids, self.texts = [], []
        for item_id, text in items:
            data = normalise(np.frombuffer((text or "").replace("\0", " ").encode(), np.uint8))[0]
            data = data[:-1] if len(data) and data[-1] == 32 else data
            if len(data):
                self.ids.append(item_id)
                self.texts.append(data)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.lengths = lengths
        self.edits = np.floor(rate * lengths).astype(np.int64)
        self.needs = lengths + 1 - Q - self.edits * Q
        pieces = -(-lengths // SEGMENT)
        share = self.edits // np.maximum(pieces, 1)
        shortest = lengths // np.maximum(pieces, 1)
        least = shortest + 1 - Q - share * Q
        self.short = [i for i in range(len(lengths)) if lengths[i] <= Q or least[i] < 1 or self.needs[i] < 1]
        self.long = [i for i in range(len(lengths)) if i not in set(self.short)]
        #: Window width, q-grams needed: the widest and least of each class of widths.
        classes: dict[int, int] = {}
        for i in self.long:
            width = -(-int(shortest[i] + 1 + share[i]) // 8) * 8
            classes[width] = min(classes.get(width, 1 << 30), int(least[i]))
        self.windows = sorted(classes.items())
        grams = [_grams(self.texts[i])[: len(self.texts[i]) + 1 - Q] for i in self.long]
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(g), i) for g, i in zip(grams, self.long)]) if grams else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.item, self.at = item[order], at[order]
        self.code, self.first = np.unique(code[order], return_index=True)
        self.last = np.append(self.first[1:], len(code)) if len(code) else self.first
        self.seen = np.zeros(1 << _BITS, bool)
        with np.errstate(over="ignore"):
            self.seen[(self.code * _ODD) >> np.uint64(64 - _BITS)] = True

    def hits(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Item index, start, end, edits of the best matches in normalised texts divided by zeros."""
        out = []
        if self.long and len(data) >= Q:
            out = self._verify(data, *self._candidates(data))
        if self.short:
            raw = b" " + data.tobytes().replace(b"\0", b" \0 ") + b" "
            shift = None
            for i in self.short:
                want = b" " + self.texts[i].tobytes() + b" "
                k = raw.find(want)
                while k >= 0:
                    if shift is None:
                        zeros = np.nonzero(data == 0)[0]
                        shift = zeros + 1 + 2 * np.arange(len(zeros)) + 1  # where each zero stands in raw
                    start = k - 2 * int(np.searchsorted(shift, k))
                    out.append((i, start, start + len(want) - 2, 0))
                    k = raw.find(want, k + 1)
        return out

    def _candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item index and lowest diagonal of each band that meets the lemma."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = _grams(data)
        with np.errstate(over="ignore"):
            hit = self.seen[(code * _ODD) >> np.uint64(64 - _BITS)]
        run = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
        marks = np.zeros(len(data) + 1, np.int32)
        for width, least in self.windows:
            width = min(width, len(data))
            begin = np.nonzero(run[width:] - run[:-width] >= least)[0]
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + width, -1)
        where = np.nonzero(hit & (np.cumsum(marks[:-1]) > 0))[0]
        if not len(where):
            return none
        # a region's other segments may lie outside the windows: all hits within an item's length of a window count
        reach = max(len(self.texts[i]) + int(self.edits[i]) for i in self.long)
        wide = np.zeros(len(data) + 1, np.int32)
        heads = where[np.concatenate(([True], np.diff(where) > reach))]
        tails = where[np.concatenate((np.diff(where) > reach, [True]))]
        np.add.at(wide, np.maximum(heads - reach, 0), 1)
        np.add.at(wide, np.minimum(tails + reach + 1, len(data)), -1)
        where = np.nonzero(hit & (np.cumsum(wide[:-1]) > 0))[0]
        k = np.searchsorted(self.code, code[where])
        k = np.minimum(k, len(self.code) - 1)
        true = self.code[k] == code[where]
        where, k = where[true], k[true]
        bands: list[np.ndarray] = []
        step = max(1, (4 << 20) // max(1, int((self.last[k] - self.first[k]).mean() if len(k) else 1)))
        # counts of bands that later places may still add to are carried from step to step
        open_ = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in (0, 1)]
        for begin in range(0, len(where), step):
            end = min(len(where), begin + step)
            part = slice(begin, end)
            many = self.last[k[part]] - self.first[k[part]]
            flat = np.repeat(self.first[k[part]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            item, diagonal = self.item[flat], np.repeat(where[part], many) - self.at[flat]
            for half in (0, 1):
                broad = 2 * (self.edits[item] + 1)
                band = (diagonal + (1 << 20) * broad + half * (broad // 2)) // broad
                new, count = np.unique(item << np.int64(40) | band, return_counts=True)
                key, at = np.unique(np.concatenate((open_[half][0], new)), return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, at, np.concatenate((open_[half][1], count)))
                owner, b = key >> 40, key & ((1 << 40) - 1)
                wide_ = 2 * (self.edits[owner] + 1)
                low = (b - (1 << 20)) * wide_ - half * (wide_ // 2)
                good = total >= self.needs[owner]
                bands.append(np.stack((owner[good], low[good])))
                if end < len(where):
                    more = ~good & (low + wide_ + self.lengths[owner] > where[end])
                    open_[half] = key[more], total[more]
        both = np.unique(np.concatenate(bands, axis=1), axis=1) if bands else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def _verify(self, data: np.ndarray, item: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Exact passages first; the other regions are aligned side by side, at most 512 at a time."""
        out: list[tuple[int, int, int, int]] = []
        rest = []
        for i, d in zip(item.tolist(), low.tolist()):
            text, e = self.texts[i], int(self.edits[i])
            begin, end = max(0, d - e), min(len(data), d + 2 * (e + 1) + len(text) + e)
            k = data[begin:end].tobytes().find(text.tobytes())
            if k >= 0:
                out.append((i, begin + k, begin + k + len(text), 0))
            else:
                rest.append((i, d))
        for s in range(0, len(rest), 512):
            out += self._align(data, rest[s : s + 512])
        best: dict[int, list[tuple[int, int, int, int]]] = {}
        for h in sorted(set(out), key=lambda h: (h[3], h[1])):
            mine = best.setdefault(h[0], [])
            if all(h[2] <= m[1] or h[1] >= m[2] for m in mine):
                mine.append(h)
        return [h for mine in best.values() for h in mine]

    def _align(self, data: np.ndarray, rest: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Edit distance of item and region over the band's diagonals and e more on each side; one row of the matrix at a time.

        Cells hold edits << 32 | start, so the start of the cheapest path comes along."""
        if not rest:
            return []
        n = len(rest)
        lengths = np.array([len(self.texts[i]) for i, _ in rest])
        edits = np.array([self.edits[i] for i, _ in rest])
        left = np.array([d for _, d in rest]) - edits
        width = int((4 * edits + 3).max())
        items = np.zeros((n, int(lengths.max())), np.uint8)
        for r, (i, _) in enumerate(rest):
            items[r, : lengths[r]] = self.texts[i]
        column = np.arange(width)
        big = np.int64(1) << 50
        one = np.int64(1) << 32
        # cell c of row j stands before text place left + j + c, with j item bytes used
        start = left[:, None] + column
        row = np.where((start >= 0) & (start <= len(data)), start & (one - 1), big)
        found = np.full((n, 3), -1, np.int64)
        padded = np.concatenate((data, np.zeros(1, np.uint8)))
        for j in range(1, int(lengths.max()) + 1):
            place = left[:, None] + j + column  # text places used so far
            ok = (place >= 1) & (place <= len(data))
            byte = padded[np.clip(place - 1, 0, len(data))]
            same = ok & (byte == items[:, j - 1][:, None]) & (byte != 0)
            swap = np.where(ok & (byte != 0), row + np.where(same, 0, one), big)
            skip = np.concatenate((row[:, 1:], np.full((n, 1), big)), axis=1) + one  # an item byte without a text byte
            new = np.minimum(swap, skip)
            slope = column * one
            gap = np.minimum.accumulate(np.where(ok & (byte == 0), big, new) - slope, axis=1) + slope  # text bytes without item bytes
            row = np.minimum(new, gap)
            ends = np.nonzero(lengths == j)[0]
            if len(ends):
                c = row[ends].argmin(axis=1)
                v = row[ends, c]
                found[ends, 0], found[ends, 1], found[ends, 2] = v & (one - 1), left[ends] + j + c, v >> 32
        return [(i, int(a), int(b), int(e)) for (i, _), (a, b, e) in zip(rest, found) if e <= self.edits[i] and a < b and 0 not in data[a:b]]


_OPENED: dict[str, Benchmark] = {}


def _opened(held, rate: float) -> Benchmark:
    """The index of a broadcast block (its name and items), built once a worker."""
    name, items = held.value
    if name not in _OPENED:
        _OPENED.clear()
        _OPENED[name] = Benchmark(items, rate)
    return _OPENED[name]


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end (characters of the text), edits: every benchmark passage in docs."""
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark):
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, block))  # BLOCK_BYTES and one item at most

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = _opened(held, rate)
            for part in text_slices(batches, 2 << 20):
                yield _scan(part, known)

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start int, end int, edits int")
        out = found if out is None else out.union(found)
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about BLOCK_BYTES, one block at least; the driver holds one at a time."""
    block, filled, given = [], 0, 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        filled += len((row[1] or "").encode())
        if filled >= BLOCK_BYTES:
            yield block
            block, filled, given = [], 0, given + 1
    if block or not given:
        yield block


def _hits(part: pa.RecordBatch, known: Benchmark) -> tuple[list[int], list[tuple]]:
    """Rows of the batch with hits, and (row, item_id, start, end, edits) with places in characters."""
    texts = [(t or b"").replace(b"\0", b" ") for t in part.column("text").cast(pa.binary()).to_pylist()]
    data, place = normalise(np.frombuffer(b"\0".join(texts), np.uint8))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    rows = []
    for i, a, b, e in known.hits(data):
        if a < b:
            lo, hi = int(place[a]), int(place[b - 1]) + 1
            doc = int(np.searchsorted(begins, lo, side="right")) - 1
            text, base = texts[doc], int(begins[doc])
            head = len(text[: lo - base].decode("utf-8", "ignore"))
            rows.append((doc, known.ids[i], head, head + len(text[lo - base : hi - base].decode("utf-8", "ignore")), e))
    rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    return sorted({r[0] for r in rows}), rows


def _scan(part: pa.RecordBatch, known: Benchmark) -> pa.RecordBatch:
    ids, rows = part.column("doc_id").to_pylist(), _hits(part, known)[1]
    columns = list(zip(*[(ids[r[0]], *r[1:]) for r in rows])) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start", "end", "edits"])


def without_passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs in which no benchmark passage is found, judged where they stand: texts aren't shuffled."""
    out = docs
    for block in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))  # BLOCK_BYTES and one item at most
        names = docs.columns

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = _opened(held, rate)
            for part in text_slices(batches, 2 << 20):
                clean = np.ones(part.num_rows, bool)
                clean[_hits(part, known)[0]] = False
                yield part.filter(pa.array(clean)).select(names)

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the benchmark in the documents; see the module."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("similarity", F.lit(1.0) - F.col("edits") / F.greatest(F.col("end") - F.col("start"), F.lit(1)))


QUERIES = {"op8_qgram_lemma": op8_qgram_lemma}
ORACLE: dict[str, str] = {}
