"""Toxicity: Levenshtein automata on a lexicon trie, with context windows.

1. Lexicon. Words (with their weights, log-odds of standing in a toxic text) are learned from a sample of labelled documents of at
   most about ``MOST_ROWS`` ids: words of three bytes or more in at least ``LEAST`` toxic texts whose log-likelihood ratio passes ``SURE``, the best
   ``MOST_TERMS`` of them.
2. Matching. The product of the lexicon's trie and a Levenshtein automaton (no edit for words under five letters, one from five on)
   is walked once per distinct word of a batch; sets of (trie node, edits) are its states and transitions are kept as they are
   found. Texts are lowered (ASCII and Latin-1), digits and signs inside a word stand for the letters they imitate.
3. Context. A window of ``WINDOW`` bytes around each match is judged: inside quotation marks it weighs ``QUOTED``, next to a word of
   reporting ``REPORTED``, else 1. A misspelled term weighs less by ``EDITED``.
4. Score. A logistic unit, fitted on the same sample (where ids repeat, the first 2 * ``MOST_ROWS`` rows by a hash), over the sum and the largest of the weights and the number of terms, in all
   contexts and outside quotation.

Defined cases: a null or empty text has no match and gets the score of such texts; no labels, or one kind of label: every score
is the share of label 1 (0 without labels); repeated rows count as often as they occur; an empty table gives an empty result;
columns called like the added ones are replaced. Prediction reads nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.llm.common import table, text_slices, utf8
from irloom.llm.quality import held_out, sample_labels

MOST_ROWS, MOST_TERMS, LEAST, SURE = 12_000, 2_000, 4, 20.0
WINDOW, QUOTED, REPORTED, EDITED = 60, 0.3, 0.6, 0.3
CUT = 0.5
FEATURES = 6
#: Words that report speech, of the languages at hand.
REPORTING = [b"said", b"says", b"quote", b"quoted", b"called", b"wrote", b"word", b"term", b"sagte", b"nannte", b"dit", b"disait", b"dijo", b"llama"]
_OPEN, _CLOSE = [b'"', "“".encode(), "„".encode(), "«".encode(), "‘".encode(), b"`"], [b'"', "”".encode(), "“".encode(), "»".encode(), "’".encode(), b"`"]
_IMITATES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def fold(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Bytes lowered, imitations undone inside words, everything that ends a word made a blank."""
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    if len(low):
        after = np.zeros(len(low), bool)
        after[1:] = raw[:-1] == 0xC3
        low[after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 0x20
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    before, behind = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], behind[:-1] = letter[:-1], letter[1:]
    for sign, to in _IMITATES.items():
        here = low == ord(sign)
        low[here & (before | behind if sign.isdigit() else before & behind)] = ord(to)
    word = ((low >= 97) & (low <= 122)) | (low >= 128) | ((low >= 48) & (low <= 57))
    low[~word] = 32
    return low


def words(low: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of the folded bytes."""
    word = low != 32
    head = word.copy()
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    head[1:] &= ~word[:-1]
    edge = begins[(begins > 0) & (begins < len(low))]
    head[edge] = word[edge]
    start = np.nonzero(head)[0]
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    place = np.arange(len(low)) - start[np.maximum(np.cumsum(head) - 1, 0)]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        value = np.where(word, (low.astype(np.uint64) + np.uint64(1)) * power[np.clip(place, 0, 63)], np.uint64(0))
        hashed = np.add.reduceat(value, start)
    return start, start + np.add.reduceat(word.astype(np.int64), start), hashed ^ (hashed >> np.uint64(29))


@dataclass
class Automaton:
    """Trie of the terms, walked together with a Levenshtein automaton; states are kept as they are met."""

    terms: list[str]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [-1])
    reach: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for i, term in enumerate(self.terms):
            node = 0
            for ch in term:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][ch] = nxt
                    self.children.append({})
                    self.ends.append(-1)
                    self.reach.append(0)
                node = nxt
                self.reach[node] = max(self.reach[node], budget(term))
            self.ends[node] = i
            self.reach[0] = max(self.reach[0], budget(term))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._close({(0, 0)}))
        self.dead = self._state(frozenset())
        self.alphabet = {ch for c in self.children for ch in c}
        #: A word within one edit begins or ends like a term: two bytes suffice as a sieve.
        self.lengths = {len(t.encode()) for t in self.terms}

    def _state(self, s: frozenset) -> int:
        k = self.states.get(s)
        if k is None:
            k = self.states[s] = len(self.sets)
            self.sets.append(s)
            self.moves.append({})
        return k

    def _close(self, some: set) -> frozenset:
        """Add what deleting letters of a term reaches, and keep the fewest edits of each node."""
        best: dict[int, int] = {}
        todo = list(some)
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(c, e + 1) for c in self.children[node].values()]
        return frozenset(best.items())

    def _move(self, state: int, ch: str) -> int:
        to = set()
        for node, e in self.sets[state]:
            if ch in self.children[node]:
                to.add((self.children[node][ch], e))
            to.add((node, e + 1))  # a letter too many
            to.update((c, e + 1) for c in self.children[node].values())  # another letter
        return self._state(self._close(to))

    def match(self, word: str) -> tuple[int, int] | None:
        """Term index and edits of the nearest term in reach; of equal ones the heavier, which comes first."""
        state = self.start
        for ch in word:
            known = self.moves[state]
            key = ch if ch in self.alphabet else "\0"
            nxt = known.get(key)
            if nxt is None:
                nxt = known[key] = self._move(state, key)
            state = nxt
            if state == self.dead:
                return None
        found = [(e, self.ends[n]) for n, e in self.sets[state] if self.ends[n] >= 0 and e <= budget(self.terms[self.ends[n]])]
        return min(found)[::-1] if found else None


def budget(term: str) -> int:
    return 1 if len(term) >= 5 else 0


@dataclass
class Lexicon:
    terms: list[str]
    weights: list[float]

    def open(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.weights = np.array(lexicon.weights)
        self.automaton = Automaton(lexicon.terms)
        self.known: dict[int, tuple[int, int] | None] = {}
        raw = [t.encode() for t in lexicon.terms]
        self.longest = max(map(len, raw), default=0)
        self.shortest = min(map(len, raw), default=0)
        two = lambda b: b[0] << 8 | b[1]
        # one edit leaves the first or the last half of a term whole, so words are sieved by three bytes at either end
        self.heads, self.tails = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for r in raw:
            if len(r) >= 2:
                self.heads[two(r)] = self.tails[two(r[-2:])] = True

    def features(self, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        n = len(begins) - 1
        out = np.zeros((n, FEATURES))
        if not len(self.weights) or not len(raw):
            return out
        low = fold(raw, begins)
        start, end, hashed = words(low, begins)
        size = end - start
        padded = np.concatenate((low, np.zeros(2, np.uint8))).astype(np.int64)
        fits = (size >= max(1, self.shortest - 2)) & (size <= self.longest + 4)
        fits &= self.heads[padded[start] << 8 | padded[start + 1]] | self.tails[padded[end - 2] << 8 | padded[end - 1]] | (size < 4)
        start, end, hashed = start[fits], end[fits], hashed[fits]
        keys, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        term, edits = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        if len(self.known) > 2_000_000:
            self.known.clear()
        text = low.tobytes()
        for i, (key, s, e) in enumerate(zip(keys.tolist(), start[first].tolist(), end[first].tolist())):
            if key in self.known:
                m = self.known[key]
            else:
                m = self.known[key] = self.automaton.match(text[s:e].decode("utf-8", "replace"))
            if m:
                term[i], edits[i] = m
        term, edits = term[back], edits[back]
        hit = np.nonzero(term >= 0)[0]
        if not len(hit):
            return out
        doc = np.searchsorted(begins, start[hit], side="right") - 1
        weight = self.weights[term[hit]] * (1 - EDITED * edits[hit])
        whole = raw.tobytes()
        context = np.array([self._context(whole, text, int(begins[d]), int(begins[d + 1]), int(start[h]), int(end[h])) for d, h in zip(doc, hit)])
        # a term counts once a text, by its heaviest occurrence
        value = weight * context
        order = np.lexsort((-value, term[hit], doc))
        d, t, v, c = doc[order], term[hit][order], value[order], context[order]
        lead = np.ones(len(d), bool)
        lead[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        d, v, c = d[lead], v[lead], c[lead]
        out[:, 0] = np.log1p(np.bincount(d, v, minlength=n))
        np.maximum.at(out[:, 1], d, v)
        out[:, 2] = np.log1p(np.bincount(d, minlength=n))
        plain = c >= 1
        out[:, 3] = np.log1p(np.bincount(d[plain], v[plain], minlength=n))
        out[:, 4] = np.log1p(np.bincount(doc, value, minlength=n) * 1000 / np.maximum(np.diff(begins), 200))
        out[:, 5] = np.log1p(np.bincount(d[plain], minlength=n))
        return out

    @staticmethod
    def _context(raw: bytes, low: bytes, begin: int, stop: int, s: int, e: int) -> float:
        left, right = raw[max(begin, s - WINDOW) : s], raw[e : min(stop, e + WINDOW)]
        quoted = 1.0
        if any(left.count(o) % 2 == 1 if o == c else left.rfind(o) > left.rfind(c) for o, c in zip(_OPEN, _CLOSE) if c in right):
            quoted = QUOTED
        near = low[max(begin, s - WINDOW // 2) : s].split()
        return quoted * (REPORTED if any(w in REPORTING for w in near[-3:]) else 1.0)


@dataclass
class Model:
    lexicon: Lexicon
    weight: np.ndarray


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps; the last weight is the constant's."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_terms(rows: DataFrame) -> Lexicon:
    """Terms of the sampled rows (text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2 << 20):
            raw, begins = utf8(part)
            low = fold(raw, begins)
            start, end, hashed = words(low, begins)
            doc = np.searchsorted(begins, start, side="right") - 1
            ok = end - start >= 3
            start, end, hashed, doc = start[ok], end[ok], hashed[ok], doc[ok]
            order = np.lexsort((hashed, doc))
            lead = np.ones(len(order), bool)
            lead[1:] = (doc[order][1:] != doc[order][:-1]) | (hashed[order][1:] != hashed[order][:-1])
            one = order[lead]
            y = np.array(part.column("y").to_pylist(), np.int64)[doc[one]]
            keys, first, back = np.unique(hashed[one], return_index=True, return_inverse=True)
            text = low.tobytes()
            names = [text[s:e].decode("utf-8", "replace") for s, e in zip(start[one][first].tolist(), end[one][first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.bincount(back, y, minlength=len(keys)).astype(np.int64)), pa.array(np.bincount(back, 1 - y, minlength=len(keys)).astype(np.int64))], ["word", "t", "c"])

    totals = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    big_t, big_c = float(totals[0] or 0), float(totals[1] or 0)
    n = big_t + big_c
    counts = rows.select("text", "y").mapInArrow(run, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= LEAST)
    weight = F.log((F.col("t") + 0.5) / (big_t + 1)) - F.log((F.col("c") + 0.5) / (big_c + 1))
    both = F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") * n / (both * max(big_t, 1))) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") * n / (both * max(big_c, 1)))).otherwise(0.0))
    best = counts.select("word", weight.alias("w"), ratio.alias("g")).where((F.col("w") > 1.5) & (F.col("g") > SURE)).orderBy(F.desc("g"), "word").limit(MOST_TERMS).collect()
    return Lexicon([r[0] for r in best], [float(min(r[1], 6.0)) for r in best])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | float:
    few, found = sample_labels(labels, label, MOST_ROWS)
    if len(found) < 2:
        return float(next(iter(found), 0))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("key"))  # MOST_ROWS pairs
    lexicon = learn_terms(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.open()
        for part in text_slices(batches, 2 << 20):
            x = matcher.features(*utf8(part))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("y"), *[pa.array(x[:, k]) for k in range(FEATURES)]], ["key", "y", *[f"f{k}" for k in range(FEATURES)]])

    got = rows.mapInArrow(run, "key long, y int, " + ", ".join(f"f{k} double" for k in range(FEATURES))).orderBy("key", "y").limit(2 * MOST_ROWS).toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.0
    x = np.stack([got.column(f"f{k}").to_numpy() for k in range(FEATURES)], axis=1)
    order = np.lexsort((*x.T, y))
    return Model(lexicon, logistic(x[order], y[order]))


def predict(docs: DataFrame, model: Model | float, keep: list[str]) -> DataFrame:
    """`keep` columns of docs, with score and predicted."""
    keep = [c for c in keep if c not in ("score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # MOST_TERMS words
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kinds = [f for f in source.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        matcher = known.lexicon.open() if isinstance(known, Model) else None
        for part in text_slices(batches, 2 << 20):
            if matcher:
                x = matcher.features(*utf8(part))
                score = 1 / (1 + np.exp(-np.clip(x @ known.weight[:-1] + known.weight[-1], -30, 30)))
            else:
                score = np.full(part.num_rows, known)
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kinds], pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], [*[f.name for f in kinds], "score", "predicted"])

    return source.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "score double, predicted int"]))


def op7_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; see the module."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(5, 0)
    model = train(docs, table(spark, sf_dir, "labels").where(~out))
    return predict(docs.withColumn("held_out", out), model, ["doc_id", "held_out"])


QUERIES = {"op7_levenshtein_toxicity": op7_levenshtein_toxicity}
ORACLE: dict[str, str] = {}
