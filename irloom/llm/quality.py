"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes (the last one shorter). Each passage is encoded from counts over its bytes and
words through a learned tanh layer; gated attention, w . (tanh(V h) * sigmoid(U h)), soft-maxed over the text's passages, weighs
them; a logistic unit scores the weighted sum. Only documents have labels: the passages' weights are learned from them.

The network is fitted by Adam on a sample of at most about ``MOST_ROWS`` labelled documents, as many of each label as there are,
up to half of it, chosen by a hash of the id; of a text with more than ``BAG`` passages that many, evenly spaced, take part in the
fit (all take part in scoring), and where ids repeat, the first 2 * ``MOST_ROWS`` rows by a hash. The score is shifted so that the best cut between the labels of the sample falls
on ``CUT``. Prediction reads nothing but the text.

Defined cases: a null or empty text is one passage without bytes; ids with several labels count with each; with no labels, or
one kind of label, every score is the share of label 1 (0 without labels); repeated rows count as often as they occur; an empty
table gives an empty result; columns called like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.llm.common import id_remainder, table, text_slices, utf8

PASSAGE, MOST_ROWS, BAG, CUT = 512, 6_000, 64, 0.7
ENCODED, GATES, STEPS, RATE, DECAY = 24, 12, 250, 0.02, 1e-4
_KINDS = ["lower", "upper", "digit", "blank", "line", "stop", "shout", "bar", "mark", "quote", "other", "high"]


def _kinds() -> np.ndarray:
    to = np.full(256, _KINDS.index("other"), np.int64)
    to[97:123], to[65:91], to[48:58] = 0, 1, 2
    for chars, kind in ((b" \t\x0b\x0c\r", "blank"), (b"\n", "line"), (b".,;:", "stop"), (b"!?", "shout"), (b"|", "bar"), (b"#$%&*@^~<>{}[]=+_\\/", "mark"), (b"'\"`()-", "quote")):
        to[list(chars)] = _KINDS.index(kind)
    to[128:] = _KINDS.index("high")
    return to


_KIND = _kinds()
FEATURES = len(_KINDS) + 8


def word_hashes(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each word (run without blanks, inside one text)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    head = ~blank
    head[1:] &= blank[:-1]
    edge = begins[(begins > 0) & (begins < len(raw))]
    head[edge] = ~blank[edge]
    start = np.nonzero(head)[0]
    if not len(start):
        return start, start.copy(), np.zeros(0, np.uint64)
    number = np.cumsum(head) - 1
    place = np.arange(len(raw)) - start[np.maximum(number, 0)]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        value = np.where(blank, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * power[np.clip(place, 0, 63)])
        value[: start[0]] = 0
        total = np.add.reduceat(value, start)
        total ^= total >> np.uint64(31)
    length = np.add.reduceat((~blank).astype(np.int64), start)
    return start, length, total


def passages(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has."""
    sizes = np.diff(begins)
    many = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(many) - many
    n = int(many.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    p = first[owner] + (np.arange(len(raw)) - begins[:-1][owner]) // PASSAGE
    kinds = np.bincount(p * len(_KINDS) + _KIND[raw], minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
    length = kinds.sum(axis=1)
    start, size, hashed = word_hashes(raw, begins)
    wp = p[start]
    words = np.bincount(wp, minlength=n).astype(float)

    def share(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at[flag], minlength=n) / np.maximum(words, 1)

    again = (hashed[1:] == hashed[:-1]) & (wp[1:] == wp[:-1])
    second = (hashed[2:] == hashed[:-2]) & (wp[2:] == wp[:-2])
    key = np.sort((wp.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(words, 1)
    out = np.empty((n, FEATURES), np.float32)
    out[:, : len(_KINDS)] = np.sqrt(kinds / np.maximum(length, 1)[:, None])
    out[:, len(_KINDS) :] = np.stack((
        share(again, wp[1:]), share(second, wp[2:]), distinct,
        np.bincount(wp, size, minlength=n) / np.maximum(words, 1) / 10,
        share(size >= 20, wp), share(size <= 2, wp), np.log1p(length) / 6, np.log1p(np.repeat(many, many)) / 6,
    ), axis=1)
    return out, many


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    shift: float


def _forward(p: dict[str, np.ndarray], x: np.ndarray, many: np.ndarray):
    begin = np.cumsum(many) - many
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
    raw = (t * g) @ p["a"]
    top = np.repeat(np.maximum.reduceat(raw, begin), many)
    e = np.exp(raw - top)
    attention = e / np.repeat(np.add.reduceat(e, begin), many)
    z = np.add.reduceat(attention[:, None] * h, begin, axis=0)
    return h, t, g, attention, z, z @ p["c"] + p["d"][0]


def _slopes(p: dict[str, np.ndarray], x: np.ndarray, many: np.ndarray, y: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the sum of each text's logistic loss, weighed by `each`."""
    h, t, g, attention, z, logit = _forward(p, x, many)
    d_logit = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * each
    d_z = np.repeat(d_logit[:, None] * p["c"], many, axis=0)
    d_att = (d_z * h).sum(axis=1)
    begin = np.cumsum(many) - many
    d_raw = attention * (d_att - np.repeat(np.add.reduceat(attention * d_att, begin), many))
    d_tg = d_raw[:, None] * p["a"]
    d_t, d_g = d_tg * g * (1 - t**2), d_tg * t * g * (1 - g)
    d_h = (attention[:, None] * d_z + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - h**2)
    return {"w": x.T @ d_h, "b": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_g, "a": (t * g).T @ d_raw, "c": z.T @ d_logit, "d": d_logit.sum(keepdims=True)}


def fit(x: np.ndarray, many: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / scale).clip(-6, 6)
    shapes = {"w": (x.shape[1], ENCODED), "b": (ENCODED,), "v": (ENCODED, GATES), "u": (ENCODED, GATES), "a": (GATES,), "c": (ENCODED,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) * (k not in "bd") for k, s in shapes.items()}
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, STEPS + 1):
        slope = _slopes(p, x, many, y, each)
        for k in p:
            grad = slope[k] + DECAY * p[k] * (k not in "bd")
            m[k], s[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * s[k] + 0.001 * grad**2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    logit = _forward(p, x, many)[-1]
    order = np.sort(logit)
    cuts = (order[1:] + order[:-1]) / 2
    gain = np.array([each[(logit >= c) == (y == 1)].sum() for c in cuts[:: max(1, len(cuts) // 500)]])
    good = cuts[:: max(1, len(cuts) // 500)][gain >= gain.max() - 1e-9]
    return Model(mean, scale, p, float(np.log(CUT / (1 - CUT)) - good[len(good) // 2]))


def scores(x: np.ndarray, many: np.ndarray, model: Model) -> np.ndarray:
    x = ((x - model.mean) / model.scale).clip(-6, 6)
    return 1 / (1 + np.exp(-np.clip(_forward(model.parts, x, many)[-1] + model.shift, -30, 30)))


def sample_labels(labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y of at most about `most` labelled rows, at most half of them of one label; and the rows of each label."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    found = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    odds = F.when(F.col("y") == 1, min(1.0, most / 2 / max(1, found.get(1, 0)))).otherwise(min(1.0, most / 2 / max(1, found.get(0, 0))))
    return rows.where(draw < odds), found


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | float:
    """A model, or the one score to give where the labels don't tell two kinds apart."""
    few, found = sample_labels(labels, label, MOST_ROWS)
    if len(found) < 2:
        return float(next(iter(found), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1 << 20):
            x, many = passages(*utf8(part))
            begin = np.cumsum(many) - many
            bags = [x[b + (np.arange(m) if m <= BAG else np.linspace(0, m - 1, BAG).astype(int))] for b, m in zip(begin, many)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("y"), pa.array([bag.tobytes() for bag in bags], pa.binary())], ["key", "y", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("key"))  # MOST_ROWS pairs
    got = rows.mapInArrow(run, "key long, y int, x binary").orderBy("key", "y").limit(2 * MOST_ROWS).toArrow()
    y = np.array(got.column("y").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.0
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got.column("x").to_pylist()]
    order = sorted(range(len(bags)), key=lambda i: (y[i], bags[i].tobytes()))
    return fit(np.concatenate([bags[i] for i in order]).astype(np.float64), np.array([len(bags[i]) for i in order]), y[order])


def predict(docs: DataFrame, model: Model | float, keep: list[str]) -> DataFrame:
    """`keep` columns of docs, with score and predicted."""
    keep = [c for c in keep if c not in ("score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kinds = [f for f in source.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2 << 20):
            known = held.value
            score = scores(*passages(*utf8(part)), known) if isinstance(known, Model) else np.full(part.num_rows, known)
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kinds], pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], [*[f.name for f in kinds], "score", "predicted"])

    return source.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "score double, predicted int"]))


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(id_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))


def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; see the module."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(4, 2)
    model = train(docs, table(spark, sf_dir, "labels").where(~out))
    return predict(docs.withColumn("held_out", out), model, ["doc_id", "held_out"])


QUERIES = {"op10_attention_quality": op10_attention_quality}
ORACLE: dict[str, str] = {}
