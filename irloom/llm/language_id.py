"""Language ID with error-correcting output codes.

Each language has a codeword; a binary classifier per bit, on byte n-grams (1 to 3 bytes of the text with A-Z lowered, hashed),
predicts the bit. Decoding is loss-weighted: a language's loss is the sum over bits of w * log(1 + exp(-m)), with m the signed
margin for its bit and w the bit's reliability on the training rows; the language of least loss wins. The score is its share in
the softmax of the negative losses; a text is ambiguous where the two best languages' losses are closer than ``GAP``.

Codewords come from a rule, for any number of languages: one bit per language (one against the rest), then bits that split the
languages in halves by the bits of their index and of its Gray code, without repeated or constant columns.

The classifiers are fitted on a sample of at most ``MOST_ROWS`` labelled rows, chosen by a hash of id and text and spread evenly
over the languages (``LEAST_ROWS`` of each, if that is more); each row gives one vector of n-gram shares, computed where the row
is, over its whole text. The ``MOST_LABELS`` commonest languages are learned (of equally common ones the first by name): that
bounds the model, which grows with their number, and rarer labels teach nothing.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; labels null or without rows teach nothing; with
no labelled row all is ``und``; one label only is always predicted; repeated rows count as often as they occur; an empty table
gives an empty result. Prediction reads nothing but the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irloom.llm.common import id_remainder, table, text_slices, utf8

UND = "und"
FEATURES = 4096
MOST_ROWS, LEAST_ROWS, MOST_LABELS = 4_000, 8, 1_024
PIECE, ROWS = 1 << 20, 512
GAP = 0.5
STEPS, RATE, DECAY = 300, 0.5, 1e-5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes that say nothing of a language: ASCII other than letters become one blank.
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


@dataclass(frozen=True)
class Model:
    labels: list[str]
    code: np.ndarray  # labels x bits, of -1 and 1
    weight: np.ndarray  # features + 1 x bits
    trust: np.ndarray  # bits


def codebook(labels: int) -> np.ndarray:
    rows = np.arange(labels)
    columns = [np.where(rows == k, 1, -1) for k in range(labels)]
    for k in range(max(1, (labels - 1).bit_length())):
        for value in (rows, rows ^ (rows >> 1)):
            columns.append(np.where(value >> k & 1, 1, -1))
    kept: list[np.ndarray] = []
    for c in columns:
        if abs(c.sum()) < labels and not any((c == k).all() or (c == -k).all() for k in kept):
            kept.append(c)
    return np.stack(kept, axis=1) if kept else np.ones((labels, 1), int)


def vectors(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the hashed n-grams: one row a text. Bytes are taken PIECE at a time, whatever a text's length."""
    n = len(begins) - 1
    rows = np.zeros(n * FEATURES, np.int64)
    for at in range(0, len(raw), PIECE):
        low = _FOLD[raw[at : at + PIECE + 2]].astype(np.uint32)
        owner = np.searchsorted(begins, np.arange(at, at + len(low)), side="right") - 1
        two = low[:-1] << 8 | low[1:]
        three = two[:-1] << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        for gram, span in ((low | 1 << 24, 0), (two | 2 << 24, 1), (three | 3 << 24, 2)):
            gram = gram[:PIECE]  # those that begin in this piece
            own = owner[: len(gram)]
            slot = (gram * np.uint32(2654435761)) >> np.uint32(20)
            if span:
                inside = own == owner[span : span + len(gram)]
                slot, own = slot[inside], own[inside]
            rows += np.bincount(own * FEATURES + slot, minlength=n * FEATURES)
    counts = rows.reshape(n, FEATURES)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, labels: list[str]) -> Model:
    """Logistic regression for all bits at once, by gradient steps with momentum; rows of a label weigh 1 / its count."""
    code = codebook(len(labels))
    want = code[y].astype(np.float64)
    each = 1 / np.bincount(y, minlength=len(labels))[y]
    each /= each.sum()
    x1 = np.empty((len(x), x.shape[1] + 1), np.float32)  # the one large array of the fit
    np.multiply(x, 8, out=x1[:, :-1])
    x1[:, -1] = 1
    w, push = np.zeros((x1.shape[1], code.shape[1]), np.float32), np.float32(0)
    for _ in range(STEPS):
        margin = want * (x1 @ w)
        slope = (-(want / (1 + np.exp(np.clip(margin, -30, 30)))) * each[:, None]).astype(np.float32)
        push = np.float32(0.9) * push + x1.T @ slope + np.float32(DECAY) * w
        w -= np.float32(RATE) * push
    margin = want * (x1 @ w)
    wrong = np.clip(((margin <= 0) * each[:, None]).sum(axis=0), 1e-3, 0.499)
    return Model(labels, code, w.astype(np.float32), np.log((1 - wrong) / wrong) / np.log(999))


def decode(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best label's index, score, gap to the next best loss."""
    margin = (x * 8) @ model.weight[:-1] + model.weight[-1]
    loss = np.zeros((len(x), len(model.labels)))
    for k in range(len(model.labels)):
        loss[:, k] = (np.logaddexp(0, -margin * model.code[k]) * model.trust).sum(axis=1)
    order = np.sort(loss, axis=1)
    share = np.exp(-(loss - order[:, :1]))
    best = loss.argmin(axis=1)
    gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
    return best, 1 / share.sum(axis=1), gap


def train(rows: DataFrame) -> Model | None:
    """Fit on labelled rows (doc_id, text, lang)."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS).collect()}
    if not found:
        return None
    each = max(LEAST_ROWS, MOST_ROWS // len(found))
    # twice the odds wanted, then the first `each` of a label: no label is left without rows, whatever the hash
    odds = F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, 2 * each / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(F.col("lang").isin(list(found))).select("text", "lang", draw.alias("draw")).where(F.col("draw") < odds[F.col("lang")])
    sample = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))).where(F.col("at") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, PIECE, ROWS):
            x = vectors(*utf8(part)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], ["lang", "x"])

    got = sample.select("text", "lang").mapInArrow(run, "lang string, x binary").toArrow()
    labels = sorted(set(got.column("lang").to_pylist()))
    if not labels:
        return None
    at = {k: i for i, k in enumerate(labels)}
    y = np.array([at[k] for k in got.column("lang").to_pylist()])
    x = np.empty((len(y), FEATURES), np.float16)
    for row, packed in zip(x, got.column("x")):  # they travel packed, so that the driver holds them whole once
        row[:] = np.frombuffer(zlib.decompress(packed.as_buffer()), np.float16)
    del got
    return fit(x, y, labels)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """`keep` columns of docs (text must be one of docs'), with lang_pred, score and ambiguous."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "ambiguous")]
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4097 numbers a bit, two bits or so a label
    source = docs.select(*keep, *([] if "text" in keep else ["text"]), letter.alias("__letter"))
    kinds = [f for f in source.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for part in text_slices(batches, PIECE, ROWS):
            plain = part.column("__letter").to_numpy(zero_copy_only=False)
            if known is None:
                pred, score, vague = [UND] * part.num_rows, np.zeros(part.num_rows), np.ones(part.num_rows, bool)
            else:
                best, score, gap = decode(vectors(*utf8(part)), known)
                pred = [known.labels[b] if ok else UND for b, ok in zip(best, plain)]
                score, vague = np.where(plain, score, 0.0), (gap < GAP) | ~plain
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kinds], pa.array(pred), pa.array(score, pa.float64()), pa.array(vague)], [*[f.name for f in kinds], "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, f"{schema + ', ' if schema else ''}lang_pred string, score double, ambiguous boolean")


def op4_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; see the module."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])


QUERIES = {"op4_output_codes": op4_output_codes}
ORACLE: dict[str, str] = {}
