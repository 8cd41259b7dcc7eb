"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.batches import drop_kept, with_computed

#: Words, or runs of other signs.
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MEMO = 1 << 17  # words whose hash a task remembers


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = value = zlib.crc32(word.encode("utf-8", "replace"))
        return value


def features(text: str, hashes: _Hashes, bits: int) -> np.ndarray:
    """Indexes below 2**bits of all words and word pairs of the whole text, repeats included.

    A pair whose second word also stands one, two or three words before counts as that repetition instead.
    """
    words = _TOKEN.findall(text)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
    for lag in range(1, min(4, len(one))):  # a word said again is one feature, whichever word it is
        again = one[lag:] == one[:-lag]
        two[lag - 1 :][again] = np.uint64(lag)
    mixed = np.concatenate([one * np.uint64(0xC2B2AE3D27D4EB4F), two * np.uint64(0x9E3779B97F4A7C15)])
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """Weights (the last one is the bias) after FTRL-proximal updates over ``rows`` in the given order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    seen = []
    for idx, label in rows:
        unique, counts = np.unique(idx, return_counts=True)
        seen.append((np.append(unique, size - 1), np.append(counts / max(1.0, len(idx)) ** 0.5, 1.0), label))
    for _ in range(epochs):
        for at, x, label in seen:
            zi, ni = z[at], n[at]
            w = _weights(zi, ni, alpha, beta, l1, l2)
            g = (_sigmoid(float(w @ x)) - label) * x
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(n[at]) - np.sqrt(ni)) / alpha * w
    return _weights(z, n, alpha, beta, l1, l2)


def _weights(z, n, alpha, beta, l1, l2):
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 6000,
    bits: int = 18,
    epochs: int = 3,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 1.0,
) -> np.ndarray:
    """Weights from at most ``max_rows`` rows of ``labels`` (the first by a hash of the id), fitted in one task.

    Texts come from ``docs``; features are computed where those are, and the fitting task sees indexes only. Labels with
    a null id or a label other than 0 and 1 take no part, nor do those without a text. An id that stands in several rows
    of ``docs`` is one example per label. Without examples all weights are zero, and every score is 0.5. The model has
    2**bits + 1 numbers whatever the size of the input.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)  # so the broadcast below is bounded
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        hashes = _Hashes()
        for b in batches:
            idx = [features(t.as_py(), hashes, bits).astype(np.int32).tobytes() for t in b.column("text")]
            columns = [b.column("id"), b.column("label"), pa.array(idx, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "idx"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), str(r["id"]), r["label"]))
        if rows:
            weights = train([(np.frombuffer(r["idx"], np.int32), r["label"]) for r in rows], bits, epochs, alpha, beta, l1, l2)
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    chosen = texts.join(F.broadcast(sample), "id").select("id", "label", "text")
    id_type = chosen.schema["id"].dataType.simpleString()
    indexed = chosen.mapInArrow(index, f"id {id_type}, label int, idx binary")
    examples = indexed.groupBy("id", "label").agg(F.min("idx").alias("idx"))
    model = examples.repartition(1).mapInArrow(fit, "weights binary").first()
    if model is None:
        return np.zeros((1 << bits) + 1)
    return np.frombuffer(model["weights"], np.float32).astype(np.float64)


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier): sparse dot products over whole texts, no shuffle.

    A null text scores as an empty one: the bias alone. A column named ``score`` is replaced.
    """
    bits = (len(weights) - 1).bit_length() - 1
    # 2**bits numbers, whatever the input
    model = docs.sparkSession.sparkContext.broadcast((weights[:-1].astype(np.float32), float(weights[-1])))

    def start():
        (table, bias), hashes = model.value, _Hashes()

        def score(text: str | None) -> float:
            idx = features(text or "", hashes, bits)
            return _sigmoid(bias + float(table[idx].sum(dtype=np.float64)) / max(1.0, len(idx)) ** 0.5)

        return lambda b: [pa.array([score(t.as_py()) for t in b.column(text_col)], pa.float64())]

    return with_computed(docs, "score double", start)
