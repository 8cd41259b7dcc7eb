"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.batches import kept_by_worker, with_computed

_BATCH_CELLS = 1 << 22  # of the documents x trigrams table that a task holds at a time
_BATCH_CHARS = 1 << 21


def _letter_table() -> np.ndarray:
    """The lower-case letter of every code point, 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    """A random vector of -1 and 1, the same for a letter (0: the gap between words) in every task."""
    return np.random.default_rng([seed, code]).integers(0, 2, dims, np.int8) * np.int8(2) - np.int8(1)


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters with one 0 before, between and after words; empty without letters."""
    codes = kept_by_worker(("letters",), _letter_table)[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    return codes if len(codes) > 2 else codes[:0]


def bundle(texts: list[str], dims: int, seed: int) -> np.ndarray:
    """For each text the sum of its trigram vectors; a trigram's vector binds its letters' vectors, permuted by place.

    Counts of equal trigrams are taken first, so the work is one product of counts and trigram vectors.
    """
    spelled = [letters_of(t) for t in texts]
    alphabet = np.unique(np.concatenate([*spelled, np.zeros(1, np.uint32)]))
    n = len(alphabet)
    vectors = np.stack([letter_vector(int(c), dims, seed) for c in alphabet])
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    grams, counts = [], []
    for codes in spelled:
        at = np.searchsorted(alphabet, codes).astype(np.int64)
        gram, count = np.unique((at[:-2] * n + at[1:-1]) * n + at[2:], return_counts=True) if n**3 > _BATCH_CELLS else _count(at, n)
        grams.append(gram)
        counts.append(count)
    used, out = np.unique(np.concatenate(grams)), np.zeros((len(texts), dims), np.float32)
    for low in range(0, len(used), 1 << 14):  # blocks of trigrams keep the tables small
        block = used[low : low + (1 << 14)]
        bound = (first[block // (n * n)] * second[block // n % n] * vectors[block % n]).astype(np.float32)
        table = np.zeros((len(texts), len(block)), np.float32)
        for row, (gram, count) in enumerate(zip(grams, counts)):
            a, b = np.searchsorted(gram, (block[0], block[-1] + 1))
            table[row, np.searchsorted(block, gram[a:b])] = count[a:b]
        out += table @ bound
    return out


def _count(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    gram = (at[:-2] * n + at[1:-1]) * n + at[2:]
    if len(gram) * 16 < n**3:
        return np.unique(gram, return_counts=True)
    count = np.bincount(gram, minlength=n**3)
    used = np.flatnonzero(count)
    return used, count[used]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for t in texts:
        group.append(t)
        chars += len(t)
        if chars >= _BATCH_CHARS or len(group) >= 256:
            yield group
            group, chars = [], 0
    if group:
        yield group


def learn_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 10000,
    min_rows: int = 200,
    dims: int = 512,
    seed: int = 7,
) -> dict[str, np.ndarray]:
    """Language prototypes: the sum of the unit vectors of their documents.

    Learns from about ``max_rows`` rows, chosen by a hash of the id, and from about ``min_rows`` of each language that would
    get fewer (all it has, if these are fewer): rare languages are learned at any size of the table. Rows with a null id,
    text or language, or without a letter, take no part. Sums per task are added up on the cluster: the driver gets one
    vector a language.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = [(r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    total = max(1, sum(n for _, n in counts))
    shares = [(lang, min(1.0, max(max_rows / total, min_rows / n))) for lang, n in counts]
    limits = known.sparkSession.createDataFrame([(lang, int(s * (1 << 30))) for lang, s in shares], "lang string, below long")
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30))
    known = known.join(F.broadcast(limits), "lang").where(hashed < F.col("below"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            start = 0
            for group in _groups(texts):
                found = bundle(group, dims, seed)
                size = np.linalg.norm(found, axis=1, keepdims=True)
                unit = np.divide(found, size, out=np.zeros_like(found), where=size > 0)
                for lang, v in zip(langs[start:], unit):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
                start += len(group)
        rows = [(lang, i, float(x)) for lang, v in sums.items() for i, x in enumerate(v)]
        columns = list(zip(*rows)) or [[], [], []]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "i", "x"])

    summed = known.select("lang", "text").mapInArrow(add, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = {r["lang"]: np.array([e["x"] for e in r["v"]]) for r in vectors.collect()}
    return {lang: v for lang, v in sorted(found.items()) if v.any()}


def identify_languages(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dims: int = 512, seed: int = 7
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the nearest prototype (0 where it is negative).

    ``und`` and 0 if the text is null or has no letter, or if nothing was learned; of equal cosines the first language by
    name wins. Columns named ``lang_pred`` or ``score`` are replaced. No shuffle.
    """
    names = list(prototypes)
    unit = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, dims))

    def start():
        def compute(b: pa.RecordBatch) -> list:
            lang, score = [], []
            for group in _groups([t or "" for t in b.column(text_col).to_pylist()]):
                found = bundle(group, dims, seed).astype(np.float64)
                size = np.linalg.norm(found, axis=1)
                for v, length in zip(found, size):
                    if not length or not names:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    near = np.round(unit @ v / length, 12)
                    best = int(np.argmax(near))
                    lang.append(names[best])
                    score.append(float(min(1.0, max(0.0, near[best]))))
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return compute

    return with_computed(docs, "lang_pred string, score double", start, ("letters",))
