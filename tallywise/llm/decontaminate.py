"""Benchmark decontamination: latent semantic retrieval of passages, then common subsequence and answer checks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.batches import drop_kept, with_computed
from tallywise.operators.scratch import durable

_WORD = re.compile(r"\w+")
_ITEMS = 2048  # that are looked for in one pass over the documents
_PAIRS = 1 << 22  # of terms of a passage that a task lays out at a time
_HELD = 1 << 22  # sums over pairs of terms that a task holds
_MATCH = "struct<item_id: bigint, cosine: double, common: double, answer: double, first_word: int, last_word: int>"


@dataclass
class Items:
    """Benchmark items in terms of their own vocabulary; ``answer``: the rarer half of each item's terms."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    answer: list[frozenset[int]]
    latent: np.ndarray  # one unit vector an item
    terms: np.ndarray  # one row a term: its weight times its latent vector


def _indexes(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """The vocabulary's index of each word, its size for all other words."""
    words, get, other = _WORD.findall(text.lower()), vocabulary.get, len(vocabulary)
    return np.fromiter((get(w, other) for w in words), np.int64, len(words))


def _passages(idx: np.ndarray, n: int, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of consecutive passages, for terms of the vocabulary."""
    at = np.flatnonzero(idx < n)
    cells, counts = np.unique(at // passage * (n + 1) + idx[at], return_counts=True)
    return cells // (n + 1), cells % (n + 1), counts


def _joint_counts(texts: DataFrame, vocabulary: dict[str, int], passage: int) -> DataFrame:
    """How often terms stand together in the passages of all documents: a row ``term``, ``others``, ``counts`` a term.

    ``others`` are the terms up to ``term`` itself, ``counts`` sums over the passages, of the product of both terms' counts
    there. The row of the vocabulary's size holds in how many passages each term stands and, last, the number of passages.
    Counts are whole numbers and exact; a task holds a bounded number of them and writes what it has when there are more.
    """
    n, shared = len(vocabulary), texts.sparkSession.sparkContext.broadcast(vocabulary)
    block = max(1, _PAIRS // passage**2)  # passages whose pairs are laid out at a time

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        found, vocabulary, waiting, held, pairs = np.zeros(n + 1, np.int64), shared.value, [], 0, 0
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for text in b.column(0):
                idx = _indexes(text.as_py() or "", vocabulary)
                passages = -(-len(idx) // passage)
                for low in range(0, passages, block):
                    row, term, counts = _passages(idx[low * passage : (low + block) * passage], n, passage)
                    found += np.bincount(term, minlength=n + 1)
                    waiting.append((held + row, term, counts))
                    held += min(block, passages - low)
                    pairs += int((np.bincount(row, counts) ** 2).sum())  # or fewer
                    if pairs >= _PAIRS:
                        keys, sums = _merged(keys, sums, _pairs(waiting, n))
                        waiting, held, pairs = [], 0, 0
                        if len(keys) >= _HELD:
                            yield laid_out(keys, sums)
                            keys, sums = keys[:0], sums[:0]
                found[n] += passages
        if waiting:
            keys, sums = _merged(keys, sums, _pairs(waiting, n))
        used = np.flatnonzero(found)
        if len(used):
            yield laid_out(np.append(keys, n * (n + 1) + used), np.append(sums, found[used]))

    def laid_out(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        term, other = keys // (n + 1), (keys % (n + 1)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = [*cuts[1:].tolist(), len(keys)]
        columns = [pa.array([x[a:b].tobytes() for a, b in zip(cuts.tolist(), ends)], pa.binary()) for x in (other, sums)]
        return pa.RecordBatch.from_arrays([pa.array(term[cuts]), *columns], names=["term", "others", "counts"])

    def add(t: pa.Table) -> pa.Table:
        other, counts = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("others", np.int32), ("counts", np.int64)))
        total = np.zeros(n + 1, np.int64)
        np.add.at(total, other, counts)
        used = np.flatnonzero(total)
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (used.astype(np.int32), total[used])]
        return pa.table([t.column("term").slice(0, 1).combine_chunks(), *columns], names=["term", "others", "counts"])

    schema = "term long, others binary, counts binary"
    return durable(texts.mapInArrow(count, schema).groupBy("term").applyInArrow(add, schema), "joint-counts")


def _pairs(passages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """term * (n + 1) + other of all pairs of a passage's terms, other <= term, as often as their counts' product."""
    row, term, count = (np.concatenate(x) for x in zip(*passages))
    if not len(row):
        return row
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))  # terms ascend in a passage
    ends = np.cumsum(place + 1)
    one = np.repeat(np.arange(len(row)), place + 1)
    other = one + np.arange(len(one)) - ends[one] + 1
    return np.repeat(term[one] * (n + 1) + term[other], count[one] * count[other])


def _merged(keys: np.ndarray, sums: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, in the keys' order, with one added for each key in ``more``."""
    more = np.sort(more)
    starts = np.flatnonzero(np.diff(more, prepend=-1))
    every = np.concatenate([keys, more[starts]])
    order = np.argsort(every, kind="stable")
    every, counts = every[order], np.concatenate([sums, np.diff(np.append(starts, len(more)))])[order]
    starts = np.flatnonzero(np.diff(every, prepend=-1))
    return every[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _basis(joint: DataFrame, items: list[np.ndarray], weights: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix of all passages and the items, by randomised SVD.

    G is the product of the matrix' transpose and the matrix: the joint counts times both terms' weights. Every round
    multiplies a thin matrix by G where the counts are and adds up; the driver only holds thin matrices, of one row a term.
    """
    n = len(weights)
    width = min(n, dims + 16)
    context = joint.sparkSession.sparkContext

    def multiply(thin: np.ndarray) -> np.ndarray:
        shared = context.broadcast(weights[:, None] * thin)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            thin = shared.value
            total = np.zeros_like(thin)
            for b in batches:
                for term, others, counts in zip(*(c.to_pylist() for c in b.columns)):
                    other, count = np.frombuffer(others, np.int32), np.frombuffer(counts, np.int64).astype(np.float64)
                    total[term] += count @ thin[other]
                    apart = other != term
                    total[other[apart]] += count[apart, None] * thin[term]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(thin)
            for b in batches:
                for x in b.column(0):
                    total += np.frombuffer(x.as_py(), thin.dtype).reshape(thin.shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = joint.where(F.col("term") < n).coalesce(8).mapInArrow(part, "part binary")
        added = parts.repartition(1).mapInArrow(add, "part binary").first()
        total = np.zeros_like(thin) if added is None else np.frombuffer(added["part"], thin.dtype).reshape(thin.shape)
        total = weights[:, None] * total
        for words in items:
            _add_products(total, *_passages(words, n, max(1, len(words))), weights, thin)
        return total

    thin = np.random.default_rng(seed).standard_normal((n, width))
    for _ in range(2):
        thin = np.linalg.qr(multiply(thin))[0]
    values, vectors = np.linalg.eigh(thin.T @ multiply(thin))
    order = np.argsort(values)[::-1][:dims]
    return thin @ vectors[:, order]


def _add_products(total, row, term, count, weights, thin) -> None:
    """Add a * (a . thin) for each passage a, over the terms that occur."""
    if len(term):
        used, column = np.unique(term, return_inverse=True)
        rows, line = np.unique(row, return_inverse=True)
        table = np.zeros((len(rows), len(used)))
        table[line, column] = count * weights[term]
        total[used] += table.T @ (table @ thin[used])


def _common(words: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each of ``words``."""
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    every = (1 << len(words)) - 1
    left = every
    for w in region:
        hit = left & masks.get(w, 0)
        left = ((left + hit) | (left - hit)) & every
    return len(words) - left.bit_count()


@dataclass
class AnswerIndex:
    """Which items each term helps to answer, and how many of its answer terms an item needs within how many words."""

    starts: np.ndarray
    items: np.ndarray
    need: np.ndarray
    reach: np.ndarray

    @classmethod
    def of(cls, items: Items, passage: int, answer: float) -> AnswerIndex:
        pairs = sorted((t, i) for i, terms in enumerate(items.answer) for t in terms)
        terms, owners = (np.array(x, np.int64) for x in zip(*pairs))
        starts = np.searchsorted(terms, np.arange(len(items.vocabulary) + 2))
        need = np.array([max(1, math.ceil(answer * len(a) - 1e-9)) for a in items.answer])
        return cls(starts, owners, need, np.array([passage + 2 * len(w) for w in items.words]))

    def windows(self, idx: np.ndarray, stride: int) -> np.ndarray:
        """Windows where some item has as many answer terms as it needs within its reach: no others can pass that check."""
        counts = self.starts[idx + 1] - self.starts[idx]
        at = np.flatnonzero(counts)
        counts = counts[at]
        if not len(at):
            return at
        place = np.repeat(self.starts[idx[at]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        key = np.sort(self.items[place] << 32 | np.repeat(at, counts))
        item, position = key >> 32, key & 0xFFFFFFFF
        last = np.arange(len(key)) + self.need[item] - 1
        first = np.flatnonzero(last < len(key))
        last = last[first]
        fits = (item[last] == item[first]) & (position[last] - position[first] <= self.reach[item[first]])
        low, high = np.maximum(position[first[fits]] // stride - 1, 0), position[last[fits]] // stride
        spread = high - low + 1
        return np.unique(np.repeat(low - np.cumsum(spread) + spread, spread) + np.arange(spread.sum()))


def _find(idx: np.ndarray, items: Items, index: AnswerIndex, passage: int, cosine: float, common: float, answer: float) -> list[dict]:
    stride = passage // 2
    windows = index.windows(idx, stride)
    found: dict[int, dict] = {}
    for low in range(0, len(windows), 1024):
        block = windows[low : low + 1024]
        vectors = np.stack([items.terms[idx[w * stride : w * stride + passage]].sum(axis=0) for w in block])
        sizes = np.linalg.norm(vectors, axis=1)
        near = (vectors @ items.latent.T) / np.maximum(sizes, 1e-30)[:, None]
        for w, i in zip(*np.nonzero(near >= cosine)):
            words = items.words[i]
            first = max(0, int(block[w]) * stride - len(words))
            region = idx[first : int(block[w]) * stride + passage + len(words)]
            told = len(items.answer[i].intersection(region.tolist())) / len(items.answer[i])
            if told < answer:
                continue
            share = _common(words.tolist(), region.tolist()) / len(words)
            if share >= common and share > found.get(i, {"common": 0.0})["common"]:
                found[i] = {
                    "item_id": items.ids[i],
                    "cosine": float(near[w, i]),
                    "common": share,
                    "answer": told,
                    "first_word": first,
                    "last_word": first + len(region) - 1,
                }
    return [found[i] for i in sorted(found)]


def fit_items(
    docs: DataFrame, rows: list[tuple[int, str]], text_col: str, passage: int, dims: int, seed: int
) -> Items | None:
    """The items' terms, weighted by the passages of all documents, in the space of the leading singular vectors.

    Weights and singular vectors both come from the passages of all documents, repeated texts included, which are read
    once for that; the items are added as passages of their own.
    """
    spelled = [(i, _WORD.findall(t.lower())) for i, t in rows]
    spelled = [(i, words) for i, words in spelled if words]
    if not spelled:
        return None
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for _, ws in spelled]
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    joint = _joint_counts(texts, vocabulary, passage)
    seen = np.zeros(len(vocabulary) + 1, np.int64)
    for r in joint.where(F.col("term") == len(vocabulary)).collect():  # one row
        seen[np.frombuffer(r["others"], np.int32)] = np.frombuffer(r["counts"], np.int64)
    weights = np.log((2.0 + seen[-1]) / (1.0 + seen[:-1]))
    terms = weights[:, None] * _basis(joint, words, weights, dims, seed)
    terms = np.append(terms, np.zeros((1, terms.shape[1])), axis=0).astype(np.float32)
    latent = np.stack([terms[w].sum(axis=0) for w in words])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-30)
    rarest = [sorted(set(w.tolist()), key=lambda t: (-weights[t], t)) for w in words]
    answer = [frozenset(r[: -(-len(r) // 2)]) for r in rarest]
    return Items([i for i, _ in spelled], words, vocabulary, answer, latent, terms)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    passage: int = 32,
    dims: int = 256,
    cosine: float = 0.25,
    common: float = 0.6,
    answer: float = 0.5,
    seed: int = 5,
) -> DataFrame:
    """``docs`` with ``matches``: the benchmark items that the whole text contains, also reworded, in order of the items.

    Windows of ``passage`` words, half of them shared with the next, are candidates for the items whose latent vector has
    a cosine of ``cosine`` or more with theirs. A candidate counts if the longest common subsequence of words, looked for
    in the window and an item's length around it, has a share of ``common`` of the item's words, and if the share
    ``answer`` of the rarer half of the item's terms stands there. ``common`` and ``answer`` are given with each match.

    Items are taken in blocks of a fixed number, each with its own pass over the documents, so what a task holds is
    bounded. Documents are not shuffled, and equal rows match alike. A null text has no match; items without words or with
    a null id are left out; equal items match separately. A column named ``matches`` is replaced.
    """
    docs = docs.drop("matches")
    known = items.where(F.col(item_id_col).isNotNull() & F.col(item_text_col).isNotNull())
    known = known.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).distinct()
    blocks = max(1, -(-known.count() // (_ITEMS // 2)))  # hashing keeps each below _ITEMS in all likelihood
    out, found = docs, []
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        fitted = fit_items(docs, [(r["id"], r["text"]) for r in rows], text_col, passage, dims, seed)
        if fitted:
            out = _with_matches(out, fitted, f"_matches_{block}", text_col, passage, cosine, common, answer)
            found.append(F.col(f"_matches_{block}"))
    every = F.concat(*found) if found else F.array().cast(f"array<{_MATCH}>")
    return out.select(*docs.columns, F.array_sort(every).alias("matches"))


def _with_matches(docs, fitted: Items, name: str, text_col: str, passage: int, cosine: float, common: float, answer: float):
    plain = (fitted.ids, fitted.words, fitted.vocabulary, fitted.answer, fitted.latent, fitted.terms)
    shared = docs.sparkSession.sparkContext.broadcast(plain)  # a block of items

    def start():
        items = Items(*shared.value)
        index = AnswerIndex.of(items, passage, answer)

        def match(text: str | None) -> list[dict]:
            return _find(_indexes(text or "", items.vocabulary), items, index, passage, cosine, common, answer)

        kind = pa.list_(
            pa.struct(
                [("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64())]
                + [("first_word", pa.int32()), ("last_word", pa.int32())]
            )
        )
        return lambda b: [pa.array([match(t.as_py()) for t in b.column(text_col)], kind)]

    return with_computed(docs, f"`{name}` array<{_MATCH}>", start)
