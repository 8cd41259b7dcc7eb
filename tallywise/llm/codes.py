"""Vector code compression: integer product quantisation over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.operators.scratch import durable

_LARGEST = 1 << 26  # squares of differences of such numbers, summed over 64 components, fit in 64 bits


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Rows in the order of a Hilbert curve through their bounding box.

    The coordinates become the transposed index by the exchanges and inversions of Skilling (2004). Of rows with more
    than 16 components the first 16 are looked at. The order only decides which rows share a block.
    """
    x = points[:, :16].astype(np.int64)
    n, d = x.shape
    if not n or not d:
        return np.arange(n)
    x = (x - x.min(axis=0)).T.copy()
    bits = max(1, min(62 // d, int(x.max()).bit_length()))
    x >>= max(0, int(x.max()).bit_length() - bits)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return np.argsort(key, kind="stable")


@dataclass
class Blocks:
    """One part position of a chunk of rows: points in Hilbert order (the last one repeated to fill the last block),
    the row each came from, and of each block the least and greatest components and the sums of its rows."""

    order: np.ndarray
    points: np.ndarray  # blocks, rows, components
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, size: int) -> Blocks:
        order = hilbert_order(rows)
        blocks = -(-len(rows) // size)
        filled = np.concatenate([order, np.repeat(order[-1:], blocks * size - len(rows))])
        points = rows[filled].reshape(blocks, size, rows.shape[1])
        sums = np.add.reduceat(rows[order].astype(np.int64), np.arange(0, len(rows), size), axis=0)
        return cls(order, points, points.min(axis=1), points.max(axis=1), sums)

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, its squared distance, and which blocks lie with one entry whole.

        An entry is on a block's short list unless the nearest spot of the block's box is further from it than the
        furthest spot of the box is from some other entry. Points are compared with the short list only; it is in the
        order of the entries, so that the first of equal distances is the smallest index.
        """
        low, high = self.low[:, None, :].astype(np.int64), self.high[:, None, :].astype(np.int64)
        gap = np.maximum(np.maximum(low - book, book - high), 0)
        reach = np.maximum(np.abs(book - low), np.abs(book - high))
        listed = (gap * gap).sum(axis=2) <= (reach * reach).sum(axis=2).min(axis=1)[:, None]
        lengths = listed.sum(axis=1)
        blocks, size, _ = self.points.shape
        codes, errors = np.zeros((blocks, size), np.int64), np.zeros((blocks, size), np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            short = np.nonzero(listed[at])[1].reshape(len(at), length)
            step = max(1, (1 << 19) // (size * int(length)))
            for i in range(0, len(at), step):
                some, entries = at[i : i + step], short[i : i + step]
                distance = np.zeros((len(some), size, int(length)), np.int64)
                for j in range(book.shape[1]):
                    off = self.points[some, :, j].astype(np.int64)[:, :, None] - book[entries, j][:, None, :]
                    distance += off * off
                best = distance.argmin(axis=2)
                codes[some] = np.take_along_axis(entries, best, 1)
                errors[some] = np.take_along_axis(distance, best[:, :, None], 2)[:, :, 0]
        return codes, errors, lengths == 1

    def entry_sums(self, book: np.ndarray) -> np.ndarray:
        """Entries by (number of points, sums of their components)."""
        codes, _, whole = self.nearest(book)
        out, (blocks, size, d) = np.zeros((len(book), 1 + self.sums.shape[1]), np.int64), self.points.shape
        rows = np.minimum(size, len(self.order) - size * np.arange(blocks))
        np.add.at(out, codes[whole, 0], np.concatenate([rows[whole, None], self.sums[whole]], axis=1))
        real = (np.arange(size)[None, :] < rows[:, None]) & ~whole[:, None]
        mixed, points = codes[real], self.points[real]
        out[:, 0] += np.bincount(mixed, minlength=len(book))
        for j in range(d):  # exact: the sums of a chunk are far below 2**53
            out[:, 1 + j] += np.bincount(mixed, weights=points[:, j], minlength=len(book)).astype(np.int64)
        return out

    def pack(self) -> bytes:
        order = self.order.astype(np.int32).tobytes()
        return order + b"".join(x.tobytes() for x in (self.points, self.low, self.high)) + self.sums.tobytes()

    @classmethod
    def unpack(cls, data: bytes, rows: int, size: int, d: int, kind: str) -> Blocks:
        blocks, at, wide = -(-rows // size), 0, np.dtype(kind)

        def take(dtype: np.dtype, *shape: int) -> np.ndarray:
            nonlocal at
            n = int(np.prod(shape))
            found = np.frombuffer(data, dtype, n, at).reshape(shape)
            at += n * dtype.itemsize
            return found

        order = take(np.dtype(np.int32), rows)
        points, low, high = take(wide, blocks, size, d), take(wide, blocks, d), take(wide, blocks, d)
        return cls(order, points, low, high, take(np.dtype(np.int64), blocks, d))


def finite(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def _whole_numbers(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * values.astype(np.float64)).astype(np.int64)


def _chunks(kept: DataFrame, parts: int, d: int, scale: float, chunk_rows: int, block_rows: int) -> DataFrame:
    """Rows packed by the thousand: ids, labels, and for every part position its Hilbert-sorted blocks. No shuffle."""

    def pack(ids: list, labels: list, values: list) -> pa.RecordBatch:
        rows = _whole_numbers(np.concatenate(values), scale).reshape(-1, parts, d)
        low, high = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
        kind = next(k for k in (np.int8, np.int16, np.int32) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        blobs = [Blocks.of(rows[:, p].astype(kind), block_rows).pack() for p in range(parts)]
        cells = [[np.dtype(kind).str], [blobs], [ids], [labels]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow)], schema=arrow)

    arrow = pa.schema([("kind", pa.string()), ("blocks", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values = [], [], []
        for b in batches:
            for at in range(0, b.num_rows, chunk_rows):
                piece = b.slice(at, chunk_rows)
                ids += piece.column("id").to_pylist()
                labels += piece.column("label").to_pylist()
                values.append(piece.column("v").flatten().to_numpy())
                if len(ids) >= chunk_rows:
                    yield pack(ids, labels, values)
                    ids, labels, values = [], [], []
        if ids:
            yield pack(ids, labels, values)

    return kept.mapInArrow(run, "kind string, blocks array<binary>, ids array<long>, labels array<long>")


def _each_chunk(b: pa.RecordBatch, d: int, size: int) -> Iterator[tuple[list[int | None], list[int | None], list[Blocks]]]:
    for kind, blobs, ids, labels in zip(*(b.column(n) for n in ("kind", "blocks", "ids", "labels"))):
        parts = [Blocks.unpack(x.as_py(), len(ids), size, d, kind.as_py()) for x in blobs]
        yield ids.as_py(), labels.as_py(), parts


def _updated(chunks: DataFrame, books: np.ndarray, size: int) -> np.ndarray:
    """One round: assign every part, then floor of the mean of each entry's parts. Only sums leave the tasks."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + d), np.int64)
        for b in batches:
            for _, _, found in _each_chunk(b, d, size):
                for p, blocks in enumerate(found):
                    total[p] += blocks.entry_sums(books[p])
        part, entry = np.nonzero(total[:, :, 0])
        cells = [part, entry, *total[part, entry].T]
        names = ["part", "entry", "n", *[f"s{j}" for j in range(d)]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], names=names)

    sums = [f"s{j}" for j in range(d)]
    found = chunks.mapInArrow(run, ", ".join(f"{c} long" for c in ("part", "entry", "n", *sums)))
    found = found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])
    after = books.copy()
    for row in found.collect():  # parts x entries rows
        after[row["part"], row["entry"]] = [row[s] // row["n"] for s in sums]
    return after


def _assigned(chunks: DataFrame, books: np.ndarray, size: int) -> DataFrame:
    """``id, label, code, error`` of every row."""
    parts, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, found in _each_chunk(b, d, size):
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, blocks in enumerate(found):
                    code, off, _ = blocks.nearest(books[p])
                    codes[blocks.order, p] = code.reshape(-1)[: len(ids)]
                    error[blocks.order] += off.reshape(-1)[: len(ids)]
                text, width = codes.tobytes().hex(), 2 * parts
                digits = [text[i * width : (i + 1) * width] for i in range(len(ids))]
                cells = [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(digits, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "label", "code", "error"])

    return chunks.mapInArrow(run, "id long, label long, code string, error long")


def compress(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    chunk_rows: int = 4096,
    block_rows: int = 32,
    on_codebooks: Callable[[np.ndarray], None] | None = None,
) -> DataFrame:
    """``vec_id, label, code, error, codebooks_sha256`` of every usable row: codes of ``parts`` equal parts, two hex digits each.

    Components become floor(``scale`` * x). A part's codebook starts as that part of the rows with the ``entries``
    smallest ids (fewer rows: fewer entries); each round assigns all parts to the nearest entry, ties to the smaller
    index, and moves entries to the floor of their parts' mean; entries without parts stay. Codes are those of a last
    assignment, ``error`` is the sum of their squared distances. All in exact integers.

    Rows are packed once, by chunks within their input tasks, into Hilbert-sorted blocks with box and sums, and written
    to the shared folder; rounds read those, and only sums per part and entry are shuffled. A block whose short list has
    one entry gives its stored sums. ``on_codebooks`` is called with the final codebooks (parts, entries, components).

    Left out: vectors that are null or hold null or non-finite components. Vectors that can't be coded beside the others
    (empty, of another length than the one with the smallest id, with numbers beyond 2**26) have a row with null code and
    error, and no part in the codebooks. Null ids come last in the order of ids; equal ids are ordered by their vectors.
    Repeated rows each have a row. Labels are whole numbers; null ones stay null. A length that ``parts`` doesn't divide is
    an error. A table without usable rows gives an empty result. Other columns are not looked at.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    spark, v = vectors.sparkSession, F.col("v")
    rows = vectors.where(finite(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    codable = (F.size(v) > 0) & F.forall(v, lambda x: F.abs(x * scale) < _LARGEST)
    first = rows.where(codable).orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    if not first:
        books, coded, length = np.zeros((parts, 0, 0), np.int64), None, 0
    else:
        length = len(first[0]["v"])
        if length % parts:
            raise ValueError(f"{parts} equal parts can't be cut from vectors of length {length}")
        d, alike = length // parts, [r["v"] for r in first if len(r["v"]) == length]
        codable = codable & (F.size(v) == length)
        if len(alike) < len(first):
            alike = [r["v"] for r in rows.where(codable).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
        books = _whole_numbers(np.array(alike), scale).reshape(-1, parts, d).transpose(1, 0, 2).copy()
        chunks = durable(_chunks(rows.where(codable), parts, d, scale, chunk_rows, block_rows), "blocks")
        for _ in range(rounds):
            books = _updated(chunks, books, block_rows)
        coded = _assigned(chunks, books, block_rows)
    if on_codebooks:
        on_codebooks(books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    rest = rows.where(~codable).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = rest if coded is None else coded.union(rest)
    return coded.select(F.col("id").alias("vec_id"), "label", "code", "error", F.lit(digest).alias("codebooks_sha256"))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: its ``error`` summed over the rows of its label, nulls together.

    Sums are combined before the shuffle and joined back; a frequent label is no larger there than a rare one.
    """
    coded = durable(coded, "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
