"""Ranked lexical search: equal bags of item terms are scored once and expanded to their documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywise.operators.scratch import durable

_LAST = np.iinfo(np.int64).max  # where a class without any id stands
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_BLANKED = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_CLASS = ["h", "m", "terms", "tfs"]


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased."""
    return text.lower().translate(_BLANKED).split() if text else []


def _bags(docs: DataFrame, id_col: str, text_col: str, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs``: number of terms, and the numbers and frequencies of those in ``numbers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ends, terms, tfs = [], [0], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for text in b.column(1).cast(pa.binary()):
                words = terms_of(text.as_py())
                found, counts = np.unique([i for i in map(numbers.get, words) if i is not None], return_counts=True)
                n.append(len(words))
                ends.append(ends[-1] + len(found))
                terms.append(found)
                tfs.append(counts)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class _Items:
    """The terms of a block of items, laid end to end, and what scoring a class needs of them."""

    def __init__(self, items: Sequence[Sequence[int]], weights: Sequence[int]):
        self.weights = np.array(weights, np.int64)
        self.places = np.concatenate([np.array(x, np.int64) for x in items])
        self.starts = np.cumsum([0, *map(len, items[:-1])])
        self.width = max(8, (1 << 22) // (len(weights) + len(self.places)))  # classes at a time: 32 MB of numbers

    def scores(self, classes: pa.RecordBatch) -> np.ndarray:
        """Items by classes, in 64-bit integers. Terms that an item repeats count as often."""
        lists = classes.column("terms")
        rows = np.repeat(np.arange(classes.num_rows), lists.value_lengths().to_numpy())
        terms, tf = lists.flatten().to_numpy(), classes.column("tfs").flatten().to_numpy().astype(np.int64)
        m = classes.column("m").to_numpy()[rows]
        parts = np.zeros((len(self.weights), classes.num_rows), np.int64)
        parts[terms, rows] = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        return np.add.reduceat(parts[self.places], self.starts, axis=0)


def _best_classes(classes: DataFrame, items: _Items, n_items: int, k: int) -> DataFrame:
    """The ``k`` best classes of each item in each task: by score, then by the smallest id among their members."""
    schema = pa.schema([("item", pa.int32()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(n_items, np.int64)  # the k-th score of each item, 0 until there are k
        item, score, first, held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            for at in range(0, b.num_rows, items.width):
                piece = b.slice(at, items.width)
                found = items.scores(piece)
                new, row = np.nonzero((found >= least[:, None]) & (found > 0))
                if not len(new):
                    continue
                ids = piece.column("first_doc").fill_null(_LAST).to_numpy()
                rows = np.concatenate([np.arange(len(item)), len(item) + row])
                item, score = np.concatenate([item, new]), np.concatenate([score, found[new, row]])
                first = np.concatenate([first, ids[row]])
                order = np.lexsort((first, -score, item))
                starts = np.searchsorted(item[order], np.arange(n_items))
                order = order[np.arange(len(order)) - starts[item[order]] < k]
                item, score, first = item[order], score[order], first[order]
                pool = pa.Table.from_batches([piece] if held is None else [*held.to_batches(), piece])
                held = pool.take(rows[order]).combine_chunks()
                counts = np.bincount(item, minlength=n_items)
                ends = np.cumsum(counts)
                least = np.where(counts == k, score[np.maximum(ends - 1, 0)], 0)
        if held is not None:
            both = pa.table([pa.array(item, pa.int32()), pa.array(score)], schema=schema)
            for name in held.column_names:
                both = both.append_column(name, held.column(name))
            yield from both.to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    found = classes.mapInArrow(run, f"item int, score long, {fields}")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first_doc"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place", "first_doc")


def _search_block(docs: DataFrame, asked: list, k: int, id_col: str, text_col: str) -> DataFrame | None:
    spark, numbers, wanted = docs.sparkSession, {}, []
    for _, text in asked:
        wanted.append([numbers.setdefault(t, len(numbers)) for t in terms_of(text.encode() if text else None)])
    answerable = [i for i, terms in enumerate(wanted) if terms]
    if not answerable:
        return None
    bags = durable(_bags(docs, id_col, text_col, numbers), "bags")
    total = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total[1]:
        return None
    df = F.count(F.lit(1))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total[0] + 2) / (F.lit(2) * df + 1)))
    heard = bags.select(F.explode("terms").alias("term")).groupBy("term").agg(w.alias("w")).collect()  # one row a term
    weights = [0] * len(numbers)
    for row in heard:
        weights[row["term"]] = row["w"]

    m = F.lit(25).cast("long") + F.expr(f"(75L * n * {total[0]}L) div {total[1]}L")
    bags = bags.where(F.size("terms") > 0).withColumn("m", m)
    bags = bags.withColumn("h", F.xxhash64("m", "terms", "tfs")).select("doc_id", *_CLASS)
    classes = bags.groupBy(*_CLASS).agg(F.min("doc_id").alias("first_doc"))
    items = _Items([wanted[i] for i in answerable], weights)
    winners = durable(_best_classes(classes, items, len(answerable), k), "classes")  # k rows an item at most
    members = bags.join(F.broadcast(winners.select(*_CLASS).distinct()), _CLASS)
    by_id = Window.partitionBy(*_CLASS).orderBy(F.asc_nulls_last("doc_id"))
    members = members.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k).drop("place")
    ranked = members.join(F.broadcast(winners), _CLASS)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, asked[i][0]) for n, i in enumerate(answerable)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 1 << 20,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents that score highest for each item, above 0 only.

    Documents are restricted to the terms of the items. Those with equal terms, frequencies and length norm form a class
    (grouped by hash, told apart by the whole key); each class is scored once, against a block of items at a time, and the
    best classes are expanded by ascending id. A class has the score of all its members, so the ``k`` best classes by
    score and smallest id hold the ``k`` best documents, and the ``k`` smallest ids of a class are all that can count.

    Items come to the tasks in blocks of about ``block_bytes`` of text; the documents are read once a block. All texts are
    read whole. Ids are whole numbers. Null and empty texts have no terms: such documents and items are never found or
    answered, and don't count among the documents. Documents with a null id are ranked behind all with the same score;
    rows with equal ids are documents of their own. Items repeated with id and text count once; an id with several texts
    has one answer for each. Empty tables give an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked = asked.distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = []
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=str)
        found.append(_search_block(docs, rows, k, id_col, text_col))
    found = [f for f in found if f is not None]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
