"""Nearest neighbours by inner product: vantage-point trees per shard, with relaxed pruning."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TINY = 1e-9  # against rounding when a bound meets the distance it is compared with


@dataclass
class Tree:
    """Rows in leaf order, and nodes (vantage row, children's distance ranges, children), or slices for leaves.

    Inner products become distances by one more component that gives all rows the length of the longest: the nearest
    row is then the one with the largest inner product.
    """

    ids: np.ndarray
    rows: np.ndarray
    longest: float
    nodes: list[tuple]


def build(ids: np.ndarray, rows: np.ndarray, leaf: int, seed: int) -> Tree:
    rows = rows.astype(np.float64)
    squares = np.einsum("ij,ij->i", rows, rows)
    longest = float(np.sqrt(squares.max()))
    extra = np.sqrt(np.maximum(longest**2 - squares, 0.0))
    rng, nodes, order = np.random.default_rng(seed), [], []

    def split(members: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(())
        if len(members) <= leaf:
            start = sum(map(len, order))
            order.append(members[np.argsort(ids[members], kind="stable")])
            nodes[at] = (start, start + len(members))
            return at
        vantage = members[rng.integers(len(members))]
        near = rows[members] @ rows[vantage] + extra[members] * extra[vantage]
        distance = np.sqrt(np.maximum(2 * (longest**2 - near), 0.0))
        by = np.argsort(distance, kind="stable")  # halves by rank, so that equal rows split too
        half = len(by) // 2
        ranges = [(float(distance[by[a]]), float(distance[by[b]])) for a, b in ((0, half - 1), (half, -1))]
        children = [split(members[by[:half]]), split(members[by[half:]])]
        nodes[at] = (rows[vantage], ranges, children)
        return at

    split(np.arange(len(ids)))
    placed = np.concatenate(order)
    return Tree(ids[placed], rows[placed], longest, nodes)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last: equal pairs give equal bits wherever they stand."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` rows of the tree for each query: ids and ``products``, best first, -inf where there are fewer.

    A child is left out for a query if the triangle inequality puts all of it beyond the distance of the k-th row found,
    with the bound multiplied by ``relax``: 1 is exact, more prunes more. Queries walk in groups that want the same child
    first.
    """
    best = np.full((len(ids), k), -np.inf)
    best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
    squares = np.einsum("ij,ij->i", queries, queries)
    lengths = squares + tree.longest**2
    slack = 4 * queries.shape[1] * np.finfo(float).eps * np.sqrt(squares) * tree.longest

    def visit(at: int, group: np.ndarray, bound: np.ndarray) -> None:
        reach = np.sqrt(np.maximum(lengths[group] - 2 * best[group, -1], 0.0))  # infinite until k rows are found
        kept = bound * relax <= reach + _TINY
        group = group[kept]
        if not len(group):
            return
        node = tree.nodes[at]
        if len(node) == 2:
            return take(slice(*node), group)
        vantage, ranges, children = node
        distance = np.sqrt(np.maximum(lengths[group] - 2 * (queries[group] @ vantage), 0.0))
        bounds = [np.maximum(np.maximum(distance - high, low - distance), 0.0) for low, high in ranges]
        inner = distance <= (ranges[0][1] + ranges[1][0]) / 2
        for first in (True, False):
            for child, wanted in ((0, inner), (1, ~inner)):
                side = wanted if first else ~wanted
                if side.any():
                    visit(children[child], group[side], bounds[child][side])

    def take(rows: slice, group: np.ndarray) -> None:
        scores, found = queries[group] @ tree.rows[rows].T, tree.ids[rows]
        scores[found[None, :] == ids[group, None]] = -np.inf
        # products of matrices round by a row's place, so they only choose the pairs that are multiplied out
        floor = best[group, -1]
        if len(found) > k:
            floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
        chosen = (scores >= (floor - slack[group])[:, None]) & (scores > -np.inf)
        better = chosen.any(axis=1)
        group, chosen = group[better], chosen[better]
        if not len(group):
            return
        at, column = np.nonzero(chosen)
        scores = np.full(chosen.shape, -np.inf)
        scores[at, column] = products(queries[group[at]], tree.rows[rows][column])
        all_scores = np.concatenate([best[group], scores], axis=1)
        all_ids = np.concatenate([best_ids[group], np.broadcast_to(found, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        best[group] = np.take_along_axis(all_scores, order, 1)
        best_ids[group] = np.take_along_axis(all_ids, order, 1)

    visit(0, np.arange(len(ids)), np.zeros(len(ids)))
    return best_ids, best


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    relax: float = 1.1,
    shard_rows: int = 8192,
    block_rows: int = 1024,
    leaf: int = 128,
    seed: int = 11,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each query the ``k`` rows of largest inner product found.

    Every usable row is indexed, in trees of about ``shard_rows`` rows dealt evenly over the cluster; queries come in
    blocks of ``block_rows``, and each block meets each tree once (a stated set against all rows). Scores are inner
    products of the stored vectors in double precision; equal scores go to the smaller id.

    Unusable vectors (null, zero, with null or non-finite components) and rows with a null id take no part. Equal rows
    count once. If an id has several vectors, each is a candidate, and the smallest is the query; a query never finds its
    own id. Vectors only meet vectors of their length. No usable row or no query gives an empty result.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.dropDuplicates()
    asked = vectors.where(is_query & F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    asked = asked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(vector_col).cast("array<double>")).alias("v"))
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // block_rows))

    def grouped(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        by_length: dict[int, tuple[list, list]] = {}
        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v")):
                ids, found = by_length.setdefault(len(v), ([], []))
                ids.append(i)
                found.append(v.values.to_numpy())
        return {n: (np.array(ids, np.int64), np.stack(found)) for n, (ids, found) in sorted(by_length.items())}

    def packed(found: dict[int, bytes], name: str) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for n, blob in found.items():
            arrays = [pa.array([shard], pa.int32()), pa.array([n], pa.int32()), pa.array([blob], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "length", name])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = {n: build(ids, rows, leaf, seed) for n, (ids, rows) in grouped(batches).items()}
        trees = {n: pickle.dumps((t.ids, t.rows, t.longest, t.nodes)) for n, t in grown.items()}
        yield from packed(trees, "tree")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed({n: pickle.dumps(x) for n, x in grouped(batches).items()}, "block")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, block in zip(b.column("tree"), b.column("block")):
                ids, queries = pickle.loads(block.as_py())
                found, scores = search(Tree(*pickle.loads(tree.as_py())), ids, queries, k, relax)
                at, column = np.nonzero(scores > -np.inf)
                arrays = [ids[at], found[at, column], scores[at, column]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["query_id", "vec_id", "score"])

    trees = rows.repartition(shards).mapInArrow(plant, "shard int, length int, tree binary")
    packs = asked.repartition(blocks).mapInArrow(pack, "shard int, length int, block binary").drop("shard")
    packs = packs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # every pair is a large piece of work of its own: one task each as far as there are partitions
    pairs = packs.join(trees.hint("shuffle_hash"), ["shard", "length"]).select("block", "tree")
    found = pairs.repartition(min(shards * blocks, 4096)).mapInArrow(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
