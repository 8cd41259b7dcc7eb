"""Histogram sort: shards of near equal bytes, with one exchange of the rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.operators.scratch import durable

_FIRST_BITS = 12  # of the first histogram
_NEXT_BITS = 8  # by which each further round splits the bins that still hold a splitter
_COLUMNS = ("_key", "_size", "_part")


def sort_key(id_col: str, text_col: str) -> Column:
    """64 bits: 32 of the text's hash, then 32 of the id's. Equal texts are neighbours, and a large group can be cut."""
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    high = F.shiftleft(F.shiftright(text, 32), 32)
    return high.bitwiseOR(F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def row_bytes(text_col: str, overhead: int) -> Column:
    """UTF-8 bytes of the text (none if null) and a fixed number for the rest of the row."""
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(overhead)


@dataclass
class _Splitter:
    """A wanted number of bytes to the left, and what is known of the key that has them there."""

    target: float
    slack: float
    key: int | None = None  # rows below this key go left
    bin: int | None = None  # prefix of the bin to be split next
    below: int = 0  # exact bytes below that bin

    def settle(self, bins: list[tuple[int, int]], below: int, shift: int) -> None:
        """Look the target up in exact counts of neighbouring bins; ``below``: bytes under the first of them."""
        edges = list(accumulate((size for _, size in bins), initial=below))
        at = max(0, min(bisect_right(edges, self.target) - 1, len(bins) - 1))
        prefix, size = bins[at]
        left, right = self.target - edges[at], edges[at + 1] - self.target
        if min(left, right) <= self.slack or shift == 0:
            self.key, self.bin = (prefix if left <= right else prefix + 1) << shift, None
        else:
            self.bin, self.below = prefix, edges[at]


def find_splitters(keys: DataFrame, wanted: list[tuple[float, float]]) -> list[int]:
    """Keys (rows below them go left) for ``wanted`` pairs of bytes to the left and slack, over ``_key`` and ``_size``.

    Each round counts exact bytes in all bins that still hold an open splitter, over all partitions; the driver sees at
    most 2**8 bins for each open splitter (2**12 in the first round). Rounds end when every splitter is within its slack
    or the key has no more bits.
    """
    splitters, shift = [_Splitter(*w) for w in wanted], 64 - _FIRST_BITS
    found = _histogram(keys, shift)
    for s in splitters:
        s.settle(found, 0, shift)
    while open_ := [s for s in splitters if s.key is None]:
        active, parent = sorted({s.bin for s in open_}), shift
        shift = max(0, shift - _NEXT_BITS)
        found = _histogram(keys.where(F.shiftright("_key", parent).isin(active)), shift)
        prefixes, step = [p for p, _ in found], parent - shift
        for s in open_:
            inside = found[bisect_left(prefixes, s.bin << step) : bisect_left(prefixes, (s.bin + 1) << step)]
            s.settle(inside, s.below, shift)
    return sorted(min(s.key, 2**63 - 1) for s in splitters)


def _histogram(keys: DataFrame, shift: int) -> list[tuple[int, int]]:
    counted = keys.groupBy(F.shiftright("_key", shift).alias("bin")).agg(F.sum("_size").alias("size"))
    return sorted((r["bin"], r["size"]) for r in counted.collect())


def _longs(values: list) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _part_of(splitters: list[int]) -> Column:
    """How many splitters are at or below ``_key``: a lookup by the first bits, then a look at that bin's splitters."""
    if not splitters:
        return F.lit(0)
    shift, half = 64 - _FIRST_BITS, 1 << (_FIRST_BITS - 1)
    bounds = [bisect_left(splitters, b << shift) for b in range(-half, half + 1)]
    at = F.shiftright("_key", shift).cast("int") + F.lit(half + 1)
    low, high = (F.element_at(_longs(bounds), i) for i in (at, at + 1))
    own = F.slice(_longs(splitters), low + 1, high - low)
    passed = F.size(F.filter(own, lambda s: s <= F.col("_key")))
    return (low + passed).cast("int")


def histogram_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    tolerance: float = 0.0005,
    part_bytes: int = 128 << 20,
    max_parts: int = 64,
) -> DataFrame:
    """``docs`` with ``size`` (bytes), ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard).

    Shards are ranges of ``sort_key`` whose bytes differ from the mean by at most ``tolerance`` of it, or by about one
    row where rows are larger than that. A shard over ``part_bytes`` is written by up to ``max_parts`` tasks: the
    splitters between its parts are found in the same rounds with more slack, and exact counts of the parts give the
    first slot of each. The whole rows are exchanged once, by part.

    A null text counts as empty; a null id sorts like any other value. Equal ids and wholly equal rows are kept, each
    with a slot of its own; rows equal in id and text can't be parted by the key. An empty table gives no rows. Columns
    of ``docs`` named ``size``, ``shard`` or ``slot`` are replaced; all others pass.
    """
    if clash := [c for c in docs.columns if c in _COLUMNS]:
        raise ValueError(f"columns with reserved names: {clash}")
    docs = docs.withColumns({"_key": sort_key(id_col, text_col), "_size": row_bytes(text_col, overhead)})
    keys = durable(docs.select("_key", "_size"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).first()["n"]
    mean = total / shards
    parts = max(1, min(max_parts, -(-total // (shards * part_bytes))))
    wanted = [
        (mean * j / parts, tolerance * mean / 2 if j % parts == 0 else mean / parts / 4) for j in range(1, shards * parts)
    ]
    splitters = find_splitters(keys, wanted) if total else []
    part = _part_of(splitters)
    counted = {r["part"]: r["count"] for r in keys.groupBy(part.alias("part")).count().collect()}
    firsts = []
    for s in range(shards):
        firsts += accumulate((counted.get(s * parts + j, 0) for j in range(parts - 1)), initial=0)
    order = Window.partitionBy("_part").orderBy("_key", id_col, F.col(text_col).isNull())
    placed = docs.withColumn("_part", part).withColumn("_slot", F.row_number().over(order) - 1)
    return placed.withColumns(
        {
            "size": F.col("_size"),
            "shard": F.floor(F.col("_part") / F.lit(parts)).cast("int"),
            "slot": F.element_at(_longs(firsts), F.col("_part") + 1) + F.col("_slot"),
        }
    ).drop("_key", "_size", "_part", "_slot")
