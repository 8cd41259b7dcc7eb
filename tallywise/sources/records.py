"""CSV records that span lines, read by many tasks a file.

A task can't know whether its part of a file begins inside quotes. But a line does one of four things to the reader: it
leaves it outside, leaves it inside, leaves it as it was, or turns it over. Lines compose to parts and parts to files, so
one pass finds what each part does, a running composition over one row a part finds how each begins, and a second pass
cuts the records. Only records that cross the border of parts are shuffled to be put together.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLOSED = r'"(?:[^"]|"")*"(?:[^",][^,]*)?'
_FIELDS = rf'(?:(?:{_CLOSED}|[^",][^,]*)?,)*'
_OPEN = r'"(?:[^"]|"")*$'
# lines after which a quoted field is open: begun at a record's start, begun inside quotes
_FROM_OUTSIDE = rf"^{_FIELDS}{_OPEN}"
_FROM_INSIDE = rf'^(?:[^"]|"")*(?:$|"(?:[^",][^,]*)?,{_FIELDS}{_OPEN})'


def line_ends(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether a quoted field is open after each line, for a reader outside and for one inside quotes before it."""
    outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.flatnonzero(pc.match_substring(lines, b'"').to_numpy(zero_copy_only=False))
    some = lines.take(pa.array(quoted))
    outside[quoted] = pc.match_substring_regex(some, _FROM_OUTSIDE.encode()).to_numpy(zero_copy_only=False)
    inside[quoted] = pc.match_substring_regex(some, _FROM_INSIDE.encode()).to_numpy(zero_copy_only=False)
    return outside, inside


def states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """Whether the reader is inside quotes before each line and after the last, from its state before the first."""
    turns = np.cumsum(outside & ~inside) & 1 == 1
    fixed = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    base = np.where(fixed >= 0, outside[fixed] ^ turns[fixed], start)
    return np.concatenate([[start], base ^ turns])


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch, pa.Array]]:
    """Stretches of a part of a file: its name and begin, whether the stretch is the part's first, rows and lines."""
    last = None
    for b in batches:
        blocks, files = b.column("block").to_numpy(), b.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
        for at, to in zip([0, *cuts], [*cuts, b.num_rows]):
            if at < to:
                key = (files.dictionary[codes[at]].as_py(), int(blocks[at]))
                rows = b.slice(at, to - at)
                yield key, key != last, rows, rows.column("value").cast(pa.binary())
                last = key


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part: its effect on a reader outside and on one inside, and whether a record begins in it for the latter."""
    out: dict[tuple[str, int], list[bool]] = {}
    for key, _, _, lines in stretches(batches):
        effect = out.setdefault(key, [False, True, False])
        outside, inside = line_ends(lines)
        within = states(outside, inside, effect[1])
        effect[0], effect[1] = bool(states(outside, inside, effect[0])[-1]), bool(within[-1])
        effect[2] |= not within[:-1].all()
    if out:
        cells = [[f for f, _ in out], [b for _, b in out], *map(list, zip(*out.values()))]
        kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 3]
        names = ["file", "block", "after_outside", "after_inside", "begins"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)


def _begins(effects: DataFrame) -> DataFrame:
    """``(file, block, inside, owner)``: how each part begins, and in which part the record began that is open there."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.col("after_outside"), F.col("after_inside")
    known = effects.withColumn("_turns", F.sum((a & ~b).cast("int")).over(upto))
    fixed = F.last(F.when(a == b, F.struct("_turns", a.alias("inside"))), ignorenulls=True).over(earlier)
    known = known.withColumn("_fixed", fixed).withColumn("_turned", F.coalesce(F.lag("_turns").over(Window.partitionBy("file").orderBy("block")), F.lit(0)))
    turned = (F.col("_turned") - F.coalesce(F.col("_fixed._turns"), F.lit(0))) % 2 == 1
    known = known.withColumn("inside", F.coalesce(F.col("_fixed.inside"), F.lit(False)) != turned)
    after = F.when(F.col("inside"), b).otherwise(a)
    opened = F.when(after & (~F.col("inside") | F.col("begins")), F.col("block"))
    return known.select("file", "block", "inside", F.last(opened, ignorenulls=True).over(earlier).alias("owner"))


@dataclass
class _Cutter:
    """Records of the parts that a task reads; lines of the open record are kept from stretch to stretch."""

    key: tuple[str, int] = ("", 0)
    inside: bool = False
    lines: list = field(default_factory=list)
    owner: int | None = None  # where the open record began
    first: bool = False  # it is the file's first
    want_whole: bool = True  # whole records, or the pieces of others
    out: list = field(default_factory=list)

    def begin(self, key: tuple[str, int], inside: bool | None, owner: int | None) -> None:
        if inside is None:
            raise ValueError("the parts of the files changed between two scans; set spark.sql.files.minPartitionNum")
        self.key, self.inside, self.lines, self.owner, self.first = key, inside, [], owner, False

    def feed(self, lines: pa.Array) -> None:
        at = states(*line_ends(lines), self.inside)
        texts, starts = lines.to_pylist(), np.flatnonzero(~at[:-1]).tolist()
        fresh = not self.lines and not self.inside and self.key[1] == 0
        self.lines += texts[: starts[0]] if starts else texts
        for i, start in enumerate(starts):
            if self.lines:
                self.close(open_after=False)
            self.first, self.owner = fresh and i == 0, self.key[1]
            self.lines = texts[start : starts[i + 1] if i + 1 < len(starts) else None]
        self.inside = bool(at[-1])

    def close(self, open_after: bool) -> None:
        """Put out the open record: whole, or a piece of one that began before this part or goes on after it."""
        if self.lines:
            if (self.owner == self.key[1] and not open_after) == self.want_whole:
                text = b"\n".join(self.lines)
                text = text if open_after else text.removesuffix(b"\r")
                self.out.append((self.key[0], self.owner, self.key[1], self.first, text))
        self.lines = []

    def taken(self) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        cells = [pa.array(list(c), k) for c, k in zip(zip(*self.out), kinds)]
        cells[-1] = cells[-1].view(pa.string())  # bytes as they stand in the file
        self.out = []
        return pa.RecordBatch.from_arrays(cells, names=["file", "owner", "block", "first", "record"])


def _cut(batches: Iterator[pa.RecordBatch], want_whole: bool) -> Iterator[pa.RecordBatch]:
    cutter = _Cutter(want_whole=want_whole)
    for key, new, rows, lines in stretches(batches):
        if new:
            cutter.close(open_after=cutter.inside)
            cutter.begin(key, rows.column("inside")[0].as_py(), rows.column("owner")[0].as_py())
        cutter.feed(lines)
        if cutter.out:
            yield cutter.taken()
    cutter.close(open_after=cutter.inside)
    if cutter.out:
        yield cutter.taken()


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``(file, record)``: the records of CSV files below ``path``, as text, quoted line breaks in them.

    Fields are divided by commas and quoted by ``"``, which is doubled within quotes; a quote in a field that does not
    begin with one is a character like others. Lines end in line feeds, with a carriage return before it or not. Empty
    lines between records are no records. Line breaks within quotes stay as they are in the file. With ``header`` the first record of each file is left out.

    Files are read in parts of the size that Spark reads text files in, which need not end where records do: once for the
    effect of the parts, once for the records that lie in one part, and once for the others, of which alone text is
    shuffled. What is broadcast is one small row a part. A record longer than a part is put together in one task.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = lines.mapInArrow(_effects, "file string, block long, after_outside boolean, after_inside boolean, begins boolean")
    begun = lines.join(F.broadcast(_begins(effects)), ["file", "block"], "left")

    def cut(want_whole: bool) -> DataFrame:
        kind = "file string, owner long, block long, first boolean, record string"
        return begun.mapInArrow(lambda batches: _cut(batches, want_whole), kind)

    ordered = F.array_sort(F.collect_list(F.struct("block", "record")))
    joined = F.array_join(F.transform(ordered, lambda piece: piece["record"]), "\n")
    pieces = cut(False).groupBy("file", "owner").agg(F.max("first").alias("first"), joined.alias("record"))
    records = cut(True).select("file", "first", "record").unionByName(pieces.drop("owner"))
    return records.where((F.col("record") != "") & ~(F.col("first") & F.lit(header))).select("file", "record")


def read_csv(spark: SparkSession, path: str, schema: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """CSV files with a header, as a table: what Spark's multi-line reader gives, without its one task a file."""
    said = {"escape": '"', "multiLine": "true", **(options or {})}
    parsed = read_records(spark, path).select(F.from_csv("record", schema, said).alias("r"))
    return parsed.select("r.*")
