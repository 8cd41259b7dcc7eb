"""Arrays as long as the data in JSON documents: written and read by many tasks, with exact positions.

A document is a folder of part files that make one JSON object when they are put one behind the other, in the order of
their names; a single file is such a folder too. A reader cuts at commas, so that parts of a file are as good as files:
what a part needs to know of those before it is one row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywise.sources.records import stretches

_NAME = r'"((?:[^"\\]|\\.)*)"\s*:\s*'
_OBJECT, _ARRAY = re.compile(_NAME + r"\{"), re.compile(_NAME + r"\[")


def write_arrays(
    values: DataFrame, path: str, field: str, array_col: str, position_col: str, value_col: str, mode: str = "error"
) -> None:
    """One document ``{field: {array: [values]}}``. Positions count from 0 in each array, without gaps.

    Rows are range partitioned by array and position; every task writes its stretch, a few thousand values a line. Names
    of arrays hold no commas and brackets; values are numbers, flags or null.
    """
    sizes = values.groupBy(F.col(array_col).alias("_array")).agg(F.count(F.lit(1)).alias("_size"))
    ends = sizes.agg(F.min("_array"), F.max("_array")).first()
    text = F.coalesce(F.to_json(F.struct(F.col(value_col).alias("v")), {"ignoreNullFields": "false"}), F.lit('{"v":null}'))
    rows = values.select(
        F.col(array_col).alias("_array"), F.col(position_col).cast("long").alias("_at"), F.substr(text, F.lit(6), F.length(text) - 6).alias("_v")
    )
    ranged = rows.join(sizes, "_array").repartitionByRange("_array", "_at").sortWithinPartitions("_array", "_at")
    head = json.dumps({field: {}}, ensure_ascii=False)[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, at, sizes = b.column("_array").to_pylist(), b.column("_at").to_numpy(), b.column("_size").to_numpy()
            texts, lines = b.column("_v").to_pylist(), []
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for low, high in zip(starts, starts[1:]):
                for i in range(low, high, 4096):
                    to = min(i + 4096, high)
                    before = "," if at[i] else (head if names[i] == ends[0] else ",") + json.dumps(names[i], ensure_ascii=False) + ": ["
                    after = "" if at[to - 1] + 1 < sizes[i] else "]" + ("}}" if names[i] == ends[1] else "")
                    lines.append(before + ",".join(texts[i:to]) + after)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    ranged.mapInArrow(run, "value string").write.mode(mode).text(path)


@dataclass
class _Scan:
    """What a reader knows at a comma. At a part's begin it takes itself to be inside an array, which others check."""

    part: int = 0  # arrays begun in the part of the file
    seen: int = 0  # values of the present one
    head: int = 0  # values before the first array that begins here
    inside: bool = True
    sure: bool = False  # whether a bracket has told it so
    field: str | None = None
    name: str | None = None

    def feed(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, list, list]:
        """Which pieces are values; the values' texts, arrays, indexes, and names of field and array."""
        opens, closes, objects = (pc.match_substring(pieces, s).to_numpy(zero_copy_only=False) for s in "[]{")
        events = np.where(opens & ~closes, 1, np.where(closes, 0, -1))
        last = np.maximum.accumulate(np.where(events >= 0, np.arange(len(events)), -1))
        after = np.where(last >= 0, events[last] == 1, self.inside)
        texts = pc.replace_substring_regex(pc.replace_substring_regex(pieces, r"^[\s\S]*\[", ""), r"[\]}][\s\S]*$", "")
        texts = pc.utf8_trim_whitespace(texts)
        is_value = (opens | np.concatenate([[self.inside], after[:-1]])) & (pc.utf8_length(texts).to_numpy() > 0)
        part = self.part + np.cumsum(opens)
        before = np.cumsum(is_value) - is_value
        begins = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), -1))
        index = before - np.where(begins >= 0, before[begins], -self.seen)
        self.head += int(is_value[part == 0].sum())
        fields, names, done = [], [], 0
        for i in [*np.flatnonzero(opens | objects).tolist(), len(pieces)]:
            held = int(is_value[done:i].sum())
            fields += [self.field] * held
            names += [self.name] * held
            done = i
            if i < len(pieces):
                text = pieces[i].as_py()
                for pattern, target in ((_OBJECT, "field"), (_ARRAY, "name")):
                    if found := pattern.findall(text):
                        setattr(self, target, json.loads(f'"{found[-1]}"'))
        self.seen = int(index[-1] + is_value[-1])
        self.part, self.inside, self.sure = int(part[-1]), bool(after[-1]), self.sure or bool((events >= 0).any())
        return is_value, texts, part, index, fields, names


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scans: dict[tuple[str, int], _Scan] = {}
    for key, _, _, pieces in stretches(batches):
        scans.setdefault(key, _Scan()).feed(pieces.cast(pa.string()))
    if scans:
        rows = [(f, b, s.part > 0, s.seen, s.head, s.inside, s.sure, s.field, s.name) for (f, b), s in scans.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
        names = ["file", "block", "opened", "seen", "head", "inside", "sure", "field", "name"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = _Scan()
    for key, new, _, pieces in stretches(batches):
        scan = _Scan() if new else scan
        is_value, texts, part, index, fields, names = scan.feed(pieces.cast(pa.string()))
        at = np.flatnonzero(is_value)
        if len(at):
            cells = [pa.array([key[0]] * len(at)), pa.array(np.full(len(at), key[1])), pa.array(part[at] == 0), pa.array(index[at])]
            cells += [pa.array(fields, pa.string()), pa.array(names, pa.string()), texts.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(cells, names=["file", "block", "goes_on", "index", "field", "name", "value"])


def read_arrays(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """``(document, field, array, position, value)``: every value of the arrays ``{field: {array: [values]}}`` below ``path``.

    ``document`` is the folder of the files. ``value`` is text, null for a JSON null. Files are read in the parts that
    Spark reads text files in, twice: once for what each part holds, in one row, and once for the values, which are not
    shuffled. Values are numbers, flags, null, or strings without commas, brackets and braces; arrays of arrays are not read.
    """
    raw = spark.read.option("lineSep", ",").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    document = F.regexp_replace("file", "/[^/]*$", "")
    kinds = "opened boolean, seen long, head long, inside boolean, sure boolean, field string, name string"
    parts = pieces.mapInArrow(_summaries, f"file string, block long, {kinds}").withColumn("document", document)
    stream = Window.partitionBy("document").orderBy("file", "block")
    earlier, upto = stream.rowsBetween(Window.unboundedPreceding, -1), stream.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.struct("seen", F.sum("head").over(upto).alias("heads"))
    known = parts.withColumn("_opened", F.when(F.col("opened"), opened))
    known = known.select(
        F.col("file").alias("f"),
        F.col("block").alias("b"),
        F.coalesce(F.last(F.when(F.col("sure"), F.col("inside")), ignorenulls=True).over(earlier), F.lit(False)).alias("inside"),
        F.last("field", ignorenulls=True).over(earlier).alias("open_field"),
        F.last("name", ignorenulls=True).over(earlier).alias("open_name"),
        F.last("_opened", ignorenulls=True).over(earlier).alias("_opened"),
        F.sum("head").over(earlier).alias("heads"),
    )
    known = known.withColumn("base", F.col("_opened.seen") + F.col("heads") - F.col("_opened.heads")).drop("_opened", "heads")
    kinds = "file string, block long, goes_on boolean, index long, field string, name string, value string"
    values = pieces.mapInArrow(_values, kinds)
    found = values.join(F.broadcast(known), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left")
    # a value in a part that no row tells of would be lost; inside is null for it
    lost = F.raise_error(F.lit("the parts of the files changed between two scans; set spark.sql.files.minPartitionNum"))
    found = found.where(F.when(F.col("inside").isNull(), lost.cast("boolean")).otherwise(~F.col("goes_on") | F.col("inside")))
    position = F.col("index") + F.when(F.col("goes_on"), F.col("base")).otherwise(0)
    rows = found.select(
        document.alias("document"),
        F.coalesce("field", "open_field").alias("field"),
        F.when(F.col("goes_on"), F.col("open_name")).otherwise(F.col("name")).alias("array"),
        position.alias("position"),
        F.when(F.col("value") != "null", F.col("value")).alias("value"),
    )
    return rows if field is None else rows.where(F.col("field") == field)
