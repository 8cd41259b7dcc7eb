"""Salvage of damaged CSV files: the longest clean prefix of lines of every file.

A line is judged by what it does to the quote state: it is either inside an open quoted field when it ends or not, and
that depends only on whether it began inside one. Each line is thus a small function of the state before it. Functions
are combined inside a file block first, then over the blocks of a file, so neither a file nor the set of lines has to
pass through one task; the blocks of a file are few.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywise.operators.scratch import durable

_STOP = "\x01"
# a quoted field up to its closing quote and the rest of the field, or up to the end of the line
_QUOTED = r'(^|,)"[^"\x01]*+(?:""[^"\x01]*+)*+(?:"[^,\x01]*|\x01)'


def _scan(line: Column) -> tuple[Column, Column]:
    """(ends inside quotes, number of delimiters outside quotes) for a line that begins outside quotes."""
    bare = F.regexp_replace(F.concat(line, F.lit(_STOP)), _QUOTED, "$1")
    return ~bare.endswith(_STOP), F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, pos, line)``: lines of text files with their place. ``pos`` is ordered within a block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def _carry(closed: Column, opened: Column, w) -> tuple[Column, Column]:
    """End state of a run of lines for either start state, as (after closed start, after open start)."""
    fixed = F.when(closed == opened, closed)
    flips = F.sum(F.when(closed & ~opened, 1).otherwise(0)).over(w)
    last = F.last(fixed, ignorenulls=True).over(w)
    since = flips - F.coalesce(F.last(F.when(fixed.isNotNull(), flips), ignorenulls=True).over(w), F.lit(0))
    odd = since % 2 == 1
    return F.coalesce(last, F.lit(False)) != odd, F.coalesce(last, F.lit(True)) != odd


def _judged_lines(lines: DataFrame, with_text: bool) -> DataFrame:
    """Lines with the quote state before and after them and their delimiter count.

    Written once: the places of lines must not move between the jobs that compare them.
    """
    end_closed, commas_closed = _scan(F.col("line"))
    end_open, commas_open = _scan(F.concat(F.lit('"'), F.col("line")))
    scanned = lines.withColumns(
        {
            "_c": end_closed,
            "_o": end_open,
            "_dc": commas_closed,
            "_do": commas_open,
            "blank": F.trim(F.replace(F.col("line"), F.lit("\t"), F.lit(" "))) == "",
        }
    )
    in_block = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    after_c, after_o = _carry(F.col("_c"), F.col("_o"), in_block)
    scanned = scanned.withColumns({"_ac": after_c, "_ao": after_o})
    blocks = scanned.groupBy("file", "block").agg(
        F.max_by("_ac", "pos").alias("_ac"), F.max_by("_ao", "pos").alias("_ao")
    )
    in_file = Window.partitionBy("file").orderBy("block")
    block_after, _ = _carry(F.col("_ac"), F.col("_ao"), in_file.rowsBetween(Window.unboundedPreceding, 0))
    starts = blocks.withColumn("_end", block_after).select(
        "file", "block", F.coalesce(F.lag("_end").over(in_file), F.lit(False)).alias("_start")
    )
    joined = scanned.join(starts, ["file", "block"])
    joined = joined.withColumn("after", F.when(F.col("_start"), F.col("_ao")).otherwise(F.col("_ac")))
    before = F.coalesce(F.lag("after").over(Window.partitionBy("file", "block").orderBy("pos")), F.col("_start"))
    joined = joined.withColumn("before", before)
    delimiters = F.when(F.col("before"), F.col("_do")).otherwise(F.col("_dc"))
    kept = [c for c in ("line",) if with_text]
    place = F.struct("block", "pos").alias("place")
    judged = joined.select("file", place, "before", "after", "blank", delimiters.alias("delimiters"), *kept)
    return durable(judged, "judged-lines")


def _records(judged: DataFrame) -> DataFrame:
    """One row per record: the place of its first line, its number of fields, whether it is blank."""
    block = F.col("place.block")
    begins = F.when(~F.col("before"), F.col("place"))
    in_block = Window.partitionBy("file", block).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    tagged = judged.withColumn("_local", F.last(begins, ignorenulls=True).over(in_block))
    blocks = tagged.groupBy("file", block.alias("block")).agg(F.max("_local").alias("_last"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", F.last("_last", ignorenulls=True).over(in_file).alias("_carried"))
    tagged = tagged.withColumn("block", block).join(carried, ["file", "block"])
    return tagged.groupBy("file", F.coalesce("_local", "_carried").alias("record")).agg(
        (F.sum("delimiters") + 1).alias("fields"), F.min("blank").alias("blank")
    )


def _per_block(judged: DataFrame, per_file: DataFrame) -> DataFrame:
    """``per_file`` repeated for every block of the file: rows then meet it by file and block, not all rows of a large file
    in one task."""
    return judged.select("file", F.col("place.block").alias("block")).distinct().join(per_file, "file")


def _with_file(judged: DataFrame, rows: DataFrame, block: Column, per_file: DataFrame, how: str = "inner") -> DataFrame:
    blocks = _per_block(judged, per_file)
    return rows.withColumn("block", block).join(blocks, ["file", "block"], how).drop("block")


def _cut(judged: DataFrame) -> DataFrame:
    """``(file, cut)``: the place of the last kept line, null where not even the header is clean."""
    records = _records(judged).where(~F.col("blank"))
    header = records.groupBy("file").agg(F.min_by("fields", "record").alias("width"))
    surplus = _with_file(judged, records, F.col("record.block"), header).where(F.col("fields") > F.col("width"))
    bad = surplus.groupBy("file").agg(F.min("record").alias("bad"))
    clean = ~F.col("after") & (F.col("bad").isNull() | (F.col("place") < F.col("bad")))
    placed = _with_file(judged, judged, F.col("place.block"), bad, "left")
    return placed.groupBy("file").agg(F.max(F.when(clean, F.col("place"))).alias("cut"))


def salvage_report(spark: SparkSession, path: str) -> DataFrame:
    """``(file, rows_kept, lines_removed, aborted)``; aborted files have no clean header and are left as they are."""
    judged = _judged_lines(read_lines(spark, path), with_text=False)
    placed = _with_file(judged, judged, F.col("place.block"), _cut(judged))
    kept = F.coalesce(F.col("place") <= F.col("cut"), F.lit(False))
    starts = kept & ~F.col("before") & ~F.col("blank")
    return placed.groupBy("file").agg(
        F.greatest(F.count_if(starts) - 1, F.lit(0)).alias("rows_kept"),
        F.count_if(~kept).alias("lines_removed"),
        F.max("cut").isNull().alias("aborted"),
    )


def salvaged_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, place, line)`` of every kept line; sorted by these columns they are the clean files."""
    judged = _judged_lines(read_lines(spark, path), with_text=True)
    placed = _with_file(judged, judged, F.col("place.block"), _cut(judged))
    return placed.where(F.col("cut").isNull() | (F.col("place") <= F.col("cut"))).select("file", "place", "line")


def write_salvaged(spark: SparkSession, path: str, target: str) -> None:
    """Clean copies below ``target``, one folder per file, named by its place below ``path``.

    Sorted part files of a folder follow one another.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().toString().rstrip("/")
    root = re.sub("^file:/+", "file:/", root)
    file = F.regexp_replace("file", "^file:/+", "file:/")
    place = F.when(file.startswith(root + "/"), F.substr(file, F.lit(len(root) + 2))).otherwise(file)
    ordered = salvaged_lines(spark, path).repartitionByRange("file", "place").sortWithinPartitions("file", "place")
    ordered.select(place.alias("name"), F.col("line").alias("value")).write.partitionBy("name").text(target)
