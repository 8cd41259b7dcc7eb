"""Incremental work: which documents are still to do, resumable batch runs, streaming extraction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallywise.functions.extraction import extract_structured
from tallywise.operators.scratch import durable
from tallywise.streaming.journal import ATTEMPT, Journal


def pending(letters: DataFrame, done: DataFrame, key: str | Sequence[str] = "input_text") -> DataFrame:
    """Rows of ``letters`` whose key has no row in ``done``. A row with a null in its key is always pending.

    Text keys are compared by digest: the shuffle of the done side then carries one short value per distinct text, and
    repeated texts collapse map-side before it. Null keys stay out of the join, where they would all meet in one task.
    """
    keys, types = [key] if isinstance(key, str) else list(key), dict(letters.dtypes)
    short = {f"_key{i}": F.sha2(F.col(k), 256) if types[k] == "string" else F.col(k) for i, k in enumerate(keys)}
    known = [F.col(k).isNotNull() for k in keys]
    whole = reduce(lambda x, y: x & y, known)
    seen = done.where(whole).select(*[c.alias(n) for n, c in short.items()]).distinct()
    left = letters.where(whole).withColumns(short).join(seen, list(short), "left_anti").drop(*short)
    return left.union(letters.where(~whole))


def finished_rows(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Epoch of a run and the rows that count in it, of all its attempts; other folders are never read."""
    journal = Journal(spark, path)
    entries = journal.entries()
    rows = journal.rows(entries)
    return max((e.epoch for e in entries), default=0), rows if rows is None else rows.drop(ATTEMPT)


def _fine(rows: DataFrame) -> Column:
    return F.col("error").isNull() if "error" in rows.columns else F.lit(True)


def _rows_of_attempts(rows: DataFrame, keys: list[str], identity: list[str], rows_per_key: int) -> DataFrame:
    """``(keys…, attempt, whole)``: whether the attempt has all rows of the key without an error."""
    found = F.count_distinct(F.when(_fine(rows), F.struct(*identity)))
    return rows.groupBy(*keys, ATTEMPT).agg((found >= rows_per_key).alias("_whole"))


def latest_attempts(rows: DataFrame, keys: list[str], identity: list[str], rows_per_key: int) -> DataFrame:
    """Of every key the rows of one attempt: the last one that is whole, else the last one. Rows of two attempts never mix.

    Only keys with several attempts are looked up again; those are written, so that the optimizer knows their number.
    """
    if rows.select(ATTEMPT).distinct().limit(2).count() < 2:
        return rows.drop(ATTEMPT)
    each = _rows_of_attempts(rows, keys, identity, rows_per_key)
    best = F.max(F.struct(F.col("_whole"), F.col(ATTEMPT).alias("attempt")))["attempt"]
    tried = each.groupBy(*keys).agg(F.collect_set(ATTEMPT).alias("_tried"), best.alias("_best")).where(F.size("_tried") > 1)
    left = tried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(F.array_remove("_tried", F.col("_best"))).alias("_left"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    matched = reduce(lambda x, y: x & y, same, F.col(ATTEMPT) == F.col("_left"))
    return rows.join(durable(left, "replaced"), matched, "left_anti").drop(ATTEMPT)


def run_resumable(
    letters: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    path: str,
    key: str | Sequence[str] = "row_id",
    identity: Sequence[str] | None = None,
    rows_per_key: int = 1,
    chunks: int = 1,
    resume: bool = True,
    batch_rows: int | None = None,
) -> DataFrame:
    """Process the pending rows into ``path`` and return the whole table.

    Every call is an attempt with a number of its own, taken from the folder's journal; its rows go to folders that only
    the journal names. A chunk counts once its entry is written: what a crash leaves half done is never read, and its
    rows are pending again. With ``batch_rows``, each task works on about that many rows and commits its result when it
    is done, so that a crash loses the batches under way and no others; ``process`` must then work row by row, without a
    shuffle. (Tasks commit by the file output committer's algorithm 2: a task's file gets its place by one rename, under
    the name of its partition, so that of several attempts of a task one is there.)

    A key is done when one attempt has ``rows_per_key`` rows of it, told apart by ``identity``, without an error (column
    ``error``, if there is one); otherwise its row of ``letters`` is processed again. Of every key the result has the rows
    of one attempt: the last whole one, else the last. So two runs that work on one folder at a time lose and double
    nothing. Without ``resume`` the run starts a new epoch, and earlier ones count no more. Rows with a null key are
    processed every time.
    """
    keys = [key] if isinstance(key, str) else list(key)
    identity = [*keys, *[c for c in identity or () if c not in keys]]
    journal = Journal(letters.sparkSession, path)
    begun = journal.begin(resume, chunks, batch_rows is not None)
    done, todo = journal.rows(journal.entries(), before=begun) if resume else None, letters
    if done is not None:
        each = _rows_of_attempts(done, keys, identity, rows_per_key)
        todo = pending(letters, each.where("_whole").select(*keys), keys)
    number = F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int")
    sizes = dict(todo.groupBy(number).count().collect()) if batch_rows else {}
    for chunk in range(chunks):
        part, options = todo.where(number == chunk) if chunks > 1 else todo, {}
        if batch_rows:
            part = part.repartition(max(1, -(-sizes.get(chunk, 0) // batch_rows)))
            options = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
        process(part).write.options(**options).parquet(f"{journal.path}/{begun.folder(chunk)}")
        journal.finish(begun, chunk)
    return latest_attempts(journal.rows(journal.entries()), keys, identity, rows_per_key)


def stream_extract(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    text_col: str = "output_text",
    record: str = "PatientInfoSchema",
    columns: Sequence[str] = ("row_id", "run_idx", "label"),
    max_files: int = 1000,
):
    """Start extraction over the files that arrive in ``source`` and drain what is there.

    Each micro-batch writes its own ``batch_id`` folder, replacing it when a batch is run again after a failure: every
    answer is in the target once. Returns the query; ``awaitTermination`` ends when the backlog is done.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    records = extract_structured(arriving, text_col, record).select(*columns, "record", "status", "valid")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
