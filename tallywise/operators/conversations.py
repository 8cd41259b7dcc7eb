"""Prompts of conversations: rendered turn by turn, with their place in the prompt, however long a conversation is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywise.functions.prompts import ChatTemplate, fill_template
from tallywise.operators.scratch import durable


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows ``conv, …, n_chars``: the task, the characters before the row in the task's part of its
    conversation, whether the row is the task's first, and whether it is the last of its conversation in the task.

    What is carried from batch to batch is one conversation id and one number; a batch waits for the next one's first row.
    """
    slot, carried, waiting = TaskContext.get().partitionId(), 0, None

    def tagged(b: pa.RecordBatch, start: np.ndarray, last: np.ndarray, first: bool) -> pa.RecordBatch:
        n = b.num_rows
        firsts = np.zeros(n, bool)
        firsts[0] = first
        added = [pa.array(np.full(n, slot, np.int32)), pa.array(start), pa.array(firsts), pa.array(last)]
        return pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "_slot", "_start", "_first", "_last"])

    number = 0
    for b in batches:
        if not b.num_rows:
            continue
        convs, lengths = b.column("conv"), b.column("n_chars").to_numpy()
        codes = convs.dictionary_encode(null_encoding="encode").indices.to_numpy()
        last = np.append(np.diff(codes) != 0, True)
        goes_on = waiting is not None and waiting[0].column("conv")[-1].as_py() == convs[0].as_py()
        if waiting is not None:
            waiting[2][-1] = not goes_on
            yield tagged(*waiting, first=number == 1)
        before = np.cumsum(lengths) - lengths
        begins = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
        run = np.searchsorted(begins, np.arange(len(last)), side="right") - 1
        start = before - before[begins[run]] + np.where(run == 0, carried if goes_on else 0, 0)
        carried = int(start[-1] + lengths[-1])
        waiting, number = (b, start, last), number + 1
    if waiting is not None:
        yield tagged(*waiting, first=number == 1)


def render_conversations(
    turns: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    add_generation_prompt: bool = True,
    enable_thinking: bool = True,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_col, turn_col, start, n_chars, piece``: the part of each turn in its conversation's prompt, and its place.

    The pieces of a conversation, put together by ``start``, are its prompt; the last one holds the opening of the answer.
    Rows are range partitioned by conversation and turn, so that a long conversation lies in several tasks; each
    counts on from row to row, and only the sums of conversations that cross from task to task are put together after.
    No conversation is gathered, neither in an array nor in a task.

    A null role or text counts as empty. Rows with a null conversation make one of their own. Turns with equal numbers
    are ordered by role and text (by a hash of both); null turns come first. Other columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("tie"),
        F.concat(fill_template(template.opening, {"role": role}), text, F.lit(template.closing)).alias("piece"),
    ).withColumn("n_chars", F.length("piece").cast("long"))
    order = ["conv", "turn", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    placed = durable(ranged.mapInArrow(_placed, f"{fields}, _slot int, _start long, _first boolean, _last boolean"), "turns")
    # a conversation that began in an earlier task is the first one of its later tasks: one id a task at most
    across = placed.where("_first").select(F.col("conv").alias("c")).distinct()
    parts = placed.join(F.broadcast(across), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    parts = parts.groupBy("conv", "_slot").agg(F.sum("n_chars").alias("n"))
    by_slot = Window.partitionBy("conv").orderBy("_slot")
    parts = parts.select(
        F.col("conv").alias("c"),
        F.col("_slot").alias("s"),
        F.sum("n").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)).alias("base"),
        F.lead("_slot").over(by_slot).isNotNull().alias("more"),
    )
    found = placed.join(F.broadcast(parts), F.col("conv").eqNullSafe(F.col("c")) & (F.col("_slot") == F.col("s")), "left")
    end = ""
    if add_generation_prompt:
        end = template.generation + ("" if enable_thinking else template.no_thinking)
    ends = F.col("_last") & ~F.coalesce("more", F.lit(False))
    piece = F.when(ends, F.concat("piece", F.lit(end))).otherwise(F.col("piece"))
    return found.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        (F.col("_start") + F.coalesce("base", F.lit(0))).alias("start"),
        F.length(piece).cast("long").alias("n_chars"),
        piece.alias("piece"),
    )


def recent_prompts(rendered: DataFrame, max_chars: int, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col, n_turns, n_chars, prompt``: the last whole turns of every conversation that fit ``max_chars``.

    At most that many characters of a conversation meet; one whose last turn alone is longer has an empty prompt.
    """
    size = rendered.groupBy(F.col(conv_col).alias("_conv")).agg(F.max(F.col("start") + F.col("n_chars")).alias("_size"))
    kept = rendered.join(size, F.col(conv_col).eqNullSafe(F.col("_conv")))
    fits = F.col("start") >= F.col("_size") - max_chars
    # rows that don't fit only say that there is a conversation; they are counted where they are
    pieces = F.array_sort(F.collect_list(F.when(fits, F.struct("start", "piece"))))
    return kept.groupBy(conv_col).agg(
        F.count_if(fits).alias("n_turns"),
        F.coalesce(F.sum(F.when(fits, F.col("n_chars"))), F.lit(0)).alias("n_chars"),
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("prompt"),
    )
