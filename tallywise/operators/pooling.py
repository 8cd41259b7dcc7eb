"""Pooling of repeated answers: one vote per document from several runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and labels of the pooling modes. A mode without a number of runs uses all of them.
POOLING_MODES = (
    ("all", "all models", "concatenation", None),
    ("single", "single model", "single", None),
    ("maj_3", "maj-pooling-3", "majority", 3),
    ("maj_5", "maj-pooling-5", "majority", 5),
    ("maj_10", "maj-pooling-10", "majority", 10),
)


def modes_for(n_runs: int) -> list[tuple[str, str]]:
    """(name, label) of every mode that ``n_runs`` runs allow."""
    fitting = [(name, label) for name, label, _, needed in POOLING_MODES if needed is None or needed <= n_runs]
    return [(n, f"all {n_runs} models" if n == "all" else label) for n, label in fitting]


def wide_to_votes(df: DataFrame, id_cols: Sequence[str], prefix: str = "mRS_") -> DataFrame:
    """Columns ``{prefix}000``, ``{prefix}001`` ... to rows ``(id, run_idx, pred)``."""
    columns = [c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d+", c)]
    long = df.unpivot(list(id_cols), columns, "_column", "pred")
    run = F.regexp_extract("_column", r"(\d+)$", 1).cast("int")
    return long.select(*id_cols, run.alias("run_idx"), "pred")


def _tallies(votes: DataFrame, by: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Count of each distinct vote per document, for the first k runs and for all runs."""
    counts = [F.count_if(F.col("run_idx") < k).alias(f"_n{k}") for k in ks]
    return votes.groupBy(*by, "pred").agg(
        *counts,
        F.count("*").alias("_n"),
        F.min("run_idx").alias("_first"),
        F.max("label").alias("label"),
    )


def _winner(count: str) -> Column:
    """The most frequent vote; of equally frequent ones the vote seen first in run order.

    Count and first run share one number: a primitive sort key lets the aggregation stay hash based.
    """
    key = F.col(count) * F.lit(2**32) - F.col("_first")
    return F.max_by("pred", F.when(F.col(count) > 0, key))


def pool(votes: DataFrame, mode: str, k: int | None = None, by: Sequence[str] = ("row_id",)) -> DataFrame:
    """Pool ``(by…, run_idx, label, pred)`` rows. ``k`` restricts to the first k runs where that many exist."""
    if mode not in ("single", "concatenation", "majority"):
        raise ValueError(f"votes can't be pooled by {mode!r}: choose single, concatenation or majority")
    if mode == "single":
        return votes.where(F.col("run_idx") == 0).select(*by, "label", "pred")
    if k is not None and k > 0:
        votes = votes.where(F.col("run_idx") < k)
    if mode == "concatenation":
        return votes.select(*by, "run_idx", "label", "pred")
    return (
        _tallies(votes, by, []).groupBy(*by).agg(F.max("label").alias("label"), _winner("_n").alias("pred"))
    )


def pooled_wide(votes: DataFrame, n_runs: int, by: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row per document with the pooled vote of every mode, and its sums over all votes, in one plan.

    Votes are first counted per document and value, so what the second grouping receives no longer depends on the
    number of runs. ``has_…`` tells whether a document has a vote in the mode's runs at all, also a missing one. The sums
    ``n_votes``, ``n_present``, ``n_wrong`` and ``sum_distance`` cover the mode that keeps every vote.
    """
    ks = [needed for _, _, _, needed in POOLING_MODES if needed is not None and needed <= n_runs]
    off = F.col("pred") - F.col("label")
    return (
        _tallies(votes, by, ks)
        .groupBy(*by)
        .agg(
            F.max("label").alias("label"),
            F.max(F.when(F.col("_first") == 0, F.col("pred"))).alias("single"),
            F.max(F.col("_first") == 0).alias("has_single"),
            *[_winner(f"_n{k}").alias(f"maj_{k}") for k in ks],
            *[F.max(F.col(f"_n{k}") > 0).alias(f"has_maj_{k}") for k in ks],
            F.sum("_n").alias("n_votes"),
            F.sum(F.when(off.isNotNull(), F.col("_n")).otherwise(0)).alias("n_present"),
            F.sum(F.when(off == 0, 0).otherwise(F.col("_n"))).alias("n_wrong"),
            F.sum(F.abs(off) * F.col("_n")).alias("sum_distance"),
        )
    )


def pooled_long(votes: DataFrame, n_runs: int, by: Sequence[str] = ("row_id",)) -> DataFrame:
    """``(by…, mode, label, pred, weight)`` for every mode, in one plan.

    The mode that keeps all votes has one row per document and distinct vote, with the number of such votes as its
    weight; the other modes have one row of weight 1 per document that has a vote in their runs.
    """
    ks = [needed for _, _, _, needed in POOLING_MODES if needed is not None and needed <= n_runs]
    row = "struct<mode:string,pred:int,weight:bigint>"
    pooled = [("single", F.max(F.when(F.col("_first") == 0, F.col("pred"))), F.max(F.col("_first") == 0))]
    pooled += [(f"maj_{k}", _winner(f"_n{k}"), F.max(F.col(f"_n{k}") > 0)) for k in ks]
    chosen = [F.when(there, F.struct(F.lit(name), value, F.lit(1)).cast(row)) for name, value, there in pooled]
    # one entry per distinct vote of a document: no more than there are runs
    every = F.collect_list(F.struct(F.lit("all"), F.col("pred"), F.col("_n")).cast(row))
    rows = _tallies(votes, by, ks).groupBy(*by).agg(
        F.max("label").alias("label"), F.filter(F.concat(F.array(*chosen), every), lambda r: r.isNotNull()).alias("_rows")
    )
    return rows.select(*by, "label", F.inline("_rows"))


def consensus_table(votes: DataFrame, n_runs: int, keep: DataFrame | None = None, id_col: str = "row_id") -> DataFrame:
    """``pred_1`` and ``pred_maj_3/5/10`` per document; null where there are too few runs."""
    wide = pooled_wide(votes, n_runs, [id_col])
    needed = {name: k for name, _, _, k in POOLING_MODES if k is not None}
    columns = [F.col("single").alias("pred_1")]
    for name, k in needed.items():
        value = F.col(name) if k <= n_runs else F.lit(None).cast("int")
        columns.append(value.alias(f"pred_{name}"))
    out = wide.select(id_col, "label", *columns)
    return out if keep is None else keep.join(out.drop("label"), id_col)
