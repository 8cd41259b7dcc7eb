"""Raters in rows: from a wide table with one column per rater to rater or pair rows and their cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.operators.prepare import broad_class
from tallywise.operators.scoring import cells, class_scores, rater_metrics


def against_expert(
    df: DataFrame, expert: str, raters: Sequence[str], keep: Sequence[str] = (), complete_only: bool = False
) -> DataFrame:
    """``(keep…, rater, y, p)``: the expert's score beside each rater's, from one scan.

    ``complete_only`` leaves out rows where the expert or any rater has no score.
    """
    pairs = F.array(
        *[F.struct(F.lit(r).alias("rater"), F.col(expert).alias("y"), F.col(r).alias("p")) for r in raters]
    )
    if complete_only:  # no filter: the optimizer's reasoning about many not-null columns would take longer than the query
        missing = F.greatest(*[F.col(c).isNull() for c in (expert, *raters)])
        pairs = F.when(~missing, pairs)
    return df.select(*keep, F.inline(pairs))


def rater_cells(df: DataFrame, expert: str, raters: Sequence[str]) -> DataFrame:
    """Cells of each rater against the expert, from one pass over the data.

    Rows are laid out by rater first and counted map-side then: whatever the number of raters, a task passes on at most
    raters x labels x labels rows.
    """
    return cells(against_expert(df, expert, raters), "y", "p", ["rater"])


def pair_cells(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Cells of named rater pairs; rows where either rating is missing are dropped pair by pair."""
    rows = [
        F.struct(F.lit(name).alias("category"), F.col(a).alias("y"), F.col(b).alias("p"))
        for name, (a, b) in pairs.items()
    ]
    return cells(df.select(F.inline(F.array(*rows))), "y", "p", ["category"])


def inter_rater(counted: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Kappa, mean absolute error and exact accuracy per pair. A pair without complete rows has no row."""
    return rater_metrics(counted, by).drop("tol1_acc")


def self_cells(
    votes: DataFrame, runs: tuple[int, int] = (0, 9), id_cols: Sequence[str] = ("row_id",), by: Sequence[str] = ()
) -> DataFrame:
    """Cells of two runs of one model against each other; documents missing in either run are dropped."""
    first, second = runs
    sides = (
        votes.where(F.col("run_idx").isin(first, second))
        .groupBy(*by, *id_cols)
        .agg(
            F.max(F.when(F.col("run_idx") == first, F.col("pred"))).alias("_a"),
            F.max(F.when(F.col("run_idx") == second, F.col("pred"))).alias("_b"),
        )
    )
    return cells(sides, "_a", "_b", by)


def broad_class_cells(df: DataFrame, expert: str, raters: Sequence[str]) -> DataFrame:
    """Cells over the broad classes, for rows where the expert and every rater have a score."""
    pairs = against_expert(df, expert, raters, complete_only=True)
    mapped = pairs.select("rater", broad_class(F.col("y")).alias("y"), broad_class(F.col("p")).alias("p"))
    return cells(mapped, "y", "p", ["rater"])


def broad_class_metrics(df: DataFrame, expert: str, raters: Sequence[str]) -> DataFrame:
    return class_scores(broad_class_cells(df, expert, raters))
