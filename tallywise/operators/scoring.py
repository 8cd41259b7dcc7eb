"""Scores of predictions against ordinal labels, and the contingency cells that most statistics start from."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.operators.pooling import modes_for, pooled_wide
from tallywise.operators.prepare import UNLABELLED, label_or_sentinel

LABELS = tuple(range(0, 7))
LABELS_WITH_SENTINEL = (UNLABELLED, *LABELS)


def joint_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts ``n`` of each combination of a few ordinal columns, nulls included.

    Meant for a handful of raters: with labels 0-6 four raters make at most 8^4 rows. Statistics over those columns
    then read this table, and the data are passed over once.
    """
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def cells(
    df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Counts ``n`` of each pair ``(y, p)`` per group: at most labels x labels rows per group.

    One map-side combined aggregation. Every statistic of a pair of raters depends on the pair counts only, so this is
    the last step that sees single rows. ``weight`` names the count column of an already counted input.
    """
    return (
        df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
        .groupBy(*by, F.col(y_true).alias("y"), F.col(y_pred).alias("p"))
        .agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    )



def weighted_mean(value: Column) -> Column:
    return F.sum(value * F.col("n")) / F.sum("n")


def error_distance(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Error rate and mean absolute distance over labelled rows. Predictions of -1 count as errors; no rows give NaN.

    A missing prediction is wrong, and has no distance: ``n`` rows make the error rate, ``n_distance`` the distance.
    """
    scored = df.withColumn("_y", label_or_sentinel(label))
    labelled = F.col("_y") != UNLABELLED
    distance = F.when(labelled, F.abs(F.col("_y") - F.col(pred)))
    wrong = F.when(labelled, (~F.col("_y").eqNullSafe(F.col(pred))).cast("int"))
    return scored.groupBy(*by).agg(
        F.count_if(labelled).alias("n"),
        F.count(distance).alias("n_distance"),
        F.coalesce(F.avg(wrong), F.lit(float("nan"))).alias("error_rate"),
        F.coalesce(F.avg(distance), F.lit(float("nan"))).alias("distance"),
    )


def metrics_by_mode(votes: DataFrame, n_runs: int, by: Sequence[str] = (), id_col: str = "row_id") -> DataFrame:
    """``(by…, mode, label, n, n_distance, error_rate, distance)`` for every pooling mode, from one pass over the votes.

    A missing vote is a vote like any other; where it is the outcome of a mode it counts as ``error_distance`` says.
    """
    labelled = votes.where(F.col("label").isNotNull() & (F.col("label") != UNLABELLED))
    wide = pooled_wide(labelled, n_runs, [*by, id_col])
    modes = modes_for(n_runs)
    sums = [
        F.sum("n_votes").alias("all_n"),
        F.sum("n_present").alias("all_p"),
        F.sum("n_wrong").alias("all_e"),
        F.sum("sum_distance").alias("all_d"),
    ]
    for name, _ in modes:
        if name != "all":
            there, off = F.col(f"has_{name}"), F.abs(F.col(name) - F.col("label"))
            sums += [
                F.count_if(there).alias(f"{name}_n"),
                F.count(off).alias(f"{name}_p"),
                F.count_if(there & ~F.col(name).eqNullSafe(F.col("label"))).alias(f"{name}_e"),
                F.sum(off).alias(f"{name}_d"),
            ]
    totals = wide.groupBy(*by).agg(*sums)
    rows = [
        F.struct(
            F.lit(name).alias("mode"),
            F.lit(label).alias("mode_label"),
            F.coalesce(f"{name}_n", F.lit(0)).alias("n"),
            F.coalesce(f"{name}_p", F.lit(0)).alias("n_distance"),
            F.coalesce(F.try_divide(f"{name}_e", f"{name}_n"), F.lit(float("nan"))).alias("error_rate"),
            F.coalesce(F.try_divide(f"{name}_d", f"{name}_p"), F.lit(float("nan"))).alias("distance"),
        )
        for name, label in modes
    ]
    return totals.select(*by, F.inline(F.array(*rows)))


def confusion_matrix(
    counted: DataFrame, labels: Sequence = LABELS_WITH_SENTINEL, by: Sequence[str] = ()
) -> DataFrame:
    """Cells over a fixed label list, zeros included; pairs outside the list are left out.

    Per group at most labels x labels counts are gathered, and the grid is laid over them.
    """
    grid = F.array(*[F.lit(x) for x in labels])
    listed = F.col("y").isin(*labels) & F.col("p").isin(*labels)
    pair = F.struct(F.concat_ws("|", "y", "p"), "n")
    gathered = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(listed, pair))).alias("_cells"))
    full = gathered.select(*by, "_cells", F.explode(grid).alias("y")).select("*", F.explode(grid).alias("p"))
    n = F.try_element_at("_cells", F.concat_ws("|", "y", "p"))
    return full.select(*by, "y", "p", F.coalesce(n, F.lit(0)).alias("n"))


def accuracy_metrics() -> list[Column]:
    """Aggregates over cells: mean absolute error, exact accuracy and accuracy within one point."""
    off = F.abs(F.col("y") - F.col("p"))
    return [
        weighted_mean(off).alias("mae"),
        weighted_mean((off == 0).cast("int")).alias("exact_acc"),
        weighted_mean((off <= 1).cast("int")).alias("tol1_acc"),
    ]


def _placed(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells with ``i`` and ``j``: the places of y and p among the labels present in the group.

    The window sees cells, not rows.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    present = F.array_union(F.collect_set("y").over(group), F.collect_set("p").over(group))
    scaled = counted.withColumn("_scale", F.array_sort(present))
    place = {c: F.array_position("_scale", F.col(v)).cast("double") for c, v in (("i", "y"), ("j", "p"))}
    return scaled.withColumns(place).drop("_scale")


def _kappa() -> Column:
    """Kappa from moments of the places; it equals the definition by observed and expected weight matrices."""
    i, j = F.col("i"), F.col("j")
    mean_i, mean_j = weighted_mean(i), weighted_mean(j)
    var_i, var_j = weighted_mean(i**2) - mean_i**2, weighted_mean(j**2) - mean_j**2
    expected = var_i + var_j + (mean_i - mean_j) ** 2
    observed = weighted_mean((i - j) ** 2)
    return F.when(expected > 1e-12, 1 - observed / expected).otherwise(F.lit(float("nan")))


def quadratic_kappa(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quadratic weighted kappa per group of cells.

    Categories are numbered by the sorted union of the labels present, so an unused label does not widen the scale.
    One category only gives NaN.
    """
    return _placed(counted, by).groupBy(*by).agg(_kappa().alias("qwk"))


def rater_metrics(counted: DataFrame, by: Sequence[str] = ("rater",)) -> DataFrame:
    """Kappa, mean absolute error, exact accuracy and accuracy within one point per group of cells."""
    n = F.sum("n").alias("n")
    return _placed(counted, by).groupBy(*by).agg(n, *accuracy_metrics(), _kappa().alias("qwk"))


def class_scores(counted: DataFrame, by: Sequence[str] = ("rater",)) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 per group of cells; a class is any value of y or p."""
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.lit(True).alias("is_true")),
        F.struct(F.col("p").alias("label"), F.lit(False).alias("is_true")),
    )
    hit = F.col("y") == F.col("p")
    per_class = (
        counted.select(*by, "n", hit.alias("hit"), F.inline(sides))
        .groupBy(*by, "label")
        .agg(
            F.sum(F.when(F.col("is_true") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("is_true"), F.col("n")).otherwise(0)).alias("n_true"),
            F.sum(F.when(~F.col("is_true"), F.col("n")).otherwise(0)).alias("n_pred"),
        )
        .withColumn("f1", 2.0 * F.col("tp") / (F.col("n_true") + F.col("n_pred")))
    )
    return per_class.groupBy(*by).agg(
        F.sum("n_true").alias("n"),
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("n_true")) / F.sum("n_true")).alias("f1_weighted"),
    )


def mae_by_class(counted: DataFrame, by: Sequence[str] = ("rater",)) -> DataFrame:
    """Mean absolute error per true label; labels without rows are absent."""
    off = F.abs(F.col("y") - F.col("p"))
    return counted.groupBy(*by, F.col("y").alias("label")).agg(
        F.sum("n").alias("n"), weighted_mean(off).alias("mae")
    )


def error_histogram(counted: DataFrame, by: Sequence[str] = ("rater",), reach: int = 6) -> DataFrame:
    """Density of the signed error in unit bins centred on -reach..reach, per group; errors outside are ignored."""
    error = F.floor(F.col("p") - F.col("y") + F.lit(0.5)).cast("int")
    bins = range(-reach, reach + 1)
    sums = [F.sum(F.when(error == b, F.col("n")).otherwise(0)).alias(f"_n{b + reach}") for b in bins]
    inside = counted.where(error.between(-reach, reach)).groupBy(*by).agg(F.sum("n").alias("_all"), *sums)
    rows = [F.struct(F.lit(b).alias("error"), F.col(f"_n{b + reach}").alias("n")) for b in bins]
    long = inside.select(*by, "_all", F.inline(F.array(*rows)))
    return long.select(*by, "error", "n", (F.col("n") / F.col("_all")).alias("density"))


def bland_altman(counted: DataFrame, by: Sequence[str] = ("rater",), width: float = 1.96) -> DataFrame:
    """Bias of ``y - p`` and its limits of agreement, with the population standard deviation."""
    diff = (F.col("y") - F.col("p")).cast("double")
    bias = weighted_mean(diff)
    sd = F.sqrt(F.greatest(weighted_mean(diff**2) - bias**2, F.lit(0.0)))
    return counted.groupBy(*by).agg(
        F.sum("n").alias("n"),
        bias.alias("bias"),
        sd.alias("sd"),
        (bias - width * sd).alias("lower"),
        (bias + width * sd).alias("upper"),
    )


def bland_altman_points(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Per row: mean of both ratings and their difference."""
    return df.withColumn("mean", (F.col(y_true) + F.col(y_pred)) / 2).withColumn("diff", F.col(y_true) - F.col(y_pred))


def mean_sem(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and standard error of the mean; a single value has no error."""
    n, sd = F.count(value), F.stddev_samp(value)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.when(n > 1, sd / F.sqrt(n)).alias("sem")
    )


def run_cost(chunks: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Seconds per sample weighted by chunk size, and peak memory; 0 where nothing was processed."""
    n = F.sum("n_samples")
    spent = F.sum(F.col("time_per_sample") * F.col("n_samples"))
    return chunks.groupBy(*by).agg(
        F.coalesce(n, F.lit(0)).alias("n_samples"),
        F.coalesce(F.try_divide(spent, n), F.lit(0.0)).alias("time_per_sample"),
        F.coalesce(F.max("memory_gb"), F.lit(0.0)).alias("memory_gb"),
    )


def cell_metric(
    counted: DataFrame, metrics: Mapping[str, Callable], by: Sequence[str] = ("rater",)
) -> DataFrame:
    """User metrics over cells: each callable gets the arrays ``(y, p, n)`` of one group and returns a number.

    A group is a contingency table, not its rows, so its size does not grow with the data.
    """
    import pandas as pd

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.select(*by).schema)

    def apply(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        y, p, n = (frame[c].to_numpy() for c in ("y", "p", "n"))
        values = {name: float(metric(y, p, n)) for name, metric in metrics.items()}
        return pd.DataFrame([dict(zip(by, key)) | values])

    schema = ", ".join([keys, *[f"`{m}` double" for m in metrics]])
    return counted.groupBy(*by).applyInPandas(apply, schema)
