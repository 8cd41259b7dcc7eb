"""Result and metric files of many runs: partitioned results, metric JSON, pooling, prediction columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.functions.model_ids import correct_fp8, result_scheme
from tallywise.operators.bootstrap import bootstrap_halfwidth
from tallywise.operators.indexing import dense_index
from tallywise.sources.letters import write_csv

_END_MARK = "__end__"
_CELLS = "cells"  # the one key of a metric file that is no metric
RUN_COLUMNS = ("backend", "guided", "model", "quant_scheme")

# Metric names and units in metric files, and the cases that get pooled.
MODE_METRICS = {"error_rate": ("Error Rate", "%"), "distance": ("Distance", "mRS")}
RUN_METRICS = {
    "nparams": ("Number of params", "Billions"),
    "nbits": ("Bits/param", "Bits"),
    "vram": ("VRAM param usage", "GB"),
    "time_per_sample": ("Time/sample", "s"),
}
POOLED_CASES = {
    "single": "single model",
    "maj_5": "maj-pooling-5",
    "maj_10": "maj-pooling-10",
    "all": "all 10 models",
}


def write_results(
    df: DataFrame, root: str, backend: str, guided: bool = False, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Results below one folder per run. ``df`` holds ``model`` and ``quant_scheme``.

    The scheme counts for gguf models only. Overwriting replaces the runs in ``df`` and leaves other runs alone.
    """
    tagged = df.withColumns(
        {
            "backend": F.lit(backend),
            "guided": F.lit("guided" if guided else "free"),
            "quant_scheme": result_scheme(F.col("model"), F.col("quant_scheme")),
        }
    )
    writer = tagged.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_COLUMNS)
    writer.format(fmt).option("header", "true").option("escape", '"').save(root)


def read_results(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).option("header", "true").option("escape", '"').option("multiLine", "true").load(root)


def consensus_path(results_path: str) -> str:
    """Where the consensus predictions of a result file go."""
    stem = results_path.removesuffix(".csv")
    return f"{stem}_data_with_predictions.csv"


def write_consensus(consensus: DataFrame, results_path: str, mode: str = "overwrite") -> str:
    """Write a consensus table as CSV beside its result file; returns the path."""
    path = consensus_path(results_path)
    write_csv(consensus, path, mode)
    return path


def metric_entries(by_mode: DataFrame, run_values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tidy ``(keys…, metric, value, unit)`` from scores per mode and values per run."""
    per_mode = [
        F.struct(
            F.concat(F.lit(name + "\n("), F.col("mode_label"), F.lit(")")).alias("metric"),
            F.col(column).cast("double").alias("value"),
            F.lit(unit).alias("unit"),
        )
        for column, (name, unit) in MODE_METRICS.items()
    ]
    per_run = [
        F.struct(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"), F.lit(unit).alias("unit"))
        for column, (name, unit) in RUN_METRICS.items()
        if column in run_values.columns
    ]
    return by_mode.select(*keys, F.inline(F.array(*per_mode))).unionByName(
        run_values.select(*keys, F.inline(F.array(*per_run)))
    )


def write_metrics(
    entries: DataFrame, root: str, keys: Sequence[str], mode: str = "overwrite", cells: DataFrame | None = None
) -> None:
    """One JSON document per run: ``{metric: {values: [value], unit}}``. A run has a handful of metrics.

    ``cells`` (``keys…, mode_label, y, p, n``: how often label ``y`` met prediction ``p``) go in as
    ``cells: {mode_label: [[y, p, n]]}``. They take the place of arrays of labels and predictions: their number depends on
    the labels and not on the data, and those of two files add up.
    """
    body = F.struct(F.array("value").alias("values"), "unit")
    documents = entries.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("metric"), body)))).alias("value")
    )
    if cells is not None:
        triple = F.array(*[F.col(c).cast("long") for c in ("y", "p", "n")])
        modes = cells.groupBy(*keys, "mode_label").agg(F.array_sort(F.collect_list(triple)).alias("cells"))
        held = modes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("mode_label", "cells"))).alias("cells"))
        both = F.concat(F.substr("value", F.lit(1), F.length("value") - 1), F.lit(f',"{_CELLS}":'), F.to_json("cells"), F.lit("}"))
        documents = documents.join(held, list(keys), "left").select(*keys, F.coalesce(both, "value").alias("value"))
    documents.write.mode(mode).partitionBy(*keys).text(root)


def read_metric_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, keys…, metrics, cells)``: one row per file; ``metrics`` and ``cells`` are null for a damaged file.

    A file is one JSON object and nothing after it. The parser stops after the first value, so the text is put into an
    array in front of an end mark: whatever follows the object breaks the array. NaN counts as a number.
    """
    files = spark.read.option("wholetext", "true").text(root)
    wrapped = F.concat(F.lit("["), "value", F.lit('\n,{"%s":{"unit":"1"}}]' % _END_MARK))
    parsed = F.from_json(wrapped, "array<map<string,struct<values:array<string>,unit:string>>>")
    marked = F.try_element_at(F.get(parsed, F.lit(1)), F.lit(_END_MARK))["unit"] == "1"
    readable = F.when((F.size(parsed) == 2) & marked, F.get(parsed, F.lit(0)))
    metrics = F.map_filter(readable, lambda name, _: name != _CELLS)
    counted = F.from_json("value", f"struct<{_CELLS}:map<string,array<array<bigint>>>>")[_CELLS]
    keys = [c for c in files.columns if c != "value"]
    rows = files.select(F.col("_metadata.file_path").alias("path"), *keys, metrics.alias("metrics"), counted.alias("cells"))
    return rows.withColumn("cells", F.when(F.col("metrics").isNotNull(), F.col("cells")))


def metric_cells(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tidy ``(keys…, mode_label, y, p, n)`` of the files' cells; cells of files with equal keys are added up."""
    rows = files.select(*keys, F.explode("cells").alias("mode_label", "triples"))
    rows = rows.select(*keys, "mode_label", F.explode("triples").alias("t"))
    parts = [F.get("t", F.lit(i)).alias(name) for i, name in enumerate(("y", "p", "n"))]
    return rows.select(*keys, "mode_label", *parts).groupBy(*keys, "mode_label", "y", "p").agg(F.sum("n").alias("n"))


def damaged_files(files: DataFrame) -> DataFrame:
    """Paths that ``pooled_results`` leaves out."""
    return files.where(F.col("metrics").isNull()).select("path")


def first_value(metrics: Column, name: str | Column) -> Column:
    """First element of a metric's values as a number; null if missing, not a number or NaN."""
    values = F.try_element_at(metrics, F.lit(name) if isinstance(name, str) else name)["values"]
    value = F.get(values, F.lit(0)).try_cast("double")
    return F.when(~F.isnan(value), value)


def flatten_metrics(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tidy rows again: ``(keys…, metric, value, unit)``."""
    rows = files.select(*keys, F.explode("metrics").alias("metric", "body"))
    return rows.select(*keys, "metric", F.get("body.values", F.lit(0)).try_cast("double").alias("value"), "body.unit")


def pooled_results(
    files: DataFrame,
    group: Column,
    target: str = "error",
    main_x: str = "vram",
    cases=POOLED_CASES,
    intervals: bool = False,
    replicates: int = 1000,
) -> DataFrame:
    """One row per ``(model, vram, nparams, nbits)`` with error and distance of every case.

    A case counts where the run has both ``main_x`` and the target. Rows with a missing key vanish. Of several runs with
    equal keys each column takes the value of the first one, by path, that has it.

    With ``intervals`` every value has ``…_err_low`` and ``…_err_high`` beside it: the distances of its 95% bootstrap
    interval, drawn from the cells in the file that the value came from. They are 0 where that file has no cells with
    labels, and null where there is no value.
    """
    metrics = F.col("metrics")
    base = files.where(metrics.isNotNull()).select(
        "path",
        group.alias("model"),
        correct_fp8(first_value(metrics, RUN_METRICS["vram"][0]), F.col("path")).alias("vram"),
        first_value(metrics, RUN_METRICS["nparams"][0]).alias("nparams"),
        correct_fp8(first_value(metrics, RUN_METRICS["nbits"][0]), F.col("path")).alias("nbits"),
        *[
            first_value(metrics, f"{name}\n({label})").alias(f"{short}_{case}")
            for case, label in cases.items()
            for short, name in (("error", "Error Rate"), ("distance", "Distance"))
        ],
    )
    keys = ["model", "vram", "nparams", "nbits"]
    picked = []
    for case in cases:
        usable = F.col(main_x).isNotNull() & F.col(f"{target}_{case}").isNotNull()
        for column in (f"error_{case}", f"distance_{case}"):
            there = usable & F.col(column).isNotNull()
            picked.append(F.min_by(column, F.when(there, F.col("path"))).alias(column))
            if intervals:
                picked.append(F.min(F.when(there, F.col("path"))).alias(f"{column}_path"))
    any_case = F.exists(F.array(*[F.col(f"{target}_{c}").isNotNull() for c in cases]), lambda x: x)
    rows = base.na.drop("any", subset=keys).where(any_case & F.col(main_x).isNotNull())
    pooled = rows.groupBy(*keys).agg(*picked).withColumn("marker_size", 200 * F.col("nbits") / 16)
    return _with_intervals(pooled, files, keys, cases, replicates) if intervals else pooled


def _with_intervals(pooled: DataFrame, files: DataFrame, keys: list[str], cases, replicates: int) -> DataFrame:
    """Half-widths beside the values. Cells are drawn from only where a value came from; a file has a few dozen of them."""
    values = [(case, short, f"{short}_{case}") for case in cases for short in ("error", "distance")]
    asked = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(cases[case]).alias("mode_label"), F.lit(short).alias("metric"), F.col(f"{c}_path").alias("path"))
        for case, short, c in values
    ])
    asked = pooled.select(*keys, F.inline(asked)).where(F.col("path").isNotNull())
    cells = metric_cells(files.where(F.col("cells").isNotNull()), ["path"])
    chosen = asked.join(cells, ["path", "mode_label"]).select("column", "metric", *keys, "y", "p", "n")
    by = [*keys, "column"]
    found = [
        bootstrap_halfwidth(chosen.where(F.col("metric") == metric), metric, by, replicates) for metric in ("error", "distance")
    ]
    sides = [
        F.max(F.when(F.col("column") == c, F.col(side))).alias(f"{c}_{side}") for _, _, c in values for side in ("err_low", "err_high")
    ]
    wide = found[0].unionByName(found[1]).groupBy(*keys).agg(*sides)
    beside = {
        f"{c}_{side}": F.when(F.col(c).isNotNull(), F.coalesce(f"{c}_{side}", F.lit(0.0)))
        for _, _, c in values
        for side in ("err_low", "err_high")
    }
    return pooled.join(wide, keys, "left").withColumns(beside).drop(*[f"{c}_path" for _, _, c in values])


def prediction_columns(
    predictions: DataFrame, id_col: str, names: Sequence[str], run: Column, mode_col: str = "mode"
) -> DataFrame:
    """One row per document and one column per name ``run-mode``; names that never occur are null columns."""
    named = predictions.withColumn("_name", F.concat_ws("-", run, F.col(mode_col)))
    return named.groupBy(id_col).pivot("_name", list(names)).agg(F.max("pred"))


def attach_predictions(table: DataFrame, predictions: DataFrame, id_col: str, names: Sequence[str], run: Column):
    """The table with the predictions of every named run and mode beside each row."""
    return table.join(prediction_columns(predictions, id_col, names, run), id_col, "left")


def prediction_arrays(spark: SparkSession, root: str, field: str = "y_pred") -> DataFrame:
    """``(path, keys…, mode, position, pred, length)`` from the per-mode arrays of metric files."""
    files = spark.read.option("wholetext", "true").text(root)
    keys = [c for c in files.columns if c != "value"]
    arrays = F.from_json(F.get_json_object("value", f"$.{field}"), "map<string,array<int>>")
    modes = files.select(F.col("_metadata.file_path").alias("path"), *keys, F.explode(arrays).alias("mode", "values"))
    return modes.select(
        "path", *keys, "mode", F.size("values").alias("length"), F.posexplode("values").alias("position", "pred")
    )


def attach_prediction_arrays(
    table: DataFrame, order_by: str, arrays: DataFrame, names: Sequence[str], run: Column
) -> DataFrame:
    """Attach arrays by position in the order of ``order_by``. An array of another length than the table is an error."""
    rows = table.count()
    wrong = arrays.where(F.col("length") != rows).select("path", "mode", "length").distinct().take(5)
    if wrong:
        raise ValueError(f"the table has {rows} rows, but these arrays differ: {[tuple(w) for w in wrong]}")
    numbered = dense_index(table, [order_by], "position")
    return attach_predictions(numbered, arrays, "position", names, run).drop("position")
