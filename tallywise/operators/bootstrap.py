"""Bootstrap intervals from contingency cells.

Resampling n rows with replacement and counting the cells of the resample is one multinomial draw over the cells, so a
replicate costs as many numbers as there are cells, whatever the number of rows. Draws are seeded per group: results do
not depend on partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.operators.prepare import UNLABELLED


class Resamples:
    """Cell counts ``(replicates, cells)`` with the label codes of each cell."""

    def __init__(self, y: np.ndarray, p: np.ndarray, counts: np.ndarray):
        self.values = np.unique(np.concatenate([y, p]))
        self.y, self.p, self.counts = y, p, counts.astype(float)
        self.i, self.j = np.searchsorted(self.values, y), np.searchsorted(self.values, p)
        self.total = self.counts.sum(axis=1)

    def mean(self, per_cell: np.ndarray) -> np.ndarray:
        return (self.counts * per_cell).sum(axis=1) / self.total

    def margins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per replicate and label: true count, predicted count, hits."""
        k = len(self.values)
        one_i, one_j = np.eye(k)[self.i], np.eye(k)[self.j]
        return self.counts @ one_i, self.counts @ one_j, self.counts @ (one_i * one_j)


def error_rate(s: Resamples) -> np.ndarray:
    return s.mean((s.y != s.p).astype(float))


def distance(s: Resamples) -> np.ndarray:
    return s.mean(np.abs(s.y - s.p))


def accuracy(s: Resamples) -> np.ndarray:
    return s.mean((s.y == s.p).astype(float))


def within_one(s: Resamples) -> np.ndarray:
    return s.mean((np.abs(s.y - s.p) <= 1).astype(float))


def quadratic_kappa(s: Resamples) -> np.ndarray:
    """Kappa of each replicate; labels are numbered by those present in the replicate."""
    true, predicted, _ = s.margins()
    place = np.cumsum((true + predicted) > 0, axis=1) - 1.0
    total = s.total[:, None]
    mean_i, mean_j = (true * place).sum(1) / s.total, (predicted * place).sum(1) / s.total
    var_i = (true * place**2 / total).sum(1) - mean_i**2
    var_j = (predicted * place**2 / total).sum(1) - mean_j**2
    gap = (place[:, s.i] - place[:, s.j]) ** 2
    observed = (s.counts * gap).sum(1) / s.total
    expected = var_i + var_j + (mean_i - mean_j) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(expected > 1e-12, 1 - observed / expected, np.nan)


def _f1(s: Resamples) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    true, predicted, hits = s.margins()
    size = true + predicted
    return np.divide(2 * hits, size, out=np.zeros_like(hits), where=size > 0), true, size > 0


def f1_macro(s: Resamples) -> np.ndarray:
    f1, _, present = _f1(s)
    return f1.sum(1) / present.sum(1)


def f1_weighted(s: Resamples) -> np.ndarray:
    f1, true, _ = _f1(s)
    return (f1 * true).sum(1) / s.total


METRICS = {
    "error": error_rate,
    "distance": distance,
    "mae": distance,
    "exact_acc": accuracy,
    "accuracy": accuracy,
    "tol1_acc": within_one,
    "qwk": quadratic_kappa,
    "f1_macro": f1_macro,
    "f1_weighted": f1_weighted,
}

_NUMBERS_IN_MEMORY = 4_000_000


def bootstrap_ci(
    counted: DataFrame,
    metrics: Sequence[str] | Mapping[str, object],
    by: Sequence[str] = ("rater",),
    replicates: int = 1000,
    seed: int = 42,
    level: float = 0.95,
) -> DataFrame:
    """``(by…, metric, n, estimate, lower, upper, used)``: percentile interval of each metric per group of cells.

    ``metrics`` are names of ``METRICS`` or a mapping of names to functions of ``Resamples``. Replicates whose metric is
    undefined are left out; ``used`` counts the others. Without any, the bounds are null.
    """
    chosen = dict(metrics) if isinstance(metrics, Mapping) else {m: METRICS[m] for m in metrics}
    columns = [*by, "metric", "n", "estimate", "lower", "upper", "used"]
    tails = [50 * (1 - level), 100 - 50 * (1 - level)]

    def apply(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["n"] > 0].sort_values(["y", "p"])
        if frame.empty:
            rows = [[*key, name, 0, np.nan, np.nan, np.nan, 0] for name in chosen]
            return pd.DataFrame(rows, columns=columns)
        y, n = frame["y"].to_numpy(), frame["n"].to_numpy(dtype=np.int64)
        p = frame["p"].to_numpy()
        if y.dtype == object:  # named classes: only equality matters
            y, p = y.astype(str), p.astype(str)
        total = int(n.sum())
        rng = np.random.default_rng([seed, zlib.crc32(repr(tuple(map(str, key))).encode())])
        observed = Resamples(y, p, n[None, :])
        block = max(1, _NUMBERS_IN_MEMORY // len(n))
        scores: dict[str, list] = {m: [] for m in chosen}
        for start in range(0, replicates, block):
            draws = rng.multinomial(total, n / total, size=min(block, replicates - start))
            sample = Resamples(y, p, draws)
            for name, metric in chosen.items():
                scores[name].append(metric(sample))
        rows = []
        for name, metric in chosen.items():
            values = np.concatenate(scores[name])
            values = values[~np.isnan(values)]
            low, high = np.percentile(values, tails) if len(values) else (np.nan, np.nan)
            rows.append([*key, name, total, float(metric(observed)[0]), float(low), float(high), len(values)])
        return pd.DataFrame(rows, columns=columns)

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counted.select(*by).schema)
    schema = keys + "metric string, n bigint, estimate double, lower double, upper double, used bigint"
    return counted.select(*by, "y", "p", "n").groupBy(*by).applyInPandas(apply, schema)


def bootstrap_halfwidth(
    counted: DataFrame, metric: str, by: Sequence[str] = ("rater",), replicates: int = 1000, seed: int = 1234
) -> DataFrame:
    """Distances ``err_low`` and ``err_high`` of the interval from the estimate, over labelled rows.

    An unknown metric gives zeros, as does a group without labelled rows.
    """
    if metric not in ("error", "distance"):
        return counted.groupBy(*by).agg(F.lit(0.0).alias("err_low"), F.lit(0.0).alias("err_high"))
    # unlabelled cells get no weight instead of being dropped: a group without labels keeps its row
    labelled = counted.withColumn("n", F.when(F.col("y") != UNLABELLED, F.col("n")).otherwise(0))
    intervals = bootstrap_ci(labelled, [metric], by, replicates, seed)
    return intervals.select(
        *by,
        F.coalesce(F.col("estimate") - F.col("lower"), F.lit(0.0)).alias("err_low"),
        F.coalesce(F.col("upper") - F.col("estimate"), F.lit(0.0)).alias("err_high"),
    )
