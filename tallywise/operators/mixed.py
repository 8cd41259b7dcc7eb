"""Linear mixed-effects regression with a random intercept per group, fitted by restricted maximum likelihood.

Spark reduces the rows to sums per group, and the groups to sums per group size. The fit reads only those: one row per
distinct group size, plus the totals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INVERSE_GOLDEN = (math.sqrt(5) - 1) / 2


def size_and_bits_design(size: str = "nparams", bits: str = "nbits", interaction: bool = True) -> dict[str, Column]:
    """Intercept, log10 of the size, the bits and, if wanted, their product."""
    log_size = F.log10(F.col(size))
    terms = {"intercept": F.lit(1.0), f"log_{size}": log_size, bits: F.col(bits).cast("double")}
    if interaction:
        terms[f"log_{size}:{bits}"] = log_size * F.col(bits)
    return terms


def _pairs(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


def group_size_sums(df: DataFrame, target: str, design: dict[str, Column], group: str) -> DataFrame:
    """Sums that determine the fit, one row per group size ``n``.

    Columns: ``groups``; ``c_i_j``, the sums over rows of products of columns i and j; ``s_i_j``, the sums over groups
    of products of group sums. Columns are the design terms in order, then the target. Incomplete rows are dropped.
    """
    columns = [*design.values(), F.col(target).cast("double")]
    rows = df.select(F.col(group).alias("_g"), *[c.alias(f"v{i}") for i, c in enumerate(columns)])
    rows = rows.na.drop("any")
    width = len(columns)
    per_group = rows.groupBy("_g").agg(
        F.count("*").alias("n"),
        *[F.sum(f"v{i}").alias(f"t{i}") for i in range(width)],
        *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"c_{i}_{j}") for i, j in _pairs(width)],
    )
    return per_group.groupBy("n").agg(
        F.count("*").alias("groups"),
        *[F.sum(f"c_{i}_{j}").alias(f"c_{i}_{j}") for i, j in _pairs(width)],
        *[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s_{i}_{j}") for i, j in _pairs(width)],
    )


def _matrix(values: dict, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for i, j in _pairs(width):
        out[i, j] = out[j, i] = values[i, j]
    return out


def fit_random_intercept(sums: pd.DataFrame, names: Sequence[str]) -> pd.DataFrame:
    """Coefficients, standard errors and variances from the group size sums."""
    width = len(names) + 1
    sizes, groups = sums["n"].to_numpy(dtype=float), sums["groups"].to_numpy(dtype=float)
    pairs = _pairs(width)
    within = _matrix({ij: sums[f"c_{ij[0]}_{ij[1]}"].sum() for ij in pairs}, width)
    between = {ij: sums[f"s_{ij[0]}_{ij[1]}"].to_numpy(dtype=float) for ij in pairs}
    free = float((sizes * groups).sum()) - (width - 1)

    def solve(ratio: float):
        shrink = ratio / (1 + sizes * ratio)
        m = within - _matrix({ij: float((shrink * between[ij]).sum()) for ij in pairs}, width)
        a, b, c = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        beta = np.linalg.solve(a, b)
        scale = max((c - b @ beta) / free, 1e-300)
        _, log_det = np.linalg.slogdet(a)
        loss = free * math.log(scale) + float((groups * np.log1p(sizes * ratio)).sum()) + log_det
        return loss, beta, scale, a

    # the variance ratio is searched on a coarse log grid, then by golden section around its best point
    grid = np.linspace(-18.0, 18.0, 145)
    best = int(np.argmin([solve(math.exp(g))[0] for g in grid]))
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    for _ in range(80):
        left, right = high - _INVERSE_GOLDEN * (high - low), low + _INVERSE_GOLDEN * (high - low)
        if solve(math.exp(left))[0] < solve(math.exp(right))[0]:
            high = right
        else:
            low = left
    ratio = math.exp((low + high) / 2)
    if solve(0.0)[0] <= solve(ratio)[0]:
        ratio = 0.0
    loss, beta, scale, a = solve(ratio)
    errors = np.sqrt(np.diag(np.linalg.inv(a)) * scale)
    log_likelihood = -0.5 * (loss + free * (1 + math.log(2 * math.pi)))
    return pd.DataFrame(
        {
            "term": list(names),
            "coef": beta,
            "std_err": errors,
            "z": beta / errors,
            "p_value": [math.erfc(abs(z) / math.sqrt(2)) for z in beta / errors],
            "group_var": ratio * scale,
            "residual_var": scale,
            "log_likelihood": log_likelihood,
        }
    )


def random_intercept_fit(
    df: DataFrame, target: str = "target", group: str = "model", design: dict[str, Column] | None = None
) -> DataFrame:
    """One row per term: ``coef, std_err, z, p_value`` with the two variances and the log likelihood."""
    design = design or size_and_bits_design()
    names = list(design)
    sums = group_size_sums(df, target, design, group)
    schema = (
        "term string, coef double, std_err double, z double, p_value double, group_var double, "
        "residual_var double, log_likelihood double"
    )
    one = sums.withColumn("_fit", F.lit(0)).groupBy("_fit")
    return one.applyInPandas(lambda frame: fit_random_intercept(frame, names), schema)
