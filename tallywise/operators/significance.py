"""Agreement and significance statistics. Spark aggregates; a scalar function finishes each aggregated row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.functions.dists import (
    f_quantile,
    log_jzs_bayes_factor,
    normal_two_sided,
    signed_rank_two_sided,
    t_two_sided,
)
from tallywise.operators.scoring import weighted_mean


def _finish(function, *columns: Column) -> Column:
    """Apply a scalar Python function to aggregated rows; null or NaN input gives null."""

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        values = frame.to_numpy(dtype=float)
        return pd.Series([None if (row != row).any() else function(*row) for row in values], dtype="float64")

    return run(F.struct(*[c.cast("double").alias(f"a{i}") for i, c in enumerate(columns)]))


def icc_consistency(counted: DataFrame, by: Sequence[str] = ("rater",)) -> DataFrame:
    """ICC3: single rater, consistency, two raters, from cells."""
    y, p = F.col("y").cast("double"), F.col("p").cast("double")
    n = F.sum("n").alias("n")
    moments = counted.groupBy(*by).agg(
        n,
        weighted_mean(y).alias("_my"),
        weighted_mean(p).alias("_mp"),
        weighted_mean(y * y).alias("_yy"),
        weighted_mean(p * p).alias("_pp"),
        weighted_mean(y * p).alias("_yp"),
    )
    spread = F.col("n") / (F.col("n") - 1)
    var_y = (F.col("_yy") - F.col("_my") ** 2) * spread
    var_p = (F.col("_pp") - F.col("_mp") ** 2) * spread
    cov = (F.col("_yp") - F.col("_my") * F.col("_mp")) * spread
    between, within = (var_y + var_p + 2 * cov) / 2, (var_y + var_p - 2 * cov) / 2
    many = F.col("n") > 1
    return moments.select(
        *by,
        "n",
        F.when(many, F.try_divide(between - within, between + within)).alias("icc"),
        F.when(many, F.try_divide(between, within)).alias("f_value"),
    )


def icc_interval(icc: DataFrame, level: float = 0.95) -> DataFrame:
    """Add ``lower`` and ``upper`` of ICC3 from the quantiles of F with (n-1, n-1) degrees of freedom."""

    def bound(sign: int):
        def compute(f_value: float, n: float) -> float:
            shifted = f_value * f_quantile(1 - (1 - level) / 2, n - 1, n - 1) ** sign
            return (shifted - 1) / (shifted + 1)

        return compute

    lower = _finish(bound(-1), F.col("f_value"), F.col("n"))
    upper = _finish(bound(1), F.col("f_value"), F.col("n"))
    return icc.withColumn("lower", lower).withColumn("upper", upper)


def error_differences(
    df: DataFrame,
    expert: str,
    comparisons: Mapping[str, tuple[str, str]],
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts of ``d = |a - expert| - |b - expert|`` per group and comparison of raters; incomplete rows are dropped."""
    rows = []
    for name, (a, b) in comparisons.items():
        d = F.abs(F.col(a) - F.col(expert)) - F.abs(F.col(b) - F.col(expert))
        rows.append(F.struct(F.lit(name).alias("comparison"), d.alias("d")))
    keep = [weight] if weight else []
    long = df.select(*by, *keep, F.inline(F.array(*rows))).where(F.col("d").isNotNull())
    return long.groupBy(*by, "comparison", "d").agg((F.sum(weight) if weight else F.count("*")).alias("n"))


#: Up to this many non-zero pairs, all sums of ranks are counted in doubles without rounding.
EXACT_PAIRS = 50


def wilcoxon(
    differences: DataFrame, correction: bool = True, by: Sequence[str] = ("comparison",), exact_upto: int = 0
) -> DataFrame:
    """Signed rank test on counted differences: zeros dropped, average ranks, normal approximation with ties.

    ``w`` is the smaller rank sum, ``rbc`` the matched-pairs rank-biserial correlation. ``correction`` moves the
    statistic half a step towards its mean. Ranks come from the counts of each distinct size, not from sorting rows.

    Groups with at most ``exact_upto`` non-zero pairs (50 at most) get the exact p value instead, ties and all: the
    share of the 2^n ways to give the ranks signs whose smaller sum is no larger. With it comes a column ``method``. Only
    the ranks of such groups are gathered, so a group holds ``exact_upto`` of them at most.
    """
    if exact_upto > EXACT_PAIRS:
        raise ValueError(f"exact_upto is at most {EXACT_PAIRS}")
    size = F.abs("d")
    tied = (
        differences.where(F.col("d") != 0)
        .groupBy(*by, size.alias("size"))
        .agg(
            F.sum("n").cast("double").alias("t"),
            F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("above"),
            F.sum(F.when(F.col("d") < 0, F.col("n")).otherwise(0)).alias("below"),
        )
    )
    upto = F.sum("t").over(Window.partitionBy(*by).orderBy("size"))
    ranked = tied.withColumn("rank", upto - F.col("t") + (F.col("t") + 1) / 2)
    t, extra = F.col("t"), []
    if exact_upto:
        ranked = ranked.withColumn("pairs", F.sum("t").over(Window.partitionBy(*by)))
        doubled = F.struct((2 * F.col("rank")).cast("int").alias("rank"), t.cast("int").alias("times"))
        extra = [F.collect_list(F.when(F.col("pairs") <= exact_upto, doubled)).alias("ranks")]
    sums = ranked.groupBy(*by).agg(
        *extra,
        F.sum("t").alias("n"),
        F.sum(F.col("rank") * F.col("above")).alias("w_plus"),
        F.sum(F.col("rank") * F.col("below")).alias("w_minus"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n = F.col("n")
    w = F.least("w_plus", "w_minus")
    mean = n * (n + 1) / 4
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    shift = 0.5 * F.signum(w - mean) if correction else F.lit(0.0)
    out = sums.select(
        *by,
        *(["ranks"] if exact_upto else []),
        n.cast("bigint").alias("n"),
        "w_plus",
        "w_minus",
        w.alias("w"),
        ((F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus"))).alias("rbc"),
        F.try_divide(w - mean - shift, sd).alias("z"),
    )
    out = out.withColumn("p_value", _finish(normal_two_sided, F.col("z")))
    if not exact_upto:
        return out
    exact = _exact_signed_rank(F.col("w"), F.col("ranks"))
    few = F.col("n") <= exact_upto
    out = out.withColumn("p_value", F.when(few, exact).otherwise(F.col("p_value")))
    return out.withColumn("method", F.when(few, "exact").otherwise("normal")).drop("ranks")


def _exact_signed_rank(w: Column, ranks: Column) -> Column:
    """The exact p value of aggregated rows. Ranks come doubled, so that average ranks are whole numbers."""

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        rows = zip(frame["w"], frame["ranks"])
        found = [signed_rank_two_sided(w, [(r["rank"], r["times"]) for r in ranks]) for w, ranks in rows]
        return pd.Series(found, dtype="float64")

    return run(F.struct(w.alias("w"), ranks.alias("ranks")))


def paired_t(differences: DataFrame, by: Sequence[str] = ("comparison",)) -> DataFrame:
    """Paired t statistic of the differences, its p value and the Bayes factor of a difference."""
    d = F.col("d").cast("double")
    n = F.sum("n").alias("n")
    mean = weighted_mean(d)
    moments = differences.groupBy(*by).agg(n, mean.alias("mean_diff"), (weighted_mean(d * d) - mean**2).alias("_v"))
    total = F.col("n")
    sd = F.sqrt(F.greatest(F.col("_v"), F.lit(0.0)) * total / (total - 1))
    out = moments.withColumn("sd_diff", F.when(total > 1, sd)).drop("_v")
    out = out.withColumn("t", F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt(total)))
    out = out.withColumn("p_value", _finish(lambda t, n: t_two_sided(t, n - 1), F.col("t"), total))
    out = out.withColumn("log_bf10", _finish(log_jzs_bayes_factor, F.col("t"), total))
    return out.withColumn("bf10", F.exp("log_bf10"))


def verdicts(tests: DataFrame, errors: DataFrame, comparisons: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Readable verdicts per comparison.

    ``tests`` holds ``comparison, p_value, rbc, bf10``; ``errors`` holds ``rater, mae``. Both have one row per name.
    """
    mae = errors.select(F.map_from_entries(F.collect_list(F.struct("rater", "mae")))).scalar()
    names = [F.struct(F.lit(c).alias("c"), F.lit(a).alias("a"), F.lit(b).alias("b")) for c, (a, b) in comparisons.items()]
    side = F.get(F.filter(F.array(*names), lambda x: x["c"] == F.col("comparison")), F.lit(0))
    mae_a, mae_b = F.element_at(mae, side["a"]), F.element_at(mae, side["b"])
    return tests.select(
        "comparison",
        "p_value",
        F.when(F.col("p_value") < 0.05, "**Significant**").otherwise("Not sig").alias("significance"),
        "rbc",
        "bf10",
        F.when(F.col("bf10") > 3, "Favors difference")
        .when(F.col("bf10") < 0.333, "Favors equivalence")
        .otherwise("Inconclusive")
        .alias("bayes_interpretation"),
        F.when(mae_a < mae_b, F.concat(side["a"], F.lit(" better")))
        .when(mae_b < mae_a, F.concat(side["b"], F.lit(" better")))
        .otherwise("TIE")
        .alias("winner"),
    )


def comparison_plan(columns: Sequence[str], model: str, competitors: Sequence[str]) -> dict[str, tuple[str, str]]:
    """The model against each competitor, then the first two competitors against each other if both are columns."""
    plan = {f"{model} vs {c}": (model, c) for c in competitors}
    if len(competitors) > 1 and all(c in columns for c in competitors[:2]):
        a, b = competitors[:2]
        plan[f"{a} vs {b}"] = (a, b)
    return plan


def spearman_errors(df: DataFrame, expert: str, raters: Sequence[str], weight: str | None = None) -> DataFrame:
    """Spearman correlation matrix of the signed errors of each pair of raters, pairwise complete.

    Average ranks come from the counts per distinct error; no row-level sort takes place.
    """
    pairs = []
    for i, a in enumerate(raters):
        for b in raters[i:]:
            errors = [(F.col(c) - F.col(expert)) for c in (a, b)]
            pairs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), errors[0].alias("u"), errors[1].alias("v")))
    keep = [weight] if weight else []
    counted = (
        df.select(*keep, F.inline(F.array(*pairs)))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull())
        .groupBy("a", "b", "u", "v")
        .agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    )

    def rank(value: str) -> Column:
        # rows of equal value share one rank: all rows up to the value, minus half of its own
        upto = F.sum("n").over(Window.partitionBy("a", "b").orderBy(value))
        own = F.sum("n").over(Window.partitionBy("a", "b", value))
        return upto - (own - 1) / 2

    ranked = counted.select("a", "b", "n", rank("u").alias("x"), rank("v").alias("z"))
    mean_x, mean_z = weighted_mean(F.col("x")), weighted_mean(F.col("z"))
    moments = ranked.groupBy("a", "b").agg(
        F.sum("n").alias("n"),
        (weighted_mean(F.col("x") * F.col("z")) - mean_x * mean_z).alias("_xz"),
        (weighted_mean(F.col("x") ** 2) - mean_x**2).alias("_xx"),
        (weighted_mean(F.col("z") ** 2) - mean_z**2).alias("_zz"),
    )
    rho = moments.select("a", "b", "n", F.try_divide(F.col("_xz"), F.sqrt(F.col("_xx") * F.col("_zz"))).alias("rho"))
    mirrored = rho.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "rho")
    return rho.unionByName(mirrored)
