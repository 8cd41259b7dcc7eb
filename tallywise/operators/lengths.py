"""Distribution of document lengths: statistics, histogram, density estimate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.functions.text import word_count


def length_counts(
    df: DataFrame, text_col: str = "input_text", count_tokens: Callable[[Column], Column] = word_count,
    by: Sequence[str] = (),
) -> DataFrame:
    """Number of documents per token count: what the statistics below need of the texts."""
    texts = df.where(F.col(text_col).isNotNull())
    return texts.groupBy(*by, count_tokens(F.col(text_col)).alias("length")).agg(F.count("*").alias("n"))


def length_stats(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    length, n = F.col("length"), F.col("n")
    wide_length, wide_n = (c.cast("decimal(19,0)") for c in (length, n))
    total = F.sum("n")
    mean = F.sum((wide_length * wide_n).cast("decimal(38,0)")).cast("double") / total
    # sums of integers are exact, so the variance can be taken from them
    spread = F.sum((wide_length * wide_n * wide_length).cast("decimal(38,0)")).cast("double") - total * mean * mean
    return counted.groupBy(*by).agg(
        total.alias("n"),
        mean.alias("mean"),
        F.percentile("length", F.lit(0.5), n).alias("median"),
        F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (total - 1))).alias("sd"),
        F.min("length").alias("min"),
        F.max("length").alias("max"),
    )


def length_histogram(counted: DataFrame, bins: int = 50) -> DataFrame:
    """Density in ``bins`` equal bins over the range of lengths; the last bin holds its upper end.

    Bins without documents are included.
    """
    span = F.struct(
        F.min("length").cast("double").alias("low"), F.max("length").cast("double").alias("high"), F.sum("n").alias("n")
    )
    whole = counted.agg(span).scalar()
    # a range of a single value becomes half a unit to either side
    margin = F.when(whole["low"] == whole["high"], 0.5).otherwise(0.0)
    low, high, total = whole["low"] - margin, whole["high"] + margin, whole["n"]
    step = (high - low) / bins
    slot = F.least(F.floor((F.col("length") - low) / step).cast("int"), F.lit(bins - 1))
    counts = counted.groupBy(slot.alias("bin")).agg(F.sum("n").alias("n"))
    edges = counted.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin",
        (low + F.col("bin") * step).alias("low"),
        (low + (F.col("bin") + 1) * step).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (total * step)).alias("density"),
    )


def length_kde(counted: DataFrame, points: int = 1000) -> DataFrame:
    """Gaussian density estimate with Scott's bandwidth on an even grid.

    The grid reaches half a range beyond the smallest and the largest length. Equal lengths were merged before, so the
    work is distinct lengths times grid points, summed map-side per point.
    """
    reach = F.col("max") - F.col("min")
    whole = length_stats(counted).select(
        F.struct(
            F.col("n").cast("double").alias("total"),
            (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"),
            (F.col("min") - 0.5 * reach).alias("start"),
            (2.0 * reach / (points - 1)).alias("step"),
        )
    ).scalar()
    spread = counted.select("length", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    z = (whole["start"] + F.col("point") * whole["step"] - F.col("length")) / whole["bandwidth"]
    summed = spread.groupBy("point").agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("weight"))
    scale = whole["total"] * whole["bandwidth"] * F.sqrt(F.lit(2.0) * F.pi())
    return summed.select(
        "point",
        (whole["start"] + F.col("point") * whole["step"]).alias("x"),
        (F.col("weight") / scale).alias("density"),
    )
