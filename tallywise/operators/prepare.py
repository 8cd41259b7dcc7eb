"""Dataset preparation: column checks, renaming, recoding, incomplete rows, surrogate ids, sampling, union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallywise.operators.indexing import attach_dense_id, dense_index

LETTER_COLUMNS = ("input_text", "label")
UNLABELLED = -1
_SAMPLE_GROUPS = 1024


def require_columns(df: DataFrame, columns: Sequence[str] = LETTER_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"the table lacks {', '.join(missing)}")
    return df


def rename_select(df: DataFrame, column_map: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Rename by ``column_map`` and keep only the mapped columns plus ``keep``."""
    return df.withColumnsRenamed(dict(column_map)).select(*column_map.values(), *keep)


def recode(column: Column, mapping: Mapping[str, object]) -> Column:
    """Exact-match replacement; values outside the mapping stay."""
    out = column
    for old, new in mapping.items():
        out = F.when(column == old, F.lit(new)).otherwise(out)
    return out


def drop_incomplete(
    df: DataFrame, subset: Sequence[str], observation: Observation | None = None
) -> DataFrame:
    """Drop rows with a null in any of ``subset``. The observation receives ``rows`` and ``dropped``."""
    if observation is not None:
        broken = F.exists(F.array(*[F.col(c).isNull() for c in subset]), lambda x: x)
        df = df.observe(observation, F.count("*").alias("rows"), F.count_if(broken).alias("dropped"))
    return df.na.drop("any", subset=list(subset))


def label_or_sentinel(column: str = "label") -> Column:
    return F.coalesce(F.col(column).cast("int"), F.lit(UNLABELLED))


def broad_class(score: Column) -> Column:
    """Broad outcome classes of the 0-6 scale; null outside it."""
    # Class names and their bounds.
    return F.when(score.between(0, 1), "(0-1)").when(score.between(2, 5), "(2-5)").when(score == 6, "(6)")


def prepare_letters(
    raw: DataFrame,
    column_map: Mapping[str, str],
    no_label: Sequence[str] = (),
    order_by: str | None = None,
    patient_col: str = "patient_id",
) -> DataFrame:
    """Raw table to letters: renamed columns, integer label, anonymous patient numbers.

    With ``order_by``, the name of a unique column, a dense ``document_id`` in that order is added too.
    """
    labels = recode(F.col("label"), {m: None for m in no_label}).try_cast("int")
    if order_by is None:
        out = rename_select(raw, column_map).withColumn("label", labels)
        numbered = attach_dense_id(out, patient_col, "_patient")
        return numbered.drop(patient_col).withColumnRenamed("_patient", patient_col)
    out = rename_select(raw, column_map, [order_by]).withColumn("label", labels)
    # both numbers are found on keys alone; the rows with their texts take part in one join only
    keys = attach_dense_id(out.select(order_by, patient_col), patient_col, "_patient")
    numbers = dense_index(keys.select(order_by, F.col("_patient").alias(patient_col)), [order_by], "document_id")
    return out.drop(patient_col).join(numbers, order_by)


def seeded_order(seed: int, id_col: str) -> Column:
    """Pseudo-random sort key, equal in every run and on every partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def balanced_sample(
    df: DataFrame, per_label: int, id_col: str = "row_id", label_col: str = "label", seed: int = 0
) -> DataFrame:
    """At most ``per_label`` rows of each label, chosen by a seeded hash of the unique ``id_col``.

    Rows without a label are left out. Only ids are ranked, in two steps: first per label and group of input partitions,
    with the limit applied inside each partition before the shuffle, then per label. So a label that holds a third of
    the rows never meets in one task. The chosen ids then pick their rows.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(_SAMPLE_GROUPS))
    ids = df.where(F.col(label_col).isNotNull()).select(id_col, label_col, group.alias("_group"))
    for keys in ([label_col, "_group"], [label_col]):
        w = Window.partitionBy(*keys).orderBy(seeded_order(seed, id_col), id_col)
        ids = ids.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_label).drop("_rank")
    return df.join(ids.select(id_col), id_col, "left_semi")


def shuffle_rows(df: DataFrame, id_col: str = "row_id", seed: int = 0) -> DataFrame:
    return df.orderBy(seeded_order(seed, id_col), id_col)


def union_datasets(base: DataFrame, curated: DataFrame) -> DataFrame:
    """All rows of both; columns are matched by name and filled with null where one side lacks them."""
    return base.unionByName(curated, allowMissingColumns=True)


def load_for_benchmark(
    base: DataFrame | None,
    curated: DataFrame | None = None,
    use_curated: bool = False,
    add_curated: bool = False,
    drop_unlabelled: bool = False,
    sample_per_label: int | None = None,
    id_col: str = "row_id",
    seed: int = 0,
) -> DataFrame:
    """The dataset of a benchmark run from its options."""
    if use_curated and add_curated:
        raise ValueError("Cannot both use only the curated dataset and add it. Please choose one.")
    df = curated if use_curated else base
    if add_curated:
        df = union_datasets(df, curated)
    df = require_columns(df)
    if drop_unlabelled:
        df = drop_incomplete(df, ["label"])
    if sample_per_label is not None:
        df = shuffle_rows(balanced_sample(df, sample_per_label, id_col, seed=seed), id_col, seed)
    return df
