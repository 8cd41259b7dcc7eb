"""A filter of fixed size for ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD_BITS = 17  # 2**17 words of 64 bits: about 1 MB, whatever the number of ids


def maybe_among(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``df`` with ``hit``: true for every row whose id stands in the first column of ``ids``, and for a few others.

    One bit an id, so that most rows without a partner need not be shuffled to a join. Where ids fill the filter it lets
    more rows pass; the join that follows decides. Null ids are no hit.
    """
    asked = ids.columns[0]
    words = ids.where(F.col(asked).isNotNull()).groupBy(_word(asked).alias("_word"))
    words = words.agg(F.bit_or(_bit(asked)).alias("_bits"))
    marked = df.withColumn("_word", _word(id_col)).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(_bit(id_col)) != 0, F.lit(False)) & F.col(id_col).isNotNull()
    return marked.withColumn("hit", hit).drop("_word", "_bits")


def _word(id_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_col), 64 - _WORD_BITS)


def _bit(id_col: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(id_col).bitwiseAND(F.lit(63).cast("long")).cast("int"))
