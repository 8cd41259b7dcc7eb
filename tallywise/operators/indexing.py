"""Dense 0-based numbers in sort order, without a window over the whole table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.operators.scratch import durable

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def dense_index(keys: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """Add ``name``: the position of each row in the total order of ``order_by``.

    Rows are range partitioned and sorted, written once, and shifted by the number of rows in the partitions before
    theirs. Only the partition sizes, one number per partition, pass through the driver.
    """
    ranged = keys.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    tagged = durable(ranged.withColumn("_mid", F.monotonically_increasing_id()), "index")
    slot = F.shiftright("_mid", _POSITION_BITS)
    sizes = {r["slot"]: r["n"] for r in tagged.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}
    slots = sorted(sizes)
    starts = accumulate([0] + [sizes[s] for s in slots[:-1]])
    offsets = keys.sparkSession.createDataFrame(list(zip(slots, starts)), "_slot bigint, _start bigint")
    position = F.col("_mid") - F.shiftleft(F.col("_slot"), _POSITION_BITS)
    return (
        tagged.withColumn("_slot", slot)
        .join(F.broadcast(offsets), "_slot")
        .withColumn(name, F.col("_start") + position)
        .drop("_slot", "_start", "_mid")
    )


def attach_dense_id(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: 0-based number of the distinct value of ``key`` in sorted order; null for a null key."""
    distinct = df.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(dense_index(distinct, [key], name), key, "left")
