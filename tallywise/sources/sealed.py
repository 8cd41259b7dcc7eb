"""Encrypted tables that show tampering: cells bound to their row and column, and a keyed digest over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.sources.letters import hide_keys

CELL_CODEC = "zstd"  # of files with encrypted cells: six bits a character are all there is to a cell's text
_WORDS = 4  # of 64 bits each: what the sums over all rows keep of a row's digest


def write_sealed(
    df: DataFrame, path: str, key: str, columns: Sequence[str], id_col: str = "row_id", mode: str = "error"
) -> None:
    """Parquet in which the named columns are encrypted, each cell with its row id and column name as associated data,
    and beside it (``_seal``) the number of rows and a keyed digest of them all.

    A cell that was moved to another row or column, or changed, reads as null (``read_sealed``) and is listed by
    ``damaged_cells``; rows that were dropped, doubled or changed, in open columns too, break the seal (``verify_sealed``).
    The digest adds up a keyed hash of every row, so it needs no order, and one pass with map-side sums. ``id_col`` should
    be unique: cells of one column can trade places between rows of one id. A whole table put back to an older state with
    its own seal is not noticed. Nulls stay null; a null id counts as empty text.
    """
    hide_keys(df.sparkSession)
    df.withColumns({c: _locked(c, id_col, key) for c in columns}).write.mode(mode).parquet(path, compression=CELL_CODEC)
    seal = _digest(df.sparkSession.read.parquet(path), key)
    seal.coalesce(1).write.mode("overwrite").parquet(f"{path}/_seal")


def read_sealed(spark: SparkSession, path: str, key: str, columns: dict[str, str], id_col: str = "row_id") -> DataFrame:
    """What ``write_sealed`` wrote; ``columns`` maps the encrypted columns to their types. Damaged cells are null."""
    hide_keys(spark)
    df = spark.read.parquet(path)
    return df.withColumns({c: _opened(c, id_col, key).try_cast(t) for c, t in columns.items()})


def verify_sealed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row: ``rows`` found, ``sealed_rows`` and ``whole``, whether these are the rows that were sealed with this key."""
    hide_keys(spark)
    rows, digest = spark.read.parquet(f"{path}/_seal").select("rows", "digest").first()
    found = _digest(spark.read.parquet(path), key)
    return found.select("rows", F.lit(rows).alias("sealed_rows"), (F.col("digest") == digest).alias("whole"))


def damaged_cells(spark: SparkSession, path: str, key: str, columns: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """``id_col`` and ``column`` of every encrypted cell that is not what was written there."""
    hide_keys(spark)
    broken = [F.when(F.col(c).isNotNull() & _opened(c, id_col, key).isNull(), F.lit(c)) for c in columns]
    listed = spark.read.parquet(path).select(F.col(id_col), F.explode(F.array_compact(F.array(*broken))).alias("column"))
    return listed


def _bound(column: str, id_col: str) -> Column:
    row = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.encode(F.concat(F.lit(f"{len(column)}:{column}:"), row), "utf-8")


def _locked(column: str, id_col: str, key: str) -> Column:
    plain = F.encode(F.col(column).cast("string"), "utf-8")
    sealed = F.aes_encrypt(plain, F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), _bound(column, id_col))
    return F.base64(sealed)


def _opened(column: str, id_col: str, key: str) -> Column:
    stored = F.unbase64(F.col(column))
    plain = F.try_aes_decrypt(stored, F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), _bound(column, id_col))
    return F.decode(plain, "utf-8")


def _keyed(message: Column, key: str) -> Column:
    """A keyed hash as 64 hexadecimal digits; hashed twice, so that nothing can be appended to the message."""
    secret = F.unhex(F.lit(key))
    return F.sha2(F.concat(secret, F.unhex(F.sha2(F.concat(secret, message), 256))), 256)


def _digest(stored: DataFrame, key: str) -> DataFrame:
    columns = sorted(stored.columns)
    row = F.encode(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), "utf-8")
    hashed = stored.select(_keyed(row, key).alias("h"))
    words = [F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(_WORDS)]
    sums = [F.coalesce(F.sum(w).cast("string"), F.lit("0")) for w in words]
    totals = hashed.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *sums).alias("sums"))
    message = F.encode(F.concat_ws(":", F.col("rows").cast("string"), "sums"), "utf-8")
    return totals.select("rows", _keyed(message, key).alias("digest"))
