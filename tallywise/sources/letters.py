"""Reading and writing letters: CSV with multi-line text, parquet, encrypted columns."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.sources.records import read_csv

LETTER_SCHEMA = "row_id bigint, input_text string, patient_id string, lang string, source string, label int"
_CSV_WRITE = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_letters(spark: SparkSession, path: str, schema: str = LETTER_SCHEMA, fmt: str = "csv") -> DataFrame:
    """Letters from CSV (quoted text may span lines, and a file is read by many tasks) or parquet, with a declared schema."""
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"letters are read from csv or parquet, not from {fmt!r}")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(**_CSV_WRITE).csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small report table as one CSV file."""
    df.coalesce(1).write.mode(mode).options(**_CSV_WRITE).csv(path)


def key_from_environment(variable: str) -> str:
    """A hexadecimal key from an environment variable."""
    key = os.environ.get(variable)
    if not key:
        raise KeyError(f"environment variable '{variable}' holds no key")
    return key


def encrypt(column: Column, key: str) -> Column:
    """Authenticated encryption of a value as text; ``key`` is hexadecimal, 32, 48 or 64 digits.

    The key is a literal of the plan. ``hide_keys`` keeps it out of printed plans and event logs.
    """
    return F.base64(F.aes_encrypt(F.encode(column.cast("string"), "utf-8"), F.unhex(F.lit(key)), F.lit("GCM")))


def decrypt(column: Column, key: str) -> Column:
    """The plain text, or null for a wrong key or a damaged value."""
    return F.decode(F.try_aes_decrypt(F.unbase64(column), F.unhex(F.lit(key)), F.lit("GCM")), "utf-8")


def hide_keys(spark: SparkSession) -> None:
    """Have Spark redact hexadecimal keys (32 digits or more) in plan texts, and so in event logs, of this session."""
    mine, before = "[0-9a-fA-F]{32,}", spark.conf.get("spark.sql.redaction.string.regex", "")
    if mine not in before:
        spark.conf.set("spark.sql.redaction.string.regex", f"{before}|{mine}" if before else mine)


def write_encrypted(df: DataFrame, path: str, key: str, columns: Sequence[str], mode: str = "error") -> None:
    """Parquet in which the named columns are encrypted; the others stay open to filters."""
    hide_keys(df.sparkSession)
    df.withColumns({c: encrypt(F.col(c), key) for c in columns}).write.mode(mode).parquet(path)


def read_encrypted(spark: SparkSession, path: str, key: str, columns: dict[str, str]) -> DataFrame:
    """Read what ``write_encrypted`` wrote; ``columns`` maps the encrypted columns to their types."""
    hide_keys(spark)
    df = spark.read.parquet(path)
    return df.withColumns({c: decrypt(F.col(c), key).try_cast(t) for c, t in columns.items()})
