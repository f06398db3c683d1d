"""Helpers for the training-data operators: Arrow batches, words, sampling by hash."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.runtime import small_batches  # noqa: F401

#: ASCII white space: bytes.split() without arguments cuts at exactly these.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's texts as UTF-8; null becomes empty."""
    column = batch.column(name)
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def hash_share(df: DataFrame, by: str, want: int) -> Column:
    """Condition that keeps about ``want`` rows of ``df``, chosen by a hash of ``by``."""
    total = df.count()
    share = min(1.0, want / max(total, 1))
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(by)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
