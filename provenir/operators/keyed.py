"""Once per key, latest wins, first N per key, consent, and what is spooled but not sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once_per_key(notices: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first notice of every key, as a partial aggregate instead of a sort per key."""
    rest = [c for c in notices.columns if c not in by]
    ordered = F.struct(*order)
    first = F.min_by(F.struct(*rest), ordered)
    return notices.groupBy(*by).agg(first.alias("x")).select(*by, *(F.col("x")[c].alias(c) for c in rest))


def consented(log: DataFrame) -> DataFrame:
    """Keys whose latest action is a grant, from (key, action, at, entry_id); no entry, no consent."""
    latest = log.groupBy("key").agg(F.max_by("action", F.struct("at", "entry_id")).alias("action"), F.max("at").alias("at"))
    return latest.filter("action = 'grant'").select("key", "at")


def with_consent(rows: DataFrame, allowed: DataFrame, key: str = "key") -> DataFrame:
    """Only rows whose key is allowed; written first, so that nothing else is read for others."""
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def first_per_key(rows: DataFrame, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    """At most ``most`` rows of each key in order (32 commits a delivery); the rest stays."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def unsent(spooled: DataFrame, consumed: DataFrame, by: list[str], line: str = "line_no") -> DataFrame:
    """Spool lines behind each key's consumed count, from (key.., consumed)."""
    done = F.coalesce("consumed", F.lit(0))
    return spooled.join(consumed, by, "left").filter(F.col(line) >= done).drop("consumed")


def newest(rows: DataFrame, count: int, order: str, tie: str) -> DataFrame:
    """The last ``count`` rows (a top-k, without a full sort)."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(count)
