"""The driver's tables in the roles of session data; each query names its stand-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions.policy import classify_status

#: Event type -> HTTP status of the stand-in delivery.
STATUS = {"view": 200, "purchase": 200, "click": 503, "signup": 413, "error": 401}
#: Return flag -> grade of the stand-in edge.
GRADE = {"A": "derived", "N": "observed", "R": "declared"}

#: Rows of costly work in one task.
TASK_ROWS = 50_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to all cores, and to tasks of ``TASK_ROWS`` at most on average, before costly
    work on each of them: a split of a compressed table holds any number of rows.  An input of
    that many splits is left as it lies, without a shuffle."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def mapped(column: str, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as delivery attempts: one stream per user, every event grows its file."""
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events")
    size = (1 + F.round(F.col("value") * 100)).cast("long")
    eof = F.sum(size).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    status = mapped("event_type", STATUS)
    return e.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("attempt_id"), eof.alias("eof"), classify_status(status).alias("outcome"), F.to_date("ts").alias("fingerprint"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("sha"), mapped("l_returnflag", GRADE).alias("grade"))


def ref_commits(spark: SparkSession, sf_dir: str, since: str = "1996-01-01") -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("ref"),
        F.col("o_orderkey").alias("sha"),
        (F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz")).alias("in_window"),
        (F.col("o_orderstatus") == "O").alias("reachable"),
        F.when(F.col("o_orderstatus") == "P", "exact").when(F.col("o_orderstatus") == "F", "probable").alias("successor"),
    )
