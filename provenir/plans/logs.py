"""Queries over files read by position: the driver's texts written as logs and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.plans.registry import query
from provenir.plans.standins import load, mapped
from provenir.runtime import materialize, shared_dir
from provenir.sources import byte_log, files
from provenir.streaming import delivery


def _one_line(text: str = "text") -> Column:
    """A text as one line of a log."""
    return F.translate(F.coalesce(text, F.lit("")), "\n", " ")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and a line of a log for every document."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\t"), _one_line()).alias("value"))


_LINE_SQL = "SELECT doc_id, source, doc_id || chr(9) || replace(coalesce(text, ''), chr(10), ' ') AS line FROM documents"


@query(f"""
SELECT doc_id, strlen(line) // 4 AS from_in_line, md5(encode(line)[strlen(line) // 4 + 1 : strlen(line) - strlen(line) // 3]) AS body FROM ({_LINE_SQL})""")
def span_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of every document's line, cut at any byte, read by its place in the log's files."""
    path = _folder(spark, "log")
    _lines(spark, sf_dir).select("value").write.text(path)
    n = F.octet_length("line")
    lines = byte_log.log_lines(spark, path).select("path", "at", F.substring_index("line", "\t", 1).cast("long").alias("doc_id"), n.cast("long").alias("n"))
    lines = materialize(lines, "places")
    skip = F.floor(F.col("n") / 4)
    spans = lines.select("doc_id", skip.alias("from_in_line"), "path", (F.col("at") + skip).alias("from_off"), (F.col("at") + F.col("n") - F.floor(F.col("n") / 3)).alias("to_off"))
    return byte_log.read_spans(spark, path, spans, pattern="*").select("doc_id", "from_in_line", F.md5("body").alias("body"))


@query(f"""
SELECT CASE WHEN source IS NULL THEN 'source=__HIVE_DEFAULT_PARTITION__' ELSE 'source=' || source END AS folder, CAST(sum(strlen(line) + 1) AS BIGINT) AS listed, CAST(sum(strlen(line) + 1) AS BIGINT) AS read_bytes, count(*) AS lines
FROM ({_LINE_SQL}) GROUP BY source""")
def walked_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of logs, a folder a source: sizes by listing beside what its chunks hold."""
    path = _folder(spark, "tree")
    _lines(spark, sf_dir).select("source", "value").write.partitionBy("source").text(path)
    folder = F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder")
    listed = files.transcript_listing(spark, path, "part-*").groupBy(folder).agg(F.sum("length").alias("listed"))
    chunks = byte_log.byte_ranges(spark, path, "part-*", partition=1 << 20, chunk=1 << 16)
    lines = byte_log.log_lines(spark, path, "part-*", partition=1 << 20).groupBy(folder).agg(F.count("*").alias("lines"))
    read = chunks.groupBy(folder).agg(F.sum(F.octet_length("body").cast("long")).alias("read_bytes"))
    return listed.join(read, "folder").join(lines, "folder")


@query(f"SELECT doc_id, line FROM ({_LINE_SQL})")
def tailed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over logs that two writers leave one after the other: stopped, then taken up again."""
    path, out, place = (_folder(spark, x) for x in ("log", "tailed", "progress"))
    rows = _lines(spark, sf_dir)
    for half in (0, 1):
        rows.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)) == half).select("value").write.mode("append").text(path)
        lines = byte_log.log_lines(spark, path, stream=True).select("line")
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("line string").parquet(out)
    return found.select(F.substring_index("line", "\t", 1).cast("long").alias("doc_id"), "line")


IDLE_MS = 6 * 3_600_000
_IDLE_SQL = f"""
WITH a AS (SELECT *, epoch_us(happened) // 1000 AS at_ms FROM (
  SELECT user_id AS key, ts AS happened, event_id AS attempt_id, CASE event_type WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'never' ELSE 'later' END AS outcome,
    CAST(sum(1 + CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS eof FROM events)),
g AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER w <= {IDLE_MS} THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY key ORDER BY at_ms, attempt_id)),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY at_ms, attempt_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
c AS (SELECT *, coalesce(max(CASE WHEN outcome IN ('ok', 'never') THEN eof END) OVER (PARTITION BY key, island ORDER BY at_ms, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
f AS (SELECT key, island, max(eof) AS eof, coalesce(max(CASE WHEN outcome IN ('ok', 'never') THEN eof END), 0) AS sent, count(*) AS seq, max(at_ms) AS last,
    coalesce(sum(CASE WHEN outcome = 'never' THEN eof - before END), 0) AS gap_bytes, count(*) FILTER (outcome = 'never') AS gap_count FROM c GROUP BY key, island)
SELECT CAST(key AS VARCHAR) AS session, seq, eof AS sent, CAST(gap_bytes + eof - sent AS BIGINT) AS gap_bytes, gap_count + 1 AS gap_count FROM f
WHERE eof > sent AND last + {IDLE_MS} + 1 <= (SELECT max(at_ms) FROM a) - 600000"""


@query(_IDLE_SQL)
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts of one sub-agent file a user, streamed: what sessions lack that fell silent for six hours."""
    path, out, place = (_folder(spark, x) for x in ("attempts", "ended", "progress"))
    e = load(spark, sf_dir, "events")
    size = (1 + F.round(F.col("value") * 100)).cast("long")
    eof = F.sum(size).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    outcome = mapped("event_type", {"view": "ok", "purchase": "ok", "signup": "never", "click": "later", "error": "later"})
    at_ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    rows = e.select(F.col("user_id").cast("string").alias("session"), F.lit("agent-1").alias("file"), at_ms.alias("at_ms"), F.col("event_id").alias("attempt_id"), eof.alias("eof"), outcome.alias("outcome"), F.lit("").alias("fingerprint"), F.lit(False).alias("last"))
    rows.write.parquet(path)
    inf = float("inf")
    found = delivery.timed_deliveries(spark.readStream.schema(delivery.ATTEMPT).parquet(path), IDLE_MS, caps=(inf, inf, inf), grows=True).filter("result = 'session-ended'")
    with delivery.state_store(spark):
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(delivery.DELIVERY).parquet(out).select("session", "seq", "sent", "gap_bytes", "gap_count")
