"""Readers of the files that a capture client leaves: events, transcripts, spools, states.

Every reader is a lazy DataFrame; streaming variants take ``stream=True`` where the files
only ever grow in number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions import decode, identity
from provenir.sources import byte_log

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def hook_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Valid events of newline-delimited JSON; invalid records are dropped."""
    lines = (spark.readStream if stream else spark.read).schema("value string").text(path)
    return lines.select(decode.sound(decode.hook_event(F.col("value"))).alias("e")).select("e.*")


def transcript_listing(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, modificationTime, length) without reading any content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def subagent_files(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty agent-*.jsonl files below a folder with their keys."""
    return subagents_of(transcript_listing(spark, path, "agent-*.jsonl"))


def subagents_of(listing: DataFrame, root: Column | None = None) -> DataFrame:
    """The non-empty sub-agent files of a listing (path, modificationTime, length) with their
    keys; with ``root`` only those inside it.  Oldest first when sorted by (mtime, path)."""
    found = listing.filter("length > 0").withColumn("file_key", identity.subagent_file_key(F.col("path"))).filter("file_key is not null")
    return found if root is None else found.filter(identity.is_inside(root, F.col("path")))


def current_transcript(listing: DataFrame) -> DataFrame:
    """The newest non-empty transcript of each folder; ties go to the least path."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    newest = F.min_by(F.struct("path", "modificationTime", "length"), F.struct(-F.unix_micros("modificationTime"), "path"))
    return listing.filter("length > 0").groupBy(folder.alias("folder")).agg(newest.alias("f")).select("folder", "f.*")


def spool(spark: SparkSession, path: str) -> DataFrame:
    """Observed commits in file order: (path, line_no, sha, branch, at, files)."""
    lines = byte_log.numbered(byte_log.log_lines(spark, path))
    return lines.select("path", "line_no", decode.sound(decode.spool_entry(F.col("line"))).alias("e")).select("path", "line_no", "e.*")


def session_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per state file: (path, seq, stop, files); a broken file is the empty state."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return files.select("path", decode.session_state(F.col("value")).alias("s")).select("path", "s.*")


def recent_log(spark: SparkSession, path: str) -> DataFrame:
    """sha, subject, author_date of a tab-separated log whose subjects may hold tabs."""
    parts = F.split("value", "\t")
    n = F.size(parts)
    lines = spark.read.text(path).filter(n >= 3)
    return lines.select(F.get(parts, F.lit(0)).alias("sha"), F.array_join(F.slice(parts, F.lit(2), n - 2), "\t").alias("subject"), F.element_at(parts, -1).alias("author_date"))


def tree_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of every file below ``path``, with paths relative to it."""
    files = spark.read.schema(_BINARY).format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file://") + "/"
    return files.select(F.substr("path", F.locate(root, F.col("path")) + len(root)).alias("path"), F.sha2("content", 256).alias("sha256"), "length")


def blame_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha, line, epoch, offset) from files of porcelain output, one line each."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return files.select("path", decode.sound(decode.blame_porcelain(F.col("value"))).alias("b")).select("path", "b.*")
