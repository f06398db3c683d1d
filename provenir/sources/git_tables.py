"""Exported git tables: commits, parents, refs, touched files; and the sinks beside them.

Git itself runs outside Spark; an export has commits (repo, sha, committed_at, patch_id),
parents (repo, child, parent), refs (repo, ref, sha, is_head, is_branch), files (repo, sha,
path) and repos (repo, path, remote, shallow).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions import identity
from provenir.operators.coverage import reachable


def repositories(repos: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds repo_slug and complete; an unknown shallow flag counts as shallow."""
    out = identity.with_repo_slug(repos, aliases)
    return out.withColumn("complete", F.coalesce(~F.col("shallow"), F.lit(False)))


def heads(refs: DataFrame) -> DataFrame:
    """(repo, sha, branch) of each head; a detached head has no branch."""
    return refs.filter("is_head").select("repo", "sha", F.when(F.col("is_branch"), F.col("ref")).alias("branch"))


def window_commits(commits: DataFrame, parents: DataFrame, refs: DataFrame, since: str) -> DataFrame:
    """(repo, ref, sha) of commits on each ref since a day."""
    key = lambda sha: F.concat_ws(":", "repo", sha)
    starts = refs.select(F.concat_ws("\t", "repo", "ref").alias("root"), key("sha").alias("node"))
    edges = parents.select(key("child").alias("child"), key("parent").alias("parent"))
    recent = commits.filter(F.col("committed_at") >= F.lit(since).cast("timestamp")).select(key("sha").alias("node"), "repo", "sha")
    return reachable(starts, edges).join(recent, "node").select("repo", F.element_at(F.split("root", "\t"), -1).alias("ref"), "sha")


def changed_files(files: DataFrame, parents: DataFrame) -> DataFrame:
    """(repo, sha, files): touched paths; a merge touches none."""
    merges = parents.groupBy("repo", F.col("child").alias("sha")).count().filter("count > 1")
    return files.join(merges, ["repo", "sha"], "left_anti").groupBy("repo", "sha").agg(F.sort_array(F.collect_set("path")).alias("files"))


def observed(commits: DataFrame, touched: DataFrame, sessions: DataFrame, allowed: DataFrame) -> DataFrame:
    """Spool rows of commits in repositories with consent and a live session.

    sessions is (repo, sha, session_id), as attribution gives it; others leave no trace.
    """
    live = sessions.filter("session_id is not null").select("repo", "sha", "session_id")
    rows = commits.join(allowed.select("repo").distinct(), "repo", "left_semi").join(live, ["repo", "sha"])
    return rows.join(touched, ["repo", "sha"], "left").select("repo", "session_id", "sha", F.col("committed_at").alias("at"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def append_spool(rows: DataFrame, path: str) -> None:
    """One JSON line a commit; consumed lines are skipped by count, never rewritten."""
    rows.write.mode("append").partitionBy("repo").json(path)


def write_manifest(tree: DataFrame, path: str) -> None:
    """(path, sha256) rows, sorted within files."""
    tree.select("path", "sha256").sortWithinPartitions("path").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, sha256 string").parquet(path)
