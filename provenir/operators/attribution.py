"""Which session a commit belongs to, and which turns belong to a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.policy import LIVE_SECONDS


def active_session(commits: DataFrame, touches: DataFrame, window_s: int = LIVE_SECONDS) -> DataFrame:
    """Adds the session last touched within ``window_s`` before each commit (else null).

    commits is (repo, commit_id, at), touches (repo, session_id, at, touch_id).  Both sides
    fall into time buckets as wide as the window, touches also into the next one; within
    a (repo, bucket) one ordered pass carries the last touch forward.  A commit meets no
    touch more than once and a busy repository spreads over its buckets.  A touch after
    the commit is not known when the commit is observed and plays no part; among touches
    of one moment the greatest touch_id wins.
    """
    seconds = F.unix_micros(F.col("at").cast("timestamp"))
    width = window_s * 1_000_000
    own = F.floor(F.col("us") / width)
    null = F.lit(None)
    t = touches.select("repo", seconds.alias("us"), "session_id", "touch_id")
    t = t.withColumn("bucket", F.explode(F.array(own, own + 1)))
    t = t.select("repo", "bucket", "us", F.lit(0).alias("turn"), F.struct("us", "session_id").alias("touch"), "touch_id", null.cast("long").alias("commit_id"))
    c = commits.select("repo", seconds.alias("us"), "commit_id").withColumn("bucket", own)
    c = c.select("repo", "bucket", "us", F.lit(1).alias("turn"), null.cast(t.schema["touch"].dataType).alias("touch"), null.cast("long").alias("touch_id"), "commit_id")
    order = Window.partitionBy("repo", "bucket").orderBy("us", "turn", "touch_id").rowsBetween(Window.unboundedPreceding, 0)
    met = t.unionByName(c).withColumn("last", F.last("touch", ignorenulls=True).over(order)).filter("turn = 1")
    fresh = F.col("us") - F.col("last.us") <= width
    return met.select("repo", "commit_id", "us", F.when(fresh, F.col("last.session_id")).alias("session_id"), F.when(fresh, F.col("last.us")).alias("touched_us"))


def with_recorded_commit(blamed: DataFrame, successors: DataFrame) -> DataFrame:
    """Resolve rewritten commits: adds recorded_sha and match_kind (exact or probable, never merged).

    blamed is (sha, ..), successors (new_sha, old_sha, match_kind).
    """
    hop = successors.select(F.col("new_sha").alias("sha"), F.col("old_sha").alias("recorded_sha"), "match_kind")
    return blamed.join(hop, "sha", "left")


def why_turns(blamed: DataFrame, edges: DataFrame, turns: DataFrame) -> DataFrame:
    """One document per blamed line: state, grades and ordered turns of its commit.

    blamed is (repo, sha, file, ..); edges (repo, sha, session_id, grade); turns (repo, sha,
    file, position, tool, files, agent_id, agent_id_recorded, subagent_count).
    """
    key = ["repo", "sha"]
    held = edges.groupBy(*key).agg(F.sort_array(F.collect_set("grade")).alias("grades"))
    fields = F.struct("position", "tool", "files", "agent_id", "agent_id_recorded", "subagent_count")
    own = turns.groupBy(*key, "file").agg(F.sort_array(F.collect_list(fields)).alias("turns"))
    out = blamed.join(held, key, "left").join(own, [*key, "file"], "left")
    state = F.when(F.col("grades").isNull(), "no_edge").otherwise("turns")
    return out.withColumn("state", state)


def turn_windows(turns: DataFrame, by: list[str], shown: int) -> DataFrame:
    """First and last shown place, total, and whether the list is partial, per group.

    The bounds follow from the count, so this is one partial aggregate without a sort.
    """
    total = turns.groupBy(*by).agg(F.count("*").alias("total"))
    last = F.least(F.col("total"), F.lit(shown)).cast("long")
    return total.select(*by, F.lit(1).cast("long").alias("first"), last.alias("last"), "total", (F.col("total") > shown).alias("partial"))


def shown_turns(turns: DataFrame, by: list[str], shown: int) -> DataFrame:
    """The turns inside the display window, in order of position (cut before the shuffle)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("position"))
    return turns.withColumn("place", place).filter(F.col("place") <= shown)


def same_patch(commits: DataFrame) -> DataFrame:
    """Probable successors (repo, new_sha, old_sha, match_kind): each commit whose exported
    patch id an earlier commit of its repository has, linked to the earliest one.

    commits is (repo, sha, patch_id, committed_at); a null patch id (a merge, an empty
    commit) matches nothing.  One partial aggregate and a join, never the pairs of a group.
    """
    known = commits.filter("patch_id is not null")
    first = known.groupBy("repo", "patch_id").agg(F.min(F.struct("committed_at", "sha")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = known.join(first, ["repo", "patch_id"]).filter("sha != first.sha")
    return met.select("repo", F.col("sha").alias("new_sha"), F.col("first.sha").alias("old_sha"), F.lit("probable").alias("match_kind"))


def files_without_turn(touched: DataFrame, turns: DataFrame) -> DataFrame:
    """(repo, sha, missing): how many files of each commit have no linked turn; none gives no row.

    Both are (repo, sha, file).
    """
    key = ["repo", "sha", "file"]
    return touched.select(*key).distinct().join(turns.select(*key), key, "left_anti").groupBy("repo", "sha").agg(F.count("*").alias("missing"))
