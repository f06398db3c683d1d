import json

from pyspark.sql import functions as F

from provenir.functions import decode, identity, policy, text
from provenir.sources import git_tables


def test_tool_answers(spark):
    ok = json.dumps({"result": {"content": [{"text": '{"a":1}'}], "isError": True}})
    cases = [(None, "", "unreachable"), (401, "", "unauthorized"), (200, "<", "malformed"), (200, '{"error":{"code":-3,"message":"m"}}', "rpc-error"), (200, '{"result":{"content":[]}}', "malformed"), (200, '{"result":{"content":[{"text":"{"}]}}', "malformed"), (200, ok, "ok")]
    rows = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(cases)], "i int, s int, b string")
    found = [r["a"] for r in rows.select("i", decode.tool_answer(F.col("s"), F.col("b")).alias("a")).orderBy("i").collect()]
    assert [a["kind"] for a in found] == [c[2] for c in cases]
    assert tuple(found[-1]) == ("ok", '{"a":1}', True, None, None) and (found[3]["code"], found[3]["message"]) == (-3, "m")


def test_git_export(spark):
    commits = spark.createDataFrame([("r", "d", "2024-03-01"), ("r", "b", "2024-02-01"), ("r", "c", "2024-02-02"), ("r", "a", "2024-01-01"), ("q", "d", "2024-03-01")], "repo string, sha string, committed_at string").withColumn("committed_at", F.to_timestamp("committed_at"))
    parents = spark.createDataFrame([("r", "d", "b"), ("r", "d", "c"), ("r", "b", "a"), ("r", "c", "a")], "repo string, child string, parent string")
    refs = spark.createDataFrame([("r", "main", "d", True, True), ("q", "d", "d", True, False)], "repo string, ref string, sha string, is_head boolean, is_branch boolean")
    found = sorted(map(tuple, git_tables.window_commits(commits, parents, refs, "2024-02-01").collect()))
    assert found == [("q", "d", "d"), ("r", "main", "b"), ("r", "main", "c"), ("r", "main", "d")]
    assert sorted(map(tuple, git_tables.heads(refs).collect()), key=str) == [("q", "d", None), ("r", "d", "main")]
    touched = spark.createDataFrame([("r", "d", "x"), ("r", "b", "y"), ("r", "b", "x")], "repo string, sha string, path string")
    files = git_tables.changed_files(touched, parents)
    assert [(r["sha"], r["files"]) for r in files.collect()] == [("b", ["x", "y"])]
    sessions = spark.createDataFrame([("r", "b", "s"), ("r", "c", None), ("q", "d", "s")], "repo string, sha string, session_id string")
    allowed = spark.createDataFrame([("r",)], "repo string")
    assert [(r["sha"], r["files"]) for r in git_tables.observed(commits, files, sessions, allowed).collect()] == [("b", ["x", "y"])]
    repos = spark.createDataFrame([("r", "/r", "https://h/o/r", False), ("q", "/q", None, None)], "repo string, path string, remote string, shallow boolean")
    assert {r["repo"]: (r["repo_slug"][:6], r["complete"]) for r in git_tables.repositories(repos).collect()} == {"r": ("h/o/r", True), "q": ("local:", False)}


def test_sinks(spark, tmp_path):
    from provenir.sources import files

    rows = spark.createDataFrame([("r", "a" * 40, "t", ["x"])], "repo string, sha string, at string, files array<string>")
    git_tables.append_spool(rows, f"{tmp_path}/spool")
    git_tables.append_spool(rows, f"{tmp_path}/spool")
    assert files.spool(spark, f"{tmp_path}/spool/repo=r").count() == 2
    git_tables.write_manifest(spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string"), f"{tmp_path}/m")
    assert sorted(map(tuple, git_tables.read_manifest(spark, f"{tmp_path}/m").collect())) == [("a", "1"), ("b", "2")]


def test_sentences(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.no_commits(F.lit("main"), F.lit("May"))) == "No commits on main in May."
    assert one(text.no_sessions(F.lit(3), F.lit("May"))) == "No recorded sessions for the 3 commits in May."
    assert one(text.truncation(F.lit(1), F.lit(4), F.lit(9))).startswith("Showing turns 1-4 of 9 ")
    assert one(text.truncation(F.lit(1), F.lit(9), F.lit(9))) is None
    assert one(text.files_without_turn(F.lit(1))).startswith("1 more file ") and one(text.files_without_turn(F.lit(0))) is None
    assert one(text.valid_since(F.lit("2026-99-99"))) and not one(text.valid_since(F.lit("yesterday")))
    assert one(identity.ingest_url(F.lit(" "), "https://d")) == "https://d" and one(identity.ingest_url(F.lit("http://h"), "https://d")) is None
    assert one(policy.is_fresh(F.lit(70_000), F.lit(5_000))) and not one(policy.is_fresh(F.lit(60_000), F.lit(0)))
    assert one(decode.approval_pending(F.struct(F.lit("pending").alias("code")), "pending"))
