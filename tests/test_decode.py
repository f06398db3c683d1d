import json

from pyspark.sql import functions as F

from provenir.functions import decode


def run(spark, docs, f):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "i int, raw string")
    return [r["o"] for r in sorted(rows.select("i", f(F.col("raw")).alias("o")).collect(), key=lambda r: r["i"])]


def test_hook_event(spark):
    good = {"session_id": "s", "transcript_path": "/t", "cwd": "/c", "hook_event_name": "Stop"}
    found = run(spark, [good, {"session_id": "s", "transcript_path": "/t"}, "nope", "[]", "null", {**good, "session_id": ""}, {**good, "session_id": 7}], decode.hook_event)
    assert tuple(found[0]) == ("s", "/t", "/c", "Stop") and tuple(found[1]) == ("s", "/t", None, "")
    assert found[2:] == [None] * 5


def test_counts(spark):
    f = lambda c: decode.as_count(decode.field(decode.parse(c), "x"))
    assert run(spark, ['{"x":1}', '{"x":1.0}', '{"x":"1"}', '{"x":-1}', '{"x":1.5}', '{"x":null}', "{}"], f) == [1, 1, None, None, None, None, None]


def test_presence(spark):
    docs = ['{"a":null}', "{}", '{"a":"x"}']
    present = run(spark, docs, lambda c: decode.field(decode.parse(c), "a").isNotNull())
    null = run(spark, docs, lambda c: decode.is_null(decode.field(decode.parse(c), "a")))
    assert present == [True, False, True] and null == [True, False, False]


def test_session_state(spark):
    ok = {"seq": 3, "stop": None, "files": {"main": {"sentOffset": 100, "backlog": [{"from": 100, "to": 150, "at": 1}], "gapBytes": 0, "gapCount": 0, "lastSentAt": 5}}}
    def state(**x):
        return {"seq": 1, "files": {"main": {"sentOffset": 0, "backlog": [], **x}}}

    cut = state(backlog=[{"from": 100, "to": 150, "at": 1}, {"from": 160, "to": 170, "at": 2}])
    bad = state(backlog=[{"from": 5, "to": 5, "at": 1}])
    found = run(spark, [ok, cut, bad, state(sentOffset=-1), state(sentOffset="7"), state(sentOffset=7.9), "torn {", {"stop": {"at": "x", "fingerprint": ""}}], decode.session_state)
    assert found[0]["seq"] == 3 and found[0]["files"]["main"]["sent_offset"] == 100 and len(found[0]["files"]["main"]["backlog"]) == 1
    assert [len(x["files"]["main"]["backlog"]) for x in found[1:3]] == [1, 0]
    assert [x["files"]["main"]["sent_offset"] for x in found[3:6]] == [0, 0, 7]
    assert found[6]["seq"] == 0 and found[6]["files"] == {} and found[7]["stop"] is None


def test_spool_entry(spark):
    sha = "a" * 40
    good = {"sha": sha, "branch": "", "at": "2026-01-01T00:00:00Z", "files": ["a.py", 3]}
    found = run(spark, [good, {**good, "sha": "a" * 7}, {**good, "sha": "A" * 40}, '{"sha":"' + sha], decode.spool_entry)
    assert tuple(found[0]) == (sha, None, "2026-01-01T00:00:00Z", ["a.py"]) and found[1:] == [None] * 3


def test_coverage_payload(spark):
    good = {"ref": "main", "edges_held": 10, "exact_successors": 2, "captured_shas": ["x"], "by_grade": {"derived": 8, "declared": 2}, "probable_line": {"count": 1, "label": "ignored"}}
    bad = [{**good, "by_grade": {"other": 1}}, {**good, "edges_held": -1}, {**good, "edges_held": 1.5}, {**good, "edges_held": "10"}, {**good, "captured_shas": [" "]}, {**good, "ref": " "}, {**good, "by_grade": []}]
    found = run(spark, [good, *bad], decode.coverage_payload)
    assert found[0]["edges_held"] == 10 and found[0]["by_grade"] == {"derived": 8, "declared": 2} and found[0]["probable_count"] == 1
    assert found[1:] == [None] * len(bad)


def test_blame_payload(spark):
    t = {"position": 1, "tool": "Edit", "files": ["a"], "excerpt": ["q"]}
    def doc(**x):
        return {"state": "turns", "match_kind": None, "grades": ["derived"], "turns": [t], **x}

    docs = [doc(turns=[{**t, "agent_id": None}, t, {**t, "agent_id": "x", "files": None}]), doc(turns=[{**t, "agent_id": ""}]), doc(grades=[]), doc(turns=[t, {"tool": "x"}]), doc(window={"first": 5, "last": 3, "total": 9}), {"state": "squash_resolved", "recorded_sha": "s", "match_kind": None}, {"state": "squash_resolved", "recorded_sha": "s", "match_kind": "exact"}, {"state": "no_edge"}, {"state": "other"}, doc(window={"first": 1, "last": 3, "total": 9}, files_without_turn=2)]
    found = run(spark, docs, decode.blame_payload)
    assert [(x["agent_id"], x["agent_id_recorded"], x["files"]) for x in found[0]["turns"]] == [(None, True, ["a"]), (None, False, ["a"]), ("x", True, [])]
    assert found[1:6] == [None] * 5 and found[8] is None
    assert found[6]["recorded_sha"] == "s" and found[7]["state"] == "no_edge"
    assert tuple(found[9]["window"]) == (1, 3, 9) and found[9]["files_without_turn"] == 2


def test_error_detail_and_porcelain(spark):
    found = run(spark, ['{"error":{"code":"pending","owners_notified":2}}', '{"code":"x","owners_notified":null}', "<html>", '{"code":"' + "x" * 70000 + '"}'], decode.error_detail)
    assert tuple(found[0]) == ("pending", 2, True) and tuple(found[1]) == ("x", None, True) and found[2:] == [None, None]
    sha = "b" * 40
    found = run(spark, [f"{sha} 3 47 1\nauthor X\nauthor-time 1735682400\nauthor-tz +0200\n", f"{'0' * 40} 1 1\nauthor-time 1\n", "bad", f"{sha} 3 47\n"], decode.blame_porcelain)
    assert tuple(found[0]) == (sha, 47, 1735682400, "+0200") and found[1:] == [None] * 3
