import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenir.operators import attribution, claims, coverage, keyed, manifest
from provenir.sources import byte_log, files
from provenir.streaming import delivery


def put(path, data, mtime=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    if mtime:
        os.utime(path, (mtime, mtime))


def test_transcripts(spark, tmp_path):
    put(tmp_path / "p/a.jsonl", b"0123456789", 100)
    put(tmp_path / "p/b.jsonl", b"xyz", 200)
    put(tmp_path / "p/empty.jsonl", b"", 300)
    put(tmp_path / "p/b/subagents/agent-1.jsonl", b"sub", 50)
    put(tmp_path / "p/b/subagents/agent-1.meta.json", b"{}", 50)
    put(tmp_path / "p/b/subagents/agent-2.jsonl", b"", 60)
    assert [r["file_key"] for r in files.subagent_files(spark, str(tmp_path)).collect()] == ["agent-1"]
    newest = {r["folder"].rsplit("/", 1)[1]: r["path"].rsplit("/", 1)[1] for r in files.current_transcript(files.transcript_listing(spark, str(tmp_path))).collect()}
    assert newest["p"] == "b.jsonl"
    path = files.transcript_listing(spark, str(tmp_path), "a.jsonl").first()["path"]
    spans = spark.createDataFrame([(path, 2, 5), (path, 8, 20), (path, 20, 30)], "path string, from_off long, to_off long")
    assert sorted(bytes(r["body"]) for r in byte_log.read_spans(spark, str(tmp_path), spans).collect()) == [b"", b"234", b"89"]


def test_text_sources(spark, tmp_path):
    put(tmp_path / "hooks/e.jsonl", b'{"session_id":"s","transcript_path":"/t"}\nnope\n')
    assert files.hook_events(spark, str(tmp_path / "hooks")).count() == 1
    sha = "a" * 40
    put(tmp_path / "spool/x.jsonl", f'{{"sha":"{sha}","at":"t","files":[]}}\nbad\n{{"sha":"{"b" * 40}","at":"u"}}\n{{"sha":'.encode())
    assert [(r["line_no"], r["sha"][0]) for r in files.spool(spark, str(tmp_path / "spool")).orderBy("line_no").collect()] == [(0, "a"), (2, "b")]
    put(tmp_path / "log/l.tsv", b"abc\ta\tsubject\twith tabs\t2024-01-01\nbroken\n")
    assert [tuple(r) for r in files.recent_log(spark, str(tmp_path / "log")).collect()] == [("abc", "a\tsubject\twith tabs", "2024-01-01")]
    put(tmp_path / "state/s.json", b"torn {")
    assert files.session_states(spark, str(tmp_path / "state")).first()["seq"] == 0
    put(tmp_path / "blame/b.txt", f"{sha} 1 2 1\nauthor-time 5\nauthor-tz +0000\n".encode())
    assert files.blame_lines(spark, str(tmp_path / "blame")).first()["line"] == 2


def test_manifest(spark, tmp_path):
    put(tmp_path / "t/bin/a.js", b"A")
    put(tmp_path / "t/bin/lib/b.js", b"B")
    tree = files.tree_manifest(spark, str(tmp_path / "t"))
    assert sorted(r["path"] for r in tree.collect()) == ["bin/a.js", "bin/lib/b.js"]
    pinned = spark.createDataFrame([("bin/a.js", "0"), ("bin/gone.js", "1")], "path string, sha256 string")
    assert sorted(map(tuple, manifest.diff(tree, pinned).collect())) == [("bin/a.js", "changed"), ("bin/gone.js", "removed"), ("bin/lib/b.js", "added")]
    m = manifest.measure(tree).first()
    assert (m["files"], m["bytes"]) == (2, 2) and len(m["digest"]) == 64
    imports = spark.createDataFrame([("bin/a.js", "./lib/b.js"), ("bin/lib/b.js", "../a.js"), ("bin/a.js", "./none.js")], "path string, specifier string")
    assert [r["target"] for r in manifest.import_failures(imports, tree).collect()] == ["bin/none.js"]
    state = "bundle string, content string, commit string, digest string"
    d = manifest.drift(spark.createDataFrame([("x", "1", "c", "d"), ("y", "1", "c", "d")], state), spark.createDataFrame([("x", "2", "c2", "d2"), ("y", "2", "c", "d")], state))
    assert {r["bundle"]: r["drifted"] for r in d.collect()} == {"x": False, "y": True}


def test_closure_handles_diamonds_and_depth(spark):
    parents = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y")], "child string, parent string")
    starts = spark.createDataFrame([("main", "d"), ("other", "b")], "root string, node string")
    assert sorted(map(tuple, coverage.reachable(starts, parents).collect())) == [("main", "a"), ("main", "b"), ("main", "c"), ("main", "d"), ("other", "a"), ("other", "b")]


def test_coverage_states(spark):
    commits = spark.createDataFrame([("r", "1", True, True, None), ("r", "2", True, False, "exact"), ("r", "3", False, False, "probable"), ("r", "4", True, False, None), ("e", "5", True, True, None), ("w", "1", False, True, None)], "ref string, sha string, in_window boolean, reachable boolean, successor string")
    edges = spark.createDataFrame([("1", "derived"), ("2", "observed"), ("3", "declared"), ("4", "derived"), ("4", "declared")], "sha string, grade string")
    found = {r["ref"]: r for r in coverage.coverage(commits, edges).collect()}
    assert (found["r"]["edges_held"], found["r"]["counted"], found["r"]["percent"], found["r"]["probable_count"]) == (4, 2, 50, 1)
    assert (found["e"]["state"], found["e"]["percent"], found["w"]["state"]) == ("no_sessions", None, "no_commits")
    assert {r["sha"]: r["floor"] for r in coverage.grade_floors(edges).collect()}["4"] == "declared"


def test_asof_edges(spark):
    ts = lambda x: F.to_timestamp(F.lit(x))
    def rows(name, xs):
        return spark.createDataFrame([("r", x, i) for i, x in enumerate(xs)], f"repo string, at string, {name} long").withColumn("at", F.to_timestamp("at"))

    commits = rows("commit_id", ["2024-01-01 01:00:00", "2024-01-01 02:00:00", "2024-01-01 00:00:00"])
    touches = rows("session_id", ["2024-01-01 00:30:00", "2024-01-01 00:45:00", "2024-01-01 00:45:00", "2024-01-01 02:00:01"]).withColumn("touch_id", F.col("session_id"))
    found = {r["commit_id"]: r["session_id"] for r in attribution.active_session(commits, touches).collect()}
    assert found == {0: 2, 1: None, 2: None}
    assert ts("2024-01-01 00:00:00") is not None


def test_claims(spark):
    phrases = claims.blocked_phrases(spark)
    texts = spark.createDataFrame([("why", "once an owner approves"), ("why", "It PROVES this"), ("connect", "was attested"), ("help", "cannot aim"), ("connect", "safe"), ("why", "safe"), ("help", "éproves")], "surface string, text string")
    found = sorted((r["text"], r["phrase"]) for r in claims.scan(texts, phrases).collect())
    assert found == [("It PROVES this", "proves"), ("safe", "safe"), ("was attested", "attest"), ("éproves", "proves")]


def test_keyed(spark):
    log = spark.createDataFrame([("a", "grant", 1, 1), ("a", "revoke", 2, 2), ("b", "revoke", 1, 3), ("b", "grant", 1, 4)], "key string, action string, at long, entry_id long")
    assert [r["key"] for r in keyed.consented(log).collect()] == ["b"]
    spooled = spark.createDataFrame([("r", i) for i in range(5)], "repo string, line_no int")
    done = spark.createDataFrame([("r", 3)], "repo string, consumed int")
    assert sorted(r["line_no"] for r in keyed.unsent(spooled, done, ["repo"]).collect()) == [3, 4]


def test_squash_and_documents(spark):
    blamed = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "sha string")
    hops = spark.createDataFrame([("n1", "o1", "exact"), ("n2", "o2", "probable")], "new_sha string, old_sha string, match_kind string")
    found = {r["sha"]: (r["recorded_sha"], r["match_kind"]) for r in attribution.with_recorded_commit(blamed, hops).collect()}
    assert found == {"n1": ("o1", "exact"), "n2": ("o2", "probable"), "n3": (None, None)}
    doc = delivery.machine_documents(spark.createDataFrame([(None, 1)], "percent long, n long"), "report", "coverage").first()["value"]
    assert doc == '{"schema":1,"verb":"report","outcome":"coverage","percent":null,"n":1}'
    sent = spark.createDataFrame([("s", 1, 0, "main", "o/r", "1", "", "main", []), ("s", 2, 5, "main", "o/r", "1", "h", None, ["a", "b"])], "session string, seq long, offset long, file string, repo_slug string, client_version string, head_sha string, branch string, shas array<string>")
    rows = [(r["head_sha"], r["branch"], r["shas"]) for r in delivery.header_rows(sent).orderBy("seq").collect()]
    assert rows == [(None, "main", None), ("h", None, "a,b")]


def test_a_long_history_closes_in_few_rounds(spark):
    n = 100_000
    parents = spark.range(1, n).selectExpr("id as child", "id - 1 as parent")
    starts = spark.createDataFrame([("a", n - 1), ("b", 7), ("c", -5)], "root string, node long")
    found = {r["root"]: (r["n"], r["low"]) for r in coverage.reachable(starts, parents).groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("low")).collect()}
    assert found == {"a": (n, 0), "b": (8, 0), "c": (1, -5)}


@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=40), st.lists(st.integers(0, 14), min_size=1, max_size=3))
@settings(max_examples=8, deadline=None)
def test_closure_of_random_histories(spark, pairs, roots):
    up = {(max(a, b), min(a, b)) for a, b in pairs if a != b}
    expected = set()
    for r in roots:
        todo = [r]
        while todo:
            x = todo.pop()
            if (r, x) not in expected:
                expected.add((r, x))
                todo += [b for a, b in up if a == x]
    parents = spark.createDataFrame(sorted(up), "child long, parent long")
    found = coverage.reachable(spark.createDataFrame([(r, r) for r in roots], "root long, node long"), parents, steps=2)
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_unknown_reachability_refuses_the_rate(spark):
    commits = spark.createDataFrame([("x", 1, True, True, None), ("x", 2, True, None, None), ("y", 3, True, True, None), ("y", 9, True, None, None)], "ref string, sha long, in_window boolean, reachable boolean, successor string")
    edges = spark.createDataFrame([(1, "derived"), (2, "observed"), (3, "declared")], "sha long, grade string")
    found = {r["ref"]: (r["state"], r["percent"]) for r in coverage.coverage(commits, edges).collect()}
    assert found == {"x": ("unknown", None), "y": ("coverage", 100)}


def test_utc_day_in_another_zone(spark):
    from provenir.functions import text

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp'2026-01-02 03:00:00 UTC' as a, timestamp_ntz'2026-01-02 23:00:00' as b")
        assert tuple(df.select(text.utc_day(F.col("a")), text.utc_day(F.col("b"))).first()) == ("2026-01-02", "2026-01-02")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sink_keeps_one_row_a_key_over_all_batches(spark, tmp_path):
    from provenir.streaming.delivery import idempotent_sink

    write = idempotent_sink(str(tmp_path / "sent"), ["k"])
    batch = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    write(batch((1, "a"), (1, "a"), (2, "b")), 0)
    write(batch((2, "b"), (3, "c")), 1)
    write(batch((2, "b"), (3, "c")), 1)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "sent")).collect()) == [1, 2, 3]


def test_spans_outside_the_root_are_not_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes(b"0123456789")
    (tmp_path / "b.jsonl").write_bytes(b"secret")
    rows = [(f"file:{tmp_path}/in/a.jsonl", 2, 5), (f"file:{tmp_path}/in/a.jsonl", 8, 50), (f"file:{tmp_path}/in/a.jsonl", 2**33, 2**33 + 5), (f"file:{tmp_path}/in/none.jsonl", 0, 3), (f"file:{tmp_path}/b.jsonl", 0, 3)]
    spans = spark.createDataFrame(rows, "path string, from_off long, to_off long")
    found = {(r["path"].rsplit("/", 1)[1], r["from_off"]): r["body"] for r in byte_log.read_spans(spark, f"{tmp_path}/in", spans).collect()}
    assert {k: v and bytes(v) for k, v in found.items()} == {("a.jsonl", 2): b"234", ("a.jsonl", 8): b"89", ("a.jsonl", 2**33): b"", ("none.jsonl", 0): None, ("b.jsonl", 0): None}
