import pytest
from pyspark.sql import functions as F

from provenir.functions import identity, policy, text


def values(spark, cases, schema, column):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {schema}").withColumn("out", column)
    return [r["out"] for r in sorted(rows.select("i", "out").collect())]


def test_status_classes(spark):
    cases = {200: "ok", 204: "ok", 299: "ok", 400: "never", 413: "never", 401: "fatal", 403: "later", 429: "later", 500: "later", 599: "later", 302: "later", 404: "later", 600: "later", None: "later"}
    assert values(spark, [(s,) for s in cases], "s int", policy.classify_status(F.col("s"))) == list(cases.values())


@pytest.mark.parametrize(
    "remote, slug",
    [
        ("git@github.com:Owner/repo.git", "Owner/repo"),
        ("ssh://git@ssh.github.com:443/o/r.git", "o/r"),
        ("https://GitLab.com/o/r", "gitlab.com/o/r"),
        ("https://github.com.evil.example/o/r", "github.com.evil.example/o/r"),
        ("https://user:pw@host.example:8443/o/r", "host.example/o/r"),
        ("https://github.com/o/r.git/", "o/r.git"),
        ("  https://github.com/o/r  ", "o/r"),
        ("https://github.com/o/r/tree/main", None),
        ("https://github.com/-o/r", None),
        ("https://github.com/o/..", None),
        ("ftp://h/o/r", None),
        ("host.example:o/r", "host.example/o/r"),
        ("https://h/o/" + "r" * 300, None),
        ("", None),
        (None, None),
    ],
)
def test_remote_slug(spark, remote, slug):
    assert values(spark, [(remote,)], "u string", identity.parse_remote_slug(F.col("u"))) == [slug]


def test_local_slug_and_alias(spark):
    repos = spark.createDataFrame([("work:o/r", "/a"), ("git@github.com:o/r", "/b"), (None, "/c"), ("https://work/o/r", "/d")], "remote string, path string")
    aliases = spark.createDataFrame([("work", "git.example"), ("github.com", "evil.example")], "alias string, hostname string")
    found = {r["path"]: r["repo_slug"] for r in identity.with_repo_slug(repos, aliases).collect()}
    assert found["/a"] == "git.example/o/r" and found["/b"] == "o/r" and found["/d"] == "work/o/r"
    assert found["/c"].startswith("local:") and len(found["/c"]) == 18


def test_paths(spark):
    cases = [("/r", "/r", True), ("/r", "/r/a", True), ("/r", "/rx", False), ("/r", None, False)]
    assert values(spark, [c[:2] for c in cases], "a string, b string", identity.is_inside(F.col("a"), F.col("b"))) == [c[2] for c in cases]
    assert values(spark, [("a/b:c",), ("...",), ("",), ("x" * 200,)], "s string", identity.sanitise(F.col("s"))) == ["a_b_c", "_", "_", "x" * 128]
    assert values(spark, [("/t/agent-1.jsonl",), ("/t/agent-1.meta.json",), ("/t/main.jsonl",)], "p string", identity.subagent_file_key(F.col("p"))) == ["agent-1", None, None]
    urls = [("https://h/x", True), ("http://localhost:1/x", True), ("http://127.0.0.1/", True), ("http://h/x", False), ("nope", False)]
    assert values(spark, [u[:1] for u in urls], "u string", identity.is_allowed_ingest_url(F.col("u"))) == [u[1] for u in urls]


def test_spans_and_budgets(spark):
    spans = values(spark, [(0, 10), (10, 10), (50, 20), (10, 30)], "s long, e long", policy.next_span(F.col("s"), F.col("e")))
    assert [x and tuple(x) for x in spans] == [(0, 10), None, (0, 20), (10, 30)]
    assert values(spark, [(5000, 0), (5000, 4990), (5000, 9000)], "b long, c long", policy.send_timeout_ms(F.col("b"), F.col("c"))) == [3000, 50, 50]
    assert values(spark, [(5000,), (100,)], "b long", policy.settle_delay_ms(F.col("b"))) == [250, 30]
    assert values(spark, [(49,), (50,), (9000,)], "r long", policy.spawn_timeout_ms(F.col("r"), F.lit(2000))) == [None, 50, 2000]
    assert values(spark, [(None, 5), (5, None), (5, 3), (5, 9)], "a long, b long", policy.settled_size(F.col("a"), F.col("b"))) == [None, 5, 5, 9]
    assert values(spark, [("7",), ("-1",), ("x",), (None,)], "v string", policy.positive_or(F.col("v"), 3)) == [7.0, 3.0, 3.0, 3.0]


def test_relative_age(spark):
    cases = [(-5, "just now"), (59_999, "just now"), (60_000, "1 minute ago"), (7_200_000, "2 hours ago"), (86_400_000, "1 day ago"), (172_800_000, "2 days ago")]
    assert values(spark, [(c[0],) for c in cases], "g long", text.relative_age(F.lit(0), F.col("g"))) == [c[1] for c in cases]


def test_dates_and_targets(spark):
    assert values(spark, [(1735673400, "+0200"), (1735673400, "-0100"), (1735673400, "")], "e long, o string", text.author_date(F.col("e"), F.col("o"))) == ["2024-12-31", "2024-12-31", "2024-12-31"]
    assert values(spark, [(1735682400, "+0200")], "e long, o string", text.author_date(F.col("e"), F.col("o"))) == ["2025-01-01"]
    found = values(spark, [("a:b.py:47",), ("f:0",), ("f:1e3",), ("f:",), ("-x:1",), (":3",)], "s string", text.parse_target(F.col("s")))
    assert [x and tuple(x) for x in found] == [("a:b.py", 47), None, None, None, None, None]
    assert values(spark, [("22.15.0",), ("v22.14.9",), ("23.0.0",), ("x",)], "v string", text.version_at_least(F.col("v"))) == [True, False, True, False]


def test_bounded_text(spark):
    assert values(spark, [("abcdef", 4), ("abc", 4)], "s string, n int", text.truncate_path(F.col("s"), F.col("n"))) == ["…def", "abc"]
    assert values(spark, [("é" * 70,), ("short",)], "s string", text.bound_quote(F.col("s"))) == ["é" * 64 + "…", "short"]
    assert values(spark, [("key",), ("a very long label",)], "s string", text.labelled(2, F.col("s"), F.lit("v"))) == ["  key        v", "  a very long labelv"]


def plain_wrap(s, indent, width=80):
    lines, line, empty = [], " " * indent, True
    for w in s.split():
        if not empty and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = " " * indent + w
        else:
            line = line + ("" if empty else " ") + w
        empty = False
    return lines if empty else [*lines, line]


def test_wrap(spark):
    cases = ["", "one", "word " * 60, "x" * 100 + " tail", " ".join("w" * (i % 13 + 1) for i in range(90))]
    assert values(spark, [(c,) for c in cases], "s string", text.wrap(F.col("s"), 2)) == [plain_wrap(c, 2) for c in cases]


def test_turn_rows_and_grades(spark):
    marker = text.attribution_marker(F.col("a"), F.col("r"), F.col("n"))
    cases = [("x", True, None, "· sub-agent x"), (None, True, 2, "· 2 sub-agents"), (None, True, None, ""), (None, False, None, "· actor not recorded")]
    assert values(spark, [c[:3] for c in cases], "a string, r boolean, n long", marker) == [c[3] for c in cases]
    row = text.turn_row(F.col("p"), F.col("t"), F.col("f"), F.col("m"))
    assert values(spark, [(12, "Edit", [], ""), (13, "Write", [], "· m"), (14, None, ["a.py", "b.py"], "")], "p long, t string, f array<string>, m string", row) == ["    turn 12  [Edit]", "    turn 13  [Write]  · m", "    turn 14  a.py, b.py"]
    assert values(spark, [(["derived", "observed"],), (["derived"],), ([],)], "g array<string>", text.grade_floor(F.col("g"))) == ["observed", "derived", None]


def test_redaction_keeps_the_byte_length(spark):
    cases = ["", "abc", "é" * 8, "x" * 13, "y" * 32, "ü" * 40, "z" * 5000]
    found = values(spark, [(c,) for c in cases], "s string", text.redact_span(F.col("s")))
    assert [len(x.encode()) for x in found] == [len(c.encode()) for c in cases]
    assert found[3] == "[OUT-OF-TREE]" and found[-1].startswith("[OUT-OF-TREE: 5000 bytes withheld...")
