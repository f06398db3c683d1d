"""Redaction inside records, and host names from ordered patterns."""

import fnmatch
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenir.functions import identity, redaction

ROOT = "/home/me/repo"
CASES = [
    ("see /etc/passwd now", "see ........... now"),
    ("/home/me/repo/a.py and /home/me/repo", None),
    ("/home/me/repository/secret", "[OUT-OF-TREE]............."),
    ("/home/me/repo/../other/x.txt", "[OUT-OF-TREE]..............."),
    ("rel/path/to/x and ./a/b ../c/d https://host/a/b/c ok", None),
    ("a=/usr/local/share/x.", "a=[OUT-OF-TREE]....." + "."),
    ("tab\t/opt/tool/bin/run\nnext", "tab\t[OUT-OF-TREE]....\nnext"),
    ('quote "/opt/tool/bin/run" end', 'quote "[OUT-OF-TREE]...." end'),
    ("/only", "....."),
    ("1/2 and / alone, // and /", None),
    ("file:///etc/hosts x", None),
]


@pytest.mark.parametrize("plain, wanted", CASES)
@pytest.mark.parametrize("ascii_", [True, False])
@pytest.mark.parametrize("escape", [False, True])
def test_cases(plain, wanted, ascii_, escape):
    raw = json.dumps({"k": plain}, ensure_ascii=ascii_)
    if escape:  # a slash may be written as an escape
        raw = raw.replace("/", "\\/")
    out, gone = redaction.redacted(raw.encode(), ROOT)
    assert len(out) == len(raw.encode())
    found = json.loads(out)["k"]
    if wanted is None:
        assert out == raw.encode() and gone == 0
    elif not escape:
        assert found == wanted and gone > 0
    else:
        assert "etc" not in found and "opt" not in found and gone > 0


def test_long_marker_and_letters_beyond_ascii():
    path = "/srv/data/é/" + "x" * 40
    for raw in (json.dumps([path]), json.dumps([path], ensure_ascii=False)):
        out, gone = redaction.redacted(raw.encode(), ROOT)
        assert len(out) == len(raw.encode()) and gone == len(raw.encode()) - 4
        assert json.loads(out)[0].startswith(f"[OUT-OF-TREE: {gone} bytes withheld")


texts = st.lists(st.sampled_from([*'ab/."\\\n\t é😀:=\x01~', "/x/y", "/home/me/repo/z", "http://h/p", "/home/me/repo/../q"]), max_size=20).map("".join)
values = st.recursive(st.none() | st.booleans() | st.integers() | texts, lambda x: st.lists(x, max_size=4) | st.dictionaries(texts, x, max_size=4), max_leaves=12)


@settings(max_examples=500, deadline=None)
@given(values, st.booleans(), st.sampled_from([None, 1]))
def test_records_stay_valid_and_as_long(value, ascii_, indent):
    raw = json.dumps(value, ensure_ascii=ascii_, indent=indent).encode()
    out, gone = redaction.redacted(raw, ROOT)
    assert len(out) == len(raw)

    again = json.loads(out)
    assert type(again) is type(value)
    changed = sum(a != b for a, b in zip(raw, out, strict=True))
    assert changed <= gone and (gone > 0 or out == raw)
    assert redaction.redacted(out, ROOT) == (out, 0)  # nothing is left to redact


def test_records_in_spark(spark):
    rows = [(1, '{"a":"/etc/passwd"}', ROOT, "x"), (2, None, ROOT, None), (3, f'{{"a":"{ROOT}/b"}}', ROOT, ""), (4, f'{{"a":"{ROOT}/b"}}', None, ""), (5, "", ROOT, "")]
    df = spark.createDataFrame(rows, "k int, raw string, root string, withheld_ string")
    found = {r["k"]: (r["raw"], r["withheld"], r["withheld_"]) for r in redaction.redact_records(df, "raw", "root").collect()}
    assert found[1] == ('{"a":"..........."}', 11, "x") and found[2] == (None, 0, None) and found[3] == (rows[2][1], 0, "") and found[4][1] == len(ROOT) + 2 and found[5] == ("", 0, "")


CONFIG = """
# first of all
HostName = %h.all   # comes before any block? no: a value
Host a.* !a.secret.* "b c"
    User x
    HOSTNAME  one.test
    HostName two.test
Host !*
    HostName never.test
Match host a.b
    HostName never.test
Host ??.net *.[x]
    HostName %h.%%h.test
Match all
    HostName last-%h
"""


def plain_hostname(host, rules):
    for patterns, name in rules:
        good = [p for p in patterns if not p.startswith("!")]
        fits = lambda p: fnmatch.fnmatchcase(host, p.replace("[", "[[]"))
        if any(map(fits, good)) and not any(fits(p[1:]) for p in patterns if p.startswith("!")):
            return "%".join(x.replace("%h", host) for x in name.split("%%"))
    return None


def test_first_fitting_rule_counts(spark):
    rules = identity.ssh_rules(CONFIG)
    assert [n for _, n in rules] == ["%h.all", "one.test", "never.test", "%h.%%h.test", "last-%h"]
    rng = random.Random(2)
    hosts = ["a.b", "a.secret.x", "b c", "xy.net", "xyz.net", "q.[x]", "q.x", "A.b", ""] + ["".join(rng.choice("ab.xy?*-") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    for use in (rules, rules[1:], rules[1:-1], []):
        df = spark.createDataFrame([(h,) for h in hosts], "host string")
        found = {r["host"]: r["name"] for r in df.select("host", identity.ssh_hostname(F.col("host"), use).alias("name")).collect()}
        assert found == {h: plain_hostname(h, use) for h in hosts}


def test_aliases_come_before_patterns(spark):
    remotes = ["git@work:o/r.git", "git@play.x:o/r", "https://play.x/o/r", "ssh://git@github.com/o/r", "git@odd:o/r"]
    df = spark.createDataFrame([(r, "/p") for r in remotes], "remote string, path string")
    aliases = spark.createDataFrame([("work", "git.corp.test")], "alias string, hostname string")
    rules = identity.ssh_rules("Host work play.*\n HostName mirror.test\nHost odd\n HostName bad_name\n")
    found = [r["repo_slug"] for r in identity.with_repo_slug(df, aliases, rules).collect()]
    assert sorted(found) == sorted(["git.corp.test/o/r", "mirror.test/o/r", "play.x/o/r", "o/r", "odd/o/r"])
    with pytest.raises(ValueError):
        identity.ssh_rules("Host x\n HostName y\n" * 1001)


def test_a_worker_holds_few_records_at_a_time(spark, monkeypatch):
    from provenir.functions import redaction

    monkeypatch.setattr(redaction, "BATCH", 16)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = spark.range(100).coalesce(1).selectExpr("concat('{\"a\":\"/etc/x', id, '\"}') AS raw", "'/work' AS root")
        sizes = redaction.redact_records(rows, "raw", "root").mapInArrow(lambda batches: batches, "raw string, root string, withheld long")
        assert sizes.filter("withheld >= 6").count() == 100
        assert int(spark.conf.get(key)) == 16
    finally:
        spark.conf.set(key, before)
