"""Line differences against a table of common subsequences, and ids of whole commits."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from provenir.operators import attribution, patches


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=24), st.lists(st.integers(0, 4), max_size=24))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    found = patches.common(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p < i and q < j for (p, q), (i, j) in zip(found, found[1:], strict=False))
    assert len(found) == longest(a, b)


def test_hunks_rebuild_both_sides():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(30))] for _ in range(2))
        i = j = 0
        kept = patches.common(a, b)
        found = patches.hunks(a, b)
        assert sum(len(r) for r, _ in found) + len(kept) == len(a) and sum(len(x) for _, x in found) + len(kept) == len(b)
        it = iter(found)
        for p, q in [*kept, (len(a), len(b))]:
            if p > i or q > j:
                removed, added = next(it)
                assert a[i:p] == removed and b[j:q] == added
            i, j = p + 1, q + 1
        assert next(it, None) is None


def plain_id(files):
    """Sum of the hunks' hashes in plain numbers; files is (path, before, after)."""
    lanes, n = [0] * 4, 0
    for path, before, after in files:
        for removed, added in patches.hunks((before or "").encode().splitlines(), (after or "").encode().splitlines()):
            n += 1
            text = "\n".join(["".join(path.split())] + ["-" + "".join(x.decode().split()) for x in removed] + ["+" + "".join(x.decode().split()) for x in added])
            h = hashlib.sha256(text.encode()).digest()
            lanes = [(x + int.from_bytes(h[8 * k : 8 * k + 8], "big")) % 2**64 for k, x in enumerate(lanes)]
    return "".join(f"{x:016x}" for x in lanes) if n else None


SCHEMA = "repo string, sha string, path string, before string, after string"


def test_ids_follow_the_lines_not_their_places(spark):
    base = [f"line {k}" for k in range(40)]
    text = "\n".join
    change = lambda at, rows=base: text([*rows[:at], "new one", "new two", *rows[at:]])
    spaced = text([*base[:5], "  new\tone", "new two ", *base[5:]])
    moved = text(["shift"] * 3 + base)
    rows = [
        ("r", "plain", "f", text(base), change(5)),
        ("r", "elsewhere", "f", text(base), change(30)),
        ("r", "shifted", "f", moved, change(5, ["shift"] * 3 + base)),
        ("r", "spaced", "f", text(base), spaced),
        ("r", "other file", "g", text(base), change(5)),
        ("r", "two", "f", text(base), change(5)),
        ("r", "two", "g", text(base), change(7)),
        ("r", "two again", "g", text(base), change(20)),
        ("r", "two again", "f", text(base), change(1)),
        ("r", "nothing", "f", text(base), text(base)),
        ("r", "made", "f", None, text(base)),
        ("r", "gone", "f", text(base), None),
        ("r", "merge", "f", text(base), change(5)),
        ("r", "twice", "f", text(base), text([*base[:5], "new one", "new two", *base[5:9], "new one", "new two", *base[9:]])),
    ]
    merges = spark.createDataFrame([("r", "merge")], "repo string, sha string")
    found = {r["sha"]: r for r in patches.patch_ids(spark.createDataFrame(rows, SCHEMA).repartition(5), merges).collect()}
    ids = {k: v["patch_id"] for k, v in found.items()}
    for sha in ids:
        assert ids[sha] == (None if sha == "merge" else plain_id([r[2:] for r in rows if r[1] == sha]))
    assert len({ids[k] for k in ("plain", "elsewhere", "shifted", "spaced")}) == 1
    assert ids["two"] == ids["two again"] and ids["nothing"] is None
    assert len({ids[k] for k in ("plain", "other file", "two", "made", "gone", "twice")}) == 6
    assert (found["made"]["hunks"], found["made"]["removed"], found["made"]["added"]) == (1, 0, 40)


def test_computed_ids_find_successors(spark):
    rows = [("r", "a", "f", "x\ny", "x\nq\ny"), ("r", "b", "f", "1\nx\ny\n2", "1\nx\nq\ny\n2"), ("r", "c", "f", "x", "z")]
    ids = patches.patch_ids(spark.createDataFrame(rows, SCHEMA))
    commits = ids.join(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sha string, committed_at int"), "sha")
    assert [(r["new_sha"], r["old_sha"]) for r in attribution.same_patch(commits).collect()] == [("b", "a")]


def test_long_texts_take_linear_space():
    rng = random.Random(9)
    a = [f"l{rng.randrange(3000)}" for _ in range(6000)]
    b = [x for x in a if rng.random() > 0.03]
    b[1000:1000] = ["fresh"] * 200
    assert len(patches.common(a, b)) == len(b) - 200


def test_ids_of_all_documents(spark, sf):
    from provenir.plans.catalogue import QUERIES

    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "text").collect(), key=lambda r: r["doc_id"])
    last, want = {}, {}
    for source, one, text in docs:
        path = f"f{one // 64}"
        want[source, one] = plain_id([(path, last.get((source, path)), text)])
        last[source, path] = text
    found = {(r["repo"], r["sha"]): r["patch_id"] for r in QUERIES["patch_ids"](spark, sf).collect()}
    assert found == want
