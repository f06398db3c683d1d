"""Closure over graphs with and without cycles, and what modules import."""

import random

import pytest

from provenir.operators import coverage, manifest


def plain_closure(starts, edges):
    up = {}
    for child, parent in edges:
        up.setdefault(child, set()).add(parent)
    out = set()
    for root, node in starts:
        seen, left = {node}, [node]
        while left:
            for p in up.get(left.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    left.append(p)
        out |= {(root, n) for n in seen}
    return out


def closed(spark, starts, edges, hops=coverage.HOPS):
    kind = "long" if isinstance(starts[0][1], int) else "string"
    found = coverage.reachable(spark.createDataFrame(starts, f"root string, node {kind}"), spark.createDataFrame(edges, f"child {kind}, parent {kind}"), hops=hops)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(
    "edges",
    [
        [("a", "b"), ("b", "a")],
        [("a", "a")],
        [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "y"), ("y", "z")],
        [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "c"), ("q", "r")],
    ],
)
def test_cycles_close(spark, edges):
    starts = [(f"r{n}", n) for n in sorted({x for e in edges for x in e})] + [("lone", "none")]
    assert closed(spark, starts, edges) == closed(spark, starts, edges, hops=0) == plain_closure(starts, edges)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_close(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range((30, 60, 90, 150)[seed])]
    ring = rng.sample(range(n, 2 * n), 40)
    edges += list(zip(ring, [*ring[1:], ring[0]], strict=True)) + [(ring[3], 5), (7, ring[20])]
    starts = [(str(k), rng.randrange(2 * n)) for k in range(12)]
    assert closed(spark, starts, edges, hops=4 * (seed % 2)) == plain_closure(starts, edges)


def test_long_history_with_a_ring_behind_it(spark):
    edges = [(k, k - 1) for k in range(1, 300)] + [(0, 1000), (1000, 1001), (1001, 1000)]
    starts = [("head", 299), ("ring", 1001)]
    assert closed(spark, starts, edges) == plain_closure(starts, edges)


CASES = [
    ("bin/a.js", "./b.js", None, "bin/b.js"),
    ("bin/a.js", "../lib/x.js", None, "lib/x.js"),
    ("bin/a.js", "./sub/../b.js", None, "bin/b.js"),
    ("bin/a.js", ".//b.js", None, "bin/b.js"),
    ("a.js", "./lib/x.js", None, "lib/x.js"),
    ("bin/a.js", "./none.js", "unresolved", "bin/none.js"),
    ("bin/a.js", "./b.js/", "unresolved", "bin/b.js/"),
    ("bin/a.js", "..", "unresolved", ""),
    ("bin/a.js", "../../lib/x.js", "escaping", "../lib/x.js"),
    ("a.js", "../bin/b.js", "escaping", "../bin/b.js"),
    ("bin/a.js", "../../../q/../x.js", "escaping", "../../x.js"),
    ("bin/a.js", "left-pad", "bare", None),
    ("bin/a.js", "/abs.js", "bare", None),
    ("bin/a.js", "lib/x.js", "bare", None),
]


def test_kinds_of_failing_imports(spark):
    tree = spark.createDataFrame([("bin/a.js",), ("bin/b.js",), ("lib/x.js",), ("lib/x.js",)], "path string")
    imports = spark.createDataFrame([(k, path, spec) for k, (path, spec, *_) in enumerate(CASES)], "k int, path string, specifier string")
    found = {r["k"]: (r["kind"], r["target"]) for r in manifest.import_failures(imports, tree).collect()}
    assert found == {k: (kind, target) for k, (_, _, kind, target) in enumerate(CASES) if kind}


def test_imports_are_found_in_text(spark):
    text = 'import a from "./a.js";\nimport {b}\n  from"../b.js"; const c = await import ( "./c.js" );\nimport fs from "node:fs"; // from "bare"\nxfrom "./not.js"; import "./side.js"; export * from "./d.js"'
    rows = spark.createDataFrame([("m.js", text), ("n.js", ""), ("o.js", None)], "path string, text string")
    found = manifest.imports_of(rows).orderBy("path", "place").collect()
    assert [(r["path"], r["specifier"]) for r in found] == [("m.js", s) for s in ("./a.js", "../b.js", "./c.js", "bare", "./d.js")]


def test_import_closure_of_modules_that_import_each_other(spark):
    imports = spark.createDataFrame([("a/m.js", "./n.js"), ("a/n.js", "./m.js"), ("a/n.js", "../b.js"), ("b.js", "../out.js"), ("b.js", "bare")], "path string, specifier string")
    entries = spark.createDataFrame([("e", "a/m.js")], "root string, node string")
    assert {r["node"] for r in manifest.import_closure(entries, imports).collect()} == {"a/m.js", "a/n.js", "b.js"}
