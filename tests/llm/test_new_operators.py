"""Manifest, odd-sketch near-duplicates and filter audit against plain versions."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import audit, merkle, oddsketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """Every row's answer from whole trees in one process."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, n: h("".join(map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))
    first = lambda x: (x is not None, x if x is not None else 0)

    def up(nodes):
        return [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]

    def root(nodes):
        while len(nodes) > 1:
            nodes = up(nodes)
        return nodes[0]

    def siblings(nodes, i):
        out = []
        while len(nodes) > 1:
            out.append((i % 2, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
            nodes, i = up(nodes), i // 2
        return out

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = [(r, leaf(r, r["n_chars"])) for r in rows if r["lang"] == lang]
        trees[lang] = sorted(own, key=lambda x: (first(x[0]["doc_id"]), x[1]))
    tops = [root([x for _, x in trees[lang]]) for lang in langs]
    out = []
    for k, lang in enumerate(langs):
        nodes = [x for _, x in trees[lang]]
        for i, (r, own) in enumerate(trees[lang]):
            way = siblings(nodes, i) + siblings(tops, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            node = leaf(r, r["n_chars"] + 1) if hit else own
            for right, other in way:
                node = h(node) if other is None else h(other + node) if right else h(node + other)
            out.append((r["doc_id"], own, tops[k], root(tops), h("".join(s for _, s in way if s)), node, node == root(tops)))
    return sorted(map(str, out))


def shown(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_equals_whole_trees(spark, odd):
    rows = [r.asDict() for r in odd.collect()]
    assert shown(merkle.manifest(odd)) == plain_manifest(rows)
    assert shown(merkle.manifest(odd, top=2, least=1)) == plain_manifest(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 63, 64, 65])
def test_manifest_of_many_blocks(spark, count):
    rows = [(i, f"text {i}", "é" if i % 3 else None, "s", i) for i in range(count)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain_manifest([r.asDict() for r in docs.collect()])
    assert shown(merkle.manifest(docs, top=1, least=2)) == want
    assert shown(merkle.manifest(docs, top=1000, least=0)) == want
    found = merkle.manifest(docs).collect()
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in found)


def test_manifest_with_a_language_a_row_and_equal_rows(spark):
    rows = [(i, "t", f"l{i:03}", None, 1) for i in range(40)] + [(None, "same", "l000", None, None)] * 50
    docs = spark.createDataFrame(rows, SCHEMA)
    assert shown(merkle.manifest(docs, top=1, least=2)) == plain_manifest([r.asDict() for r in docs.collect()])


def test_paths_have_a_bounded_top():
    assert merkle.block_bits(0) == merkle.BITS and merkle.block_bits(10**9) == 14
    for rows in (1, 5 * 10**8, 10**12):
        assert rows / 2 ** merkle.block_bits(rows) <= merkle.TOP


def words(rng, n, pool):
    return [rng.choice(pool) for _ in range(n)]


def edited(rng, base, changes, pool):
    out = list(base)
    for i in rng.sample(range(len(out)), changes):
        out[i] = rng.choice(pool)
    return out


@pytest.fixture(scope="module")
def copies():
    """Texts around the bound: templates with many edits, shared passages, chains, short texts."""
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(5000)]
    texts = []
    for size in (60, 200, 900):
        base = words(rng, size, pool)
        texts += [base] + [edited(rng, base, c, pool) for c in range(1, 1 + size // 25) for _ in range(3)]
        chain = base
        for _ in range(12):
            chain = edited(rng, chain, max(1, size // 60), pool)
            texts.append(chain)
    passage = words(rng, 300, pool)
    texts += [passage + words(rng, n, pool) for n in (20, 30, 40, 50, 60, 100) for _ in range(4)]
    texts += [words(rng, n, pool) for n in (1, 2, 4, 5, 6, 7) for _ in range(3)]
    texts += [texts[0], texts[5], ["w1", "w2"], ["W1", "W2"], ["w1", "w2"]]
    made = [" ".join(t) for t in texts] + ["", None, " \n", texts[0] and "  ".join(texts[0]).upper()]
    rng.shuffle(made)
    return made


def plain_components(texts, percent=85):
    sets = []
    for t in texts:
        ws = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


def test_odd_sketch_links_equal_brute_force(spark, copies):
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(5)
    found = sorted(tuple(r) for r in oddsketch.near_duplicates(docs).collect())
    want = plain_components(copies)
    assert found == want and 20 < len({c for *_, c in want}) < len(want) - 40


def test_odd_sketch_blocks_equal_brute_force(spark, copies, monkeypatch):
    """Without the centres' passes all is left to the blocks, here of four members."""
    monkeypatch.setattr(oddsketch, "CHUNK", 4)
    none = lambda members, salts: members.select("sid", "sid").toDF("a", "b").filter("false")
    monkeypatch.setattr(oddsketch, "central", none)
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    assert sorted(tuple(r) for r in oddsketch.near_duplicates(docs).collect()) == plain_components(copies)


def test_odd_sketch_tells_similarities():
    rng = np.random.default_rng(3)
    for share in (0.6, 0.85, 0.95):
        errors = []
        for _ in range(60):
            n = 1000
            both = int(round(2 * n * share / (1 + share)))
            draw = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
            a, b = (oddsketch.minima(np.concatenate([draw[:both], x])) for x in (draw[n : 2 * n - both], draw[2 * n - both : 3 * n - 2 * both] if both < n else draw[:0]))
            count = int(np.bitwise_count((oddsketch.odd_sketch(a) ^ oddsketch.odd_sketch(b)).view(np.uint64)).sum())
            errors.append(oddsketch.estimated(count) - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert oddsketch.estimated(oddsketch.LIKELY) >= oddsketch.DOUBT > oddsketch.estimated(oddsketch.LIKELY + 1)
    assert (1 - 0.85**oddsketch.ROWS) ** oddsketch.BANDS < 1e-6


def test_odd_sketch_of_odd_rows(spark, odd, none):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in oddsketch.near_duplicates(odd).collect()}
    assert {(1, 8, 1), (2, 8, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (9, 1, 9)} <= found
    assert any(i is None and c is None for i, _, c in found)
    assert oddsketch.near_duplicates(none).count() == 0


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(oddsketch, "CHUNK", 8)
    rows = [(1, i, 0) for i in range(400)] + [(1, 1000 + i, 1000 + i) for i in range(3)]
    met = oddsketch.blocks(spark.createDataFrame(rows, "key long, sid long, group long"))
    pairs = met.groupBy("key", "i", "j").agg(F.collect_set("group").alias("g")).collect()
    assert all(len(p["g"]) > 1 for p in pairs) and met.count() < 400 * 2 + 60 * 5
    assert met.select("sid").distinct().count() == 403


def plain_audit(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    marks = {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = good or q == 1, toxic or t == 1
    fails = []
    for i, text, _, source, _ in docs:
        t = text or ""
        w = t.split()
        own = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        fails.append((source or "", {k for k, v in own.items() if v}, marks.get(i, (False, False)) if i is not None else (False, False)))
    rows, shapley = [], {}
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in fails}:
            for step in range(5):
                name, before = order[step], set(order[:step])
                mine = [(f, m) for p, f, m in fails if p == part]
                gone = [(f, m) for f, m in mine if name in f and not f & before]
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
                kept = sum(not f & (before | {name}) for f, _ in mine)
                rows.append((part, "".join(order), step + 1, kept, len(gone), sum(name in f and bool(f & before) for f, _ in mine), sum(f == {name} for f, _ in mine), sum(m[0] for _, m in gone), sum(m[1] for _, m in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


@pytest.mark.parametrize("partitions", [1, 7])
def test_audit_equals_plain_counts(spark, odd, partitions):
    rng = random.Random(2)
    extra = [(i, rng.choice(["Same text here", "x " * 60, "CAPITALS # and so on", "some other words"]), "en", rng.choice(["a", "b", "", None]), 1) for i in range(100, 300)]
    extra += [(250, "Same text here", "en", "a", 1), (None, "Same text here", "en", "a", 1)] * 5
    docs = odd.unionByName(spark.createDataFrame(extra, SCHEMA)).repartition(partitions)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(90, 300)] + [(120, 1, 1), (None, 1, 1), (5, None, 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # runs go on behind ranges
    try:
        found = audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r) for r in found) == plain_audit([tuple(r) for r in docs.collect()], labels)


def test_a_run_over_many_ranges_is_one_run(spark):
    docs = spark.createDataFrame([(i, "all alike", "en", "a", 1) for i in range(2000)], SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = {r["doc_id"] for r in audit.masks(docs).filter(F.col("mask").bitwiseAND(F.lit(16)) > 0).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == set(range(1, 2000))
