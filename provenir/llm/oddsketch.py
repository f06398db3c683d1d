"""MinHash near-duplicates verified by odd sketches.

A text's set holds the hashes of its distinct five-word shingles.  ``SAMPLES`` MinHash values
of a set make its bands; sets that agree on a band meet in a bucket.  The same samples are
folded into an odd sketch: a bitmap in which bit h(i, minimum i) is flipped for every sample
i, so that equal samples of two sets cancel out and the population count of the XOR tells
how many differ.  For m differing samples, 2m flips fall on ``SKETCH`` bits and an expected
SKETCH / 2 * (1 - exp(-4m / SKETCH)) of them stay set, which is inverted to a similarity
whose error is smallest where it is high.  Candidates estimated below ``DOUBT`` are dropped
(a pair at the bound would have to be misjudged by over five standard deviations), all
others are confirmed on the full sets.  A pair at 0.85 meets in no band with a chance of
(1 - 0.85**ROWS)**BANDS, under one in a million.

Equal sets are one node.  A bucket isn't compared pair by pair: first every member meets
one centre, then members of buckets that still lie in several components meet a few other
centres, and only what is left after that is compared in blocks, each two blocks of a bucket
that could still join components.  Blocks hold members of one component where they can, and
two blocks of the same component never meet, so a large group costs no square.  Tasks report
links that join components, never all pairs.

Defined cases: null, empty or wordless texts have the empty set, are linked with nothing and
are their own component; texts with fewer words than a shingle are one shingle; rows with a
null id link like others but are a component's id only where no other id is there (then it
is null); rows that repeat an id are nodes of their own; an empty table gives no row; very
long texts are read whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import small_batches, table, utf8
from provenir.llm.components import connected_components
from provenir.llm.resemblance import _Words, mixed, shingle_set
from provenir.llm.simhash import _Union
from provenir.runtime import materialize

#: Links need 100 * intersection >= PERCENT * union.
PERCENT, BANDS, ROWS, SKETCH, DOUBT = 85, 32, 6, 512, 0.65
SAMPLES = BANDS * ROWS
#: Members of a block, shingles compared at once, centres of the second pass.
CHUNK, COLUMNS, CENTRES = 256, 4096, 3
LONGS = SKETCH // 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_DRAWS = mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * _STEP)
_TIMES, _PLUS = (_DRAWS[:SAMPLES] | np.uint64(1)).astype(np.uint32)[:, None] | np.uint32(1), _DRAWS[SAMPLES:].astype(np.uint32)[:, None]
_PLACE = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_BAND = mixed(np.arange(1, ROWS + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def minima(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    """The least of each sample's hash over a non-empty set."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(values), block):
        drawn = values[None, at : at + block] * _TIMES
        drawn += _PLUS
        np.minimum(best, drawn.min(1), out=best)
    return best


def bands(least: np.ndarray) -> np.ndarray:
    """One bucket key a band."""
    rows = mixed(least.astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)) * _BAND
    return mixed(rows.sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples as signed longs."""
    at = mixed(least.astype(np.uint64) ^ _PLACE) % np.uint64(SKETCH)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def estimated(differing: float) -> float:
    """Similarity told by the population count of two sketches' XOR; minus infinity where it is full."""
    left = 1 - 2 * differing / SKETCH
    return 1 + SKETCH * math.log(left) / 4 / SAMPLES if left > 0 else -math.inf


#: Counts up to this one leave a pair in.
LIKELY = max(x for x in range(SKETCH // 2) if estimated(x) >= DOUBT)


def alike(both: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


def sketched(rows: DataFrame) -> DataFrame:
    """(uid, n, high, low, keys, sketch) of every row's whole text: size and a 128-bit sum of its set,
    bucket keys and odd sketch; the last two are empty for an empty set."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sizes, sums, keys, sketches = [], [], [], []
            for text in utf8(batch, "text"):
                s = shingle_set(text, known)
                least = minima(s) if len(s) else None
                sizes.append(len(s))
                sums.append((int(s.sum(dtype=np.uint64)), int(mixed(s ^ _STEP).sum(dtype=np.uint64))))
                keys.append(bands(least) if len(s) else [])
                sketches.append(odd_sketch(least) if len(s) else [])
            high, low = np.array(sums, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, sketches)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sizes, pa.int64()), pa.array(high), pa.array(low), *lists], ["uid", "n", "high", "low", "keys", "sketch"])

    return rows.select("uid", "text").mapInArrow(run, "uid long, n long, high long, low long, keys array<long>, sketch array<long>")


def likely(percent: int = PERCENT) -> Column:
    """Whether two sketches (sketch, other) and sizes (n, m) allow the similarity."""
    count = sum((F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("other", F.lit(k)))) for k in range(LONGS)), F.lit(0))
    return (count <= LIKELY) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the pairs (a, b), each there once, that their sketches allow and their full sets confirm."""
    own = sets.select(F.col("sid").alias("a"), "n", "sketch")
    far = sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    near = materialize(pairs.join(own.hint("merge"), "a").join(far.hint("merge"), "b").filter(likely(percent)).select("a", "b"), "near")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, held = _Words(), None, np.zeros(0, np.uint64)
        for batch in batches:
            hits = []
            for far_, text in zip(utf8(batch, "far"), utf8(batch, "text"), strict=True):
                if far_ != last:
                    last, held = far_, shingle_set(far_, known)
                own_ = shingle_set(text, known)
                hits.append(alike(len(np.intersect1d(own_, held, assume_unique=True)), len(own_), len(held), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hits, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    text = texts.select(F.col("uid").alias("a"), "text")
    other = texts.select(F.col("uid").alias("b"), F.col("text").alias("far"))
    met = near.join(text.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "text", "far")
    return materialize(met.mapInArrow(verify, "a long, b long"), "confirmed")


def with_group(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, sid) of the buckets whose members lie in several components, with their group."""
    roots = connected_components(links).withColumnRenamed("node", "sid")
    marked = members.join(roots.hint("merge"), "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("group"))
    marked = materialize(marked, "marked")
    sums = [F.sum(F.xxhash64(F.lit(k), "sid").cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    open_ = marked.groupBy("key").agg(F.count("*").alias("members"), F.min("group").alias("low"), F.max("group").alias("high"), *sums).filter("low != high")
    # buckets of the same members are compared once
    open_ = open_.groupBy("members", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    return materialize(marked.join(open_.hint("merge"), "key"), "open")


def central(members: DataFrame, salts: range) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's centres, one for each salt."""
    least = [F.min_by("sid", F.xxhash64(F.lit(s), "sid")).alias(f"c{s}") for s in salts]
    centres = members.groupBy("key").agg(*least).select("key", F.array(*(f"c{s}" for s in salts)).alias("centres"))
    met = members.join(materialize(centres, "centres").hint("merge"), "key")
    return met.select(F.col("sid").alias("a"), F.explode("centres").alias("b")).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def blocks(members: DataFrame) -> DataFrame:
    """(key, i, j, sid, group): the rows of every two blocks of a bucket that could join components.

    A component with ``CHUNK`` members in a bucket has blocks of its own there, smaller ones
    share blocks; blocks of one and the same component don't meet.
    """
    own = members.groupBy("key", "group").agg(F.count("*").alias("own"))
    small = own.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("own") < CHUNK, F.col("own")).otherwise(0)) / CHUNK).alias("shared"))
    sizes = materialize(own.join(small.hint("merge"), "key"), "sizes")
    large = F.col("own") >= CHUNK
    place = F.when(large, F.pmod(F.xxhash64("sid"), F.ceil(F.col("own") / CHUNK))).otherwise(F.pmod(F.xxhash64("group"), F.greatest(F.col("shared"), F.lit(1))))
    block = F.xxhash64(F.when(large, F.col("group")), place)
    dealt = materialize(members.join(sizes.hint("merge"), ["key", "group"]).select("key", "sid", "group", block.alias("block")), "dealt")
    of = dealt.groupBy("key", "block").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    i = of.select("key", F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    j = of.select("key", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    several = (F.col("low_i") != F.col("high_i")) | (F.col("low_j") != F.col("high_j")) | (F.col("low_i") != F.col("low_j"))
    meet = materialize(i.join(j.hint("merge"), "key").filter((F.col("i") <= F.col("j")) & several).select("key", "i", "j"), "meet")
    first = dealt.join(meet.hint("merge"), [dealt["key"] == meet["key"], F.col("block") == F.col("i")]).select(meet["key"], "i", "j", "sid", "group")
    second = dealt.join(meet.filter("i != j").hint("merge"), [dealt["key"] == meet["key"], F.col("block") == F.col("j")]).select(meet["key"], "i", "j", "sid", "group")
    return first.unionByName(second)


def block_links(ids: list[int], groups: list[int], sets: list[np.ndarray], sketches: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span all pairs of different groups which sketches allow and full sets confirm."""
    marks, sizes = np.array(groups), np.array([len(s) for s in sets])
    count = np.zeros((len(ids), len(ids)), np.uint16)
    for k in range(LONGS):
        count += np.bitwise_count(sketches[:, k, None] ^ sketches[None, :, k])
    open_ = np.triu((count <= LIKELY) & (marks[:, None] != marks[None, :]) & (100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes)))
    at = np.flatnonzero(open_.any(0) | open_.any(1))
    if not len(at):
        return []
    some = [sets[i] for i in at]
    values, where, seen = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(seen > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    row, column = np.repeat(np.arange(len(at)), sizes[at]), place[where]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(at), len(at)), np.float32)
    for first in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(at), min(COLUMNS, len(shared) - first)), np.float32)
        held[row[a:b], column[a:b] - first] = 1
        both += held @ held.T
    shared_ = both.astype(np.int64)
    hit = open_[np.ix_(at, at)] & (100 * shared_ >= percent * (sizes[at][:, None] + sizes[at] - shared_))
    joined = _Union()
    return [(ids[at[i]], ids[at[j]]) for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True) if joined.join(groups[at[i]], groups[at[j]])]


def rest(members: DataFrame, sets: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links across the groups of members (key, sid, group), all pairs of a bucket compared."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            found = pa.array([shingle_set(t, known).tobytes() for t in utf8(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), found], ["sid", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            out = []
            for *place, one, group, sketch, shingles in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "sid", "group", "sketch", "shingles")), strict=True):
                if place != last:
                    out += found_in(held)
                    last, held = place, []
                held.append((one, group, sketch, shingles))
            yield _pairs(out)
        yield _pairs(found_in(held))

    def found_in(held: list[tuple]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        ids, groups, sketches, sets_ = zip(*held, strict=True)
        return block_links(list(ids), list(groups), [np.frombuffer(s, np.uint64) for s in sets_], np.array(sketches, np.int64).view(np.uint64), percent)

    wanted = members.select(F.col("sid").alias("uid")).distinct()
    full = texts.join(wanted.hint("merge"), "uid", "left_semi").mapInArrow(packed, "sid long, shingles binary")
    full = materialize(full.join(sets.select("sid", "sketch").hint("merge"), "sid"), "full")
    rows = blocks(members).join(full.hint("merge"), "sid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialize(rows.mapInArrow(compare, "a long, b long"), "rest")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row; component_id is the least id reachable."""
    texts = materialize(docs.select(F.col(id_col).alias("id"), "text", F.monotonically_increasing_id().alias("uid")), "texts")
    marked = materialize(sketched(texts), "sketched")
    whole = ["n", "high", "low"]
    # one node a distinct set: the first row that has it
    first = marked.groupBy(*whole).agg(F.min_by(F.struct("keys", "sketch"), "uid").alias("x"), F.min("uid").alias("sid"))
    sets = materialize(first.select(*whole, "sid", "x.keys", "x.sketch"), "sets")
    entries = materialize(sets.select("sid", F.explode("keys").alias("key")), "entries")
    sums = [F.sum(F.xxhash64(F.lit(k), "sid").cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    open_ = entries.groupBy("key").agg(F.count("*").alias("members"), *sums).filter("members > 1").groupBy("members", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    members = materialize(entries.join(materialize(open_, "buckets").hint("merge"), "key").select("key", "sid"), "members")
    met = texts.join(members.select(F.col("sid").alias("uid")).distinct().hint("merge"), "uid", "left_semi").select("uid", "text")
    met = materialize(met, "candidates")
    links = confirmed(central(members, range(1)), sets, met, percent)
    left = with_group(members, links)
    if not left.isEmpty():
        links = links.unionByName(confirmed(central(left, range(1, 1 + CENTRES)), sets, met, percent))
        left = with_group(left.select("key", "sid"), links)
        if not left.isEmpty():
            links = links.unionByName(rest(left, sets, met, percent))
    roots = connected_components(links).withColumnRenamed("node", "sid")
    groups = materialize(sets.select(*whole, "sid").join(roots.hint("merge"), "sid", "left").select(*whole, F.coalesce("component", "sid").alias("group")), "groups")
    ids = materialize(marked.select("uid", *whole).join(texts.select("uid", "id").hint("merge"), "uid").select("id", *whole), "ids")
    own = ids.groupBy(*whole).agg(F.min("id").alias("least"))
    least = groups.join(own.hint("merge"), whole).groupBy("group").agg(F.min("least").alias("least"))
    answer = materialize(groups.join(least.hint("merge"), "group").select(*whole, "least"), "answer")
    found = ids.join(answer.hint("merge"), whole)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
e AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i : i + 4], ' ')) AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
