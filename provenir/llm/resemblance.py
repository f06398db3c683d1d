"""Documents whose sets of five-word shingles share 0.8 or more of their union.

A 64-bit SimHash can't hold that bound: at a similarity of 0.8 about a seventh of its bits
differ, and searching so wide a radius grows with the square of the corpus.  This module
adds the links that the radius of ``simhash`` misses.

Every set is sampled ``VIEWS`` times: a view keeps the shingles whose mixed hash lies under
a rate that follows the set's size, some ``SAMPLE`` to twice as many, and its key is their
sum.  Sets that agree on a view's whole sample meet in a bucket.  Sizes that allow the
similarity share a rate, since a set near a rate's border is sampled at both.

Buckets are verified in two passes.  The first compares every member with one centre, the
member of least hash, which joins most groups at a cost that grows with the members.  The
second takes each bucket whose members are then still in several components and compares
all its members, in blocks of at most ``2 * CHUNK`` rows, so that no pair that meets in a
bucket is left out; buckets of the same members are compared once.

Two sets of similarity s meet in a view with a chance of about s**(1.1 * sample), over half
at 0.9 and over a quarter at 0.8 on average; over all views fewer than one pair in a hundred
at 0.8 never meets, and hardly any above 0.85.

Defined cases: null or wordless texts have the empty set and link with each other only;
texts of fewer words than a shingle are one shingle; rows with a null id are not linked;
repeated rows of an id are linked by the texts of all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import small_batches, utf8
from provenir.llm.components import connected_components
from provenir.llm.simhash import _Union
from provenir.runtime import materialize

SHINGLE, SIMILARITY, VIEWS, SAMPLE, SEED, VOCABULARY = 5, 0.8, 24, 3, 42, 1 << 18
#: Members of a block of a bucket; two blocks are compared at a time, ``COLUMNS`` shingles at once.
CHUNK, COLUMNS = 256, 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words seen by this worker; emptied when it holds ``VOCABULARY``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (a splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, known: dict[bytes, int], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    count = max(1, len(words) - shingle + 1)
    found = np.full(count, min(len(words), shingle), np.uint64)
    for k in range(min(len(words), shingle)):
        found = found * _ODD + each[k : k + count]
    return np.unique(mixed(found))


def level(size: float) -> int:
    """A view's rate is 2**-level."""
    return max(1, math.floor(math.log2(size / SAMPLE)))


_SALTS = mixed(np.arange(1, VIEWS + 1, dtype=np.uint64) * _ODD)


def view_keys(shingles: np.ndarray) -> np.ndarray:
    """Bucket keys of a set, one or two a view; samples too small to tell texts apart have none."""
    n, out = len(shingles), []
    if not n:
        return np.zeros(0, np.int64)
    draws = mixed(shingles[None, :] ^ _SALTS[:, None])
    for rate in sorted({level(n), level(n / SIMILARITY)}):
        taken = draws < np.uint64(1 << (64 - rate))
        sums = np.where(taken, draws, np.uint64(0)).sum(1, dtype=np.uint64)
        told = taken.sum(1) >= (2 if rate > 1 else 1)
        out.append(mixed(sums ^ _SALTS ^ np.uint64(rate))[told])
    return np.concatenate(out).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def bucket_links(ids: list[int], groups: list[int], sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between members of different groups that span all pairs of that similarity."""
    sizes = np.array([len(s) for s in sets])
    values, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(seen > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    row, column = np.repeat(np.arange(len(sets)), sizes), place[at]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(sets), min(COLUMNS, len(shared) - first)), np.float32)
        held[row[a:b], column[a:b] - first] = 1
        both += held @ held.T
    union = np.maximum(1, sizes[:, None] + sizes[None, :] - both.astype(np.float64))
    marks = np.array(groups)
    hit = np.triu((both / union >= least) & (marks[:, None] != marks[None, :]))
    joined = _Union()
    return [(ids[i], ids[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True) if joined.join(groups[i], groups[j])]


def shingle_views(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, n, whole, keys): size, one hash and the bucket keys of every text's set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sets = [shingle_set(t, known) for t in utf8(batch, "text")]
            whole = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([view_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole, pa.int64()), keys], ["id", "n", "whole", "keys"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "text")
    return rows.mapInArrow(run, "id long, n long, whole long, keys array<long>")


def similar(docs: DataFrame, id_col: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """(a, b): links of ids whose components join all texts of that similarity."""
    views = materialize(shingle_views(docs, id_col), "views")
    # one row per distinct set goes on; written, so that the join below can split a busy set
    firsts = materialize(views.groupBy("n", "whole").agg(F.min_by("keys", "id").alias("keys"), F.min("id").alias("first")), "firsts")
    copies = views.join(firsts.select("n", "whole", "first").hint("merge"), ["n", "whole"]).filter("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    entries = materialize(firsts.select(F.col("first").alias("id"), "n", F.explode("keys").alias("key")), "entries")
    order = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("centre"), F.col("n").alias("size"))
    centres = entries.groupBy("key").agg(F.min(order).alias("c"), F.count("*").alias("members")).filter("members > 1").select("key", "c.centre", "c.size")
    shared = materialize(entries.join(centres.hint("merge"), "key"), "shared")
    near = shared.filter((F.col("id") != F.col("centre")) & (F.col("n") >= F.lit(least) * F.col("size")) & (F.col("size") >= F.lit(least) * F.col("n")))
    pairs = materialize(near.select("id", "centre").distinct(), "pairs")
    wanted = pairs.select("id").unionByName(pairs.select(F.col("centre").alias("id"))).distinct()
    texts = docs.select(F.col(id_col).alias("id"), "text").join(wanted.hint("merge"), "id", "left_semi")
    texts = materialize(texts, "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, held = _Words(), None, np.zeros(0, np.uint64)
        for batch in batches:
            hits = []
            for centre, text in zip(utf8(batch, "other"), utf8(batch, "text"), strict=True):
                if centre != last:
                    last, held = centre, shingle_set(centre, known)
                hits.append(similarity(shingle_set(text, known), held) >= least)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hits, pa.bool_())) for c in (batch.column("id"), batch.column("centre"))], ["a", "b"])

    met = pairs.join(texts.hint("merge"), "id").join(texts.select(F.col("id").alias("centre"), F.col("text").alias("other")).hint("merge"), "centre")
    links = materialize(met.select("id", "centre", "text", "other").mapInArrow(verify, "a long, b long"), "central")
    return copies.unionByName(links).unionByName(rest_of_buckets(docs, shared, links, id_col, least))


def rest_of_buckets(docs: DataFrame, shared: DataFrame, links: DataFrame, id_col: str, least: float) -> DataFrame:
    """(a, b): links across the components of ``links`` among all members of each bucket (id, key)."""
    group = F.coalesce("component", "id").alias("group")
    marked = shared.select("id", "key").distinct().join(connected_components(links).withColumnRenamed("node", "id").hint("merge"), "id", "left")
    marked = materialize(marked.select("id", "key", group), "marked")
    sums = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    mixed_ = marked.groupBy("key").agg(F.count("*").alias("members"), F.min("group").alias("low"), F.max("group").alias("high"), *sums).filter("low != high")
    mixed_ = mixed_.groupBy("members", "s1", "s2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("members") / CHUNK).cast("int").alias("blocks"))
    open_ = materialize(marked.join(mixed_.hint("merge"), "key"), "open")
    # each two blocks of a bucket meet; a bucket of one block meets itself
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own"))))
    met = open_.withColumn("own", own).withColumn("other", other).select("id", "group", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            found = pa.array([shingle_set(t, known).tobytes() for t in utf8(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "shingles"])

    wanted = docs.select(F.col(id_col).alias("id"), "text").join(open_.select("id").distinct().hint("merge"), "id", "left_semi")
    wanted = materialize(wanted.mapInArrow(sets, "id long, shingles binary"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, groups, held = None, [], [], []
        for batch in batches:
            out = []
            for *place, one, group_, shingles in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "id", "group", "shingles")), strict=True):
                if place != last:
                    out += bucket_links(ids, groups, held, least) if len(ids) > 1 else []
                    last, ids, groups, held = place, [], [], []
                ids.append(one)
                groups.append(group_)
                held.append(np.frombuffer(shingles, np.uint64))
            yield _links(out)
        yield _links(bucket_links(ids, groups, held, least) if len(ids) > 1 else [])

    rows = met.join(wanted.hint("merge"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(compare, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
