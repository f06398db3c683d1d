"""SimHash near-duplicates: fingerprints linked through a generalised pigeonhole.

Distinct fingerprints are cut into partitions of correlated bits.  If thresholds T_i sum to
``bits - partitions + 1``, two fingerprints within ``bits`` of each other agree to T_i bits
in at least one partition i (T_i = -1: not probed).  Each fingerprint gets the thresholds
that are cheapest for it, by dynamic programming over estimated candidate counts; the
estimates come from exact histograms of 16-bit pieces over all fingerprints (a bounded
table).  Every fingerprint is indexed under its own key in every partition, probes the keys
within its thresholds, and candidates are verified by their whole distance.

Buckets are stored in chunks of ``CHUNK`` members and verified in numpy; a task reports a
spanning forest of the links that it finds, never all pairs of a bucket, which keeps the
components whole.

Defined cases: null or wordless text has fingerprint 0 and is linked like any other; equal
texts share a fingerprint; a null id is never a component id unless nothing else is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import small_batches, table, utf8
from provenir.llm.components import connected_components
from provenir.runtime import materialize

WIDTH, SHINGLE, BITS, PARTITIONS, CHUNK, SEED = 64, 3, 3, 2, 256, 42
#: Cost of one probe row against one candidate that a probe meets.
PROBE_COST, CANDIDATE_COST = 1.0, 0.5


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is set if over half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)], np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found)], [id_col, "fp"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_pairs(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(n, 64 x 64 counts of bits set together) over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH, WIDTH), np.int64)
        n = 0
        for batch in batches:
            b = _bits(batch.column("fp").to_numpy()).astype(np.float32)
            total += (b.T @ b).astype(np.int64)
            n += len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH * WIDTH + 1)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])

    found = np.zeros(WIDTH * WIDTH + 1, np.int64)
    for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        found[r["cell"]] = r["n"]
    return int(found[-1]), found[:-1].reshape(WIDTH, WIDTH)


def group_bits(n: int, pairs: np.ndarray, partitions: int = PARTITIONS) -> list[list[int]]:
    """Partitions of near-equal width; each takes, greedily, the bits most correlated with it."""
    p = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((pairs / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(WIDTH)), []
    for k in range(partitions):
        size = len(free) // (partitions - k)
        order = sorted(free)
        first = max(order, key=lambda b: (corr[b, order].max(), -b))
        group = [first]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def keys_of(fps: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """Each partition's bits, packed low first, as non-negative longs (partitions of 2 or more)."""
    bits = _bits(fps).astype(np.int64)
    return [bits[:, g] @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups]


def _pieces(group: list[int]) -> list[tuple[int, int]]:
    return [(at, min(16, len(group) - at)) for at in range(0, len(group), 16)]


def piece_histograms(fps: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """Counts of each 16-bit piece of each partition over all fingerprints: at most 64 Ki longs apiece."""
    pieces = [(i, k, at, width) for i, g in enumerate(groups) for k, (at, width) in enumerate(_pieces(g))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << width, np.int64) for *_, width in pieces]
        for batch in batches:
            keys = keys_of(batch.column("fp").to_numpy(), groups)
            for total, (i, _, at, width) in zip(totals, pieces, strict=True):
                total += np.bincount((keys[i] >> at) & ((1 << width) - 1), minlength=1 << width)
        for p, total in enumerate(totals):
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p)), pa.array(at), pa.array(total[at])], ["piece", "value", "n"])

    out = [[np.zeros(1 << width) for _, width in _pieces(g)] for g in groups]
    counted = fps.select("fp").mapInArrow(run, "piece long, value long, n long").groupBy("piece", "value").agg(F.sum("n").alias("n"))
    for p, value, n in zip(*(x.to_numpy() for x in counted.select("piece", "value", "n").toArrow().columns), strict=True):
        i, k, *_ = pieces[p]
        out[i][k][value] = n
    return out


def within(hist: np.ndarray, most: int) -> np.ndarray:
    """Row d: for every value, how many entries lie at distance exactly d (d = 0 .. most)."""
    at = np.zeros((most + 1, len(hist)))
    at[0] = hist
    values = np.arange(len(hist))
    for b in range(len(hist).bit_length() - 1):
        flipped = at[:, values ^ (1 << b)]
        at[1:] += flipped[:-1]
    return at


def allocate(cost: np.ndarray, total: int) -> np.ndarray:
    """Thresholds (queries, partitions) of least cost that sum to ``total``.

    cost[q, i, t + 1] is the cost of threshold t = -1, 0, ... in partition i: a dynamic
    programme over partitions, all queries at once.
    """
    n, m, choices = cost.shape
    span = total + m  # thresholds raised by one sum to this
    best = np.full((n, span + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for i in range(m):
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
        for c in range(min(choices, span + 1)):
            tried = best[:, : span + 1 - c] + cost[:, i, c, None]
            better = tried < new[:, c:]
            new[:, c:][better] = tried[better]
            pick[:, c:][better] = c
        best = new
        picks.append(pick)
    out = np.zeros((n, m), np.int64)
    left = np.full(n, span)
    for i in range(m - 1, -1, -1):
        out[:, i] = picks[i][np.arange(n), left] - 1
        left = left - out[:, i] - 1
    return out


def _masks(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], np.int64)


class Pigeonhole:
    """Bit groups, distance tables and probe masks; its size is fixed by widths, not by data."""

    def __init__(self, n: int, groups: list[list[int]], histograms: list[list[np.ndarray]], bits: int) -> None:
        self.n, self.groups, self.bits = max(n, 1), groups, bits
        self.near = [[within(h, bits).astype(np.float32) for h in hs] for hs in histograms]

    def estimates(self, keys: list[np.ndarray]) -> np.ndarray:
        """Expected entries within t of each key (queries, partitions, t = 0 .. bits), pieces independent."""
        out = np.zeros((len(keys[0]), len(keys), self.bits + 1))
        for i, (key, group) in enumerate(zip(keys, self.groups, strict=True)):
            at = np.zeros((self.bits + 1, len(key)))
            at[0] = self.n
            for near, (shift, width) in zip(self.near[i], _pieces(group), strict=True):
                piece = near[:, (key >> shift) & ((1 << width) - 1)] / self.n
                at = np.stack([sum(at[a] * piece[d - a] for a in range(d + 1)) for d in range(self.bits + 1)])
            out[:, i] = np.cumsum(at, 0).T
        return out

    def thresholds(self, keys: list[np.ndarray]) -> np.ndarray:
        cost = np.zeros((len(keys[0]), len(keys), self.bits + 2))
        cost[:, :, 1:] = CANDIDATE_COST * self.estimates(keys)
        for i, g in enumerate(self.groups):
            for t in range(self.bits + 1):
                cost[:, i, t + 1] += PROBE_COST * sum(comb(len(g), k) for k in range(t + 1))
        return allocate(cost, self.bits - len(self.groups) + 1)

    def probes(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(partition, keys, fingerprints): all keys within each fingerprint's thresholds."""
        keys = keys_of(fps, self.groups)
        chosen = self.thresholds(keys)
        for i, g in enumerate(self.groups):
            for t in range(self.bits + 1):
                rows = np.flatnonzero(chosen[:, i] == t)
                masks = _masks(len(g), t) if len(rows) else None
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    yield i, (keys[i][part][:, None] ^ masks).ravel(), np.repeat(fps[part], len(masks))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least of its component) spanning the links of one batch."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class _Union:
    """Union-find over the links that one task has seen."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links(fps: DataFrame, bits: int = BITS, partitions: int = PARTITIONS) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints (fp) within ``bits``."""
    spark = fps.sparkSession
    n, pairs = bit_pairs(fps)
    groups = group_bits(n, pairs, partitions)
    shared = spark.sparkContext.broadcast(Pigeonhole(n, groups, piece_histograms(fps, groups), bits))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            for i, key in enumerate(keys_of(values, groups)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i)), pa.array(key), pa.array(values)], ["part", "key", "fp"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key, values in shared.value.probes(batch.column("fp").to_numpy()):
                for k in range(0, len(key), 65536):
                    cut = slice(k, k + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[cut]), i)), pa.array(key[cut]), pa.array(values[cut])], ["part", "key", "probe"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Union()
        for batch in batches:
            members = batch.column("members")
            sizes = np.diff(members.offsets.to_numpy())
            a = np.repeat(batch.column("probe").to_numpy(), sizes)
            b = members.flatten().to_numpy()
            # bitwise_count of signed numbers would count the bits of their absolute value
            hit = (np.bitwise_count((a ^ b).view(np.uint64)) <= bits) & (a != b)
            if hit.any():
                new = [(x, y) for x, y in zip(*(z.tolist() for z in _forest(a[hit], b[hit])), strict=True) if seen.join(x, y)]
                if new:
                    x, y = zip(*new, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    schema = "part long, key long, {} long"
    entries = fps.select("fp").mapInArrow(index, schema.format("fp"))
    # fingerprints have no bound: merge joins at every size, never a broadcast by the driver
    # buckets in chunks: the number of chunks follows each bucket's size
    sizes = entries.groupBy("part", "key").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    buckets = entries.join(sizes.hint("merge"), ["part", "key"]).groupBy("part", "key", chunk.alias("chunk")).agg(F.collect_list("fp").alias("members"))
    probes = fps.select("fp").mapInArrow(probe, schema.format("probe"))
    met = probes.join(buckets.select("part", "key", "members").hint("merge"), ["part", "key"]).filter(~((F.size("members") == 1) & (F.element_at("members", 1) == F.col("probe"))))
    return met.select("probe", "members").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE, bits: int = BITS, partitions: int = PARTITIONS) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the least id reachable."""
    known = materialize(fingerprints(docs, id_col, shingle), "fingerprints")
    distinct = materialize(known.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = connected_components(materialize(links(distinct, bits, partitions), "found"))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    labelled = materialize(labelled.select("fp", "label", "least"), "labelled")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return known.join(labelled.join(least.hint("merge"), "label").select("fp", "component_id").hint("merge"), "fp")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
