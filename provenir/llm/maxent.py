"""Language-model scores from a hashed maximum-entropy model.

Words fall into ``CLASSES`` classes of ``SUBS`` sub-classes: each of the most frequent words
has a sub-class of its own, all others fall into one by their ending and their hash.  The
model is P(word | history) = P(class | history) * P(sub-class | class, history) *
P(word | sub-class).  Both softmaxes have hashed features of the history: the word before,
the two before as a bigram and, for the classes, a skip to the second before; within a
class the features are those of the history together with the class.  All share one table
of ``FEATURES`` rows.  Words that share a sub-class have the word as their only feature, whose
maximum-entropy fit is the smoothed relative frequency.

Training covers every training row: word counts in one pass, then ``ROUNDS`` rounds of
distributed gradient updates, each over its own share of the rows.  In a round every task
starts from the broadcast weights, makes sparse Adagrad steps over its partitions and
returns the rows that it changed; a row's changes are averaged by how often each task met
its feature, so that a rare feature keeps what it learned wherever it was met.  Texts are
encoded once, as one number a token, and written; rounds and scores read that.

Weights (FEATURES x CLASSES floats, 32 MB) and the table of the at most ``TOP`` most
frequent words of up to ``WORD_BYTES`` bytes are bounded broadcasts; all other words are
joined with the counts.

Defined cases: null or empty text is the end token alone; a table without training rows
gives uniform classes and counts of zero; repeated rows are scored one by one; equal texts
have equal scores.  The weights depend on how rows fall into partitions, as averaged
updates do: another layout of the same table gives slightly other values of ``score``;
every other column is exact.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import crc_mod, small_batches, table, utf8
from provenir.runtime import materialize

TOP, WORD_BYTES, CLASSES, SUBS, RANKED, FEATURES, ROUNDS = 1 << 18, 64, 32, 32, 16, 1 << 18, 2
ALPHA, RATE, STEP, ROW_BLOCK, TOKENS_A_TASK = 0.1, 0.15, 2048, 4096, 8_000_000
#: Rows behind those of the features: a bias of the classes, and one of each class's sub-classes.
ROWS = FEATURES + 1 + CLASSES
LEAVES = CLASSES * SUBS
#: The end of a text as a token; no word is empty.
END = b""
_START = np.uint32(0x51ED270B)
_MIX = tuple(np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32))
_OTHER, _HASH_BITS = 1 << 30, 26


def tokens(text: bytes) -> list[bytes]:
    found = text.lower().split()
    found.append(END)
    return found


def code(word: bytes) -> int:
    """A word as a number: its ending's class and its hash."""
    return _OTHER | zlib.crc32(word[-3:]) % (CLASSES - RANKED) << _HASH_BITS | zlib.crc32(word) & (1 << _HASH_BITS) - 1


def leaf_of(codes: np.ndarray) -> np.ndarray:
    """The sub-class of words that have none of their own."""
    ending = (codes >> _HASH_BITS) & (CLASSES - RANKED - 1)
    return (RANKED + ending) * SUBS + codes % SUBS


def _partial_counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all tokens of the rows, counted in each task before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in utf8(batch, "text"):
                seen.update(tokens(text))
            if len(seen) > 400_000:
                yield _partial_counts(seen)
                seen = Counter()
        yield _partial_counts(seen)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Index(dict):
    """Word -> place; -1 for any other word."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """Exact counts of the most frequent words, totals of all, and sub-class sums of all."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    leaf_tokens: np.ndarray
    leaf_words: np.ndarray
    floor: int = 1
    index: dict[bytes, int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._prepare()

    def _prepare(self) -> None:
        self.index = _Index(zip(self.words, range(len(self.words)), strict=True))
        self.codes = np.array([code(w) for w in self.words], np.int32)
        self.leaves = leaf_of(self.codes)
        n = min(RANKED * SUBS, len(self.words))
        self.leaves[:n] = np.arange(n)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "codes", "leaves")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()


def vocabulary(counted: DataFrame, top: int = TOP) -> Vocabulary:
    """Read off a materialized (word, n): all words of up to WORD_BYTES counted at least
    ``floor`` times, where the floor is the least that leaves at most ``top`` of them."""
    short = counted.filter(F.length("word") <= WORD_BYTES)
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["level"], r["words"], r["least"]) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()), reverse=True)
    floor, held = None, 0
    for _, words, least in sizes:  # about a thousand levels at most
        if held + words > top:
            break
        floor, held = least, held + words
    floor = floor if floor is not None else 1 << 62
    rows = short.filter(F.col("n") >= floor).toArrow()
    found = sorted(zip((-n for n in rows["n"].to_pylist()), rows["word"].to_pylist(), strict=True))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, LEAVES), np.int64)
        for batch in batches:
            leaf = leaf_of(np.array([code(w) for w in batch.column("word").to_pylist()], np.int64))
            sums[0] += np.bincount(leaf, batch.column("n").to_numpy(), minlength=LEAVES).astype(np.int64)
            sums[1] += np.bincount(leaf, minlength=LEAVES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEAVES)), pa.array(sums[0]), pa.array(sums[1])], ["leaf", "n", "v"])

    vocab = Vocabulary([w for _, w in found], np.array([-n for n, _ in found], np.int64), int(total[0]), int(total[1]), np.zeros(LEAVES, np.int64), np.zeros(LEAVES, np.int64), floor)
    np.add.at(vocab.leaf_tokens, vocab.leaves, vocab.counts)
    np.add.at(vocab.leaf_words, vocab.leaves, 1)
    rest = rare_words(counted, vocab).mapInArrow(by_leaf, "leaf long, n long, v long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    for r in rest.collect():
        vocab.leaf_tokens[r["leaf"]] += r["n"]
        vocab.leaf_words[r["leaf"]] += r["v"]
    return vocab


def rare_words(counted: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The counted words that the broadcast table doesn't hold."""
    return counted.filter((F.col("n") < vocab.floor) | (F.length("word") > WORD_BYTES))


def encode(texts: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(a number for each token: its place in the vocabulary, or its code; tokens of each text; the words without a place)."""
    words: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = tokens(t)
        sizes[i] = len(own)
        words += own
    found = np.fromiter(map(vocab.index.__getitem__, words), np.int32, len(words))
    unknown = np.flatnonzero(found < 0)
    others = [words[i] for i in unknown.tolist()]
    found[unknown] = np.fromiter(map(code, others), np.int32, len(others))
    return found, sizes, others


def features_of(numbers: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(rows of the weights, targets) of the classes and of the sub-classes: a row a token,
    whose last entry is the bias."""
    known = numbers < _OTHER
    codes, leaves = numbers.copy(), leaf_of(numbers)
    if len(vocab.words):
        codes[known], leaves[known] = vocab.codes[numbers[known]], vocab.leaves[numbers[known]]
    hashes = codes.view(np.uint32)
    starts = np.cumsum(sizes) - sizes
    one, two = np.empty_like(hashes), np.empty_like(hashes)
    for k, h in ((1, one), (2, two)):
        h[k:] = hashes[: len(hashes) - k]
        for j in range(k):  # places with fewer than k words before them in their text
            h[starts[sizes > j] + j] = _START
    classes = leaves // SUBS
    rows = [np.empty((len(numbers), 4), np.int32), np.empty((len(numbers), 3), np.int32)]
    rows[0][:, -1], rows[1][:, -1] = FEATURES, FEATURES + 1 + classes
    salt = (classes.astype(np.uint32) + np.uint32(1)) * _MIX[1]
    with np.errstate(over="ignore"):
        before, both = one * _MIX[0], (one * _MIX[1]) ^ (two * _MIX[0]) * _MIX[2]
        for level, mixed in enumerate(((before, both, two * _MIX[2]), (before ^ salt, both ^ salt))):
            for k, m in enumerate(mixed):
                m = (m ^ (m >> np.uint32(15))) * _MIX[3]
                m = (m ^ (m >> np.uint32(13))) * _MIX[0]
                rows[level][:, k] = m >> np.uint32(32 - FEATURES.bit_length() + 1)
    return rows, [classes, leaves % SUBS]


@dataclass
class Weights:
    """One row of CLASSES (as many as SUBS) weights for every hashed feature and every bias."""

    rows: np.ndarray

    @staticmethod
    def fresh(vocab: Vocabulary | None = None) -> Weights:
        """No feature weighs; the biases are the relative frequencies of classes and sub-classes."""
        out = Weights(np.zeros((ROWS, CLASSES), np.float32))
        if vocab is not None:
            tokens_ = vocab.leaf_tokens.reshape(CLASSES, SUBS) + ALPHA * (vocab.leaf_words.reshape(CLASSES, SUBS) + 1)
            out.rows[FEATURES] = np.log(tokens_.sum(1) / tokens_.sum())
            out.rows[FEATURES + 1 :] = np.log(tokens_ / tokens_.sum(1, keepdims=True))
        return out

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """Sums of weights (tokens, CLASSES), kept where exp can't overflow."""
        out = self.rows.take(rows[:, 0], 0)
        for k in range(1, rows.shape[1]):
            out += self.rows.take(rows[:, k], 0)
        return np.clip(out, -60, 60, out=out)

    def chosen(self, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability."""
        out = np.empty(len(targets))
        for i in range(0, len(targets), STEP):
            z = self.logits(rows[i : i + STEP])
            own = z[np.arange(len(z)), targets[i : i + STEP]]
            out[i : i + STEP] = own - np.log(np.exp(z, out=z).sum(1))
        return out

    def update(self, rows: np.ndarray, targets: np.ndarray, seen: np.ndarray, met: np.ndarray, rate: float = RATE) -> None:
        """One Adagrad step on a batch, with one step size a row; ``seen`` holds the rows' sums
        of squared gradients, ``met`` how often each was met."""
        p = self.logits(rows)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(targets)), targets] -= 1
        k = rows.shape[1] - 1  # biases stay as they are
        flat = rows[:, :k].ravel()
        # two passes of 16-bit keys, which numpy sorts by radix
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        order = order.take(np.argsort((flat >> 16).astype(np.uint16).take(order), kind="stable"))
        ordered = flat.take(order)
        at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        touched = ordered.take(at)
        met[touched] += np.diff(at, append=len(ordered))
        # two floats in one complex number halve the work of the segmented sum
        g = np.add.reduceat(p.take(order // k, 0).view(np.complex64), at, 0).view(np.float32)
        squares = seen[touched] + np.einsum("ij,ij->i", g, g)
        seen[touched] = squares
        g *= (-rate / np.sqrt(squares / CLASSES + 0.02))[:, None]
        g += self.rows.take(touched, 0)
        self.rows[touched] = g


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Changes of one block of rows, averaged by how often each task met the rows."""
    met = [np.frombuffer(x, "<f4").astype(np.float64) for x in pdf["met"]]
    total = np.maximum(sum(met), 1e-9)
    change = sum(np.frombuffer(x, "<f2").reshape(len(total), CLASSES) * (n / total)[:, None] for n, x in sorted(zip(met, pdf["change"], strict=True), key=lambda x: x[1]))
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "task": [0], "met": [sum(met).astype("<f4").tobytes()], "change": [change.astype("<f2").tobytes()]})


def train_round(encoded: DataFrame, vocab, weights: Weights, tasks: int) -> Weights:
    """One round in at most ``tasks`` tasks: their changes of the rows that they met, averaged row by row."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, met = Weights(shared.value.rows.copy()), np.zeros(ROWS, np.float32), np.zeros(ROWS, np.int64)
        for batch in batches:
            levels = features_of(*_numbers(batch), vocab.value)
            for i in range(0, len(levels[0][0]), STEP):
                for rows, targets in zip(*levels, strict=True):
                    own.update(rows[i : i + STEP], targets[i : i + STEP], seen, met)
        if met.any():
            change = (own.rows - shared.value.rows).astype("<f2")
            for k in range(0, ROWS, ROW_BLOCK):
                if met[k : k + ROW_BLOCK].any():
                    data, n = change[k : k + ROW_BLOCK].tobytes(), met[k : k + ROW_BLOCK].astype("<f4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k // ROW_BLOCK]), pa.array([zlib.crc32(data) & 0xFFFF]), pa.array([n], pa.binary()), pa.array([data], pa.binary())], ["block", "task", "met", "change"])

    schema = "block long, task long, met binary, change binary"
    # a task returns up to a whole table of rows, so tasks follow the tokens, not the files
    changes = encoded.select("numbers").coalesce(tasks).mapInArrow(run, schema)
    # changes are merged in two steps, so that no group grows with the number of tasks
    halves = changes.withColumn("part", F.col("task") % 64).groupBy("block", "part").applyInPandas(_merged, schema)
    out = weights.rows.copy()
    for r in halves.groupBy("block").applyInPandas(_merged, schema).collect():  # one table of weights
        change = np.frombuffer(r["change"], "<f2").reshape(-1, CLASSES)
        out[r["block"] * ROW_BLOCK :][: len(change)] += change
    return Weights(out)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all tokens, tokens of each text) of a batch of encoded texts."""
    column = batch.column("numbers")
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()).astype(np.int64)


def encoded_texts(docs: DataFrame, vocab, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(uid, *keep, n_tokens, known, frequent, numbers, others, times) for every row, written.

    ``frequent`` sums log10 of the smoothed counts of words in the broadcast table; a text's
    other words come out as a list with their counts.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.append(np.log10(vocab.value.counts + ALPHA), 0)
        for batch in batches:
            numbers, sizes, others = encode(utf8(batch, "text"), vocab.value)
            n = len(sizes)
            known = numbers < _OTHER
            owner = np.repeat(np.arange(n), sizes)
            frequent = np.bincount(owner, logs[np.where(known, numbers, -1)], n)
            cuts = np.searchsorted(owner[~known], np.arange(n + 1)).tolist()
            words, times, offsets = [], [], [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seen = Counter(others[a:b])
                words += seen
                times += seen.values()
                offsets.append(len(words))
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v) for v in (pa.array(words, pa.binary()), pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sizes), pa.array(np.bincount(owner[known], minlength=n)), pa.array(frequent), pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32())), *lists],
                [*keep, "n_tokens", "known", "frequent", "numbers", "others", "times"],
            )

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "".join(f"`{c}` {fields[c]}, " for c in keep) + "n_tokens long, known long, frequent double, numbers array<int>, others array<binary>, times array<bigint>"
    rows = docs.select(*keep, "text").mapInArrow(run, schema)
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "encoded")


def score(encoded: DataFrame, counted: DataFrame, vocab, weights: Weights, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, n_tokens, n_known, train_tokens, base_score, score) for every encoded row.

    Frequent words are scored where the text is read; a text's other words meet their
    counts in a join.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(weights)
    v = vocab.value
    base_norm = math.log10(v.total + ALPHA * (v.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = np.log10(vocab.value.leaf_tokens + ALPHA * (vocab.value.leaf_words + 1))
        for batch in batches:
            numbers, sizes = _numbers(batch)
            rows, targets = features_of(numbers, sizes, vocab.value)
            each = sum(shared.value.chosen(r, t) for r, t in zip(rows, targets, strict=True)) / math.log(10) - norm[targets[0] * SUBS + targets[1]]
            model = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(model)], [*names, "model"])

    names = ("uid", *keep, "n_tokens", "known", "frequent")
    fields = {f.name: f.dataType.simpleString() for f in encoded.schema}
    schema = "".join(f"`{c}` {fields[c]}, " for c in names) + "model double"
    rows = encoded.select(*names, "numbers").mapInArrow(run, schema)
    # each text's words came out once, with their counts
    rest = encoded.select("uid", F.explode(F.arrays_zip(F.col("others").alias("word"), F.col("times").alias("tf"))).alias("x")).select("uid", "x.word", "x.tf")
    met = rest.join(rare_words(counted, v), "word", "left")
    logs = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(ALPHA)) * F.col("tf")
    sums = met.groupBy("uid").agg(F.sum(logs).alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more"))
    log, more = F.col("frequent") + F.coalesce("log", F.lit(0.0)), F.coalesce("more", F.lit(0))
    base = log - F.col("n_tokens") * F.lit(base_norm)
    return rows.join(sums, "uid", "left").select(*keep, "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + log).alias("score"))


def fit(docs: DataFrame, train, keep: tuple[str, ...] = ("doc_id",), rounds: int = ROUNDS, top: int = TOP):
    """(encoded rows, counts, broadcast vocabulary, weights); ``train`` marks the training rows of ``docs``."""
    spark = docs.sparkSession
    counted = materialize(count_words(docs.filter(train)), "words")
    vocab = spark.sparkContext.broadcast(vocabulary(counted, top))
    marked = docs.select(*keep, "text", train.alias("train"))
    encoded = encoded_texts(marked, vocab, (*keep, "train"))
    weights = Weights.fresh(vocab.value)
    tasks = max(1, -(-vocab.value.total // max(1, rounds * TOKENS_A_TASK)))
    for r in range(rounds):
        weights = train_round(encoded.filter("train").filter(F.pmod(F.xxhash64(F.lit("round"), "uid"), F.lit(rounds)) == r), vocab, weights, tasks)
    return encoded, counted, vocab, weights


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 10)
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold == 0).alias("held_out"), "text")
    keep = ("doc_id", "held_out")
    return score(*fit(docs, ~F.col("held_out"), keep), keep)
