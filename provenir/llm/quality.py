"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent space.

Terms are unigrams and bigrams of byte classes (each ASCII sign alone, letters by case,
digits and non-ASCII bytes together), one term for words that equal the word before them,
and the lower-cased words themselves, hashed; all are counted over whole texts.  A bounded
sample of labelled documents gives idf weights and, by a truncated SVD, a latent-semantic
basis; its vectors (at most twice ``SAMPLE`` x ``RANK`` floats, about 1 MB) are broadcast.
Every document is compared with every labelled vector by exact cosine, in blocks, and its
``NEIGHBOURS`` nearest vote with weight similarity**``POWER``.

Defined cases: null or empty text has the zero vector and gets the sample's share of
label 1; similarities are rounded to six digits, and of equal ones the vectors' order (by
id and label) decides, so that equal texts have equal scores and votes don't depend on the
block; without any labelled row every score is 0.5; a doc_id labelled twice takes its
lowest label, null ids and null labels are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import crc_mod, hash_share, small_batches, table, utf8

SAMPLE, RANK, NEIGHBOURS, POWER, THRESHOLD, BLOCK = 4000, 48, 15, 4, 0.3, 256


def _classes() -> tuple[np.ndarray, int]:
    """Byte -> class: signs alone, then lower, upper, digit, space, newline, other control, non-ASCII."""
    out = np.zeros(256, np.int64)
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for k, b in enumerate(signs):
        out[b] = k
    n = len(signs)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = n
        elif c.islower():
            out[b] = n + 1
        elif c.isupper():
            out[b] = n + 2
        elif c.isdigit():
            out[b] = n + 3
        elif b == 10:
            out[b] = n + 4
        elif b <= 32 or b == 127:
            out[b] = n + 5
    return out, n + 6


CLASS_OF, CLASSES = _classes()
STYLE, WORDS = CLASSES + CLASSES * CLASSES + 1, 2048
TERMS = STYLE + WORDS
#: Weight of the term for repeated neighbours, which has no idf of its own kind.
REPEAT_WEIGHT = 8.0
#: Length of the words' part of a vector, where the style's part has length 1.
WORD_PART = 0.3


def term_counts(text: bytes) -> np.ndarray:
    """Class unigram and bigram counts, repeated neighbours and hashed words of a whole text (TERMS,)."""
    c = CLASS_OF[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) if len(c) > 1 else np.zeros(CLASSES * CLASSES)
    words = text.split()
    repeats = sum(map(eq, words, words[1:]))
    hashed = np.fromiter(map(crc32, text.lower().split()), np.int64) % WORDS
    return np.concatenate([np.bincount(c, minlength=CLASSES), pairs, [repeats * len(text) // max(len(words), 1)], np.bincount(hashed, minlength=WORDS)])


@dataclass
class NeighbourModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @staticmethod
    def fit(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> NeighbourModel:
        idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.2
        idf[STYLE - 1] = REPEAT_WEIGHT
        x = _weighted(counts, idf)
        basis = truncated_basis(x, rank)
        return NeighbourModel(idf, basis, _unit(x @ basis), labels.astype(np.float32), float(labels.mean()))

    def scores(self, texts: list[bytes], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        k = min(neighbours, len(self.vectors))
        for i in range(0, len(texts), BLOCK):
            block = texts[i : i + BLOCK]
            x = _unit(_weighted(np.stack([term_counts(t) for t in block]), self.idf) @ self.basis)
            near = np.round(x @ self.vectors.T, 6)
            top = nearest(near, k)
            weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(1)
            vote = (weight * self.labels[top]).sum(1)
            voted = total > 0
            out[i : i + BLOCK][voted] = np.clip(vote[voted] / total[voted], 0, 1)
        return out


def truncated_basis(x: np.ndarray, rank: int, extra: int = 16, rounds: int = 8) -> np.ndarray:
    """Right singular vectors (terms, rank) of the largest singular values, by subspace iteration."""
    q = np.random.default_rng(5).normal(size=(x.shape[1], min(rank + extra, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    turned = np.linalg.svd(x @ q, full_matrices=False)[2].T
    return np.ascontiguousarray((q @ turned)[:, :rank], dtype=np.float32)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest entries, by entry and then by place, ties at the border included."""
    if near.shape[1] <= k:
        return np.argsort(-near, 1, kind="stable")
    border = np.partition(near, -k, 1)[:, -k][:, None]
    over, equal = near > border, near == border
    taken = over | (equal & (np.cumsum(equal, 1) <= k - over.sum(1, keepdims=True)))
    places = np.nonzero(taken)[1].reshape(len(near), k)
    order = np.argsort(-np.take_along_axis(near, places, 1), 1, kind="stable")
    return np.take_along_axis(places, order, 1)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log-damped shares times idf, so that a text's length plays no part."""
    style = counts[:, :STYLE] / np.maximum(counts[:, :CLASSES].sum(1, keepdims=True), 1)
    words = counts[:, STYLE:] / np.maximum(counts[:, STYLE:].sum(1, keepdims=True), 1)
    parts = [_unit((np.log1p(1000 * x) * w).astype(np.float32)) for x, w in ((style, idf[:STYLE]), (words, idf[STYLE:]))]
    return _unit(np.concatenate([parts[0], WORD_PART * parts[1]], 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> NeighbourModel | None:
    """Fit on at most about ``sample`` labelled rows, chosen by a hash of the id."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.filter(F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    chosen = marked.filter(hash_share(marked, id_col, sample))
    # about `sample` ids and labels, never over twice as many: a bounded broadcast
    rows = docs.select(id_col, "text").join(F.broadcast(chosen.limit(2 * sample)), id_col)
    # an id teaches one text, however often its row is repeated: what is collected stays bounded
    first = F.min_by(F.struct("text", "quality"), F.xxhash64("text"))
    rows = rows.groupBy(id_col).agg(first.alias("x")).select(id_col, "x.text", "x.quality")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.minimum(term_counts(t), 2**31 - 1).astype("<i4").tobytes() for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("quality").cast(pa.int32()), pa.array(counts, pa.binary())], ["id", "quality", "counts"])

    # as one Arrow table of at most 2 * sample rows: no row of it becomes a Python object
    found = rows.mapInArrow(count, "id long, quality int, counts binary").toArrow().sort_by("id").combine_chunks()
    if not found.num_rows:
        return None
    counts = pa.concat_arrays(found.column("counts").chunks)
    ends = np.frombuffer(counts.buffers()[1], "<i4")[counts.offset : counts.offset + len(counts) + 1]
    cells = np.frombuffer(counts.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<i4").reshape(len(counts), -1)
    return NeighbourModel.fit(cells.astype(np.float32), found.column("quality").to_numpy())


def score(docs: DataFrame, model: NeighbourModel | None, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = utf8(batch, "text")
            scores = np.full(len(texts), 0.5) if model is None else model.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(scores, pa.float64())], [id_col, "score"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    held = (crc_mod("doc_id", 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
