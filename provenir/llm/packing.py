"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest; the rest is cut into pieces of at
most ``PIECE`` ids so that windows can be balanced.  Pieces fall into blocks by a hash;
within a block, partial partitions are merged, widest imbalance first, the largest sums of
one against the smallest of the other, which gives windows of near-equal length.  The
window count starts at the least possible and rises whenever a window exceeds its capacity.

Defined cases: null or empty text is the closing id alone; equal rows are packed one by
one; the vocabulary's added tokens in a text become their own ids, as its tokenizer makes
them by default; an empty table gives no piece.
A window whose length is a power of two is left as it is, any other is padded to the full
length by the reader.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import small_batches, table
from provenir.runtime import materialize

LENGTH, PIECE, CLOSING, BLOCK_PIECES = 2048, 512, 1, 3000
#: The named tokenizer, and the same byte-level vocabulary as ranks: their ids are equal
#: (tests compare them), and encoding by ranks is about four times as fast.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@cache
def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Callable[[str], list[int]]:
    """Ids of a text, loaded once in each Python worker; names or paths of the two files.

    Added tokens come from the tokenizer's own file and cut the text first.
    """
    import json
    import os

    import public_tokenizers
    import tiktoken

    place = lambda name: name if os.path.isabs(name) else public_tokenizers.path(name)
    with open(place(vocabulary), encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    with open(place(ranks), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all")


def cuts(total: int, length: int = LENGTH, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then an evenly cut rest."""
    full, rest = divmod(total, length)
    out = [(i * length, length) for i in range(full)]
    parts = -(-rest // piece)
    edges = [full * length + rest * k // parts for k in range(parts + 1)] if parts else []
    return out + [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def tokenized(docs: DataFrame, id_col: str = "doc_id", vocabulary: str = VOCABULARY, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: (id, start, length, ids_crc32, doc_tokens[, ids])."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(id_col).to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), CLOSING], "<u4")
                for start, n in cuts(len(ids), length):
                    part = ids[start : start + n]
                    out.append((doc, start, n, zlib.crc32(part.tobytes()), len(ids), *([part.tolist()] if with_ids else [])))
            columns = list(zip(*out, strict=True)) or [()] * (5 + with_ids)
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(id_col, "text").mapInArrow(run, schema)


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """Window number of every item: the k-way Karmarkar-Karp differencing method.

    A partial partition is its non-zero sums in descending order; the other windows are
    empty.  Every slot is a node of a tree whose leaves are items.
    """
    n = len(sizes)
    children: list[tuple[int, int] | None] = [None] * n
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:
            # the smallest sums of both meet, smallest of b against largest of a's smallest
            met = np.arange(len(children), len(children) + over)
            children += zip(x[len(a) - over :].tolist(), y[::-1][:over].tolist(), strict=True)
            sums = np.concatenate([a[: len(a) - over], a[len(a) - over :] + b[::-1][:over], b[: len(b) - over]])
            nodes = np.concatenate([x[: len(a) - over], met, y[: len(b) - over]])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-int(spread), count, sums, nodes))
        count += 1
    out = np.zeros(n, np.int64)
    if heap:
        for window, node in enumerate(heap[0][3].tolist()):
            stack = [node]
            while stack:
                k = stack.pop()
                if k < n:
                    out[k] = window
                else:
                    stack += children[k]
    return out


def balanced(sizes: list[int], capacity: int = LENGTH) -> np.ndarray:
    """Windows of near-equal sums, none over capacity, as few as the method finds."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        placed = differencing(sizes, windows)
        if not len(sizes) or np.bincount(placed, sizes).max() <= capacity:
            return placed
        windows += max(1, windows // 400)


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = LENGTH, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to the rows of a written table of pieces.

    Blocks are bounded and independent: a piece's block follows from its place in the
    table, so that equal rows spread over all blocks.
    """
    blocks = max(1, -(-pieces.count() // block_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col, "start", "ids_crc32", "place"], ignore_index=True)
        full = (pdf["length"] >= capacity).to_numpy()
        window = np.zeros(len(pdf), np.int64)
        rest = np.flatnonzero(~full)
        window[rest] = balanced(pdf["length"].to_numpy()[rest].tolist(), capacity)
        used = int(window[rest].max()) + 1 if len(rest) else 0
        window[full] = used + np.arange(full.sum())
        pdf["sequence_id"] = (pdf["block"].to_numpy() << 32) + window
        by = pdf.groupby("sequence_id", sort=False)["length"]
        pdf["offset"] = by.cumsum() - pdf["length"]
        return pdf.drop(columns=["block", "place"])

    placed = pieces.withColumn("place", F.monotonically_increasing_id())
    block = F.pmod(F.xxhash64("place"), F.lit(blocks))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return placed.withColumn("block", block).groupBy("block").applyInPandas(place, f"{fields}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialize(tokenized(table(spark, sf_dir, "documents")), "pieces"))
