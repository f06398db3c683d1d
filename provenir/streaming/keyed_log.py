"""A table that holds one row a key, whatever is delivered again.

Each micro-batch is a folder; beside it stand Bloom filters of its keys, a few for each
batch (one a shard of the key's hash).  A new batch meets the filters, about 29 bits for
each key that was ever written, instead of the history itself; only batches in which a
filter answers are read, and only their key columns, to decide exactly.

A batch is staged, reduced, and put in its place by a rename.  What fails before leaves
nothing that readers see, and the same batch run again replaces whatever it left; a filter
without its batch answers for rows that aren't there and costs a look, nothing else.  One
writer at a time.  Null keys are keys like others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of absent keys for which a filter answers; filters of one batch.
MISTAKES, SHARDS = 1e-6, 16
#: Bits of the smallest filter: in fewer, two keys could share all their places.
LEAST = 4096
_BLOOM = "shard int, hashes int, bits binary"


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Scrambled 64-bit values (a splitmix finalizer)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * salt) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, hashes: int, size: int) -> np.ndarray:
    """(keys, hashes) bit numbers, independent of each other."""
    x = keys.astype(np.int64).view(np.uint64)
    return np.stack([(_mixed(x, i + 1) % np.uint64(size)).astype(np.int64) for i in range(hashes)], 1)


def bloom(keys: np.ndarray, mistakes: float = MISTAKES) -> tuple[int, bytes]:
    """(hashes, bits) of a filter over 64-bit keys."""
    size = max(LEAST, math.ceil(-len(keys) * math.log(mistakes) / math.log(2) ** 2))
    hashes = max(1, round(size / max(1, len(keys)) * math.log(2))) if len(keys) else 1
    hashes = min(hashes, 20)
    bits = np.zeros(-(-size // 8) * 8, np.uint8)
    for at in range(0, len(keys), 65536):
        bits[_places(keys[at : at + 65536], hashes, len(bits)).ravel()] = 1
    return hashes, np.packbits(bits, bitorder="little").tobytes()


def answers(keys: np.ndarray, hashes: int, bits: bytes) -> np.ndarray:
    """For which keys a filter answers: all that it holds, and ``MISTAKES`` of the others."""
    held = np.frombuffer(bits, np.uint8)
    out = np.ones(len(keys), bool)
    for at in range(0, len(keys), 65536):
        place = _places(keys[at : at + 65536], hashes, 8 * len(held))
        out[at : at + 65536] = ((held[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(1)
    return out


class _Store:
    """Folders of the store that holds the table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self, path: str) -> set[int]:
        found = self.fs.globStatus(self.path(f"{path}/batch=*"))
        return {int(x.getPath().getName().removeprefix("batch=")) for x in found or []}

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} could not be put in its place")


def suspects(keys: DataFrame, blooms: DataFrame) -> DataFrame:
    """(hash, batch): keys (hash, shard) for which a filter (batch, shard, hashes, bits) answers."""

    def match(own: pa.Table, held: pa.Table) -> pa.Table:
        hashes = own.column("hash").to_numpy()
        found = [(h, held.column("batch")[i].as_py()) for i in range(len(held)) for h in hashes[answers(hashes, held.column("hashes")[i].as_py(), held.column("bits")[i].as_py())].tolist()]
        return pa.table({"hash": pa.array([h for h, _ in found], pa.int64()), "batch": pa.array([b for _, b in found], pa.int64())})

    return keys.groupBy("shard").cogroup(blooms.groupBy("shard")).applyInArrow(match, "hash long, batch long")


def keyed_log(path: str, key: list[str], shards: int = SHARDS) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of the table below ``path``: one row for each ``key``, the first that came."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = _Store(spark, path)
        staged, reduced = f"{path}/_staged/{batch_id}", f"{path}/_reduced/{batch_id}"
        # what is decided below must hold for what is written
        batch.dropDuplicates(key).write.mode("overwrite").parquet(staged)
        hash_ = F.xxhash64(*key)
        rows = spark.read.schema(batch.schema).parquet(staged)
        keyed = rows.select(hash_.alias("hash")).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
        others = store.batches(path) - {batch_id}
        if others & store.batches(f"{path}/_bloom"):
            schema = T.StructType([*T._parse_datatype_string(_BLOOM).fields, T.StructField("batch", T.LongType())])
            blooms = spark.read.schema(schema).option("basePath", f"{path}/_bloom").parquet(*(f"{path}/_bloom/batch={b}" for b in sorted(others & store.batches(f"{path}/_bloom"))))
            hits = suspects(keyed, blooms)
            hits.write.mode("overwrite").parquet(f"{staged}-hits")
            hits = spark.read.schema(hits.schema).parquet(f"{staged}-hits")
            asked = sorted(r["batch"] for r in hits.select("batch").distinct().collect())  # a row a batch
            if asked:
                kinds = T.StructType([batch.schema[c] for c in key] + [T.StructField("batch", T.LongType())])
                held = spark.read.schema(kinds).option("basePath", path).parquet(*(f"{path}/batch={b}" for b in asked))
                known = held.withColumn("hash", hash_).join(hits, ["hash", "batch"], "left_semi").select(*(F.col(c).alias(f"{c}_known") for c in key))
                same = [F.col(c).eqNullSafe(F.col(f"{c}_known")) for c in key]
                rows = rows.join(known, same, "left_anti")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(reduced)
        kept = spark.read.schema(batch.schema).parquet(reduced).select(hash_.alias("hash")).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))

        def filters(part: pa.Table) -> pa.Table:
            hashes, bits = bloom(part.column("hash").to_numpy())
            return pa.table({"shard": pa.array([part.column("shard")[0].as_py()], pa.int32()), "hashes": pa.array([hashes], pa.int32()), "bits": pa.array([bits], pa.binary())})

        kept.groupBy("shard").applyInArrow(filters, _BLOOM).write.mode("overwrite").parquet(f"{path}/_bloom/batch={batch_id}")
        commit(store, reduced, f"{path}/batch={batch_id}")
        for left in (staged, f"{staged}-hits"):
            store.remove(left)

    return write


def commit(store: _Store, made: str, place: str) -> None:
    """Put a finished batch where readers see it, in place of what an earlier try left there."""
    store.remove(place)
    store.rename(made, place)
