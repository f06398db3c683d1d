"""Mixing sources to target weights by balanced (cube) sampling.

Every source gets a target number of words.  A document of a source with ratio
r = target / words is taken floor(r) times for certain and once more with inclusion
probability r - floor(r).  The extra copies are drawn by the cube method: probabilities
move inside the null space of the constraints (expected number of documents, expected
words) until they are 0 or 1.  Flights run per (source, block); the few units a block
leaves fractional (at most one per constraint) meet in the next round's blocks, so each
round shrinks the problem by the block size, and only a landing of at most two units per
source is left: they fly on under the words alone, and the very last one goes where the
words come nearer to the target.

Defined cases: null text counts 0 words; a null source is a source of its own, ordered last;
an empty table gives an empty result; repeated rows are separate units; reruns agree since
all draws are hashes of id, size and round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.llm.common import WORD, small_batches, table
from provenir.runtime import materialize

WEIGHTS, SHARE, CEILING, BLOCK_ROWS = (3, 1, 2), 1.5, 2, 4096
#: Equal rows that one task makes from their count at a time.
RANGE = 1024
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The excess over a ceiling goes to the others by weight; the result is
    target = min(ceiling * size, level * weight) for the one level that spends the total.
    Windows below run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    # sources in the order in which a rising level caps them
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = (
        per.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("free_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.col("capped")) / F.col("free_w"))
        .withColumn("turn", F.row_number().over(rising))
        # the level is found at the first source that it leaves under its cap
        .withColumn("found", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("turn", "level"))).over(whole)["level"])
    )
    target = F.coalesce(F.least(F.col("cap"), F.col("found") * F.col("w")), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Fast flight of the cube method: three units at a time along the null space of
    (count, words), until at most two are fractional.

    The step follows from the 2 x 3 constraints by a cross product; u supplies one
    uniform draw per step and both directions keep every expectation.
    """
    p = pi.tolist()
    sizes = (size / max(float(size.max(initial=1)), 1.0)).tolist()
    draws = u.tolist()
    held: list[int] = []
    at, step = 0, 0
    while True:
        while len(held) < 3 and at < len(p):
            if _EPS < p[at] < 1 - _EPS:
                held.append(at)
            at += 1
        if len(held) < 3:
            break
        a, b, c = held
        d = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if not any(d):
            d = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, v in zip(held, d, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, -p[k] / v), min(down, -(1 - p[k]) / v)
        move = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for k, v in zip(held, d, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + move * v))
        left = [k for k in held if _EPS < p[k] < 1 - _EPS]
        if len(left) == 3:  # rounding only: settle the nearest one
            k = min(left, key=lambda k: min(p[k], 1 - p[k]))
            p[k] = round(p[k])
            left.remove(k)
        held = left
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Settles the at most two units that a flight leaves.

    Two of them fly on under the one constraint of words, each direction as likely as keeps
    both expectations; the last one goes where the words come nearer to their total, so that
    a source misses its target by half of one document at most.
    """
    p = p.copy()
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(left) == 2:
        d = np.array([size[left[1]], -size[left[0]]])
        room = lambda d: min((1 - x) / v if v > 0 else -x / v for x, v in zip(p[left], d, strict=True))
        up, down = room(d), room(-d)
        p[left] = np.clip(p[left] + (up if u[left[0]] * (up + down) < down else -down) * d, 0, 1)
        left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    p[left] = np.round(p[left])
    return p


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Uniform draws in [0, 1) from 64-bit keys (a splitmix finalizer)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53


def _flyer(salt: int, last: bool):
    """One block's flight; on the last level also the landing of at most two units."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "size"], ignore_index=True)
        keys = pd.util.hash_array(pdf["uid"].to_numpy(dtype=object), categorize=False)
        order = np.argsort(_uniform(keys, 7 + salt), kind="stable")
        pdf = pdf.iloc[order].reset_index(drop=True)
        p = flight(pdf["pi"].to_numpy(), pdf["size"].to_numpy(dtype=np.float64), _uniform(keys[order], 31 + salt))
        if last:
            p = landing(p, pdf["size"].to_numpy(dtype=np.float64), _uniform(keys[order], 101 + salt))
        pdf["pi"] = np.where(p <= _EPS, 0.0, np.where(p >= 1 - _EPS, 1.0, p))
        return pdf[["uid", "stratum", "pi", "size"]]

    return fly


def cube_sample(units: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(uid, stratum, pi, size) -> (uid, chosen 0/1), balanced per stratum on count and size."""
    spark = units.sparkSession
    schema = "uid string, stratum string, pi double, size long"
    done, level = None, 0
    most = units.groupBy("stratum").count().agg(F.max("count")).first()[0] or 0
    current = units
    while True:
        blocks = max(1, -(-most // block_rows))

        fly = _flyer(level, blocks == 1)
        salted = current.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)))
        flown = materialize(salted.groupBy("stratum", "block").applyInPandas(fly, schema), f"flight{level}")
        settled = flown.filter("pi <= 0 or pi >= 1").select("uid", F.col("pi").cast("int").alias("chosen"))
        done = settled if done is None else done.unionByName(settled)
        if blocks == 1:
            return done
        current, level, most = flown.filter("pi > 0 and pi < 1"), level + 1, 2 * blocks


def mix_sources(docs: DataFrame, id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, size, source_size, target, copies, taken) per row of ``docs``."""
    small_batches(docs.sparkSession, 10_000)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select(F.col(id_col).alias("id"), "source", size.alias("size"), F.spark_partition_id().alias("part")), "sizes")
    targets = materialize(source_targets(sizes), "targets")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    # one unit per distinct (id, source, size); repeated rows get a running number.  They are
    # counted in the part that they were read in and made again from the counts, so that
    # rows of one key (null ids, say) never have to meet: only one count a part does
    counted = sizes.groupBy("id", "source", "size", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("id", "source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # a count is cut into ranges, which are dealt out before the rows of each are made
    starts = F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"), F.lit(RANGE).cast("long")))
    ranges = counted.select("id", "source", "size", starts.alias("first"), (F.col("before") + F.col("n")).alias("end"))
    ranges = ranges.repartition(F.xxhash64("id", "source", "size", "first"))
    nth = F.explode(F.sequence(F.col("first"), F.least(F.col("end"), F.col("first") + (RANGE - 1))))
    rows = ranges.select("id", "source", "size", nth.alias("nth")).withColumn("stratum", key)
    rows = rows.withColumn("uid", F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("null")), "size", "nth", "stratum"))
    ratio = targets.withColumn("stratum", key).select("stratum", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("ratio"))
    rows = rows.join(ratio, "stratum")
    whole = F.floor(F.col("ratio") + F.lit(_EPS))
    rows = rows.withColumn("sure", whole).withColumn("pi", F.greatest(F.lit(0.0), F.col("ratio") - whole))
    rows = materialize(rows.select("id", "uid", "stratum", "size", "source_size", "target", "sure", "pi"), "units")
    open_units = rows.filter(f"pi > {_EPS} and size > 0").select("uid", "stratum", "pi", "size")
    chosen = cube_sample(open_units, block_rows)
    copies = (F.col("sure") + F.coalesce(F.col("chosen"), F.lit(0))).cast("long")
    return rows.join(chosen.hint("merge"), "uid", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
