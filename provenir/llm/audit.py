"""Filter interaction audit: what each filter removes, in every order of the filters.

Duplicates are found by sorting: rows are range-sorted by a 256-bit fingerprint of the text,
the text itself and the id, and each row is compared with its predecessor, so that a run of
equal texts shows its least id first.  A run may go on behind the end of a range: each range
reports its first text's fingerprint and its last run, one row each, and what earlier ranges
hold of that run is carried to the rows of its head (across ranges a text is known by its
fingerprint alone).  The same pass makes each row's mask of failures.  Rows are then summed
by (part, mask), which is all that any order of the filters depends on: 32 counts a part.

Defined cases: a null text is empty, a null source the empty part; a null id is neither
smaller nor greater than another, so it fails no duplicate test and lets none fail; rows
that repeat an id and its text don't fail for each other; ids with several labels count as
labelled 1 where any is; an empty table gives no row; texts of any length are read whole;
further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.llm.common import UPPER, table, utf8
from provenir.runtime import materialize

FILTERS = "ABCDE"
#: Bit of each filter in a mask.
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
MASKS = 1 << len(FILTERS)
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, b"#$%&*|"
_CAPITALS, _CONTINUES = UPPER.encode(), bytes(range(0x80, 0xC0))
_ROW, _HEAD, _TAIL = range(3)


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()
    points = len(text) - _count(text, _CONTINUES)
    out = BIT["A"] * (len(words) < FEWEST_WORDS)
    out |= BIT["B"] * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
    out |= BIT["C"] * (100 * _count(text, _CAPITALS) > CAPITAL_PERCENT * points)
    return out | BIT["D"] * (_count(text, SIGNS) > 0)


def _count(text: bytes, signs: bytes) -> int:
    return len(text) - len(text.translate(None, signs))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): the filters that each row fails."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    # the sample of the range bounds holds no text; equal rows are spread by their salt
    rows = rows.withColumn("fp", F.unhex(F.sha2("text", 256))).repartitionByRange("fp", "doc_id", "salt")
    rows = rows.sortWithinPartitions("fp", "text", F.asc_nulls_last("doc_id")).select("doc_id", "part", "text", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        first = last = low = last_fp = None
        mask = 0
        for batch in batches:
            found, heads = [], []
            ids = batch.column("doc_id").to_pylist()
            for k, (one, text) in enumerate(zip(ids, utf8(batch, "text"), strict=True)):
                if last is None or text != last:
                    last, low, mask = text, one, failures(text)
                    last_fp = batch.column("fp")[k].as_py()
                    if first is None:
                        first = text
                        yield _made([_HEAD], [place], [None], [None], [0], [True], [last_fp])
                found.append(mask | BIT["E"] * (low is not None and one is not None and low < one))
                heads.append(last is first)
            n = len(ids)
            yield _made([_ROW] * n, [place] * n, ids, batch.column("part"), found, heads, [None] * n)
        if last is not None:
            yield _made([_TAIL], [place], [low], [None], [0], [False], [last_fp])

    out = rows.mapInArrow(run, "kind int, place int, doc_id long, part string, mask int, head boolean, fp binary")
    out = materialize(out, "masks")
    # a row or two for each range: the least id that earlier ranges hold of its first text
    earlier = Window.partitionBy("fp").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carry = out.filter(F.col("kind") != _ROW).select("kind", "place", "fp", F.when(F.col("kind") == _TAIL, F.col("doc_id")).alias("low"))
    carry = carry.withColumn("low", F.min("low").over(earlier)).filter((F.col("kind") == _HEAD) & F.col("low").isNotNull()).select("place", "low")
    rows = out.filter(F.col("kind") == _ROW).join(F.broadcast(carry), "place", "left")
    late = F.coalesce(F.col("head") & (F.col("low") < F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", "part", F.when(late, F.col("mask").bitwiseOR(F.lit(BIT["E"]))).otherwise(F.col("mask")).alias("mask"))


def _made(*columns) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary())
    names = ("kind", "place", "doc_id", "part", "mask", "head", "fp")
    return pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def counters(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each part 32 counts by mask, of all rows and of labelled ones."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # rows of an id are summed before they meet its label
    rows = found.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    rows = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))
    cells = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(MASKS)))
    return rows.groupBy("part").agg(*(cells(c).alias(c) for c in ("n", "good", "toxic")))


def steps_of(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, list]:
    """All orders and steps of one part from its counts by mask."""
    mask = np.arange(MASKS)
    removed: dict[tuple[int, int], tuple[int, ...]] = {}
    for before in range(MASKS):
        for bit in BIT.values():
            if not before & bit:
                here = ((mask & before) == 0) & ((mask & bit) != 0)
                removed[before, bit] = tuple(int(c[here].sum()) for c in (n, good, toxic))
    k = len(FILTERS)
    # as many orders have exactly the filters of ``before`` in front of this one
    weight = {before: factorial(before.bit_count()) * factorial(k - 1 - before.bit_count()) for before in range(MASKS - 1)}
    shapley = {bit: sum(weight[before] * x[0] for (before, b), x in removed.items() if b == bit) for bit in BIT.values()}
    out: dict[str, list] = {c: [] for c in COLUMNS[1:]}
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = BIT[name]
            gone, good_lost, toxic_lost = removed[before, bit]
            kept = int(n[(mask & (before | bit)) == 0].sum())
            redundant = int(n[(mask & bit) != 0].sum()) - gone
            for c, x in zip(COLUMNS[1:], ("".join(order), step, kept, gone, redundant, int(n[bit]), good_lost, toxic_lost, shapley[bit]), strict=True):
                out[c].append(x)
            before |= bit
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS[3:])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(COLUMNS) - 3))
        for batch in batches:
            for part, *counts in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "good", "toxic")), strict=True):
                made = steps_of(*(np.array(c, np.int64) for c in counts))
                columns = [[part] * len(made["step"]), *made.values()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(COLUMNS))

    return counters(masks(docs), labels).mapInArrow(run, _SCHEMA)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SPACE = r"\x20\x09-\x0D"
OP13_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[{_SPACE}]+'), lambda x: x <> '') AS words FROM documents),
m AS (SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.name, b.name, d.name, e.name, g.name] AS names, [a.bit, b.bit, d.bit, e.bit, g.bit] AS bits FROM f a, f b, f d, f e, f g WHERE a.bit + b.bit + d.bit + e.bit + g.bit = 31 AND len(list_distinct([a.bit, b.bit, d.bit, e.bit, g.bit])) = 5),
s AS (SELECT array_to_string(names, '') AS filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
