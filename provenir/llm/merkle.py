"""Merkle manifest of a dataset: a leaf a row, a tree a language, a tree over the languages.

A leaf is the hash of a row's fields, a node the hash of a run of at most two nodes.  The
tree is reduced in large blocks: rows are ranked within their group by a range sort, every
2**k neighbours form a block, and a task reduces a block and notes for each of its rows the
siblings on the way up.  What remains, one node a block, is the small top tree: the driver
builds it and broadcasts each block's suffix path; executors append it, hash the proofs and
fold every row.  k follows the row count, so that the top tree has at most ``2 * TOP``
nodes however large the table is; groups of one block never reach the driver.  The tree
over the groups' roots is made the same way, so their number has no bound either.

Defined cases: null fields are ``-``; a null id comes first in its language and is never
tampered with; rows of equal id are ordered by their leaf, so that equal rows can't be told
apart; an empty table gives no row; texts of any length are hashed whole; the null language
is a group of its own, apart from the empty one.  Further columns of the input, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from provenir.llm.common import table
from provenir.runtime import materialize

#: Blocks that the top tree takes at most (times two), least rows of a block as a power of two.
TOP, BITS = 65_536, 12
TAMPERED = 7
#: How a path says where a step's sibling is: there is none, before the node, behind it.
ALONE, BEFORE, BEHIND = b"\x00", b"\x01", b"\x02"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Hash of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon, the value."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def tree(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """Levels from the leaves up to one node, or ``height`` levels above the leaves."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([digest("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def paths(levels: list[list[str]]) -> list[bytes]:
    """The siblings of every leaf from its level up to below the last one."""
    above = [b""] * len(levels[-1])
    for nodes in reversed(levels[:-1]):
        step = []
        for i in range(len(nodes)):
            sibling = i ^ 1
            if sibling < len(nodes):
                step.append((BEFORE if i & 1 else BEHIND) + bytes.fromhex(nodes[sibling]) + above[i >> 1])
            else:
                step.append(ALONE + above[i >> 1])
        above = step
    return above


def steps(path: bytes) -> Iterator[tuple[bytes, str]]:
    at = 0
    while at < len(path):
        side, at = path[at : at + 1], at + 1
        if side == ALONE:
            yield side, ""
        else:
            yield side, path[at : at + 32].hex()
            at += 32


def folded(node: str, path: bytes) -> str:
    """The root that a leaf and its siblings give."""
    for side, sibling in steps(path):
        node = digest(sibling + node if side == BEFORE else node + sibling)
    return node


def proof(path: bytes) -> str:
    """Hash of the siblings in order."""
    return digest("".join(sibling for _, sibling in steps(path)))


def block_bits(rows: int, top: int = TOP, least: int = BITS) -> int:
    return max(least, (max(rows - 1, 0) // top).bit_length())


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank`` and ``total`` within each group (columns that are never null).

    ``salt_`` spreads equal rows over ranges; equal rows may take each other's places.
    """
    keys = [*group, *order]
    # the number of a sorted row: its range above bit 33, its place within the range below
    placed = rows.repartitionByRange(*keys, "salt_").sortWithinPartitions(*keys).drop("salt_").withColumn("at_", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("range_", F.shiftright("at_", 33)), "placed")
    starts = placed.groupBy("range_", *group).agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    each = Window.partitionBy(*group)  # a row for each range that a group lies in
    before = F.coalesce(F.sum("n_").over(each.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(starts.withColumns({"before_": before, "total": F.sum("n_").over(each)}), "starts")
    met = placed.join(starts.drop("n_"), ["range_", *group])
    return met.withColumn("rank", F.col("at_") - F.col("first_") + F.col("before_")).drop("range_", "at_", "first_", "before_")


def rooted(rows: DataFrame, group: list[str], order: list[str], node: str, top: int = TOP, least: int = BITS) -> DataFrame:
    """Adds ``path`` and ``root`` of each group's tree over ``node``, and ``rank``.

    Rows are reduced in blocks; the driver sees one node of each block of the groups that
    have several, at most ``2 * top`` of them.
    """
    bits = block_bits(rows.count(), top, least)
    size = 1 << bits
    dealt = ranked(rows, group, order).withColumn("block_", F.shiftright("rank", bits))
    schema = T.StructType([*dealt.schema.fields, T.StructField("path", T.BinaryType()), T.StructField("root", T.StringType())])

    def reduce(part: pa.Table) -> pa.Table:
        part = part.sort_by("rank")
        alone = part.column("total")[0].as_py() <= size
        levels = tree(part.column(node).to_pylist(), None if alone else bits)
        way = pa.chunked_array([pa.array(paths(levels), pa.binary())])
        return part.append_column("path", way).append_column("root", pa.chunked_array([pa.array([levels[-1][0]] * len(part), pa.string())]))

    blocks = materialize(dealt.groupBy(*group, "block_").applyInArrow(reduce, schema), "blocks")
    tops = blocks.filter((F.col("total") > size) & (F.col("rank") % size == 0)).select(*group, "block_", "root")
    found: dict[tuple, list[tuple[int, str]]] = defaultdict(list)
    for *key, block, root in tops.collect():
        found[tuple(key)].append((block, root))
    crown = {}
    for key, nodes in found.items():
        levels = tree([root for _, root in sorted(nodes)])
        for block, suffix in enumerate(paths(levels)):
            crown[*key, block] = suffix, levels[-1][0]
    shared = rows.sparkSession.sparkContext.broadcast(crown)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in (*group, "block_")), strict=True)
            above = [shared.value.get(k) for k in keys]
            if any(above):
                way, root = (batch.column(c).to_pylist() for c in ("path", "root"))
                batch = batch.set_column(batch.schema.get_field_index("path"), "path", pa.array([w + a[0] if a else w for w, a in zip(way, above, strict=True)], pa.binary()))
                batch = batch.set_column(batch.schema.get_field_index("root"), "root", pa.array([a[1] if a else r for r, a in zip(root, above, strict=True)], pa.string()))
            yield batch

    return blocks.mapInArrow(finish, schema).drop("block_", "total")


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, told, lang, leaf, tampered, salt_): lang empty where ``told`` is false, tampered
    the leaf that the tampered row has, null where nothing changes."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    wrong = [*fields[:3], (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)"), fields[4]]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    return docs.select("doc_id", F.col("lang").isNotNull().alias("told"), F.coalesce("lang", F.lit("")).alias("lang"), leaf(*fields).alias("leaf"), F.when(hit, leaf(*wrong)).alias("tampered"), F.xxhash64(F.monotonically_increasing_id()).alias("salt_"))


def manifest(docs: DataFrame, top: int = TOP, least: int = BITS) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified) for every row."""
    lang = ["told", "lang"]
    rows = materialize(leaves(docs), "leaves")
    own = rooted(rows, lang, ["doc_id", "leaf"], "leaf", top, least).withColumnRenamed("root", "subroot")
    roots = own.filter("rank = 0").select(*lang, "subroot", F.lit(0).alias("all_"), F.lit(0).alias("salt_"))
    roots = rooted(materialize(roots, "subroots"), ["all_"], lang, "subroot", top, least).select(*lang, "root", F.col("path").alias("rest"))
    roots = materialize(roots, "roots")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other, path, rest = (batch.column(c).to_pylist() for c in ("leaf", "tampered", "path", "rest"))
            ways = [p + r for p, r in zip(path, rest, strict=True)]
            ends = [folded(b or a, way) for a, b, way in zip(one, other, ways, strict=True)]
            out = [*(batch.column(c) for c in ("doc_id", "told", "lang", "leaf", "subroot", "root")), pa.array(map(proof, ways), pa.string()), pa.array(ends, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "told", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    # languages have no bound, so Spark chooses by the written sizes whether to broadcast them
    met = own.select("doc_id", *lang, "leaf", "tampered", "path", "subroot").join(roots, lang)
    out = met.select("doc_id", *lang, "leaf", "tampered", "path", "subroot", "root", "rest")
    out = out.mapInArrow(fold, "doc_id long, told boolean, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.select("doc_id", F.when(F.col("told"), F.col("lang")).alias("lang"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
#: crc32 of a decimal number, bit by bit.
_CRC = """list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT)), lambda crc, byte:
  xor(list_reduce(range(8), lambda c, i: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte) % 256), crc // 256), 4294967295)"""
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(n_chars + 1)")} AS wrong, xor({_CRC}, 4294967295) % 7 = 0 AS hit FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
t(lang, level, i, node, n) AS (
  SELECT lang, 0, rank, leaf, count(*) OVER (PARTITION BY lang) FROM r
  UNION ALL
  SELECT lang, any_value(level) + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY lang, i // 2),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM t WHERE n = 1),
u(level, i, node, n) AS (
  SELECT 0, rank, subroot, count(*) OVER () FROM s
  UNION ALL
  SELECT any_value(level) + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY i // 2),
own AS (
  SELECT r.lang, r.rank, list(CASE WHEN x.node IS NULL THEN '0' WHEN x.i < t.i THEN '1' || x.node ELSE '2' || x.node END ORDER BY t.level) AS way
  FROM r JOIN t ON t.lang IS NOT DISTINCT FROM r.lang AND t.n > 1 AND t.i = r.rank // CAST(2 ** t.level AS BIGINT)
  LEFT JOIN t x ON x.lang IS NOT DISTINCT FROM t.lang AND x.level = t.level AND x.i = xor(t.i, 1) GROUP BY r.lang, r.rank),
high AS (
  SELECT s.lang, list(CASE WHEN x.node IS NULL THEN '0' WHEN x.i < u.i THEN '1' || x.node ELSE '2' || x.node END ORDER BY u.level) AS way
  FROM s JOIN u ON u.n > 1 AND u.i = s.rank // CAST(2 ** u.level AS BIGINT) LEFT JOIN u x ON x.level = u.level AND x.i = xor(u.i, 1) GROUP BY s.lang),
w AS (
  SELECT r.*, s.subroot, (SELECT node FROM u WHERE n = 1) AS root, list_concat(coalesce(own.way, []), coalesce(high.way, [])) AS way
  FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang LEFT JOIN own ON own.lang IS NOT DISTINCT FROM r.lang AND own.rank = r.rank LEFT JOIN high ON high.lang IS NOT DISTINCT FROM r.lang),
f AS (
  SELECT doc_id, lang, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: substr(x, 2)), '')) AS proof_sha256,
    list_reduce(way, lambda a, x: CASE x[1] WHEN '1' THEN sha256(substr(x, 2) || a) WHEN '2' THEN sha256(a || substr(x, 2)) ELSE sha256(a) END, CASE WHEN hit AND n_chars IS NOT NULL THEN wrong ELSE leaf END) AS folded_root FROM w)
SELECT *, folded_root = root AS verified FROM f"""
