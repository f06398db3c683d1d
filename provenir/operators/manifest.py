"""Manifests of file trees: differences, digests, import closure."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.identity import is_sha
from provenir.operators.coverage import reachable


def diff(measured: DataFrame, pinned: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed; equal files give no row. Both are (path, sha256)."""
    m, p = measured.select("path", F.col("sha256").alias("now")), pinned.select("path", F.col("sha256").alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return m.join(p, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def measure(tree: DataFrame, by: str | None = None) -> DataFrame:
    """Files, bytes and digest of each bundle (without ``by``: of the whole tree): sha256 over '<hash>  <path>' lines in order of path.

    tree is (bundle, path, sha256, length).  A digest needs its lines one after the other:
    Spark deals them by bundle and sorts them, and each task feeds its partition through
    the hash in batches, so a bundle of any size fits.  A null bundle is one of its own.
    """
    if by is None:
        return measure(tree.withColumn("bundle", F.lit("")), "bundle").drop("bundle")
    kind = tree.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        began, now, digest, files, size, kind_ = False, None, hashlib.sha256(), 0, 0, pa.null()
        for batch in batches:
            kind_ = batch.column(by).type
            for bundle, path, sha, length in zip(*(batch.column(c).to_pylist() for c in (by, "path", "sha256", "length")), strict=True):
                if not began or bundle != now:
                    if began:
                        done.append((now, files, size, digest.hexdigest()))
                    began, now, digest, files, size = True, bundle, hashlib.sha256(), 0, 0
                digest.update(f"{sha}  {path}\n".encode())
                files, size = files + 1, size + (length or 0)
        if began:
            done.append((now, files, size, digest.hexdigest()))
        if done:
            types = (kind_, pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], [by, "files", "bytes", "digest"])

    rows = tree.select(by, "path", "sha256", "length").repartition(by).sortWithinPartitions(by, "path", "sha256")
    return rows.mapInArrow(run, f"`{by}` {kind}, files long, bytes long, digest string")


#: How a module names another one, and what is built in.
SPECIFIER = r"""(?<![A-Za-z0-9_])from\s*"([^"]+)"|(?<![A-Za-z0-9_])import\s*\(\s*"([^"]+)"\s*\)"""
BUILT_IN = "node:"


def imports_of(sources: DataFrame) -> DataFrame:
    """(path, place, specifier) of every import of modules (path, text), in order; built-in ones aside."""
    found = F.transform(F.regexp_extract_all("text", F.lit(SPECIFIER), F.lit(0)), lambda m: F.regexp_extract(m, '"([^"]+)"', 1))
    rows = sources.select("path", F.posexplode(found).alias("place", "specifier"))
    return rows.filter(~F.startswith("specifier", F.lit(BUILT_IN)))


def import_target(path: Column, specifier: Column) -> Column:
    """The file, relative to the tree, that a relative specifier of a module names; it starts
    with ``..`` where it lies outside of the tree."""
    joined = F.concat(F.regexp_replace(path, "[^/]*$", ""), specifier)

    def step(acc: Column, part: Column) -> Column:
        inside = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        up = F.when(inside, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))
        return F.when(part == "..", up).when(part.isin(".", ""), acc).otherwise(F.concat(acc, F.array(part)))

    folded = F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")
    # a folder's name keeps its last slash, and names no file
    return F.when(joined.endswith("/") & (folded != ""), F.concat(folded, F.lit("/"))).otherwise(folded)


def import_failures(imports: DataFrame, tree: DataFrame) -> DataFrame:
    """(every column of imports, kind, target) of imports (path, specifier) that the tree (path) can't satisfy.

    ``bare``: not relative, so from outside of what is shipped; ``escaping``: relative, but
    outside of the tree, whether or not a file is there; ``unresolved``: inside, and no
    such file.  A bare import has no target.
    """
    target = F.when(F.startswith("specifier", F.lit(".")), import_target(F.col("path"), F.col("specifier")))
    rows = imports.withColumn("target", target)
    there = tree.select(F.col("path").alias("target")).distinct().withColumn("there_", F.lit(True))
    met = rows.join(there, "target", "left")
    kind = F.when(F.col("target").isNull(), "bare").when(F.startswith("target", F.lit("..")), "escaping").when(F.col("there_").isNull(), "unresolved")
    return met.withColumn("kind", kind).filter("kind is not null").select(*imports.columns, "kind", "target")


def import_closure(entries: DataFrame, imports: DataFrame) -> DataFrame:
    """(root, node): every file that each entry (root, node) needs, itself included, over imports
    (path, specifier) that stay inside the tree.  Modules that import each other are no obstacle."""
    inner = imports.filter(F.startswith("specifier", F.lit("."))).select(F.col("path").alias("child"), import_target(F.col("path"), F.col("specifier")).alias("parent"))
    return reachable(entries, inner.filter(~F.startswith("parent", F.lit(".."))))


def mentions(lines: DataFrame, needle: str) -> DataFrame:
    """Lines (path, line_no, line) that hold the needle: a pinned id must appear nowhere else."""
    return lines.filter(F.contains("line", F.lit(needle)))


def pinned_mentions(lines: DataFrame, pins: DataFrame, width: int = 7) -> DataFrame:
    """(every column of lines, sha) of each line (path, line_no, line) that holds the first
    ``width`` digits of a pinned sha (sha), for any number of pins at once.

    All stretches of that width in a line's hexadecimal runs are joined with the pins: an
    equi-join on short keys that carries no line, then one back to the lines that were hit.
    (path, line_no) tells lines apart; a pin that is no full sha is left out.
    """
    short = pins.filter(is_sha(F.col("sha"))).select("sha", F.left("sha", F.lit(width)).alias("key_")).distinct()
    runs = F.regexp_extract_all("line", F.lit(f"[0-9a-f]{{{width},}}"), F.lit(0))
    cuts = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (width - 1)), lambda i: F.substr(r, i, F.lit(width)))
    keys = lines.filter(F.col("line").rlike(f"[0-9a-f]{{{width}}}")).select("path", "line_no", F.explode(F.array_distinct(F.flatten(F.transform(runs, cuts)))).alias("key_"))
    met = keys.join(short, "key_").select("path", "line_no", "sha")
    return lines.join(met, ["path", "line_no"]).select(*lines.columns, "sha")


def drift(before: DataFrame, after: DataFrame, key: str = "bundle") -> DataFrame:
    """Whether content, commit and digest moved together, from (key, content, commit, digest):
    content must move with the digest and with the commit, neither alone."""
    b, a = before.alias("b"), after.alias("a")
    moved = {x: (~F.col(f"b.{x}").eqNullSafe(F.col(f"a.{x}"))).alias(f"{x}_moved") for x in ("content", "commit", "digest")}
    out = b.join(a, key).select(key, *moved.values())
    return out.withColumn("drifted", (F.col("content_moved") != F.col("digest_moved")) | (F.col("content_moved") != F.col("commit_moved")))
