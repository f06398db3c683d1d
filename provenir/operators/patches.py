"""Patch ids: what a change does to the lines of its files, wherever in them it does it.

Two revisions of a file are compared by lines (a shortest edit script in linear space); the
changed stretches are its hunks.  A hunk is hashed without any white space and without its
place, and a commit's id is the sum of its hunks' hashes, so that it depends neither on
line numbers nor on the order of hunks and files, and partial sums meet in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hash is summed as so many unsigned numbers of 64 bits, each modulo 2**64.
LANES = 4
_FIELDS = ("hunks", "removed", "added", *(f"lane{k}" for k in range(LANES)))


def _turning(a: Sequence[int], i0: int, i1: int, b: Sequence[int], j0: int, j1: int) -> tuple[int, int, int, int]:
    """A diagonal stretch (from, to) in the middle of a shortest script from (i0, j0) to (i1, j1).

    Two searches walk towards each other; ``far[k]`` is how far one came on diagonal k.
    """
    n, m = i1 - i0, j1 - j0
    delta = n - m
    size = n + m + 3
    far, back = [0] * size, [0] * size  # diagonals -(m + 1) .. n + 1, negative ones from the end
    seen_far, seen_back = set(), set()
    d = 0
    while True:
        for mine, theirs, met, own, forward in ((far, back, seen_back, seen_far, True), (back, far, seen_far, seen_back, False)):
            fresh = []
            for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
                down = k == -d or (k != d and k - 1 >= -m and mine[k - 1] < mine[k + 1]) or k - 1 < -m
                x = 0 if d == 0 else mine[k + 1] if down and k + 1 <= n else mine[k - 1] + 1
                y = x - k
                x0, y0 = x, y
                if forward:
                    while x < n and y < m and a[i0 + x] == b[j0 + y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[i1 - 1 - x] == b[j1 - 1 - y]:
                        x, y = x + 1, y + 1
                mine[k] = x
                fresh.append(k)
                if delta - k in met and x + theirs[delta - k] >= n:
                    if forward:
                        return i0 + x0, j0 + y0, i0 + x, j0 + y
                    return i1 - x, j1 - y, i1 - x0, j1 - y0
            own.clear()
            own.update(fresh)
        d += 1


def common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order."""
    code: dict = {}
    x = [code.setdefault(line, len(code)) for line in a]
    y = [code.setdefault(line, len(code)) for line in b]
    # a line that the other side lacks is in no common subsequence
    in_x, in_y = set(x), set(y)
    at_x, at_y = [i for i, v in enumerate(x) if v in in_y], [j for j, v in enumerate(y) if v in in_x]
    x, y = [x[i] for i in at_x], [y[j] for j in at_y]
    out, left = [], [(0, len(x), 0, len(y))]
    while left:
        i0, i1, j0, j1 = left.pop()
        while i0 < i1 and j0 < j1 and x[i0] == y[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and x[i1 - 1] == y[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 < i1 and j0 < j1:
            p, q, r, s = _turning(x, i0, i1, y, j0, j1)
            out += [(p + k, q + k) for k in range(r - p)]
            left += [(i0, p, j0, q), (r, i1, s, j1)]
    return [(at_x[i], at_y[j]) for i, j in sorted(out)]


def hunks(before: Sequence, after: Sequence) -> list[tuple[Sequence, Sequence]]:
    """(removed lines, added lines) of each changed stretch, in order."""
    out, i, j = [], 0, 0
    for p, q in [*common(before, after), (len(before), len(after))]:
        if p > i or q > j:
            out.append((before[i:p], after[j:q]))
        i, j = p + 1, q + 1
    return out


def hunk_hash(path: str, removed: Sequence[bytes], added: Sequence[bytes]) -> bytes:
    bare = lambda sign, lines: [sign + b"".join(line.split()) for line in lines]
    return hashlib.sha256(b"\n".join(["".join(path.split()).encode(), *bare(b"-", removed), *bare(b"+", added)])).digest()


def file_patch(path: str, before: bytes, after: bytes) -> tuple[int, ...]:
    """(hunks, removed, added, lanes..) of one file's change."""
    found = hunks(before.splitlines(), after.splitlines())
    lanes = [0] * LANES
    for removed, added in found:
        h = hunk_hash(path, removed, added)
        for k in range(LANES):
            lanes[k] += int.from_bytes(h[8 * k : 8 * k + 8], "big")
    return len(found), sum(len(r) for r, _ in found), sum(len(a) for _, a in found), *(x % 2**64 for x in lanes)


def with_patch(files: DataFrame) -> DataFrame:
    """(repo, sha, hunks, removed, added, lanes..) of each changed file (repo, sha, path, before, after).

    A null text is a file that isn't there: it is created or deleted as a whole.
    """
    kinds = {c: files.schema[c].dataType.simpleString() for c in ("repo", "sha")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "before", "after")), strict=True)
            made = [file_patch(path or "", before or b"", after or b"") for path, before, after in rows]
            columns = list(zip(*made, strict=True)) or [()] * len(_FIELDS)
            values = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array([str(x) for x in c], pa.string()) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays([batch.column("repo"), batch.column("sha"), *values], ["repo", "sha", *_FIELDS])

    rows = files.select("repo", "sha", "path", F.col("before").cast("binary").alias("before"), F.col("after").cast("binary").alias("after"))
    out = rows.mapInArrow(run, f"repo {kinds['repo']}, sha {kinds['sha']}, hunks long, removed long, added long, " + ", ".join(f"lane{k} string" for k in range(LANES)))
    return out.withColumns({f"lane{k}": F.col(f"lane{k}").cast("decimal(20,0)") for k in range(LANES)})


def patch_ids(files: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(repo, sha, patch_id, hunks, removed, added) of every commit with changed files.

    files is (repo, sha, path, before, after), merges (repo, sha).  A merge and a commit
    that changes no line have a null id: they match nothing.  Only sums meet by commit, as
    partial aggregates, so a commit of any size spreads over its files.
    """
    sums = [F.sum(f"lane{k}").alias(f"lane{k}") for k in range(LANES)]
    found = with_patch(files).groupBy("repo", "sha").agg(*(F.sum(c).alias(c) for c in ("hunks", "removed", "added")), *sums)
    told = F.col("hunks") > 0
    if merges is not None:
        found = found.join(merges.select("repo", "sha").distinct().withColumn("merge_", F.lit(True)), ["repo", "sha"], "left")
        told = told & F.col("merge_").isNull()
    return found.select("repo", "sha", F.when(told, F.concat(*(_hex(F.col(f"lane{k}")) for k in range(LANES)))).alias("patch_id"), "hunks", "removed", "added")


def _hex(lane: Column) -> Column:
    """16 digits of a sum modulo 2**64."""
    # decimals hold the sums of 10**18 hashes
    rest = F.pmod(lane, F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")
    half = F.lit(str(2**32)).cast("decimal(20,0)")
    part = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 8, "0")
    return F.concat(part(F.floor(rest / half)), part(F.pmod(rest, half)))
