"""Redaction inside JSON records: paths outside a tree go, every other byte stays.

A record's bytes are read from left to right as JSON escapes, URLs, relative paths and
words, and absolute paths; only the last are judged.  A path outside of the root is replaced
by a marker of the same number of bytes, which holds no sign that JSON escapes: the record
stays valid and every offset in it stays what it was.

Which spans count as paths is our own rule: they begin with a slash (or a drive letter),
written plainly or as an escape, where no word or slash stands right before, and go on over
letters, digits, ``. _ - + @ ~ %``, bytes beyond ASCII, escaped letters and slashes.  A path
is inside if it is the root or lies below it without a step up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from provenir.runtime import small_batches

#: Records in one Arrow batch: whole texts, their bytes and their redacted bytes are held at once.
BATCH = 256

_SLASH = rb"(?:\\?/|\\u002[fF])"
_BACK = rb"(?:\\\\|\\u005[cC])"
_SIGN = rb"(?:[A-Za-z0-9._+@~%\x80-\xff-]|\\u(?!002[fF]|005[cC]|00[01]|0020|0022|007[fF])[0-9a-fA-F]{4})"
_TOKENS = re.compile(
    rb"(?P<url>[A-Za-z][A-Za-z0-9+.-]*:" + _SLASH + _SLASH + rb"(?:" + _SIGN + rb"|" + _SLASH + rb"|[?#=&:])*)"
    rb"|(?P<path>[A-Za-z]:(?:(?:" + _BACK + rb"|" + _SLASH + rb")" + _SIGN + rb"*)+"
    rb"|" + _SLASH + _SIGN + rb"+(?:" + _SLASH + _SIGN + rb"*)*)"
    rb"|(?P<word>" + _SIGN + rb"+(?:" + _SLASH + _SIGN + rb"*)*|" + _SLASH + rb"+)"
    rb"|(?P<escape>\\(?:u[0-9a-fA-F]{4}|.))",
    re.DOTALL,
)


def marker(size: int) -> bytes:
    """What stands for so many withheld bytes, shortened where it doesn't fit."""
    long, short = b"[OUT-OF-TREE: %d bytes withheld" % size, b"[OUT-OF-TREE]"
    if size > len(long):
        return long + b"." * (size - len(long) - 1) + b"]"
    return short + b"." * (size - len(short)) if size >= len(short) else b"." * size


def is_outside(path: str, root: str) -> bool:
    parts = path.replace("\\", "/").split("/")
    root = root.rstrip("/")
    return ".." in parts or not (path == root or path.startswith(root + "/"))


def redacted(raw: bytes, root: str) -> tuple[bytes, int]:
    """(the record with paths outside of the root replaced, how many bytes went): as long as before."""
    gone = 0

    def step(m: re.Match) -> bytes:
        nonlocal gone
        span = m.group()
        if m.lastgroup != "path":
            return span
        end = len(span)
        while end > 1 and span[end - 1 : end] in (b".", b"%"):  # what ends a sentence belongs to no path
            end -= 1
        try:
            path = json.loads(b'"' + span[:end] + b'"')
        except ValueError:  # bytes that are no UTF-8 are compared as they stand
            path = span[:end].decode("latin-1").replace("\\/", "/")
        if not is_outside(path, root):
            return span
        gone += end
        return marker(end) + span[end:]

    return _TOKENS.sub(step, raw), gone


def redact_records(records: DataFrame, column: str, root: str) -> DataFrame:
    """``records`` with every JSON text in ``column`` redacted and ``withheld``, the bytes that went.

    ``root`` names a column with the tree's absolute path.  A null record stays null; a null
    root leaves nothing inside.  A worker holds ``BATCH`` records at a time, however many a
    task has.
    """
    small_batches(records.sparkSession, BATCH)
    schema = T.StructType([*records.schema.fields, T.StructField("withheld", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = batch.column(column).cast(pa.binary()).to_pylist()
            made = [(None, 0) if t is None else redacted(t, r or "\0") for t, r in zip(texts, batch.column(root).to_pylist(), strict=True)]
            field = batch.schema.field(at)
            batch = batch.set_column(at, field, pa.array([t for t, _ in made], pa.binary()).cast(field.type))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for _, n in made], pa.int64())], schema.names)

    return records.mapInArrow(run, schema)

