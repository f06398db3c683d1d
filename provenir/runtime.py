"""Session helpers shared by every subpackage: lineage cuts and small-table checks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_open_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (tests on
    a local master) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='provenir-')}"
    context.setCheckpointDir(made)
    return made


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage at a point that outlives any executor; unlike a serialized RDD
    checkpoint the columns stay prunable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _open_scratch:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialize`` writes inside the block, once the block has written its result.

    The result is taken out of the block by ``keep``: nothing else that was made inside may
    be read afterwards.
    """
    made: list[str] = []
    _open_scratch.append(made)
    try:
        yield
    finally:
        _open_scratch.remove(made)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for the result of a ``scratch`` block, which stays."""
    held = _open_scratch.pop() if _open_scratch else None
    try:
        return materialize(df, name)
    finally:
        if held is not None:
            _open_scratch.append(held)
