"""The contract module in a session that doesn't know the package's folder."""

import os
import subprocess
import sys

from tests.conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
for name in ("coverage_report", "ledger_stateful", "active_session_asof"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("FINE")
"""


def test_package_reaches_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "FINE" in done.stdout, done.stderr[-2000:]


def test_costly_rows_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    from provenir.plans import standins

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(standins, "TASK_ROWS", 50)
    rows = standins.spread(spark.read.parquet(str(tmp_path / "t")).coalesce(5))
    assert rows.rdd.getNumPartitions() == 20
    assert rows.count() == 1000
    few = spark.read.parquet(str(tmp_path / "t")).repartition(30)
    assert standins.spread(few).rdd.getNumPartitions() == 30
