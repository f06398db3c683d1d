"""What grows with the documents is never broadcast: the driver would have to hold it."""

import pytest

from provenir.llm import components, mixing, oddsketch, resemblance, simhash

MODULES = {"simhash": (simhash, "doc_id"), "resemblance": (resemblance, "doc_id"), "oddsketch": (oddsketch, "doc_id"), "mixing": (mixing, "doc_id")}
RUN = {"simhash": simhash.near_duplicates, "resemblance": resemblance.similar, "oddsketch": oddsketch.near_duplicates, "mixing": mixing.mix_sources}
#: One row a source or stratum of 4,096 rows.
SMALL = {"mixing": 1}


@pytest.mark.parametrize("name", MODULES)
def test_no_broadcast_joins_by_size(spark, sf, monkeypatch, name):
    plans = []

    def watched(make):
        def run(df, *rest):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return make(df, *rest)

        return run

    for module in (MODULES[name][0], components):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", watched(module.materialize))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    found = RUN[name](docs, MODULES[name][1])
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 0
    assert sum(p.count("BroadcastHashJoin") for p in plans) <= SMALL.get(name, 0)
