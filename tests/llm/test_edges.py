"""Every query over odd, empty and widened tables."""

import duckdb
import pytest

from provenir.llm import queries

QUERIES = {name: run for name, run in queries.QUERIES.items() if name.startswith("op")}
TABLE = {"op3_urls": "pages"}


def test_all_queries_are_registered():
    """What the entry module leaves out where it can't be imported is there in this repository."""
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_base_columns_equal_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = ", ".join(sorted(df.columns))
    found = duck.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect()) == sorted(map(str, found))
    assert len(found) > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, small, name):
    rows = QUERIES[name](spark, small).collect()
    if name == "op13_audit":
        assert len(rows) == 600 * 5  # sources a to d, and none
    elif name != "op7_packing":
        assert len(rows) == spark.read.parquet(f"{small}/{TABLE.get(name, 'documents')}.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_clashing_columns(spark, tmp_path, small, clashing, clashing_pages, name):
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    clashing_pages.write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    # the weights of op6 depend on the files' layout
    columns = [c for c in QUERIES[name](spark, small).columns if (name, c) != ("op6_maxent", "score")]
    rows = [sorted(map(str, QUERIES[name](spark, path).select(columns).collect())) for path in (small, str(tmp_path))]
    if name == "op7_packing":  # nor are windows the same in another layout
        rows = [sorted(x.split(", sequence_id")[0] for x in r) for r in rows]
    assert rows[0] == rows[1]


def test_values_on_odd_rows(spark, small, odd):
    """Defined results: null, empty and letterless texts, null ids, repeated rows."""
    found = {name: QUERIES[name](spark, small).collect() for name in ("op1_language", "op5_quality", "op6_maxent", "op8_pii", "op10_rules", "op11_manifest", "op12_minhash")}
    of = lambda name, i: [r for r in found[name] if r["doc_id"] == i]
    assert all(of("op1_language", i)[0]["lang_pred"] == "und" and of("op1_language", i)[0]["score"] == 0 for i in (3, 4, 5, 11))
    for name in found:
        first, second = of(name, 2)
        assert (first == second or name == "op11_manifest") and len(of(name, None)) == 1  # a manifest's leaves have places
    assert of("op5_quality", 3)[0]["score"] == of("op5_quality", 4)[0]["score"]
    assert [of("op6_maxent", i)[0]["n_tokens"] for i in (3, 4, 5, 1)] == [1, 1, 1, 13]
    assert of("op6_maxent", 3)[0]["score"] == of("op6_maxent", 4)[0]["score"]
    assert of("op8_pii", 3)[0]["spans"] == "" and of("op8_pii", None)[0]["spans"].startswith("email:11:30,phone:34:")
    assert all(r["verified"] is not None and len(r["proof_sha256"]) == 64 for r in found["op11_manifest"]) and len({r["root"] for r in found["op11_manifest"]}) == 1
    assert [(of("op12_minhash", i)[0]["n_shingles"], of("op12_minhash", i)[0]["component_id"], of("op12_minhash", i)[0]["kept"]) for i in (1, 2, 3, 4, 9)] == [(8, 1, True), (8, 1, False), (0, 3, True), (0, 4, True), (1, 9, True)]
    assert all(of("op10_rules", i)[0]["base_failed"] and not of("op10_rules", i)[0]["kept"] for i in (3, 4, 5, 8, 9))
