"""op10 makes a text's words, shapes and counts once; the verdicts read what was written."""

from provenir.llm import rules


def test_verdicts_read_no_text(spark, sf, monkeypatch):
    made = []

    def watched(df, name):
        made.append(df.columns)
        return write(df, name)

    write = rules.materialize
    monkeypatch.setattr(rules, "materialize", watched)
    found = rules.op10_rules(spark, sf)
    assert len(made) == 1 and {"shapes_", "pairs_", "n_repeat_words"} <= set(made[0]) and "text" not in made[0]
    assert "documents.parquet" not in found._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ids = rules.trusted_ids(spark.read.parquet(f"{sf}/labels.parquet"))
    whole = rules.judge(docs, rules.log_ratios(docs, ids)).select(*found.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
