"""The pipeline's stages, each on its own input, against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from provenir.llm import packing
from tests.llm.test_methods import WORD, brute_components, brute_fingerprint, brute_spans, brute_targets

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{path}/{i}")
        result = spark.read.parquet(f"{path}/{i}")
        out.append((docs.collect(), result))
        docs = result
    return out


def test_columns(stages):
    assert all(r.columns == list(pipeline.COLUMNS) for _, r in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    assert after.count() >= 0.99 * len(before)


def brute_shingles(text):
    words = text.encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    texts = {r["doc_id"]: r["text"] or "" for r in before}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    roots = brute_components(sorted(set(fps.values())))
    group = {i: roots[f] for i, f in fps.items()}
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if group[i] != group[j] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                old, new = group[i], group[j]
                group = {x: new if g == old else g for x, g in group.items()}
    least = {}
    for i in ids:
        least.setdefault(group[i], i)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(least.values())


def test_personal_data_is_gone(stages):
    before, after = stages[2]
    rows = {r["doc_id"]: r for r in after.collect()}
    assert len(rows) == len(before)
    for r in before:
        new = rows[r["doc_id"]]
        assert new["n_chars"] == len(new["text"])
        if not brute_spans(r["text"]) and "token = " not in r["text"]:
            assert new["text"] == r["text"]
        assert not brute_spans(new["text"])


def test_mixture_meets_its_targets(stages):
    before, after = stages[3]
    size = lambda t: len(WORD.findall(t or ""))
    sums, taken = Counter(), Counter()
    for r in before:
        sums[r["source"]] += size(r["text"])
    rows = after.collect()
    for r in rows:
        taken[r["source"]] += size(r["text"])
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
    largest = max(size(r["text"]) for r in before)
    assert all(abs(taken[s] - t) <= 2 * largest for s, t in brute_targets(sums).items())


def test_packing_holds_every_id(stages):
    before, after = stages[4]
    encode = packing.encoder()
    expected = Counter()
    for r in before:
        ids = np.array([*encode(r["text"] or ""), 1], "<u4")
        expected.update((r["doc_id"], s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.cuts(len(ids)))
    rows = after.collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    fill = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 2048 for r in fill)


def test_run_applies_all_stages(spark, small, empty):
    assert pipeline.run(spark, small).count() > 0
    assert pipeline.run(spark, empty).collect() == []


def test_stages_survive_odd_rows(spark, odd, clashing, small):
    for _, stage in pipeline.STAGES:
        assert stage(spark, clashing, small).count() == stage(spark, odd, small).count()


def test_rows_of_null_and_repeated_ids_stay(spark, small):
    """Different texts under a null id or under one id are rows of their own; equal texts are one."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None if k < 6 else 7 if k < 12 else k, text(k), "en", "ab"[k % 2], 1) for k in range(20)]
    again = [(None, text(0), "en", "a", 1), (7, text(7), "en", "b", 1), (3, text(1), "en", "b", 1)]
    docs = spark.createDataFrame(rows + again, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.keep_one_of_each(spark, docs, small).collect()
    expected = Counter((3 if k == 1 else i, t) for k, (i, t, *_) in enumerate(rows))
    assert Counter((r["doc_id"], r["text"]) for r in kept) == expected
    clean = spark.createDataFrame(rows, docs.schema)
    assert Counter((r["doc_id"], r["text"]) for r in pipeline.redact_personal_data(spark, clean, small).collect()) == Counter((i, t) for i, t, *_ in rows)
    mixed = Counter((r["doc_id"], r["text"]) for r in pipeline.mix_to_targets(spark, clean, small).collect())
    assert set(mixed) == {(i, t) for i, t, *_ in rows}
    taken = Counter()
    for r in rows:
        taken[r[3]] += 40 * mixed[r[:2]]
    assert all(abs(taken[s] - t) <= 80 for s, t in brute_targets(Counter({"a": 400, "b": 400})).items())
