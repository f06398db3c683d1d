"""One row a key under redelivery, crashes and restarts."""

import numpy as np
import pytest

from provenir.streaming import keyed_log as k


def test_filters_hold_their_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        keys = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
        hashes, bits = k.bloom(keys)
        assert k.answers(keys, hashes, bits).all()
        others = rng.integers(-(2**63), 2**63, 200_000, dtype=np.int64)
        assert k.answers(others, hashes, bits).sum() <= 3
        assert len(bits) <= max(k.LEAST / 8, 29 * n / 8 + 1)


SCHEMA = "repo string, session string, file string, offset long, body string"


def batches(n=4, per=300):
    return [[("r", f"s{i % 7}", None if i % 11 == 0 else f"f{i % 3}", i, f"b{b}") for i in range(b * per - (per // 3 if b else 0), (b + 1) * per)] for b in range(n)]


def read(spark, path):
    rows = spark.read.schema(SCHEMA).parquet(path).collect()
    return sorted(((r["repo"], r["session"], r["file"] or "", r["offset"]), r["body"]) for r in rows)


def wanted(all_batches):
    out = {}
    for rows in all_batches:
        for *key, body in rows:
            out.setdefault(tuple(x if x is not None else "" for x in key), body)
    return sorted(out.items())


KEY = ["repo", "session", "file", "offset"]


def test_redelivered_rows_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/sent"
    write = k.keyed_log(path, KEY, 4)
    for i, rows in enumerate(batches()):
        write(spark.createDataFrame(rows + rows[:50], SCHEMA), i)
    assert read(spark, path) == wanted(batches())
    write(spark.createDataFrame(batches()[1], SCHEMA), 1)  # the same batch once more
    write(spark.createDataFrame(batches()[0], SCHEMA), 9)  # the same rows as another batch
    assert read(spark, path) == wanted(batches())
    assert not [p for p in (tmp_path / "sent").glob("_staged/*")]


@pytest.mark.parametrize("at", ["before", "between"])
def test_a_crash_leaves_one_row_a_key(spark, tmp_path, monkeypatch, at):
    path = f"file://{tmp_path}/sent"
    write = k.keyed_log(path, KEY, 4)
    first, second, *_ = batches()
    write(spark.createDataFrame(first, SCHEMA), 0)
    real = k.commit

    def crash(store, made, place):
        if at == "between":
            store.remove(place)
        raise RuntimeError("lost")

    monkeypatch.setattr(k, "commit", crash)
    with pytest.raises(RuntimeError):
        write(spark.createDataFrame(second, SCHEMA), 1)
    assert read(spark, path) == wanted([first])  # nothing of the batch is seen
    monkeypatch.setattr(k, "commit", real)
    write(spark.createDataFrame(second, SCHEMA), 1)
    assert read(spark, path) == wanted([first, second])


def test_only_batches_that_answer_are_asked(spark):
    keys = [np.arange(b * 1000, b * 1000 + 1000) for b in range(5)]
    blooms = [(b, 0, *k.bloom(x)) for b, x in enumerate(keys)]
    held = spark.createDataFrame(blooms, "batch long, shard int, hashes int, bits binary")
    own = spark.createDataFrame([(h, 0) for h in [5, 3001, *range(900_000, 901_000)]], "hash long, shard int")
    assert sorted(tuple(r) for r in k.suspects(own, held).collect()) == [(5, 0), (3001, 3)]


def test_stream_into_the_log(spark, tmp_path):
    path, place = f"file://{tmp_path}/sent", str(tmp_path / "progress")
    for i, rows in enumerate(batches(3)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        stream.writeStream.foreachBatch(k.keyed_log(path, KEY, 2)).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    assert read(spark, path) == wanted(batches(3))
