"""Files read by position: ranges, spans, lines and the tail of files that grow."""

import io
import os

from hypothesis import given, settings
from hypothesis import strategies as st

from provenir.sources import byte_log


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200).map(lambda b: b.replace(b"z", b"\n")), st.integers(1, 40), st.integers(1, 9))
def test_ranges_give_each_line_once(data, size, block):
    """However a file is cut, its lines come once, with their places."""
    want, at = [], 0
    pieces = data.split(b"\n")
    for k, line in enumerate(pieces):
        if k < len(pieces) - 1 or line:
            want.append((at, line))
        at += len(line) + 1
    whole, byte_log.BLOCK = byte_log.BLOCK, block
    try:
        found = [x for r in byte_log.ranges("f", 0, len(data), size) for x in byte_log.lines_of(io.BytesIO(data), r)]
        ends = byte_log.last_newline(io.BytesIO(data), len(data))
    finally:
        byte_log.BLOCK = whole
    assert found == want
    assert ends == data.rfind(b"\n") + 1


def test_spans_beyond_two_gib_of_a_sparse_file(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    far = 3 << 30
    with open(path, "wb") as f:
        f.write(b"head")
        f.seek(far)
        f.write(b"0123456789")
    name = f"file://{path}"
    rows = [(1, name, 1, 3), (2, name, far - 2, far + 4), (3, name, far + 8, far + 99), (4, name, far + 99, far + 100), (5, name, None, 3), (6, name, 5, 2), (7, f"file://{tmp_path}/../{tmp_path.name}/big.jsonl", 0, 2)]
    spans = spark.createDataFrame(rows, "k long, path string, from_off long, to_off long")
    found = {r["k"]: r["body"] and bytes(r["body"]) for r in byte_log.read_spans(spark, str(tmp_path), spans).collect()}
    assert found == {1: b"ea", 2: b"\0\x000123", 3: b"89", 4: b"", 5: None, 6: b"", 7: None}


def test_many_spans_of_one_file_are_many_tasks(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(bytes(range(256)) * 400)
    rows = [(str(path), k * 7, k * 7 + k % 11) for k in range(5000)]
    spans = spark.createDataFrame(rows, "path string, from_off long, to_off long")
    data = path.read_bytes()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = byte_log.read_spans(spark, str(tmp_path), spans)
        assert df.rdd.getNumPartitions() > 1
        assert all(bytes(r["body"]) == data[r["from_off"] : r["to_off"]] for r in df.collect())
        sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert max(sizes) < 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_chunks_cover_every_byte(spark, tmp_path):
    for k, size in enumerate((0, 1, 999, 1000, 1001, 5000)):
        (tmp_path / f"f{k}.log").write_bytes(os.urandom(size))
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    (tmp_path / "other.txt").write_bytes(b"x")
    found = byte_log.byte_ranges(spark, f"file://{tmp_path}", "*.log", partition=700, chunk=300)
    held = {}
    for r in found.orderBy("path", "from_off").collect():
        before = held.get(r["path"], b"")
        assert r["from_off"] == len(before) and r["to_off"] - r["from_off"] == len(r["body"]) <= 300
        held[r["path"]] = before + bytes(r["body"])
    assert {k.rsplit("/", 1)[1]: v for k, v in held.items()} == {f"f{k}.log": (tmp_path / f"f{k}.log").read_bytes() for k in range(1, 6)}
    assert byte_log.byte_ranges(spark, f"{tmp_path}/none").count() == 0


def test_lines_are_numbered_over_partitions(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {k}\n" for k in range(500)) + "torn")
    (tmp_path / "b.log").write_text("\n\nx\n")
    rows = byte_log.numbered(byte_log.log_lines(spark, str(tmp_path), partition=97)).orderBy("path", "line_no").collect()
    a = [r for r in rows if r["path"].endswith("a.log")]
    assert [(r["line_no"], r["line"]) for r in a] == [(k, f"line {k}") for k in range(500)] + [(500, "torn")]
    assert [(r["line_no"], r["at"], r["line"]) for r in rows if r["path"].endswith("b.log")] == [(0, 0, ""), (1, 1, ""), (2, 2, "x")]
    assert len({r["split"] for r in a}) > 20


def test_tail_gives_each_complete_line_once(spark, tmp_path):
    """Growth, a torn last line, a stop and a new start, a file that shrinks, a new file, one that goes."""
    logs, out, place = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "progress")
    logs.mkdir()

    def run():
        lines = byte_log.log_lines(spark, str(logs), "*.log", partition=8, stream=True).select("path", "at", "line")
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"].rsplit("/", 1)[1], r["at"], r["line"]) for r in spark.read.schema("path string, at long, line string").parquet(out).collect())

    (logs / "a.log").write_bytes(b"one\ntwo\nthr")
    first = [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert run() == first
    assert run() == first
    with open(logs / "a.log", "ab") as f:
        f.write(b"ee\nfour")
    (logs / "b.log").write_bytes(b"x\n\xff\n")
    (logs / "b.txt").write_bytes(b"not a log\n")
    second = sorted([*first, ("a.log", 8, "three"), ("b.log", 0, "x"), ("b.log", 2, "�")])
    assert run() == second
    (logs / "a.log").write_bytes(b"new\n")
    (logs / "b.log").unlink()
    third = sorted([*second, ("a.log", 0, "new")])
    assert run() == third
    (logs / "b.log").write_bytes(b"y\n")
    assert run() == sorted([*third, ("b.log", 0, "y")])
