"""Sessions that end by silence: timers, gaps once, late attempts, state that goes."""

import duckdb
import pytest

from provenir.operators.ledger import Stream
from provenir.plans.catalogue import ORACLE_SQL, QUERIES
from provenir.streaming import delivery

MINUTE = 60_000
DAY = 24 * 60 * MINUTE  # the first moment of all is behind any watermark
INF = (float("inf"),) * 3


def plain(rows, idle, watermark):
    """Ended sessions over plain lists; rows are (session, file, at_ms, attempt_id, eof, outcome)."""
    out = []
    for session in sorted({r[0] for r in rows}):
        files, seen, last, seq = {}, {}, None, 0

        def end(session=session):
            for name, eof in sorted(seen.items()):
                s = files[name]
                if name != "main" and eof > s.sent:
                    out.append((session, name, seq, eof, s.gap_bytes + eof - s.sent, s.gap_count + 1))
            files.clear()
            seen.clear()

        for _, file, at, _, eof, outcome in sorted((r for r in rows if r[0] == session), key=lambda r: (r[2], r[3])):
            if last is not None and at - last > idle:
                end()
                seq = 0
            s = files.setdefault(file, Stream())
            s.seq = seq
            s.apply(eof, outcome, at, "", INF)
            seq, seen[file], last = s.seq, eof, at
        if last + idle + 1 <= watermark:
            end()
    return sorted(out)


def stream(spark, tmp_path, batches, idle=30 * MINUTE):
    """Runs a batch of rows after the other from one checkpoint; rows of ended sessions and the states that are left."""
    path, out, place = (str(tmp_path / x) for x in ("in", "out", "progress"))
    left = None
    for k, rows in enumerate(batches):
        full = [(s, f, DAY + at, i, eof, o, "", False) for s, f, at, i, eof, o in rows]
        spark.createDataFrame(full, delivery.ATTEMPT).coalesce(1).write.parquet(f"{path}/{k}")
        attempts = spark.readStream.schema(delivery.ATTEMPT).parquet(f"{path}/*")
        with delivery.state_store(spark):
            q = delivery.timed_deliveries(attempts, idle, caps=INF).writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start()
            q.awaitTermination()
        left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    found = spark.read.schema(delivery.DELIVERY).parquet(out)
    ended = found.filter("result = 'session-ended'").select("session", "file", "seq", "sent", "gap_bytes", "gap_count")
    return sorted(tuple(r) for r in ended.collect()), found.filter("attempt_id is not null").count(), left


ROWS = [
    ("a", "main", 0, 1, 10, "later"),
    ("a", "agent-1", 1 * MINUTE, 2, 50, "later"),
    ("a", "agent-2", 2 * MINUTE, 3, 70, "ok"),
    ("a", "agent-1", 20 * MINUTE, 4, 90, "later"),
    ("b", "agent-1", 5 * MINUTE, 5, 30, "never"),
    ("b", "agent-1", 6 * MINUTE, 6, 40, "later"),
    ("b", "agent-1", 40 * MINUTE, 7, 60, "later"),  # behind 34 minutes of silence
    ("c", "agent-1", 200 * MINUTE, 8, 5, "later"),
]


@pytest.mark.parametrize("cut", [[8], [2, 5, 8], [1, 2, 3, 4, 5, 6, 7, 8]])
def test_silence_ends_a_session_once(spark, tmp_path, cut):
    rows = sorted(ROWS, key=lambda r: r[2])
    batches = [rows[a:b] for a, b in zip([0, *cut], cut, strict=False)]
    ended, attempts, left = stream(spark, tmp_path, batches)
    assert ended == plain(ROWS, 30 * MINUTE, 190 * MINUTE)
    assert ended == [("a", "agent-1", 4, 90, 90, 1), ("b", "agent-1", 1, 60, 60, 1), ("b", "agent-1", 2, 40, 40, 2)]
    assert attempts == len(ROWS)
    assert 0 < left <= 6  # only the session that is still alive, with its timer


def test_an_attempt_after_the_end_begins_anew(spark, tmp_path):
    first = [("a", "agent-1", 0, 1, 50, "later"), ("z", "main", 120 * MINUTE, 2, 1, "ok")]
    again = [("a", "agent-1", 121 * MINUTE, 3, 80, "later"), ("a", "agent-1", 10 * MINUTE, 4, 60, "later"), ("z", "main", 300 * MINUTE, 5, 2, "ok")]
    ended, attempts, _ = stream(spark, tmp_path, [first, again])
    # the second attempt of the past is older than the watermark and isn't seen
    assert ended == [("a", "agent-1", 1, 50, 50, 1), ("a", "agent-1", 1, 80, 80, 1)]
    assert attempts == 4


def test_events_of_one_millisecond_against_their_ids(spark, tmp_path):
    # each pair lies in one millisecond, the later event has the smaller id
    pairs = [("purchase", "view"), ("signup", "signup"), ("click", "view"), ("click", "click"), ("view", "signup"), ("signup", "view")]
    rows = [f"({100 + u}, '2024-01-01 00:00:00.000100', {u}, '{a}', 1.0), ({u}, '2024-01-01 00:00:00.000900', {u}, '{b}', 2.0)" for u, (a, b) in enumerate(pairs)]
    rows += [f"({200 + u}, '2024-01-01 00:00:01', {u}, 'click', 2.0)" for u in (0, 1, 5)]
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT id AS event_id, ts::TIMESTAMP AS ts, u::BIGINT AS user_id, kind AS event_type, v::DOUBLE AS value FROM (VALUES {', '.join(rows)}, (300, '2024-01-03', 99, 'view', 1.0)) t(id, ts, u, kind, v)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    found = QUERIES["idle_sessions"](spark, str(tmp_path))
    told = con.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL['idle_sessions']})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(told)
    assert len(told) >= 4
