from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenir.operators import ledger
from provenir.operators.ledger import Stream
from provenir.streaming import delivery


def model(rows, caps):
    """The delivery rules once more, over plain dictionaries of held bytes."""
    sent, held, gaps, count, last, stop, seq = 0, [], 0, 0, 0, None, 0
    for eof, outcome, now, print_ in rows:
        if stop is not None and stop == print_:
            continue
        start = sent if sent <= eof else 0
        if eof <= start:
            continue
        seq += 1
        if outcome == "ok":
            sent, held, last = eof, [], now
        elif outcome == "never":
            gaps, count, sent, held = gaps + eof - start, count + 1, eof, []
        else:
            if start != sent:
                sent, held = start, []
            edge = held[-1][1] if held else sent
            if eof > edge:
                held = [*held, (edge, eof, now)]
            while held and (held[-1][1] - held[0][0] > caps[0] or now - held[0][2] > caps[1] or len(held) > caps[2]):
                first, held = held[0], held[1:]
                sent, gaps, count = first[1], gaps + first[1] - first[0], count + 1
            if outcome == "fatal":
                stop = print_
    return seq, sent, held, gaps, count, last, stop


steps = st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["ok", "later", "never", "fatal"]), st.integers(0, 9), st.sampled_from(["a", "b"])), max_size=25)


@given(steps, st.tuples(st.integers(1, 40), st.integers(1, 30), st.integers(1, 4)))
@settings(max_examples=300, deadline=None)
def test_fold_equals_the_model(rows, caps):
    now, timed = 0, []
    for eof, outcome, wait, p in rows:
        now += wait
        timed.append((eof, outcome, now, p))
    s = Stream()
    for eof, outcome, at, p in timed:
        s.apply(eof, outcome, at, p, caps)
    assert (s.seq, s.sent, s.backlog, s.gap_bytes, s.gap_count, s.last_sent_at, s.stopped) == model(timed, caps)


def test_traces():
    s = Stream(sent=0)
    s.apply(10, "ok", 0)
    assert (s.sent, s.backlog) == (10, [])
    s.apply(30, "later", 1)
    s.apply(30, "later", 2)
    assert s.backlog == [(10, 30, 1)]
    s.apply(50, "later", 3)
    assert s.backlog == [(10, 30, 1), (30, 50, 3)]
    s.apply(50, "ok", 4)
    assert (s.sent, s.backlog, s.gap_bytes, s.last_sent_at) == (50, [], 0, 4)
    s.apply(20, "later", 5)
    assert (s.sent, s.backlog) == (0, [(0, 20, 5)])
    day = 24 * 3600 * 1000
    s.apply(21, "later", 5 + day)
    assert s.gap_count == 0
    s.apply(22, "later", 6 + day)
    assert (s.gap_count, s.gap_bytes, s.sent) == (1, 20, 20)


def attempts(spark, rows):
    return spark.createDataFrame(rows, delivery.ATTEMPT)


def test_batch_and_stream_agree(spark, tmp_path):
    rows, eof = [], {}
    for i in range(200):
        s, f = f"s{i % 3}", ("main", "agent-1")[i % 2]
        eof[s, f] = eof.get((s, f), 0) + i % 7 + 1
        rows.append((s, f, 1000 * i, i, eof[s, f], ("ok", "later", "never", "later")[i * 7 % 4], "p", i >= 197))
    frame = attempts(spark, rows)
    batch = sorted(map(tuple, delivery.deliveries(frame).collect()))
    for k in range(2):
        frame.filter(F.col("attempt_id").between(100 * k, 100 * k + 99)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        sink = delivery.idempotent_sink(f"{tmp_path}/out", ["session", "attempt_id"])
        q = delivery.deliveries(stream).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, found.select(*[c for c in delivery.deliveries(frame).columns]).collect())) == batch
    seqs = found.filter("result not in ('stopped', 'nothing-to-send')").groupBy("session").agg(F.count("*").alias("n"), F.max("seq").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in seqs)


def test_last_event_stamps_sub_agents_only(spark):
    rows = [("s", "main", 1, 1, 10, "later", "p", True), ("s", "agent-1", 2, 2, 10, "later", "p", True)]
    found = {r["file"]: r for r in delivery.deliveries(attempts(spark, rows)).collect()}
    assert (found["main"]["gap_bytes"], found["main"]["backlog_entries"]) == (0, 1)
    assert (found["agent-1"]["gap_bytes"], found["agent-1"]["backlog_entries"]) == (10, 0)


def test_pending_filter_comes_before_the_cap(spark):
    files = spark.createDataFrame([("s", f"agent-{i:02d}", i, 10) for i in range(20)], "session string, file string, mtime long, size long")
    sent = spark.createDataFrame([("s", f"agent-{i:02d}", 10) for i in range(8)], "session string, file string, sent long")
    found = sorted(r["file"] for r in ledger.pending_files(files, sent).collect())
    assert found == [f"agent-{i:02d}" for i in range(8, 16)]


def test_notices_and_sessions_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:10:00"), (3, "b", "2024-01-01 00:20:00")], "id int, key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/e")
    q = delivery.notices_once(stream, ["key"]).writeStream.format("memory").queryName("notices").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["key"] for r in spark.table("notices").collect()) == ["a", "b"]
    assert sorted((r["key"], r["n"]) for r in delivery.live_sessions(rows).collect()) == [("a", 2), ("b", 1)]


@given(steps, st.tuples(st.integers(1, 40), st.integers(1, 30), st.integers(1, 4)), st.integers(1, 9))
@settings(max_examples=600, deadline=None)
def test_runs_folded_ahead_compose_to_the_plain_fold(rows, caps, run):
    """Whatever is claimed of a run, a composition that passes its checks is the fold."""
    now, timed = 0, []
    for eof, outcome, wait, p in rows:
        now += wait
        timed.append((eof, outcome, now, p))
    runs = []
    for eof, outcome, at, p in timed:
        if not runs or runs[-1][0] != p or len(runs[-1][1]) >= run:
            runs.append((p, []))
        runs[-1][1].append((at, eof, outcome))
    s, sound = Stream(), True
    for p, held in runs:
        first, *rest = ledger.summary(held, p, caps)
        sound = sound and ledger.compose(s, p, first, tuple(rest), caps)
    if sound:
        assert (s.seq, s.sent, s.backlog, s.gap_bytes, s.gap_count, s.last_sent_at, s.stopped) == model(timed, caps)


def hot(spark, n):
    """One busy key beside small ones; its file grows, shrinks now and then, and is stopped at times."""
    i = F.col("id")
    draw = F.pmod(F.xxhash64(i), F.lit(100))
    outcome = F.when(draw < 30, "ok").when(draw < 70, "later").when(draw < 99, "never").otherwise("fatal")
    eof = F.pmod(i, F.lit(5000)) * 10 + F.pmod(F.xxhash64(i, F.lit(1)), F.lit(25))
    key = F.when(i % 50 == 0, F.concat(F.lit("k"), (i % 7).cast("string"))).otherwise("hot")
    rows = spark.range(n).select(key.alias("key"), F.timestamp_millis(i * 30_000).alias("at"), i.alias("attempt_id"), eof.alias("eof"), outcome.alias("outcome"), F.floor(i / 500).alias("fingerprint"))
    return rows.repartition(8, F.xxhash64("attempt_id"))


def told(df):
    return sorted(tuple(r) for r in df.collect())


def plain(df, caps):
    at_ms = F.floor(F.unix_micros("at") / 1000)
    slim = df.select("key", at_ms.alias("at_ms"), "attempt_id", "eof", "outcome", F.col("fingerprint").cast("string").alias("fingerprint"))
    return ledger.plain_fold(slim, caps)


def test_busy_key_equals_the_plain_fold(spark):
    rows = hot(spark, 30_000)
    for caps in ((8 << 20, 24 * 3600 * 1000, 512), (400, 3_600_000, 5)):
        assert told(ledger.ledger_fold(rows, caps, run=300)) == told(plain(rows, caps))


def test_most_attempts_of_a_run_are_not_replayed(spark):
    rng = __import__("random").Random(1)
    held = [(k * 1000, k * 10 + 5, rng.choice(["ok", "later", "never"])) for k in range(4000)]
    first, claim, *_ = ledger.summary(held, "f", (8 << 20, 24 * 3600 * 1000, 512))
    assert len(first) < 20 and claim == 1
    later = [(k * 1000, k * 10 + 5, "later") for k in range(4000)]
    first, claim, *_ = ledger.summary(later, "f", (8 << 20, 24 * 3600 * 1000, 512))
    assert len(first) < 600 and claim == 1  # the caps forget what was held before


def test_a_claim_that_fails_is_folded_plainly(spark, monkeypatch):
    rows = hot(spark, 3000)
    caps = (400, 3_600_000, 5)
    want = told(plain(rows, caps))
    real = ledger.summary

    def wrong(attempts, fingerprint, caps_):
        first, claim, sent, *rest = real(attempts, fingerprint, caps_)
        return first, claim, sent + 1 if claim == 1 else sent, *rest

    monkeypatch.setattr(ledger, "summary", wrong)
    assert told(ledger.ledger_fold(rows, caps, run=100)) == want
